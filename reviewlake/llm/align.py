"""Cross-tokenizer alignment (12): hash-set intersection of cumulative token ends.

Each text is encoded by two tokenizers.  The cumulative byte ends of both token lists
become dictionaries from end to index; the intersection of their key sets, sorted, holds
the offsets where tokens of both lists end.  Each common key slices both id lists into a
group; links are expanded inside the slice, one for each pair of tokens whose byte
ranges overlap.

Counts over the corpus:

* Encoding runs once.  A document keeps its distinct linked id pairs with their number
  of occurrences, as two packed arrays in a stored table.
* A pair's count is the number of documents that hold it: one aggregate with partial sums
  in every task, so a pair that every document holds leaves a task as one row.
* A pair is best if its count is the highest of its first id: a window over at most as
  many rows as the second vocabulary has ids.
* Documents look their pairs up again.  The most frequent pairs, ``HELD`` at most, are
  broadcast (the threshold is read from a histogram of 64 powers of two, so the size is
  bounded whatever the corpus) and hold nearly all occurrences, every hot one included;
  the other pairs are joined by key, where no key has more rows than the threshold.

The byte-level tokenizer runs on the ranks and the vocabulary of its file in the faster
of two libraries, after a proof on the driver that both libraries agree: if each entry
of the vocabulary, encoded alone by the merge rules, gives itself, then merging by rank
and merging by rule are the same process.  Otherwise, and for texts with very long white
space (which the faster library refuses), the slower library is used.

Defined cases: null and empty texts, and texts that either tokenizer does not render as
space and text, have no tokens: all numbers zero, groups and digest empty.  Every row is
a document of its own, so a repeated row counts again.  Special strings inside texts
are plain text.  Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.common import digest, table

#: Where the vocabulary files lie on the driver.
FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs that are broadcast at most (17 bytes each).
HELD = 2_000_000
#: Documents that are encoded at once.
CHUNK = 128
#: The faster library refuses white space far longer than this.
LONG_SPACE = re.compile(r"\s{2000}")
#: How the byte-level file splits texts before merging; the same in both libraries.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_vocabulary(text: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary file; entries in other letters are their own UTF-8."""
    letters, file = byte_letters(), json.loads(text)
    entries = {i: x for x, i in file["model"]["vocab"].items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
    return {i: bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for i, x in entries.items()}


def merged(word: bytes, rules: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Merge rules applied to one word, the earliest rule first, from the left."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rule, at = min((rules.get(p, len(rules)), i) for i, p in enumerate(itertools.pairwise(parts)))
        if rule == len(rules):
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def ranks_agree(text: str) -> bool:
    """Whether merging by rank gives the same tokens as the merge rules of this file."""
    file = json.loads(text)
    model, split = file["model"], file["pre_tokenizer"]
    plain = (model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                                       "byte_fallback", "ignore_merges"))
             and split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and file["normalizer"] is None)
    if not plain:
        return False
    letters = byte_letters()
    rules = {}
    for n, rule in enumerate(model["merges"]):
        a, b = rule.split(" ") if isinstance(rule, str) else rule
        rules[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = n
    vocabulary = {bytes(letters[c] for c in x): i for x, i in model["vocab"].items() if all(c in letters for c in x)}
    ordered = [vocabulary.get(a + b, -1) for (a, b) in rules]
    return len(vocabulary) == len(model["vocab"]) and ordered == sorted(ordered) and ordered[0] >= 256 and all(merged(x, rules) == [x] for x in vocabulary)


def end_to_end(table: pa.BinaryArray, at: np.ndarray) -> bytes:
    """Entries of a table, joined: a take lays them one after the other in its buffer."""
    if not len(at):
        return b""
    taken = table.take(pa.array(at))
    return taken.buffers()[2].to_pybytes()[:int.from_bytes(taken.buffers()[1][4 * len(at):4 * len(at) + 4].to_pybytes(), "little")]


class Pair:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, byte_file: str, piece_file: bytes, fast: bool):
        import sentencepiece

        self.byte_file = byte_file
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        bytes_a = byte_vocabulary(byte_file)
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        self.bytes_b = [self.piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.signed = pa.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(self.ids)], pa.binary())
        self.joinable = pa.array(self.bytes_b, pa.binary())
        self.ranked = None
        if fast:
            import tiktoken

            vocabulary = json.loads(byte_file)["model"]["vocab"].values()
            self.ranked = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={self.bytes_a[i]: i for i in vocabulary}, special_tokens={})

    @cached_property
    def ruled(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.byte_file)
        out.encode_special_tokens = True
        return out

    def piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers for texts that are not empty."""
        both = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            if self.ranked is not None and not LONG_SPACE.search(text):
                a = self.ranked.encode_to_numpy(" " + text, disallowed_special=())
                same = self.size_a[a].sum() == len(whole)  # these tokens are slices of the text one after the other
            else:
                a = self.ruled.encode(" " + text, add_special_tokens=False).ids
                same = b"".join(map(self.bytes_a.__getitem__, a)) == whole
            b = np.array(b, np.int64)
            both.append((np.asarray(a, np.int64), b) if same and end_to_end(self.joinable, b) == whole else NONE)
        return both


NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)
_PAIRS: dict[str, Pair] = {}


def pair_of(held) -> Pair:
    """The tokenizers of a broadcast, built once per worker process."""
    files = held.value
    key = files["key"]
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(files["a"], files["b"], files["fast"])
    return _PAIRS[key]


def load(spark, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B):
    """Broadcast of both vocabulary files (a few MB, fixed): executors need no path of their own."""
    with open(os.path.join(folder, file_a), encoding="utf-8") as f:
        a = f.read()
    with open(os.path.join(folder, file_b), "rb") as f:
        b = f.read()
    return spark.sparkContext.broadcast({"key": digest(a.encode() + b), "a": a, "b": b, "fast": ranks_agree(a)})


def slices(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups, as indices into both token lists."""
    after_a = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True))
    after_b = dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    common = list(filter(after_b.__contains__, after_a))  # ends ascend, and so do the keys in their order of insertion
    return np.array(list(map(after_a.__getitem__, common)), np.int64), np.array(list(map(after_b.__getitem__, common)), np.int64)


def crossed(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[int]:
    """Links of a group: a walk along the ends of both sides."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append(a[i] << SHIFT | b[j])
        if ends_a[i] <= ends_b[j]:
            i, j = i + 1, j + (ends_a[i] == ends_b[j])
        else:
            j += 1
    return out


@dataclass
class Aligned:
    """One document: ids and, for each group, where it ends in both lists; a number per link."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    links: np.ndarray

    def written(self, pair: Pair) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``: every id goes to its place with the sign that follows it."""
        if not len(self.a):
            return ""
        from_a, from_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        signed_a, signed_b = self.a.copy(), self.b.copy()
        signed_a[self.cut_a - 1] += pair.ids
        signed_b[self.cut_b - 1] += 2 * pair.ids
        out[np.arange(len(self.a)) + np.repeat(self.cut_b - from_b, from_a)] = signed_a
        out[np.arange(len(self.b)) + np.repeat(self.cut_a, from_b)] = signed_b
        return end_to_end(pair.signed, out)[:-1].decode()


def align(a: np.ndarray, b: np.ndarray, pair: Pair) -> Aligned:
    """Groups and links of one document; only groups of several tokens on both sides need a walk."""
    ends_a, ends_b = np.cumsum(pair.size_a[a]).tolist(), np.cumsum(pair.size_b[b]).tolist()
    cut_a, cut_b = slices(ends_a, ends_b)
    width_a, width_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    # A token alone in its group links all tokens on the other side.
    of_a, of_b = np.repeat(np.arange(len(cut_a)), width_a), np.repeat(np.arange(len(cut_b)), width_b)
    alone_a, alone_b = width_a[of_b] == 1, (width_b[of_a] == 1) & (width_a[of_a] > 1)
    plain = a[cut_a[of_b[alone_a]] - 1] << SHIFT | b[alone_a], a[alone_b] << SHIFT | b[cut_b[of_a[alone_b]] - 1]
    links = []
    for g in np.flatnonzero((width_a > 1) & (width_b > 1)).tolist():
        x, y = cut_a[g], cut_b[g]
        i, j = x - width_a[g], y - width_b[g]
        links += crossed(a[i:x].tolist(), b[j:y].tolist(), ends_a[i:x], ends_b[j:y])
    return Aligned(a, b, cut_a, cut_b, np.concatenate((*plain, np.array(links, np.int64))))


def packed(counts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in counts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)))


def encoded(docs: DataFrame, held, groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys and times of its id pairs.

    With ``groups`` also the groups themselves, as text.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups, "keys", "times"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield chunk(batch.slice(at, CHUNK))

    def chunk(batch):
        pair = pair_of(held)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        some = iter(pair.encode([x for x in texts if x]))
        rows, keys, times = [], [], []
        for text in texts:
            a, b = next(some) if text else NONE
            done = align(a, b, pair)
            listed = done.written(pair)
            rows.append((len(a), len(b), len(done.cut_a), len(done.links), digest(listed.encode()) if listed else "", listed))
            mine = np.unique(done.links, return_counts=True)
            keys.append(mine[0])
            times.append(mine[1])
        numbers = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in numbers[:4]], pa.array(numbers[4], pa.string()),
             *[pa.array(numbers[5], pa.string())] * groups, packed(keys), packed(times)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = (f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, " + "groups string, " * groups
             + "keys array<bigint>, times array<bigint>")
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def pair_counts(documents: DataFrame) -> DataFrame:
    """Documents that hold each id pair, and whether that is the most of its first id."""
    counts = documents.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("key", SHIFT)))  # as many rows as the second vocabulary at most
    return counts.withColumn("best", F.col("n") == top)


def threshold(pairs: DataFrame, most: int) -> int:
    """The least power of two so that ``most`` pairs at most have that count; 64 rows come to the driver."""
    sizes = {r.power: r.pairs for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()}
    least, total = 1 << 62, 0
    for power in range(max(sizes, default=0), -1, -1):
        total += sizes.get(power, 0)
        if total > most:
            break
        least = 1 << power
    return least


def with_counts(documents: DataFrame, pairs: DataFrame, most: int = HELD) -> DataFrame:
    """Add n_best and count_sum to encoded documents (stored, with a row number ``_row``)."""
    spark = documents.sparkSession
    least = threshold(pairs, most)
    hot = pairs.where(F.col("n") >= least).select("key", F.when(F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n")).orderBy("key").toArrow()
    held = spark.sparkContext.broadcast((hot["key"].to_numpy(), hot["n"].to_numpy()))  # at most ``most`` rows of 16 bytes

    def run(batches):
        keys, counts = held.value
        for batch in batches:
            lists = batch.column("keys")
            mine, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
            known = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
            n = np.where(known, counts[at] if len(keys) else 0, 0)
            sums, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row, np.abs(n) * times)
            np.add.at(best, row, (n > 0) * times)
            rest = np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(best), pa.array(sums), pa.ListArray.from_arrays(pa.array(rest), pa.array(mine[~known])),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~known]))], [*kept, "n_best", "count_sum", "keys", "times"])

    kept = [c for c in documents.columns if c not in ("keys", "times")]
    shape = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    looked = documents.mapInArrow(run, f"{shape}, n_best bigint, count_sum bigint, keys array<bigint>, times array<bigint>")
    if least <= 1:  # every pair was at hand
        return looked.drop("keys", "times", "_row")
    looked = store(looked, "looked")
    rare = looked.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("_row", "p.keys", "p.times")
    rare = rare.join(pairs.where(F.col("n") < least), F.col("keys") == F.col("key"))
    more = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    out = looked.drop("keys", "times").join(more, "_row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop(
        "_best", "_sum", "_row")


def align_corpus(docs: DataFrame, held, most: int = HELD) -> DataFrame:
    """All columns of the contract, for every document."""
    documents = store(encoded(docs, held).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    return with_counts(documents, store(pair_counts(documents), "pairs"), most)


def op12_align(spark, folder, vocabularies: str = FOLDER):
    out = align_corpus(table(spark, folder, "documents"), load(spark, vocabularies))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
