"""Substring dedup (10): seed and extend over winnowed anchors.

1. Seeds.  Of the word ``gram``s inside each window of ``length`` words the one with
   the smallest hash (the last of equals) is its anchor, so equal windows have equal
   anchors at equal offsets.  The repeat filter (``bloom``) learns which anchors
   occur more than once; nothing else is sent.
2. Extension.  The consecutive windows around a repeated anchor, as far as they
   extend to both sides, form one stretch.  Stretches meet by anchor and content;
   map-side minima leave the earliest of each, so a passage that fills a third of
   the documents leaves a task once.
3. The windows of the earliest stretches meet by anchor and window hash; the
   earliest of each is an original.  All other windows around repeated anchors
   repeat an earlier one, and their union makes the maximal repeats.
4. The originals' positions go back to their documents, which drop the rest.

A window is identified by the 64-bit hashes of its anchor and of all its words.

Defined cases: null and empty texts have no words; documents shorter than ``length``
keep all words; order is by doc_id (null first), then by the hash of the text for
documents that share an id, then by start; repeated rows of one id and text are the
same document and do not repeat themselves; further columns are ignored unless named
in ``carry``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.bloom import repeat_filter
from reviewlake.llm.common import identity, mixed, same, table, texts

LENGTH, GRAM = 20, 10
FACTOR = 0x5851F42D4C957F2D


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, by doubling."""
    run, width, whole, done = h, 1, None, 0
    while True:
        shift = np.uint64(pow(FACTOR, width, 1 << 64))
        if size & 1:
            if whole is None:
                whole = run
            else:
                n = len(h) - done - width + 1
                whole = whole[:n] * shift + run[done:done + n]
            done += width
        size >>= 1
        if not size:
            return whole
        run = run[:len(run) - width] * shift + run[width:]
        width *= 2


class Stretches:
    """Anchors and stretches of one document: windows first[i] .. first[i + 1] - 1 share anchor[i]."""

    def __init__(self, words: list[bytes], length: int, gram: int):
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        grams = mixed(rolled(h, gram), 1)
        self.windows = rolled(h, length)
        wide = length - gram + 1
        last = np.lib.stride_tricks.sliding_window_view(grams, wide)[:, ::-1].argmin(axis=1)
        at = np.arange(len(self.windows)) + wide - 1 - last
        self.first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        self.after = np.concatenate((self.first[1:], [len(at)]))
        self.anchor = grams[at[self.first]]

    def content(self) -> np.ndarray:
        """Hash of each stretch: its first and last window and their distance."""
        n = (self.after - self.first).astype(np.uint64)
        return mixed(self.windows[self.first] * np.uint64(FACTOR) + self.windows[self.after - 1] + n, 2)


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: carried columns, n_words, repeats (word spans, end exclusive), kept text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def split(batch):
        return ((text or b"").split() for text in texts(batch, "text"))  # one document's words at a time

    def anchors(batch):
        return (Stretches(w, length, gram).anchor if len(w) >= length else np.zeros(0, np.uint64) for w in split(batch))

    marked = docs.select("doc_id", identity().alias("_text"), "text")
    attach, probes = repeat_filter(marked, anchors)

    def seeds(batches):
        for batch in batches:
            rows, anchor, content, start, windows, sizes = [], [], [], [], [], []
            for row, (w, probe) in enumerate(zip(split(batch), probes(batch), strict=True)):
                if len(w) < length:
                    continue
                s = Stretches(w, length, gram)
                hit = np.flatnonzero(probe(s.anchor))
                rows.append(np.full(len(hit), row))
                anchor.append(s.anchor[hit])
                content.append(s.content()[hit])
                start.append(s.first[hit])
                sizes.append((s.after - s.first)[hit])
                windows.append(s.windows[np.repeat(probe_mask(s, hit), s.after - s.first)])
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)),
                                             pa.array(np.concatenate(windows).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(anchor).view(np.int64)), pa.array(np.concatenate(content).view(np.int64)),
                 batch.column("doc_id").take(at), batch.column("_text").take(at), pa.array(np.concatenate(start).astype(np.int32)), lists],
                ["anchor", "content", "doc_id", "_text", "start", "windows"])

    stretches = attach(marked).mapInArrow(seeds, f"anchor bigint, content bigint, doc_id {kind}, _text bigint, start int, windows array<bigint>")
    earliest = stretches.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "_text", "start", "windows")).alias("e"))
    each = earliest.select("anchor", "e.doc_id", "e._text", "e.start", F.posexplode("e.windows").alias("i", "window"))
    originals = each.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "_text", (F.col("start") + F.col("i")).alias("start"))).alias("o"))
    own = originals.select("o.doc_id", "o._text", "o.start").groupBy("doc_id", "_text").agg(F.collect_list("start").alias("_own"))
    columns = list(dict.fromkeys([*carry, "doc_id"]))
    source = same(attach(docs.select(*columns, "text", identity().alias("_text"))), own, ["doc_id", "_text"]).drop("_text")

    def cut(batches):
        for batch in batches:
            total, spans, kept = [], [], []
            for w, own, probe in zip(split(batch), batch.column("_own"), probes(batch), strict=True):
                covered = np.zeros(len(w) + 1, np.int64)
                if len(w) >= length:
                    s = Stretches(w, length, gram)
                    again = np.repeat(probe(s.anchor), s.after - s.first)
                    if own.is_valid:
                        again[own.values.to_numpy()] = False
                    at = np.flatnonzero(again)
                    covered[at] += 1
                    np.subtract.at(covered, at + length, 1)
                mask = np.cumsum(covered)[:-1] > 0
                total.append(len(w))
                spans.append([{"start": a, "end": b} for a, b in spans_of(mask)])
                kept.append(b" ".join([x for x, gone in zip(w, mask.tolist(), strict=True) if not gone] if mask.any() else w))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(total, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                [*columns, "n_words", "repeats", "kept"])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    out = source.mapInArrow(cut, f"{shape}, n_words bigint, repeats array<struct<start:bigint,end:bigint>>, kept string")
    return out.select(*carry, "n_words", "repeats", "kept")


def probe_mask(s: Stretches, hit: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(s.first), dtype=bool)
    mask[hit] = True
    return mask


def op10_substrings(spark, folder):
    out = drop_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
