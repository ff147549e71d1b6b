"""SimHash near-dedup (9): bit-sliced comparison of fingerprints.

1. Every document gets a fingerprint; equal fingerprints become one node.
2. Nodes are dealt to buckets so that every pair to be linked meets in one of them.
   Exact way: the bits are cut into more blocks than the radius; a linked pair has
   at least ``blocks - radius`` blocks in common, and each choice of that many
   blocks is a key.  More nodes take more blocks, which keeps buckets small.
3. Inside a bucket the bits are stored vertically, one plane per bit with a lane per
   node.  Planes are compared for 64 lanes at a time and differences are added by
   carry-save counters; words of lanes are abandoned once all of them exceed the
   radius.  Small buckets compare lanes at every distance of a whole batch of
   buckets at once; in large ones a node is compared with those not yet reached,
   so a dense group costs few passes and never lists its pairs.
4. Each bucket returns a star per connected set; stars meet in connected components
   by alternating large and small stars, each round written to the shared folder.

Memory of a bucket is one fingerprint per distinct node in it.

Defined cases: texts without words (null, empty) have fingerprint zero and are
linked like others; fewer words than a shingle make one shingle; repeated rows share
their node; null ids count only where a component has no other; further columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.common import identity, mixed, partitions, table, texts

SEED = 42
BITS = 64
#: Buckets up to this size are compared lane by lane, larger ones node by node.
SMALL = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A fingerprint of more than one in so many documents is joined by broadcast.
HOT = 10_000


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> bytes:
    """A bit is set if more than half of the hashes have it."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(h)).tobytes()


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, _text, fp of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(fps, pa.binary())], ["doc_id", "_text", "fp"])

    return docs.select("doc_id", identity().alias("_text"), "text").mapInArrow(run, f"doc_id {kind}, _text bigint, fp binary")


def blocks_for(nodes: int, radius: int, bits: int) -> int:
    """Blocks such that evenly spread buckets hold few nodes: the key has radius blocks less than all bits."""
    n = radius + 1
    while n < radius + 4 and nodes >> (bits * (n - radius) // n) > 64:
        n += 1
    return max(n, radius + 2) if bits >= 2 * (radius + 2) else n


def block_keys(nodes: DataFrame, radius: int, bits: int, blocks: int) -> DataFrame:
    """(key, fp) for every choice of ``blocks - radius`` blocks."""
    edges = np.linspace(0, bits, blocks + 1).astype(int)
    choices = list(itertools.combinations(range(blocks), blocks - radius))

    def run(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(len(batch), -1)
            parts = np.unpackbits(fps, axis=1)
            values = [np.packbits(parts[:, a:b], axis=1).astype(np.uint64) @ (np.uint64(256) ** np.arange(-(-(b - a) // 8), dtype=np.uint64)) for a, b in itertools.pairwise(edges)]
            for c, chosen in enumerate(choices):
                key = np.full(len(batch), c, np.uint64)
                for i in chosen:
                    key = mixed(key ^ values[i], i + 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp")], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key bigint, fp binary")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints [n, bytes]: one row of lane words per bit."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, fps.shape[1] * 8), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps, axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above |= equal & counters[i]
            equal = equal & ~counters[i]
    return above


def within(difference, bits: int, radius: int, alive: np.ndarray) -> np.ndarray:
    """Lanes of ``alive`` whose differences add up to the radius at most.

    ``difference(plane, words)`` gives the differing lanes of a plane at some words.
    """
    result = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length() + 1)]
    live = alive[at]
    over = np.zeros(len(at), np.uint64)
    for plane in range(0, bits, 2):
        x, y = difference(plane, at), difference(plane + 1, at)
        ones = counters[0]
        half = ones ^ x
        carry = (ones & x) | (half & y)  # carry-save adder of the counter and two planes
        counters[0] = half ^ y
        for i in range(1, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if plane % 8 == 6:
            live &= ~(exceeds(counters, radius) | over)
            keep = live != 0
            if not keep.all():  # words of lanes that all exceed the radius
                at, live, over = at[keep], live[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(at):
                    return result
    result[at] = live & ~(exceeds(counters, radius) | over)
    return result


def lanes_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def pack_lanes(mask: np.ndarray, words: int) -> np.ndarray:
    full = np.zeros(words * 64, np.uint8)
    full[:len(mask)] = mask
    return np.packbits(full, bitorder="little").view(np.uint64)


def small_pairs(keys: np.ndarray, fps: np.ndarray, radius: int):
    """Linked pairs (i, j) inside equal keys, lane i against lane i + distance."""
    planes = planes_of(fps)
    words = planes.shape[1]
    padded = np.concatenate([planes, np.zeros((len(planes), SMALL // 64 + 2), np.uint64)], axis=1)
    for d in range(1, SMALL):
        alike = keys[:-d] == keys[d:] if d < len(keys) else np.zeros(0, bool)
        if not alike.any():
            return
        q, r = divmod(d, 64)

        def difference(plane, at, q=q, r=r):
            row = padded[plane]
            moved = row[at + q] if not r else (row[at + q] >> np.uint64(r)) | (row[at + q + 1] << np.uint64(64 - r))
            return row[at] ^ moved

        for i in lanes_of(within(difference, len(planes), radius, pack_lanes(alike, words))).tolist():
            yield i, i + d


def large_pairs(fps: np.ndarray, radius: int):
    """A spanning forest of the links: each node against those not yet reached."""
    planes, bits = planes_of(fps), np.unpackbits(fps, axis=1)
    waiting = pack_lanes(np.ones(len(fps), bool), planes.shape[1])
    for root in range(len(fps)):
        word, bit = divmod(root, 64)
        if not waiting[word] >> np.uint64(bit) & np.uint64(1):
            continue
        waiting[word] &= ~(np.uint64(1) << np.uint64(bit))
        queue = deque([root])
        while queue and waiting.any():
            i = queue.popleft()
            mine = bits[i]
            found = within(lambda plane, at: planes[plane][at] ^ ONES if mine[plane] else planes[plane][at], len(planes), radius, waiting)  # noqa: B023
            for j in lanes_of(found).tolist():
                waiting[j >> 6] &= ~(np.uint64(1) << np.uint64(j & 63))
                queue.append(j)
                yield i, j


def stars(pairs, fps: list[bytes]):
    """(node, smallest node of its connected set) for every other node of the set."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            if fps[a] > fps[b]:
                a, b = b, a
            parent[b] = a
    return [(fps[x], fps[root(x)]) for x in list(parent) if root(x) != x]


def links(buckets: DataFrame, radius: int) -> DataFrame:
    """Stars (hi, lo) over all buckets (key, fp), each node once per bucket."""

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["hi", "lo"])

    def bits_of(fps):
        return np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)

    def compared(key, fps):
        """Links of complete buckets, sorted by key."""
        cut = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((start, [len(key)])))
        of_row = np.repeat(size, size)
        small = np.flatnonzero((of_row > 1) & (of_row <= SMALL))
        if len(small):
            mine = [fps[i] for i in small]
            yield emit(stars(small_pairs(key[small], bits_of(mine), radius), mine))
        for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
            mine = fps[s:s + n]
            yield emit(stars(large_pairs(bits_of(mine), radius), mine))

    def run(batches):
        keys, fps = [], []
        for batch in batches:
            if not len(batch):
                continue
            keys.append(batch.column("key").to_numpy())
            fps.extend(batch.column("fp").to_pylist())
            if keys[-1][-1] == keys[0][0]:
                continue  # one bucket so far
            key = np.concatenate(keys)
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield from compared(key[:whole], fps[:whole])
                keys, fps = [key[whole:]], fps[whole:]
        if keys:
            yield from compared(np.concatenate(keys), fps)

    dealt = buckets.repartition(partitions(buckets), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "hi binary, lo binary")


def components(edges: DataFrame) -> DataFrame:
    """(hi, lo): every linked node and the smallest node of its component."""
    edges = store(edges.distinct(), "stars")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = store(large, "stars")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = store(moved.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "stars")


def classes(marked: DataFrame, stars: DataFrame) -> DataFrame:
    """``marked`` (doc_id, _text, fp) with the root of its component and component_id, its smallest doc_id.

    Fingerprints that hold more than one in ``HOT`` of the documents (say, all empty texts)
    are broadcast, being ``HOT`` at most; the others meet their documents by shuffle.
    """
    roots = components(stars).select(F.col("hi").alias("fp"), F.col("lo").alias("root"))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    nodes = store(nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "nodes")
    # Only roots with links need a second look; the others are their own component.
    linked = nodes.join(roots.select("root").distinct(), "root", "left_semi")
    best = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(best, "root").select("fp", F.col("component_id").alias("moved"), F.lit(True).alias("known"))
    final = nodes.select("fp", "first", "n", "root").join(moved, "fp", "left")
    final = store(final.select("fp", "n", "root", F.when(F.col("known"), F.col("moved")).otherwise(F.col("first")).alias("component_id")), "components")
    least = (nodes.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = final.where(F.col("n") > least).select("fp", "root", "component_id", F.lit(True).alias("hot"))
    rows = marked.select("doc_id", "_text", "fp").join(F.broadcast(hot), "fp", "left")
    rest = rows.where("hot IS NULL").select("doc_id", "_text", "fp").join(final.where(F.col("n") <= least).drop("n"), "fp")
    return rows.where("hot").drop("hot").unionByName(rest)


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, _text, fp, root, component_id: every pair within the radius is linked."""
    marked = store(fingerprints(docs, words), "fingerprints")
    nodes = store(marked.select("fp").distinct(), "distinct")
    blocks = blocks_for(nodes.count(), radius, BITS)
    return classes(marked, links(block_keys(nodes, radius, BITS, blocks), radius))


def keep_one(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """One document of each component, the one of the smallest doc_id; repeated rows leave one.

    Of different texts under that doc_id, the one of the smallest text hash stays; a null
    id stays only where its component has no other.  The rows that stay and their repeats
    meet on one key, so texts are shuffled once at most.
    """
    columns, key = docs.columns, ["_keep_id", "_keep_text"]
    found = near_duplicates(docs, words, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("first"))
    stay = first.select(F.xxhash64("first.doc_id").alias(key[0]), F.col("first._text").alias(key[1]))
    named = docs.select("*", F.xxhash64("doc_id").alias(key[0]), identity().alias(key[1]))
    return named.join(stay, key, "left_semi").dropDuplicates(key).select(*columns)


def op9_simhash(spark, folder):
    out = near_duplicates(table(spark, folder, "documents"), words=4, radius=4)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
