"""Repeat filters: which 64-bit hashes occur more than once, within bounded memory.

Each task keeps the distinct hashes it has seen apart by slice of the hash space
and sends them as packed arrays, those seen once and those seen again; a hash that
fills a third of the input leaves a task as 8 bytes.  The task of a slice reads
the arrays of all others through two Bloom filters: a hash that the first filter
("seen once") already holds goes to the second ("seen twice").  Only the second
is returned, sized by what it holds.  It may report single hashes as repeated,
never the reverse, so users confirm what it reports by an exact count.

The second filters are broadcast if their measured size allows it.  Beyond that the
documents' hashes go to the filter of their slice instead, and those that it reports
come back to their documents; the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.common import partitions, same

PROBES = 4
#: Bits per hash of the first and of the second filter.
FIRST_BITS, SECOND_BITS = 12, 16
#: Hashes that a task gathers before it sends them.
FLUSH = 1 << 20
#: Broadcast limit of all second filters together.
LIMIT_BYTES = 64 << 20

PACKED = "slice int, once binary, again binary"


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    step = (h >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)])


class Bloom:
    """One bit array; kept as bytes while it is filled, packed to be sent."""

    def __init__(self, expected: int, per_hash: int):
        self.cells = np.zeros(max(64, expected * per_hash), dtype=bool)

    def add(self, h):
        self.cells[places(h, len(self.cells))] = True

    def has(self, h):
        return self.cells[places(h, len(self.cells))].all(axis=0)


def pack(batches: Iterable[Iterable[np.ndarray]], slices: int) -> Iterator[pa.RecordBatch]:
    """Hash arrays of a task to rows of PACKED."""

    def sent(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(slice_of(h, slices), np.arange(slices + 1))  # slices follow the order of hashes
        rows = [(i, h[a:b], n[a:b] > 1) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_pydict({
            "slice": pa.array([i for i, _, _ in rows], pa.int32()),
            "once": pa.array([x[~twice].tobytes() for _, x, twice in rows], pa.binary()),
            "again": pa.array([x[twice].tobytes() for _, x, twice in rows], pa.binary())})

    parts, waiting = [], 0
    for arrays in batches:
        for a in arrays:
            parts.append(a)
            waiting += len(a)
            if waiting >= FLUSH:
                yield sent(parts)
                parts, waiting = [], 0
    if waiting:
        yield sent(parts)


def second(group: pd.DataFrame) -> pd.DataFrame:
    """Both filters of a slice; the second is returned."""
    arrays = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(group["once"], group["again"], strict=True)]
    first, repeats = Bloom(sum(len(a) + len(b) for a, b in arrays), FIRST_BITS), []
    for once, again in arrays:
        repeats += [once[first.has(once)], again]
        first.add(once)
        first.add(again)
    h = np.unique(np.concatenate(repeats))
    twice = Bloom(len(h), SECOND_BITS)
    if len(h):
        twice.add(h)
    return pd.DataFrame({"slice": group["slice"].iloc[:1], "size": [len(twice.cells)], "cells": [np.packbits(twice.cells).tobytes()]})


def repeat_filter(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]]):
    """Which hashes of a document occur again, here or in another document.

    ``docs`` has doc_id, _text and text; ``hashes(batch)`` gives one array per row.
    Returns ``attach(docs)``, the documents as the next step must read them, and
    ``probes(batch)``, for each of their rows a function from hashes to booleans.
    """
    slices = partitions(docs)
    docs = docs.select("doc_id", "_text", "text")
    packed = docs.mapInArrow(lambda batches: pack(map(hashes, batches), slices), PACKED)
    filters = store(packed.groupBy("slice").applyInPandas(second, "slice int, size long, cells binary"), "filters")
    total = filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if total <= LIMIT_BYTES:
        held = docs.sparkSession.sparkContext.broadcast({r.slice: (r.size, bytes(r.cells)) for r in filters.toLocalIterator()})
        probe = Probe(held, slices)
        return (lambda df: df), (lambda batch: [probe] * len(batch))

    def parts(batches):
        for batch in batches:
            rows, where, mine = [], [], []
            for row, h in enumerate(hashes(batch)):
                h = np.unique(h)
                cut = np.searchsorted(slice_of(h, slices), np.arange(slices + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    rows.append(row)
                    where.append(i)
                    mine.append(h[cut[i]:cut[i + 1]].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("_text").take(at), pa.array(where, pa.int32()), pa.array(mine, pa.binary())],
                                             ["doc_id", "_text", "slice", "mine"])

    def reported(left: pa.Table, right: pa.Table) -> pa.Table:
        twice = Bloom(0, 1)
        if right.num_rows:
            twice.cells = np.unpackbits(np.frombuffer(right["cells"][0].as_py(), np.uint8))[:right["size"][0].as_py()].astype(bool)
        found = [h[twice.has(h)].tobytes() for h in (np.frombuffer(x, np.uint64) for x in left["mine"].to_pylist())]
        some = pa.array([bool(x) for x in found], pa.bool_())
        return left.select(["doc_id", "_text"]).append_column("hits", pa.array(found, pa.binary())).filter(some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.mapInArrow(parts, f"doc_id {kind}, _text bigint, slice int, mine binary")
    hits = sent.groupBy("slice").cogroup(filters.groupBy("slice")).applyInArrow(reported, f"doc_id {kind}, _text bigint, hits binary")
    back = store(hits.groupBy("doc_id", "_text").agg(F.collect_set("hits").alias("_hits")), "repeated")

    def probes(batch):
        every = [np.frombuffer(b"".join(x or ()), np.uint64) for x in batch.column("_hits").to_pylist()]
        return [lambda h, x=x: np.isin(h, x) for x in every]

    return (lambda df: same(df, back, ["doc_id", "_text"])), probes


class Probe:
    def __init__(self, held, slices):
        self.held, self.slices, self.flat = held, slices, None

    def __getstate__(self):
        return {"held": self.held, "slices": self.slices, "flat": None}

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.flat is None:  # once per task: all slices end to end
            data = self.held.value
            sizes = np.array([data[i][0] if i in data else 0 for i in range(self.slices)], dtype=np.uint64)
            parts = [np.frombuffer(data[i][1], np.uint8) for i in range(self.slices) if i in data]
            starts = np.zeros(self.slices, dtype=np.uint64)
            at = 0
            for i in range(self.slices):
                starts[i] = at
                at += 8 * len(data[i][1]) if i in data else 0
            self.flat = sizes, starts, np.concatenate(parts) if parts else np.zeros(1, np.uint8)
        sizes, starts, cells = self.flat
        s = slice_of(h, self.slices)
        size = sizes[s]
        found = size > 0
        size = np.maximum(size, np.uint64(1))
        step = (h >> np.uint64(17)) | np.uint64(1)
        for i in range(PROBES):
            at = starts[s] + (h + np.uint64(i) * step) % size
            found &= (cells[np.minimum(at >> np.uint64(3), np.uint64(len(cells) - 1))] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return found
