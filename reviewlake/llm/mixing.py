"""Mixing sources to target weights (1): pivotal dependent rounding of copy numbers.

A source's target and its size give each of its documents the same expected number
of copies; the fraction of that number is a copy probability.  Two partners with
fractional probabilities are paired and mass (words) moves from one to the other, in
a random direction that keeps both expectations, until one probability is 0 or 1;
the other goes on to its next pair.  The expected words of a pair never change, so a
source's words differ from its target only by its very last residual.

In a leaf, where all probabilities are equal, a document's partner is the pool of all
smaller ones, which share what they win or lose: the largest documents are settled
first and the residual is a small one.  Above the leaves residuals meet in pairs.

The pairing is a reduction tree: documents are dealt to leaves of about ``leaf``
rows by a hash of their id, each leaf leaves at most one fractional document, and
the residuals of ``leaf`` leaves meet in a node of the next level, up to one per
source.  A source that holds most rows has more leaves, not larger ones.

All draws are hashes of ids: reruns agree, whatever the partitions.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null source
is a source, last in order; an empty table has an empty mix; repeated rows are
documents of their own; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.common import same, table, uniform, word_count

#: Rows of a leaf, and children of a node of the tree.
LEAF = 8192
SEED = 20

NODE = "doc_id {kind}, source string, node long, size long, floor long, p double, open boolean, tie long"


def targets(sizes: DataFrame, weight: Column, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (one row each: source, source_size, ``weight`` over its rank ``_rank`` from 0).

    ``share`` of all sizes is dealt by weight; a target stops at ``most`` times its
    source's size and the excess is dealt anew, until none is above.  That is one
    level: target = least(cap, level x weight).  In order of cap / weight, the level
    that the sources not yet stopped would share rises while sources stop and falls
    after that, so it is the largest of these values.

    The windows run over one row per source, after the sizes have been added up.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_w", weight.cast("double"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_total", total)
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    ranked = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return ranked.select("source", "source_size", "source_docs", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def settled(node: pa.Table, order: np.ndarray, p: list[float]) -> pa.Table:
    node = node.take(pa.array(order)).drop_columns(["draw"])
    node = node.set_column(node.column_names.index("p"), "p", pa.array(p, pa.float64()))
    return node.set_column(node.column_names.index("open"), "open", pa.array([0.0 < x < 1.0 for x in p], pa.bool_()))


def settle_pool(node: pa.Table) -> pa.Table:
    """A leaf: each document, largest first, against the pool of the later ones, which have one probability."""
    p, size = node["p"].to_numpy(), node["size"].to_numpy()
    order = np.lexsort((node["tie"].to_numpy(), -size, p == 0))  # whole numbers of copies go last
    p, size, draw = p[order].tolist(), size[order], node["draw"].to_numpy()[order].tolist()
    n = sum(x > 0 for x in p)
    rest = np.concatenate((np.cumsum(size[:n][::-1])[::-1], [0])).tolist()
    size, q = size.tolist(), p[0] if n else 0.0
    for i in range(n):
        a, b, pool = q * size[i], q * rest[i + 1], rest[i + 1]
        if not pool:
            p[i] = q
            break
        up, down = min(size[i] - a, b), min(a, pool - b)  # words that the document can win, and lose
        if draw[i] * (up + down) < down:
            whole, drained, a, b, end = up == size[i] - a, up == b, a + up, b - up, 0.0
            p[i] = 1.0 if whole else a / size[i]
        else:
            whole, drained, a, b, end = down == a, down == pool - b, a - down, b + down, 1.0
            p[i] = 0.0 if whole else a / size[i]
        if drained:
            p[i + 1:n] = [end] * (n - i - 1)
            break
        q = b / pool
    return settled(node, order, p)


def settle(node: pa.Table) -> pa.Table:
    """A node above the leaves: pair by pair, largest first; at most one stays fractional."""
    p, size = node["p"].to_numpy(), node["size"].to_numpy()
    order = np.lexsort((p, node["tie"].to_numpy(), -size))
    p, size, draw = p[order].tolist(), size[order].tolist(), node["draw"].to_numpy()[order].tolist()
    held = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held] * size[held], p[i] * size[i]
        up, down = min(size[held] - a, b), min(a, size[i] - b)  # words that the held one can win, and lose
        win = draw[i] * (up + down) < down
        full, empty = up == size[held] - a, down == a
        other_empty, other_full = up == b, down == size[i] - b
        if win:
            p[held] = 1.0 if full else (a + up) / size[held]
            p[i] = 0.0 if other_empty else (b - up) / size[i]
        else:
            p[held] = 0.0 if empty else (a - down) / size[held]
            p[i] = 1.0 if other_full else (b + down) / size[i]
        held = held if 0.0 < p[held] < 1.0 else i if 0.0 < p[i] < 1.0 else -1
    return settled(node, order, p)


def rounded(rows: DataFrame, leaves: int, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """Copies of each row of (doc_id, source, node, size, floor, p, open, tie): the tree of pairings.

    ``p`` is one value per source.

    ``leaves`` is the largest number of leaves of a source; it only sets the number
    of levels.
    """
    shape = NODE.format(kind=rows.schema["doc_id"].dataType.simpleString())
    done, level = [], 0
    while True:
        drawn = rows.withColumn("draw", uniform("tie", F.lit(level), seed=seed))
        rows = store(drawn.groupBy("source", "node").applyInArrow(settle if level else settle_pool, shape), "mix")
        if leaves <= 1:
            break
        done.append(rows.where(~F.col("open")))
        rows = rows.where("open").withColumn("node", F.floor(F.col("node") / leaf))
        leaves, level = -(-leaves // leaf), level + 1
    for part in done:
        rows = rows.unionByName(part)
    last = uniform("tie", F.lit(-1), seed=seed) < F.col("p")
    return rows.select("doc_id", "source", "tie", "size", (F.col("floor") + last.cast("long")).alias("copies"))


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.5, most: float = 2.0, leaf: int = LEAF,
        seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, tie (hash of id and text), source, size, source_size, target, copies.

    ``weight`` is an expression over ``source`` and its rank ``_rank``; by default
    3, 1, 2 in turn.
    """
    if weight is None:
        weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("_rank") % 3 + 1).cast("int"))
    sized = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    aims = store(targets(sizes, weight, share, most), "targets")
    leaves = F.ceil(F.col("source_docs") / leaf)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = same(sized, aims, ["source"]).select(
        "doc_id", "source", F.pmod(F.xxhash64("tie", F.lit(seed)), leaves).alias("node"), "size",
        F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("long").alias("floor"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"), F.lit(True).alias("open"), "tie")
    most_leaves = aims.agg(F.max(leaves)).first()[0] or 0
    taken = rounded(rows, most_leaves, leaf, seed)
    return same(taken, aims.select("source", "source_size", "target"), ["source"]).select(
        "doc_id", "tie", "source", "size", "source_size", "target", "copies")


def op1_mix(spark, folder):
    out = mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
