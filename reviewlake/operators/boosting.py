"""Boosted trees fitted by one barrier job, or by Spark where that takes several tasks.

Spark's boosting runs a job for every level of every tree, hundreds for a model.  Here
the tasks of one barrier stage hold their rows as bin numbers and grow all trees in step:
for each level a task sums gradients per node and bin, the tasks exchange the sums
(``allGather``) and every one derives the same splits.  Gradients are summed as
integers, so the trees do not depend on how the rows are dealt.  Of two children only
the smaller is summed; the other is the parent less that one.

Spark lets a task wait a whole second for each exchange, so growing by several tasks takes
a second a level whatever their number; rows of one task are grown without any exchange.
:class:`BoostedTrees` therefore leaves frames of more than ``ROWS_PER_TASK`` rows to Spark's
boosting, dealt by key to as many partitions as there are such lots, up to the slots of the
cluster.  Spark would take the thresholds of such frames from a sample: they get bin numbers
whose cuts all rows had a part in (:func:`fit_binned`).  If an executor is lost the stage starts again and gives the same trees.  The
fitted trees become a native Spark model, so scoring, saving and importances are Spark's.
"""

from __future__ import annotations

import base64
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.session import shared_folder

#: Bins of a feature, rows of a task, and the unit in which gradients are summed.
BINS, ROWS_PER_TASK, UNIT = 32, 16_384, float(1 << 20)
QUANTILE_ERROR = 0.001
#: Rows from which on Spark's trees take their thresholds from a sample of about as many.
SAMPLED_ROWS = 10_000
NODE = "tree int, node int, feature int, threshold double, below int, above int, value double, gain double, rows bigint"


@dataclass(frozen=True)
class Boosting:
    """Settings of one model; ``logistic`` trees take Newton steps with a penalty of 1, others least squares."""

    rounds: int = 150
    depth: int = 5
    step: float = 0.1
    sampled: float = 0.8
    columns: float = 1.0
    least_rows: int = 1
    logistic: bool = False
    seed: int = 42


def cuts(frame: DataFrame, vector: str, size: int) -> list[list[float]]:
    """Thresholds of each feature: quantiles of its values without the largest, above which nothing lies; one job."""
    x = frame.select(vector_to_array(vector).alias("x")).select(*[F.col("x")[i].alias(f"f{i}") for i in range(size)])
    shares = [i / BINS for i in range(1, BINS)] + [1.0]
    return [sorted(set(v))[:-1] for v in x.approxQuantile(x.columns, shares, QUANTILE_ERROR)]


def filled_cuts(frame: DataFrame, vector: str, found: list[list[float]], rounds: int = 3) -> list[list[float]]:
    """Cuts that use the room which frequent values leave: quantiles of the values that are none yet, below the largest; a job a round."""
    x = frame.select(vector_to_array(vector).alias("x"))
    top = x.select(*[F.max(F.col("x")[i]).alias(f"f{i}") for i in range(len(found))]).first()
    found = [list(t) for t in found]
    number = lambda v: f"double('{v!r}')"
    for _ in range(rounds):
        room = {f"f{i}": BINS - 1 - len(t) for i, t in enumerate(found) if len(t) < BINS - 1 and top[i] is not None}
        if not room:
            break
        # As SQL text: one parse instead of a call for each number.
        others = x.selectExpr(*[f"IF(x[{i}] < {number(top[i])}{''.join(f' AND x[{i}] != {number(v)}' for v in found[i])}, x[{i}], NULL) AS f{i}"
                                for i in (int(c[1:]) for c in room)])
        more = others.approxQuantile(others.columns, [i / BINS for i in range(1, BINS)] + [1.0], QUANTILE_ERROR)
        for c, values in zip(room, more, strict=True):
            values = sorted(set(values))
            if len(values) > room[c]:
                values = [values[(2 * k + 1) * len(values) // (2 * room[c])] for k in range(room[c])]
            found[int(c[1:])] = sorted({*found[int(c[1:])], *values})
        if not any(more):
            break
    return found


def binned(vector: Column, thresholds: list[list[float]]) -> Column:
    """Bin numbers of the features: how many of a feature's thresholds its value is above."""
    @F.pandas_udf("array<double>")
    def bins(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        values = np.stack(x.to_numpy())
        return pd.Series(list(np.stack([np.searchsorted(t, values[:, f], side="left") for f, t in enumerate(thresholds)], axis=1).astype(np.float64)))

    return array_to_vector(bins(vector_to_array(vector)))


def fit_binned(estimator, rows: DataFrame, n: int, thresholds: list[list[float]]):
    """The trees that one of Spark's learners grows from bin numbers, as a model of the values themselves.

    Spark takes the thresholds of more than ``SAMPLED_ROWS`` rows from a sample.  The bins come from
    all rows, and ``maxBins`` is set so that Spark reads all rows to find them; it keeps as many
    splits as there are bins.  In the saved trees each split's bin then becomes its threshold.
    """
    spark = rows.sparkSession
    fitted = estimator.fit(rows, {estimator.maxBins: max(BINS, min(46_340, math.isqrt(n) + 1))})  # its square is the size of the sample
    path = shared_folder(spark, "trees")
    fitted.write().save(f"{path}/binned")
    cut = F.from_json(F.lit(json.dumps(thresholds)), "array<array<double>>")
    split = F.col("nodeData.split")
    below = F.floor(split["leftCategoriesOrThreshold"][0]).cast("int")
    value = F.when(split["featureIndex"] >= 0, F.array(F.get(F.get(cut, split["featureIndex"]), below))).otherwise(split["leftCategoriesOrThreshold"])
    data = spark.read.parquet(f"{path}/binned/data")
    data = data.withColumn("nodeData", F.col("nodeData").withField("split", split.withField("leftCategoriesOrThreshold", value)))
    data.write.parquet(f"{path}/model/data")
    spark.read.text(f"{path}/binned/metadata").coalesce(1).write.text(f"{path}/model/metadata")
    spark.read.parquet(f"{path}/binned/treesMetadata").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    return type(fitted).load(f"{path}/model")


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    x = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Grower:
    """The rows of one task, and the trees that all tasks grow together."""

    def __init__(self, x: np.ndarray, target: np.ndarray, keys: np.ndarray, thresholds: list[list[float]], spec: Boosting, total):
        self.spec, self.total, self.target, self.keys = spec, total, target, keys
        self.used = [f for f, t in enumerate(thresholds) if t]
        self.thresholds = [np.array(thresholds[f]) for f in self.used]
        self.width = np.array([len(t) + 1 for t in self.thresholds], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.width))).astype(np.int64)
        self.bins = np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in zip(self.used, self.thresholds, strict=True)], axis=1).astype(
            np.int64) if self.used else np.zeros((len(x), 0), np.int64)
        self.flat = self.bins + self.start[:-1]
        n, y = self.total(np.array([len(target), np.rint(target.sum() * UNIT)]))
        mean = y / UNIT / n if n else 0.0
        self.base = float(np.log(mean / (1 - mean))) if spec.logistic and 0 < mean < 1 else float(mean)
        self.score = np.full(len(target), self.base)
        self.rows = int(n)

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.spec.logistic:
            return np.rint((self.target - self.score) * UNIT), np.full(len(self.target), UNIT)
        p = 1.0 / (1.0 + np.exp(-self.score))
        return np.rint((self.target - p) * UNIT), np.maximum(1.0, np.rint(p * (1 - p) * UNIT))

    def sums(self, rows: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of g, h and rows by (slot, bin) over all tasks."""
        size = slots * int(self.start[-1])
        at = (slot[:, None] * self.start[-1] + self.flat[rows]).ravel()
        wide = len(self.used)
        out = [np.bincount(at, np.repeat(g[rows], wide), size)]
        out.append(np.bincount(at, minlength=size).astype(np.float64))
        out.append(np.bincount(at, np.repeat(h[rows], wide), size) if self.spec.logistic else out[1] * UNIT)
        return self.total(np.stack((out[0], out[2], out[1]))).reshape(3, slots, -1)

    def splits(self, held: np.ndarray, allowed: np.ndarray):
        """Best split of each node from its sums: feature, bin, gain, and the sums of both sides."""
        spec, penalty = self.spec, UNIT if self.spec.logistic else 0.0
        whole = held[:, :, :self.width[0]].sum(axis=2)  # the bins of any one feature
        running = np.cumsum(held, axis=2)
        before = np.concatenate((np.zeros((3, held.shape[1], 1)), running[:, :, self.start[1:-1] - 1]), axis=2)
        left = running - np.repeat(before, self.width, axis=2)
        right = whole[:, :, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            quality = lambda s: np.where(s[1] + penalty > 0, s[0] ** 2 / (s[1] + penalty), 0.0)
            gain = (quality(left) + quality(right) - quality(whole)[:, None]) / UNIT
        heavy = UNIT if spec.logistic else 0.0  # least weight of a side
        fits = (left[2] >= spec.least_rows) & (right[2] >= spec.least_rows) & (left[1] >= heavy) & (right[1] >= heavy) & allowed
        gain = np.where(fits, gain, -1.0)
        best = gain.argmax(axis=1)
        node = np.arange(len(best))
        feature = np.searchsorted(self.start, best, side="right") - 1
        return feature, best - self.start[feature], gain[node, best], left[:, node, best], right[:, node, best], whole

    def value(self, s: np.ndarray) -> np.ndarray:
        weight = s[1] + (UNIT if self.spec.logistic else 0.0)
        return self.spec.step * np.divide(s[0], weight, out=np.zeros_like(s[0]), where=weight > 0)

    def tree(self, number: int) -> list[tuple]:
        """Grow one tree, add it to the scores and return its nodes (feature -1: a leaf)."""
        spec = self.spec
        g, h = self.gradients()
        drawn = np.flatnonzero(_uniform(self.keys, spec.seed + number) < spec.sampled)
        rng = np.random.default_rng(spec.seed + number)
        columns = rng.permutation(len(self.used))[:max(1, round(spec.columns * len(self.used)))]
        allowed = np.repeat(np.isin(np.arange(len(self.used)), columns), self.width)
        node = np.zeros(len(self.target), np.int64)  # of every row, drawn or not
        nodes = [[-1, 0.0, -1, -1, 0.0, 0.0, 0]]
        level, held = np.array([0]), self.sums(drawn, node[drawn], 1, g, h)
        first = held[:, :, :self.width[0]].sum(axis=2)
        nodes[0][4], nodes[0][6] = float(self.value(first)[0]), int(first[2, 0])
        for depth in range(spec.depth):
            feature, cut, gain, left, right, _ = self.splits(held, allowed)
            split = np.flatnonzero(gain > 1e-9)
            if not len(split):
                break
            below, above = len(nodes) + 2 * np.arange(len(split)), len(nodes) + 2 * np.arange(len(split)) + 1
            lv, rv = self.value(left), self.value(right)
            for n, s in enumerate(split.tolist()):
                f, b = int(feature[s]), int(cut[s])
                nodes[level[s]][:4] = [self.used[f], float(self.thresholds[f][b]), int(below[n]), int(above[n])]
                nodes[level[s]][5] = float(gain[s])
                nodes.append([-1, 0.0, -1, -1, float(lv[s]), 0.0, int(left[2, s])])
                nodes.append([-1, 0.0, -1, -1, float(rv[s]), 0.0, int(right[2, s])])
            place = np.full(len(nodes), -1)
            place[level[split]] = np.arange(len(split))
            at = place[node]
            mine = np.flatnonzero(at >= 0)
            at = at[mine]
            goes = self.bins[mine, feature[split][at]] <= cut[split][at]
            node[mine] = np.where(goes, below[at], above[at])
            if depth + 1 == spec.depth:
                break
            small = np.where(left[2, split] <= right[2, split], below, above)
            slot = np.full(len(nodes), -1)
            slot[small] = np.arange(len(split))
            where = slot[node[drawn]]
            less = self.sums(drawn[where >= 0], where[where >= 0], len(split), g, h)
            more = held[:, split] - less
            is_left = (small == below)[None, :, None]
            held = np.empty((3, 2 * len(split), less.shape[2]))
            held[:, 0::2], held[:, 1::2] = np.where(is_left, less, more), np.where(is_left, more, less)
            level = np.stack((below, above), axis=1).ravel()
        self.score += np.array([x[4] for x in nodes])[node]
        return [(number, i, *x) for i, x in enumerate(nodes)]


def _barrier_total(task):
    """Element-wise sum over the tasks of the barrier stage."""
    def total(a: np.ndarray) -> np.ndarray:
        a = np.ascontiguousarray(a, np.float64)
        sent = task.allGather(base64.b64encode(a.tobytes()).decode())
        return np.sum([np.frombuffer(base64.b64decode(x), np.float64) for x in sent], axis=0).reshape(a.shape)
    return total


def tasks_of(spark: SparkSession, rows: int) -> int:
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def grow(frame: DataFrame, vector: str, target: str, key: str, spec: Boosting, size: int, tasks: int | None = None,
         thresholds: list[list[float]] | None = None) -> DataFrame:
    """Nodes of all trees; tree -1 is the constant that boosting starts from.  One barrier job."""
    spark = frame.sparkSession
    n = frame.count()
    if not n:
        return spark.createDataFrame([(-1, 0, -1, 0.0, -1, -1, 0.0, 0.0, 0)], NODE)  # nothing to learn from: the constant 0
    thresholds = thresholds or cuts(frame, vector, size)
    tasks = tasks or tasks_of(spark, n)

    def run(batches):
        from pyspark import BarrierTaskContext

        task = BarrierTaskContext.get()
        total = _barrier_total(task) if tasks > 1 else (lambda a: a)
        x, y, k = [np.zeros((0, size))], [np.zeros(0)], [np.zeros(0, np.uint64)]
        for batch in batches:
            x.append(batch.column("x").flatten().to_numpy().reshape(-1, size))
            y.append(batch.column("y").to_numpy())
            k.append(batch.column("k").to_numpy().view(np.uint64))
        grower = Grower(np.concatenate(x), np.concatenate(y), np.concatenate(k), thresholds, spec, total)
        trees = [[(-1, 0, -1, 0.0, -1, -1, grower.base, 0.0, grower.rows)]]
        trees += [grower.tree(n) for n in range(spec.rounds if grower.used and grower.rows else 0)]
        if task.partitionId() == 0:  # all tasks have the same trees
            columns = list(zip(*[row for t in trees for row in t], strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in NODE.split(", ")])

    rows = frame.select(vector_to_array(vector).alias("x"), F.col(target).cast("double").alias("y"), F.xxhash64(key).alias("k"))
    return rows.repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(run, NODE, barrier=True)


def _described(kind: str, params: dict, defaults: dict, spark: SparkSession, **more) -> str:
    """Metadata of a saved Spark ML object."""
    return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": f"boosted_{uuid.uuid4().hex[:12]}",
                       "paramMap": params, "defaultParamMap": defaults, **more})


def native_model(nodes: DataFrame, spec: Boosting, size: int, native, path: str):
    """The grown trees as the model that ``native`` (a Spark estimator) would have fitted, by way of its saved form."""
    spark = nodes.sparkSession
    # Spark's two-class margin is half the log-odds; its gains are per row.
    value = F.col("value") * (0.5 if spec.logistic else 1.0)
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias(
        "leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    rows = F.greatest(F.col("rows"), F.lit(1))
    data = nodes.select((F.col("tree") + 1).alias("treeID"), F.struct(
        F.col("node").alias("id"), value.alias("prediction"), F.lit(0.0).alias("impurity"), F.array(rows.cast("double"), F.lit(0.0), F.lit(0.0)).alias("impurityStats"),
        F.col("rows").alias("rawCount"), F.when(F.col("feature") >= 0, F.col("gain") / rows).otherwise(-1.0).alias("gain"), F.col("below").alias("leftChild"),
        F.col("above").alias("rightChild"), split.alias("split")).alias("nodeData"))
    data.write.parquet(f"{path}/data")  # one file: the first task writes all trees
    trees = spark.read.parquet(f"{path}/data").agg(F.max("treeID")).first()[0] + 1
    params = {p.name: v for p, v in native._paramMap.items()}
    defaults = {p.name: v for p, v in native._defaultParamMap.items()}
    kind = "classification.GBTClassificationModel" if spec.logistic else "regression.GBTRegressionModel"
    head = _described(kind, params, defaults, spark, numFeatures=size, numTrees=trees)
    tree_defaults = {k: v for k, v in defaults.items() if k in ("featuresCol", "labelCol", "predictionCol", "leafCol", "maxBins", "maxDepth")}
    tree = _described("regression.DecisionTreeRegressionModel", {}, tree_defaults, spark)
    spark.range(1).coalesce(1).select(F.lit(head).alias("value")).write.text(f"{path}/metadata")
    spark.range(trees).select(F.col("id").cast("int").alias("_1"), F.lit(tree).alias("_2"), F.lit(1.0).alias("_3")).coalesce(1).write.parquet(f"{path}/treesMetadata")
    return (GBTClassificationModel if spec.logistic else GBTRegressionModel).load(path)


@dataclass
class BoostedTrees:
    """Estimator: grows the trees of one task's rows in one barrier job, where the cluster allows barriers; else Spark's own boosting does."""

    spec: Boosting
    size: int
    features: str = "scaled"
    label: str = "target"
    key: str = "id"
    thresholds: Callable[[], list[list[float]]] | None = None  # gives those shared by the models of one frame
    filled: Callable[[], list[list[float]]] | None = None  # the same, for Spark's boosting

    def native(self):
        s = self.spec
        kind = GBTClassifier if s.logistic else GBTRegressor
        return kind(maxIter=max(1, s.rounds), maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.sampled, minInstancesPerNode=s.least_rows, seed=s.seed,
                    featureSubsetStrategy="all" if s.columns == 1.0 else str(s.columns), labelCol=self.label, featuresCol=self.features)

    def fit(self, rows: DataFrame):
        spark = rows.sparkSession
        n = rows.count()
        barriers = spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"  # Spark allows none then
        if n > ROWS_PER_TASK or not barriers:
            whole = n > SAMPLED_ROWS
            if whole:
                cut = self.filled() if self.filled else filled_cuts(rows, self.features, cuts(rows, self.features, self.size))
                rows = rows.withColumn(self.features, binned(F.col(self.features), cut))
            if barriers:  # in an order that does not hang on how the rows came
                rows = rows.repartition(tasks_of(spark, n), F.xxhash64(self.key)).sortWithinPartitions(self.key)
            return fit_binned(self.native(), rows, n, cut) if whole else self.native().fit(rows)
        nodes = grow(rows, self.features, self.label, self.key, self.spec, self.size, thresholds=self.thresholds and self.thresholds())
        return native_model(nodes, self.spec, self.size, self.native(), shared_folder(spark, "boosted"))
