"""Model training, evaluation and batch scoring with Spark ML."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.operators.boosting import SAMPLED_ROWS, BoostedTrees, Boosting, binned, cuts, filled_cuts, fit_binned
from reviewlake.operators.metrics import clean_vector
from reviewlake.packs.metric_patterns import FEATURES
from reviewlake.session import shared_folder, store

# --- Fixed values -----------------------------------------------------------
SEED = 42
TRAIN_SHARE = 0.8
VERSION = "1.0.0"
SEVERITY_CLASSES = ("CRITICAL", "HIGH", "INFO", "LOW", "MEDIUM")
# model -> (label column, score it predicts, stratified split)
TARGETS = {
    "bug_detector": ("label_has_bug", "bug_probability", True),
    "security_risk": ("label_has_security_risk", "security_risk_score", True),
    "severity_classifier": ("label_severity", "predicted_severity", True),
    "quality_scorer": ("label_quality_score", "quality_score", False),
    "maintainability_scorer": ("label_maintainability_score", "maintainability_score", False),
    "readability_scorer": ("label_readability_score", "readability_score", False),
}
KERNEL_FEATURES = 256
PENALTY_C = 10.0
# ----------------------------------------------------------------------------

#: Rows of a partition of the training frame.
ROWS_PER_PARTITION = 2048
#: Rows of a forest's task at most, where more than the slots of the cluster are not needed.
ROWS_PER_FOREST_TASK = 131_072
#: Labels with two classes.
TWO_CLASS = ("label_has_bug", "label_has_security_risk")
#: Sums of the nodes of one job: each task holds them whole, whatever its rows, beside those of the executor's other tasks.
WIDE = {"maxMemoryInMB": 256}


# --- scaling ---------------------------------------------------------------

def scaler_stats(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature, one row per feature.

    One vector aggregate instead of a hundred column aggregates.
    """
    vector = array_to_vector(F.array(*FEATURES))
    stats = rows.select(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s"))
    n = F.col("s.count")
    stats = stats.select(n.alias("n"), F.posexplode(F.arrays_zip(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))).alias("i", "v"))
    feature = F.element_at(F.array(*map(F.lit, FEATURES)), F.col("i") + 1)
    return stats.select(feature.alias("feature"), F.col("v.mean").alias("mean"),
                        F.sqrt(F.col("v.variance") * (F.col("n") - 1) / F.col("n")).alias("scale"))


def fit_scaler(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """The statistics as numbers (51 pairs); a constant feature has scale 1."""
    return {r.feature: (r.mean, r.scale or 1.0) for r in scaler_stats(rows).collect()}


def scale(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardised features as columns."""
    return rows.withColumns({n: (F.col(n) - m) / s for n, (m, s) in scaler.items()})


def scaled_vector(scaler: dict[str, tuple[float, float]]) -> Column:
    return array_to_vector(F.array(*[(F.col(n) - scaler[n][0]) / scaler[n][1] for n in FEATURES]))


# --- splitting and weighting -------------------------------------------------

BUCKET_SHIFT = 16  # 65 536 buckets of a 32-bit hash


def by_class(values: dict, label: Column) -> Column:
    """Look-up in a literal map with one entry per class; null for classes without one."""
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), label)


def _stratum(label: str | None) -> Column:
    return F.col(label).cast("string") if label else F.lit("all")


def _split_hash(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("split"), key)), 1, 8), 16, 10).cast("long")


def split_cuts(rows: DataFrame, label: str | None = None, share: float = TRAIN_SHARE, key: str = "id") -> dict[str, tuple]:
    """(hash, key) of the last training row of each class, in hash order.

    Ranking a whole class would sort it in one task.  A histogram of the hash finds
    the bucket that holds the class's cut; only the rows of that bucket (about one
    in 65 536) are ranked.  One row per class comes back.
    """
    df = rows.select(key, _stratum(label).alias("_class"), _split_hash(key).alias("_hash"))
    df = df.where("_class IS NOT NULL").withColumn("_bucket", F.shiftright("_hash", BUCKET_SHIFT))
    sizes = df.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_class").orderBy("_bucket")  # at most 65 536 rows per class
    whole = Window.partitionBy("_class")
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(order), "_wanted": F.round(F.sum("_n").over(whole) * share)})
    cuts = sizes.where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted"))).select(
        "_class", "_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).cast("long").alias("_room")).collect()
    edge = df.where(F.col("_bucket") == by_class({r["_class"]: r["_bucket"] for r in cuts}, F.col("_class")))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_hash", key))
    last = edge.withColumn("_rank", rank).where(F.col("_rank") == by_class({r["_class"]: r["_room"] for r in cuts}, F.col("_class")))
    return {r["_class"]: (r["_hash"], r[key]) for r in last.collect()}


def split_train(rows: DataFrame, label: str | None = None, share: float = TRAIN_SHARE, key: str = "id") -> DataFrame:
    """Add ``is_train``: exactly ``share`` of each class (or of all rows), by hash order; a narrow projection."""
    cuts = split_cuts(rows, label, share, key)
    h, stratum = _split_hash(key), _stratum(label)
    last_hash, last_key = (by_class({k: v[i] for k, v in cuts.items()}, stratum) for i in (0, 1))
    return rows.withColumn("is_train", F.coalesce((h < last_hash) | ((h == last_hash) & (F.col(key) <= last_key)), F.lit(False)))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class; counts first, then one small window."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per class
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def with_class_weight(rows: DataFrame, label: str) -> DataFrame:
    """Add ``class_weight`` from a literal map: no row moves."""
    weights = {r["class"]: r["weight"] for r in class_weights(rows, label).collect()}
    return rows.withColumn("class_weight", by_class(weights, F.col(label).cast("string")))


# --- models --------------------------------------------------------------------

def kernel_map(vector: Column, n_inputs: int = len(FEATURES), n_outputs: int = KERNEL_FEATURES) -> Column:
    """Random Fourier features of an RBF kernel with gamma = 1 / n_inputs.

    A linear model on them approximates the kernel machine; the projection is a
    fixed small matrix, applied to whole Arrow batches.
    """
    rng = np.random.default_rng(SEED)
    directions = rng.normal(0.0, np.sqrt(2.0 / n_inputs), (n_inputs, n_outputs))
    phases = rng.uniform(0.0, 2 * np.pi, n_outputs)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.sqrt(2.0 / n_outputs) * np.cos(np.stack(x.to_numpy()) @ directions + phases)))

    return array_to_vector(project(vector_to_array(vector)))


def estimators(trees: int = 100, rounds: int = 150, thresholds=None, filled=None) -> dict[str, object]:
    """The six learners with the reference settings; boosted ones share the thresholds of their frame."""
    boosted = lambda **settings: BoostedTrees(
        Boosting(rounds=rounds, step=0.1, sampled=0.8, seed=SEED, **settings), len(FEATURES), thresholds=thresholds, filled=filled)
    return {
        "bug_detector": RandomForestClassifier(
            numTrees=trees, maxDepth=12, minInstancesPerNode=5, weightCol="class_weight", seed=SEED,
            labelCol="target", featuresCol="scaled", **WIDE),
        "security_risk": boosted(depth=6, columns=0.8, logistic=True),
        "severity_classifier": LogisticRegression(
            family="multinomial", regParam=0.5 / PENALTY_C / 100, maxIter=100, weightCol="class_weight",
            labelCol="target", featuresCol="kernel"),
        "quality_scorer": boosted(depth=5, least_rows=5),
        "maintainability_scorer": RandomForestRegressor(
            numTrees=trees, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="all", seed=SEED,
            labelCol="target", featuresCol="scaled", **WIDE),
        "readability_scorer": boosted(depth=4, least_rows=5),
    }


def _target(label: str) -> Column:
    if label == "label_severity":
        return (F.array_position(F.array(*map(F.lit, SEVERITY_CLASSES)), F.col(label)) - 1).cast("double")
    return F.col(label).cast("double")


@dataclass
class Scorers:
    """Fitted scaler and models; scores feature rows in one projection."""

    scaler: dict[str, tuple[float, float]]
    models: dict[str, Model]
    metadata: dict = field(default_factory=dict)

    @property
    def available(self) -> set[str]:
        return {TARGETS[name][1] for name in self.models}

    def predict(self, features: DataFrame) -> DataFrame:
        """Add ``model_<score>`` columns for the models present."""
        keep = features.columns
        # A generated column ends the projections below it: the features are made once, and the Python
        # step of the kernel queues rows without the texts and lines that they are made from.
        made = features.select("*", F.explode(F.array(F.lit(True))).alias("_made"))
        # Features are cleaned for the models only; the reported ones stay as they are.
        raw = made.withColumn("_raw", F.struct(*FEATURES))
        df = clean_vector(raw).withColumn("scaled", scaled_vector(self.scaler))
        if "severity_classifier" in self.models:
            df = df.withColumn("kernel", kernel_map(F.col("scaled")))
        out = []
        for name, model in self.models.items():
            score = f"model_{TARGETS[name][1]}"
            df = model.transform(df)
            if name == "severity_classifier":
                value = F.element_at(F.array(*map(F.lit, SEVERITY_CLASSES)), F.col("prediction").cast("int") + 1)
            elif "probability" in df.columns:
                value = F.element_at(vector_to_array("probability"), 2)
            else:
                value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("prediction")))
            df = df.withColumn(score, value).drop("prediction", "rawPrediction", "probability")
            out.append(score)
        return df.select(*[F.col(f"_raw.{c}").alias(c) if c in FEATURES else F.col(c) for c in keep], *out)

    def save(self, path: str, spark) -> None:
        """Models as Spark ML folders, scaler and metadata as one JSON record."""
        for name, model in self.models.items():
            PipelineModel([model]).write().overwrite().save(f"{path}/{name}")
        record = json.dumps({"scaler": self.scaler, "models": sorted(self.models), **self.metadata})
        spark.createDataFrame([(record,)], "value string").write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(path: str, spark) -> "Scorers":
        record = json.loads(spark.read.text(f"{path}/metadata").first().value)
        models = {n: PipelineModel.load(f"{path}/{n}").stages[0] for n in record["models"]}
        scaler = {k: tuple(v) for k, v in record["scaler"].items()}
        return Scorers(scaler, models, {k: v for k, v in record.items() if k not in ("scaler", "models")})


def training_frame(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Stored rows with their scaled vector; as numbers of many digits the vectors would take many times the room of the rows."""
    return rows.withColumn("scaled", scaled_vector(scaler)).drop(*FEATURES)


def labelled(frame: DataFrame, model: str) -> DataFrame:
    """Training frame of one model: split, target and (for classifiers) weights; rows without the label are left out."""
    label, _, stratified = TARGETS[model]
    frame = frame.where(F.col(label).isNotNull())
    df = split_train(frame, label if stratified else None).withColumn("target", _target(label))
    return with_class_weight(df, label) if model in ("bug_detector", "severity_classifier") else df


def rank_auc(rows: DataFrame, by: str, target: str, score: str) -> DataFrame:
    """Exact area under the ROC curve per group: (by, auc), ties counted half; null where a class is missing.

    Equal scores collapse on the map side.  The distinct scores are range partitioned;
    ranks are taken inside a range, and one row per range carries the negatives below it.
    """
    one = F.col(target).cast("long")
    tied = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull()).groupBy(by, score).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, because a range that is computed again may be cut elsewhere.
    ranged = store(tied.repartitionByRange(parts, by, score).withColumn("_part", F.spark_partition_id()), "scores")
    below = Window.partitionBy(by, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: c.cast("decimal(38,0)")
    pairs = exact(F.col("pos")) * exact(2 * F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg"))  # twice the pairs won
    inside = ranged.withColumn("_won", pairs).groupBy(by, "_part").agg(F.sum("_won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole = inside.withColumn("won", F.col("won") + exact(2 * F.coalesce(F.sum("neg").over(earlier), F.lit(0))) * exact(F.col("pos")))
    return whole.groupBy(by).agg(F.try_divide(F.sum("won").cast("double"), 2.0 * F.sum("pos") * F.sum("neg")).alias("auc"))


def evaluation(predictions: DataFrame) -> DataFrame:
    """Accuracy and AUC of two-class models, accuracy of the severity, MAE and R2 of the scores: (model, metric, value).

    ``predictions`` has model, id, target, prediction and score (the probability of two-class models).
    """
    two = F.col("model").isin([m for m, (label, _, _) in TARGETS.items() if label in TWO_CLASS])
    classes = two | (F.col("model") == "severity_classifier")
    right = predictions.where(classes).groupBy("model").agg(F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("value")).withColumn("metric", F.lit("accuracy"))
    auc = rank_auc(predictions.where(two), "model", "target", "score").select("model", F.col("auc").alias("value"), F.lit("auc").alias("metric"))
    error = regression_error(predictions.where(~classes), "target", "prediction", "model")
    errors = error.select("model", F.expr("stack(2, 'mae', mae, 'r2', r2) AS (metric, value)"))
    return right.unionByName(auc).unionByName(errors).select("model", "metric", "value")


def regression_error(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """MAE and R2 as one aggregate (sums only, one pass)."""
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"),
                               F.when(F.var_pop(actual) > 0, 1 - F.sum(error * error) / (F.var_pop(actual) * F.count(actual))).alias("r2"))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows of a forest in as many partitions as the cluster has slots, in an order that does not hang on how they came.

    For each level of its trees every task sends the sums of all nodes and bins, however few
    rows it has; by files or lots of rows the tasks, and with them those sums, grow with the
    table.  Rows of like targets stand together, as they mostly fall to the same nodes, whose
    sums are then at hand.  Frames of fewer lots than slots are left as they are.
    """
    slots, lots = df.sparkSession.sparkContext.defaultParallelism, max(1, -(-rows // ROWS_PER_PARTITION))
    if lots <= slots:
        return df.coalesce(lots)
    tasks = slots * -(-rows // (slots * ROWS_PER_FOREST_TASK))
    return df.repartition(tasks, F.xxhash64("id", "target", "scaled")).sortWithinPartitions("target", "id")  # ids may be null


def fit_one(frame: DataFrame, rows: int, model: str, estimator, filled=None) -> tuple[Model, DataFrame]:
    """The fitted model, and its predictions for the rows that it has not learned from.

    ``filled`` gives the thresholds of a forest of more rows than Spark reads for its own.
    """
    df = labelled(frame, model)
    df = df.select("id", "target", "scaled", "is_train", *[c for c in ("class_weight",) if c in df.columns])
    forest = isinstance(estimator, (RandomForestClassifier, RandomForestRegressor))
    # Not persisted: the learners keep their own form of the rows, and the vectors would stand beside it.
    if not forest:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_PARTITION)))
    if model == "severity_classifier":
        df = df.withColumn("kernel", kernel_map(F.col("scaled")))
    learned = df.where("is_train")
    n = learned.count() if forest and rows > SAMPLED_ROWS else 0
    if n > SAMPLED_ROWS:
        cut = filled() if filled else filled_cuts(frame, "scaled", cuts(frame, "scaled", len(FEATURES)))
        fitted = fit_binned(estimator, dealt(learned.withColumn("scaled", binned(F.col("scaled"), cut)), rows), n, cut)
    else:
        fitted = estimator.fit(dealt(learned, rows) if forest else learned)
    out = fitted.transform(df.where("NOT is_train"))
    score = F.element_at(vector_to_array("probability"), 2) if TARGETS[model][0] in TWO_CLASS else F.col("prediction")
    out = store(out.select(F.lit(model).alias("model"), "id", F.col("target"), "prediction", score.alias("score")), "predictions")
    return fitted, out


def train(rows: DataFrame, models: list[str] | None = None, trees: int = 100, rounds: int = 150,
          parallel: int = 6) -> tuple[Scorers, DataFrame]:
    """Fit the scaler on all rows and the models on all of their training part; the models, and their predictions for the held-out rows.

    The fits are independent, so their Spark jobs are submitted side by side, each in a
    pool of its own where the cluster schedules fairly.
    """
    started = time.time()
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:  # long fits cut their lineage there
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    rows = store(rows, "rows")  # read by the scaler and by each fit
    scaler = fit_scaler(rows)
    frame = training_frame(rows, scaler)
    samples = frame.count()
    wanted = [k for k in TARGETS if models is None or k in models]

    def fit(item):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", item[0])
        return fit_one(frame, samples, *item, filled=filled)

    with ThreadPoolExecutor(parallel + 2) as pool:
        boosted = any(isinstance(v, BoostedTrees) for k, v in estimators().items() if k in wanted)
        large = samples > SAMPLED_ROWS and any(k != "severity_classifier" for k in wanted)  # for Spark's trees
        thresholds = pool.submit(cuts, frame, "scaled", len(FEATURES)).result if boosted or large else None
        filled = pool.submit(lambda: filled_cuts(frame, "scaled", thresholds())).result if large else None
        chosen = {k: estimators(trees, rounds, thresholds, filled)[k] for k in wanted}
        done = dict(zip(chosen, pool.map(inheritable_thread_target(spark)(fit), chosen.items())))
    scorers = Scorers(scaler, {k: m for k, (m, _) in done.items()}, {
        "version": VERSION, "training_samples": samples, "feature_names": list(FEATURES),
        "feature_count": len(FEATURES), "training_time_seconds": round(time.time() - started, 2),
        "algorithms": {k: type(v).__name__ for k, v in chosen.items()}})
    return scorers, reduce(DataFrame.unionByName, [p for _, p in done.values()])


def metadata_table(spark, scorers: Scorers) -> DataFrame:
    """The metadata record as one row per model."""
    m = scorers.metadata
    rows = [(name, algorithm, m["version"], m["training_samples"], m["feature_count"], m["training_time_seconds"])
            for name, algorithm in sorted(m["algorithms"].items())]
    return spark.createDataFrame(rows, "model string, algorithm string, version string, training_samples long, "
                                       "feature_count int, training_time_seconds double")


def importances(spark, scorers: Scorers) -> DataFrame:
    """Feature importances of the tree models (51 rows per model)."""
    rows = [(name, feature, float(weight)) for name, model in sorted(scorers.models.items())
            if hasattr(model, "featureImportances")
            for feature, weight in zip(FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")
