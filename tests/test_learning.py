"""Boosting in one barrier job, exact ranking metrics, and the written predictions of all six models."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import TESTDATA
from entries.common import programs
from entries.learning import rows as training_rows
from reviewlake import review, store
from reviewlake.operators import boosting, ml
from reviewlake.operators.boosting import BoostedTrees, Boosting
from reviewlake.packs.metric_patterns import FEATURES


def frame(spark, n=3000, classes=False):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(n, 5)), 1)
    x[:, 3] = 1.0  # a constant feature
    y = 3 * (x[:, 0] > 0.5) + x[:, 1] ** 2 + rng.normal(0, 0.1, n)
    if classes:
        y = (y > 1.5).astype(float)
    rows = [(str(i), [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id string, x array<double>, target double").withColumn("scaled", array_to_vector("x"))
    return store(df, "frame"), x, y


@pytest.mark.parametrize("classes", [False, True])
def test_trees_do_not_depend_on_the_partitions(spark, classes):
    df, *_ = frame(spark, 700, classes)
    spec = Boosting(rounds=6, depth=4, logistic=classes, columns=0.8 if classes else 1.0)
    one, three = ([tuple(r) for r in boosting.grow(df, "scaled", "target", "id", spec, 5, n).orderBy("tree", "node").collect()] for n in (1, 3))
    assert one == three and len({r[0] for r in one}) == 7


def test_the_first_split_is_the_best_one(spark):
    df, x, y = frame(spark, 400)
    nodes = boosting.grow(df, "scaled", "target", "id", Boosting(rounds=1, depth=1, sampled=1.1), 5).where("tree = 0").orderBy("node").collect()
    best = max(((len(a) * np.mean(a) ** 2 + len(b) * np.mean(b) ** 2, f, t) for f in range(5) for t in np.unique(x[:, f])[:-1]
                for a, b in [(y[x[:, f] <= t] - y.mean(), y[x[:, f] > t] - y.mean())]))
    root, left, right = nodes
    cuts = boosting.cuts(df, "scaled", 5)
    assert cuts[3] == [] and root.feature == best[1] and min(abs(c - best[2]) for c in cuts[best[1]]) < 0.2
    below = x[:, root.feature] <= root.threshold
    assert left.rows == below.sum() and abs(left.value - 0.1 * (y[below].mean() - y.mean())) < 1e-4
    assert abs(right.value - 0.1 * (y[~below].mean() - y.mean())) < 1e-4


def walk(nodes, x):
    trees = {}
    for r in nodes:
        trees.setdefault(r.tree, {})[r.node] = r
    total = 0.0
    for tree in trees.values():
        at = tree[0]
        while at.feature >= 0:
            at = tree[at.below if x[at.feature] <= at.threshold else at.above]
        total += at.value
    return total


@pytest.mark.parametrize("classes", [False, True])
def test_the_native_model_scores_like_the_trees(spark, classes, tmp_path):
    df, x, y = frame(spark, 1500, classes)
    spec = Boosting(rounds=40, depth=4, logistic=classes, least_rows=2)
    estimator = BoostedTrees(spec, 5)
    nodes = store(boosting.grow(df, "scaled", "target", "id", spec, 5), "nodes")
    model = boosting.native_model(nodes, spec, 5, estimator.native(), str(tmp_path / "model"))
    out = model.transform(df).orderBy(F.col("id").cast("int")).collect()
    held = nodes.collect()
    for i in range(0, 1500, 50):
        margin = walk(held, x[i])
        got = out[i].probability[1] if classes else out[i].prediction
        assert abs(got - (1 / (1 + np.exp(-margin)) if classes else margin)) < 1e-9
    weights = model.featureImportances.toArray()
    assert weights[3] == 0 and weights[0] + weights[1] > 0.8
    if classes:
        assert np.mean([r.prediction == r.target for r in out]) > 0.95
    else:
        own = RegressionEvaluator(labelCol="target", metricName="r2").evaluate(model.transform(df))
        spark_own = RegressionEvaluator(labelCol="target", metricName="r2").evaluate(estimator.native().setMaxIter(40).fit(df).transform(df))
        assert own > 0.9 and own > spark_own - 0.05


@pytest.mark.parametrize("classes", [False, True])
def test_rows_of_several_tasks_are_boosted_without_barriers(spark, monkeypatch, classes):
    """Spark holds every exchange of a barrier stage for a second, a level of a tree each."""
    df, *_ = frame(spark, 1500, classes)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(boosting, "grow", lambda *a, **b: pytest.fail("a barrier job of several tasks"))
    estimator = BoostedTrees(Boosting(rounds=10, depth=4, logistic=classes, step=0.3), 5)
    models = [estimator.fit(rows) for rows in (df, df.repartition(7))]
    assert models[0].toDebugString.split("\n", 1)[1] == models[1].toDebugString.split("\n", 1)[1]  # after the line with the uid
    assert models[0].getNumTrees == 10 and np.mean([abs(r.prediction - r.target) for r in models[0].transform(df).collect()]) < (0.05 if classes else 0.4)


@pytest.mark.parametrize("model", ["maintainability_scorer", "bug_detector"])
def test_tasks_of_a_forest_do_not_grow_with_the_rows(spark, monkeypatch, model):
    """Each task sends the sums of all nodes of a level, so more tasks than slots only add work; the trees are the same however the rows came."""
    monkeypatch.setattr(ml, "ROWS_PER_PARTITION", 50)
    df, *_ = frame(spark, 900, model == "bug_detector")
    df = df.withColumn(ml.TARGETS[model][0], F.round("target", 0)).drop("target")  # sums of whole numbers are exact
    df = df.withColumn("id", F.when(F.col("id") != "7", F.col("id")))  # one without a key
    seen = []
    kind = type(ml.estimators()[model])

    class Watched(kind):
        def _fit(self, rows):
            targets = rows.select("target").rdd.glom().collect()
            assert all(part == sorted(part) for part in targets)  # rows of like nodes stand together
            seen.append((len(targets), sum(map(len, targets))))
            return super()._fit(rows)

    out = []
    for n in (15, 11):
        estimator = Watched(numTrees=5, maxDepth=4, seed=1, labelCol="target", featuresCol="scaled")
        _, predictions = ml.fit_one(df.repartition(n).persist(), 900, model, estimator)
        out.append(sorted((r.id or "", round(r.prediction, 9)) for r in predictions.collect()))
    spark.catalog.clearCache()
    assert [n for n, _ in seen] == [spark.sparkContext.defaultParallelism] * 2 and seen[0] == seen[1]
    assert out[0] == out[1] and len(out[0]) + seen[0][1] == 900
    # Few rows stay in the partitions that they were in.
    assert ml.dealt(df.withColumn("target", F.lit(1.0)).repartition(3), 100).rdd.getNumPartitions() == 2
    # Many rows are dealt in lots of a bounded size.
    monkeypatch.setattr(ml, "ROWS_PER_FOREST_TASK", 100)
    assert ml.dealt(df.withColumn("target", F.lit(1.0)), 900).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_boosting_of_odd_rows(spark):
    """No rows, one row, one class, constant features."""
    df, *_ = frame(spark, 50)
    for rows, classes in ((df.limit(0), False), (df.limit(1), False), (df.withColumn("target", F.lit(1.0)), True), (df.limit(0), True)):
        nodes = boosting.grow(store(rows, "odd"), "scaled", "target", "id", Boosting(rounds=2, depth=2, logistic=classes), 5).collect()
        assert all(np.isfinite(r.value) for r in nodes) and nodes[0].tree == -1


def test_auc_is_exact(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.choice([0, 1]), draw.choice([0.1, 0.25, 0.5, round(draw.random(), 3)])) for _ in range(900)]
    rows += [("only one class", 1, 0.3), ("c", None, 0.2), ("c", 0, None), ("c", 0, 0.2), ("c", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r.auc for r in ml.rank_auc(df, "g", "y", "s").collect()}
    for g in "abc":
        pos = [s for k, y, s in rows if k == g and y == 1 and s is not None]
        neg = [s for k, y, s in rows if k == g and y == 0 and s is not None]
        assert abs(got[g] - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12
    assert got["only one class"] is None


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    models, predictions = ml.train(training_rows(spark, TESTDATA), trees=5, rounds=8)
    path = str(tmp_path_factory.mktemp("predictions"))
    predictions.write.mode("overwrite").parquet(path)
    return models, path


def test_metrics_of_written_predictions_equal_sql(spark, trained):
    """Accuracy, AUC, MAE and R2 of all six models, over the table of predictions as it was written."""
    _, path = trained
    got = {(r.model, r.metric): r.value for r in ml.evaluation(spark.read.parquet(path)).collect()}
    want = duckdb.sql(f"""
        WITH p AS (SELECT * FROM '{path}/*.parquet'),
        ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM p)
        SELECT model, 'accuracy', avg((target = prediction)::INT) FROM p WHERE model IN ('bug_detector', 'security_risk', 'severity_classifier') GROUP BY model
        UNION ALL SELECT model, 'auc', (sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * sum(1 - target))
          FROM ranked WHERE model IN ('bug_detector', 'security_risk') GROUP BY model
        UNION ALL SELECT model, 'mae', avg(abs(target - prediction)) FROM p WHERE model LIKE '%_scorer' GROUP BY model
        UNION ALL SELECT model, 'r2', 1 - sum(pow(target - prediction, 2)) / sum(pow(target - m, 2)) FROM (SELECT *, avg(target) OVER (PARTITION BY model) AS m FROM p)
          WHERE model LIKE '%_scorer' GROUP BY model""").fetchall()
    assert set(got) == {(m, k) for m, k, _ in want} and len(got) == 11
    assert all(abs(got[m, k] - v) < 1e-9 for m, k, v in want)
    assert got["maintainability_scorer", "r2"] > 0.8


def test_predictions_are_of_held_out_rows(spark, trained):
    models, path = trained
    df = training_rows(spark, TESTDATA)
    for name, (label, _, stratified) in ml.TARGETS.items():
        held = ml.split_train(df.where(F.col(label).isNotNull()), label if stratified else None).where("NOT is_train")
        assert {r.id for r in held.select("id").collect()} == {r.id for r in spark.read.parquet(path).where(F.col("model") == name).select("id").collect()}
    # Batch scores are what the models predict.
    scored = models.predict(df).select("id", "model_quality_score", "model_bug_probability")
    both = spark.read.parquet(path).join(scored, "id")
    assert both.where("model = 'quality_scorer' AND abs(greatest(0, least(100, prediction)) - model_quality_score) > 1e-9").count() == 0
    assert both.where("model = 'bug_detector' AND abs(score - model_bug_probability) > 1e-9").count() == 0
    assert both.where("model = 'bug_detector'").count() > 0


def test_spark_agrees_on_the_auc(spark, trained):
    p = spark.read.parquet(trained[1]).where("model = 'bug_detector'").withColumn("raw", array_to_vector(F.array(1 - F.col("score"), "score")))
    own = next(r.value for r in ml.evaluation(p).collect() if r.metric == "auc")
    assert abs(BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="raw").evaluate(p) - own) < 0.02
    assert p.select(vector_to_array("raw")).count() > 0


def test_texts_do_not_queue_at_the_kernel(spark, trained):
    """Rows wait for Python a batch at a time: with their texts and lines they would be written out many times over."""
    def nodes(plan):
        children = plan.children()
        inner = [plan.initialPlan()] if plan.nodeName().startswith("AdaptiveSparkPlan") else [children.apply(i) for i in range(children.size())]
        return [plan, *(x for child in inner for x in nodes(child))]

    done = review(programs(spark, TESTDATA), models=trained[0])
    steps = [x for x in nodes(done.drop("hits")._jdf.queryExecution().executedPlan()) if x.nodeName() == "ArrowEvalPython" and "project" in x.udfs().toString()]
    passed = [step.output().apply(i).name() for step in steps for i in range(step.output().size())]
    assert steps and not {"content", "folded", "lines", "folded_lines", "stripped", "syntax"} & set(passed)
    assert done.count() == programs(spark, TESTDATA).count()
    # Nor are the kernel features stored, which are five times the room of the vectors.
    assert "kernel" not in ml.training_frame(training_rows(spark, TESTDATA), trained[0].scaler).columns


def test_training_learns_from_every_row(spark, monkeypatch):
    """No row of a large table is left out of the scaler, the frame or the fits."""
    n, seen = 1_010_000, []
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(FEATURES)],
                                 F.lit("LOW").alias("label_severity"))
    monkeypatch.setattr(ml, "fit_one", lambda frame, rows, *a, **b: seen.append((frame.count(), rows)) or (None, frame.limit(0)))
    models, _ = ml.train(rows, ["severity_classifier"])
    assert seen == [(n, n)] and models.metadata["training_samples"] == n
    for i in (0, 50):
        assert abs(models.scaler[FEATURES[i]][0] - sum(k % (i + 2) for k in range(n)) / n) < 1e-9


def test_thresholds_of_large_frames_are_of_all_rows(spark):
    """Spark's trees would take them from a sample of some ten thousand rows."""
    x = F.array(F.rand(1), F.rand(2), F.when(F.rand(3) > 0.98, F.ceil(F.rand(4) * 60)).otherwise(0).cast("double"), F.lit(1.0),
                F.when(F.rand(5) > 0.99, F.rand(6)).otherwise(1.0))
    df = spark.range(24_000).select(F.col("id").cast("string").alias("id"), array_to_vector(x).alias("scaled"))
    df = df.withColumn("v", vector_to_array("scaled")).withColumn("target", (F.col("v")[0] > 0.4).cast("double") + 3 * (F.col("v")[2] > 30).cast("double"))
    df = store(df.withColumn("label_maintainability_score", F.col("target")), "frame")
    plain = boosting.cuts(df, "scaled", 5)
    filled = boosting.filled_cuts(df, "scaled", plain)
    values = np.array([r.v for r in df.select("v").collect()])
    # Frequent values leave their room to the others; the largest value is no threshold.
    assert [len(t) for t in filled] == [31, 31, 31, 0, 31] and [len(t) for t in plain][2:] == [1, 0, 0]
    assert all(set(p) <= set(f) and f == sorted(set(f)) and set(f) <= set(values[:, i]) - {values[:, i].max()} for i, (p, f) in enumerate(zip(plain, filled)))
    forest = type(ml.estimators()["maintainability_scorer"])(numTrees=3, maxDepth=6, seed=1, labelCol="target", featuresCol="scaled", featureSubsetStrategy="all")
    fitted = [ml.fit_one(df, 24_000, "maintainability_scorer", forest, filled=lambda: filled)[0],
              BoostedTrees(Boosting(rounds=8, depth=4, step=0.5), 5).fit(df),
              BoostedTrees(Boosting(rounds=4, depth=3, step=0.5, logistic=True), 5).fit(df.withColumn("target", (F.col("target") > 0).cast("double")))]
    for model in fitted:
        used = [(int(f), float(t)) for f, t in re.findall(r"feature (\d+) <= (\S+?)\)", model.toDebugString)]
        assert used and all(t in filled[f] for f, t in used)
    errors = [np.mean([abs(r.prediction - r.target) for r in m.transform(df).select("prediction", "target").collect()]) for m in fitted[:2]]
    assert max(errors) < 0.06
    # The model of the values predicts for them what the trees did for their bins.
    assert fitted[0].getFeaturesCol() == "scaled" and len(fitted[0].trees) == 3
