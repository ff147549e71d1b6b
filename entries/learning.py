"""Training data, models and scoring, from the documents' program files and the given labels."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from entries.common import features, long, programs, rounded, table
from oracle.base import LINES, PROGRAM_FILES, corpus, features as feature_ctes, heuristics
from reviewlake import review, store
from reviewlake.operators import ml, scoring
from reviewlake.packs.metric_patterns import FEATURES

LABELS = ("label_has_bug", "label_has_security_risk", "label_severity", "label_quality_score",
          "label_maintainability_score", "label_readability_score")


def rows(spark, folder):
    """Features of every file; low quality and toxicity are given for some, the other labels are the rule-based scores."""
    df = scoring.with_heuristics(features(programs(spark, folder)))
    df = df.withColumn("doc_id", F.regexp_extract("path", r"src/(\d+)", 1).cast("long"))
    given = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return df.join(given, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), *FEATURES, (1 - F.col("quality")).cast("int").alias("label_has_bug"),
        F.col("toxic").cast("int").alias("label_has_security_risk"), F.col("predicted_severity").alias("label_severity"),
        *[F.col(c).alias(f"label_{c}") for c in ("quality_score", "maintainability_score", "readability_score")], "bug_probability", "security_risk_score")


def training_rows(spark, folder):
    return rows(spark, folder).select("id", *rounded(*FEATURES))


def training_labels(spark, folder):
    return rows(spark, folder).select("id", *long(*LABELS[:2]), "label_severity", *rounded(*LABELS[3:]))


def scaler(spark, folder):
    stats = ml.scaler_stats(rows(spark, folder))
    # Digits that the order of summation can't change, and no ties of means of a thousand rows.
    near = lambda c: F.when(F.abs(c) < 1000, F.round(c, 6)).otherwise(F.round(c, 1)).alias(c)
    return stats.select("feature", near("mean"), near("scale"))


def scaled(spark, folder):
    data = rows(spark, folder)
    return ml.scale(data, ml.fit_scaler(data)).select("id", *[(F.round(n, 4) + 0.0).alias(n) for n in FEATURES])  # no -0.0


def split(label):
    def run(spark, folder):
        known = rows(spark, folder).select("id", *([label] if label else []))
        known = store(known.where(F.col(label).isNotNull()) if label else known, "labels")  # read three times
        return ml.split_train(known, label).select("id", "is_train")
    return run


def weights(label):
    def run(spark, folder):
        return ml.class_weights(rows(spark, folder), label).select("class", *long("n"), *rounded("weight"))
    return run


def regression_error(spark, folder):
    """Error of guessing the other score of the same row."""
    both = rows(spark, folder).select("label_quality_score", "label_readability_score")
    return ml.regression_error(both, "label_quality_score", "label_readability_score").select(*rounded("mae", "r2"))


def score_evaluation(spark, folder):
    """The rule-based scores as predictions of the given labels, and one score as a guess of another, by all four metrics."""
    df = store(rows(spark, folder), "rows")  # read once per model
    guess = lambda model, target, score, prediction: df.where(F.col(target).isNotNull()).select(
        F.lit(model).alias("model"), "id", F.col(target).cast("double").alias("target"), prediction.cast("double").alias("prediction"), score.alias("score"))
    bug, risk, readable = F.col("bug_probability"), F.col("security_risk_score"), F.col("label_readability_score")
    parts = [guess("bug_detector", "label_has_bug", bug, bug > 0.1), guess("security_risk", "label_has_security_risk", risk, risk > 0.1),
             guess("quality_scorer", "label_quality_score", readable, readable)]
    return ml.evaluation(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("model", "metric", *rounded("value"))


def fit(model):
    def run(spark, folder):
        _, predictions = ml.train(rows(spark, folder), [model])
        return ml.evaluation(predictions)
    return run


@lru_cache(maxsize=2)
def _fitted(spark, folder):
    """All six models; the queries that only read them share one fit."""
    return ml.train(rows(spark, folder))[0]


def batch_scores(spark, folder):
    """The fitted models applied to the program files."""
    done = review(programs(spark, folder), models=_fitted(spark, folder))
    return done.select("path", "language", "predicted_severity",
                       *rounded("bug_probability", "security_risk_score", "quality_score", "maintainability_score", "readability_score", "overall"))


def metadata(spark, folder):
    return ml.metadata_table(spark, _fitted(spark, folder))


def importances(spark, folder):
    return ml.importances(spark, _fitted(spark, folder))


ROWS = ("rows AS (SELECT CAST(doc_id AS VARCHAR) AS id, h.*, CAST(1 - quality AS BIGINT) AS label_has_bug, "
        "CAST(toxic AS BIGINT) AS label_has_security_risk, predicted_severity AS label_severity, quality_score AS label_quality_score, "
        "maintainability_score AS label_maintainability_score, readability_score AS label_readability_score "
        "FROM (SELECT CAST(regexp_extract(path, 'src/([0-9]+)', 1) AS BIGINT) AS doc_id, * FROM heuristics) h LEFT JOIN "
        "(SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))")


def _rows(select: str) -> str:
    return corpus(select, PROGRAM_FILES, LINES, feature_ctes(), heuristics(), ROWS)


_r = lambda names, d=6: ", ".join(f"round(CAST({n} AS DOUBLE), {d}) AS {n}" for n in names)
_hash = "('0x' || substr(md5('split|' || id), 1, 8))::BIGINT"


def _split(stratum: str, where: str = "TRUE") -> str:
    return _rows(f"SELECT id, row_number() OVER (PARTITION BY {stratum} ORDER BY {_hash}, id) <= "
                 f"round(count(*) OVER (PARTITION BY {stratum}) * 0.8) AS is_train FROM rows WHERE {where}")


def _weights(label: str) -> str:
    return _rows(f"SELECT CAST({label} AS VARCHAR) AS class, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) "
                 f"/ (count(*) OVER () * count(*)), 6) AS weight FROM rows WHERE {label} IS NOT NULL GROUP BY {label}")


_near = lambda x: f"CASE WHEN abs({x}) < 1000 THEN round({x}, 6) ELSE round({x}, 1) END"
_z = lambda n: f"({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () > 0 THEN stddev_pop({n}) OVER () ELSE 1 END"

ENTRIES = {
    "training_rows": (training_rows, _rows(f"SELECT id, {_r(FEATURES)} FROM rows")),
    "training_labels": (training_labels, _rows(
        f"SELECT id, label_has_bug, label_has_security_risk, label_severity, {_r(LABELS[3:])} FROM rows")),
    "scaler_statistics": (scaler, _rows(" UNION ALL ".join(
        f"SELECT '{n}' AS feature, {_near(f'avg({n})')} AS mean, {_near(f'stddev_pop({n})')} AS scale FROM rows" for n in FEATURES))),
    "scaled_features": (scaled, _rows("SELECT id, " + ", ".join(f"round({_z(n)}, 4) + 0.0::DOUBLE AS {n}" for n in FEATURES) + " FROM rows")),
    "split_stratified": (split("label_severity"), _split("label_severity")),
    "split_labelled": (split("label_has_bug"), _split("label_has_bug", "label_has_bug IS NOT NULL")),
    "split_plain": (split(None), _split("1")),
    "class_weights_severity": (weights("label_severity"), _weights("label_severity")),
    "class_weights_bug": (weights("label_has_bug"), _weights("label_has_bug")),
    "regression_error": (regression_error, _rows(
        "SELECT round(avg(abs(label_quality_score - label_readability_score)), 6) AS mae, "
        "round(1 - sum(pow(label_quality_score - label_readability_score, 2)) / (var_pop(label_quality_score) * count(*)), 6) AS r2 FROM rows")),
    "score_evaluation": (score_evaluation, _rows(
        "SELECT model, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(
            f"SELECT '{model}' AS model, 'accuracy' AS metric, avg(CASE WHEN ({score} > 0.1) = ({label} = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM rows WHERE {label} IS NOT NULL "
            f"UNION ALL SELECT '{model}', 'auc', CASE WHEN sum({label}) > 0 AND sum(1 - {label}) > 0 THEN (sum(r) FILTER ({label} = 1) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE) "
            f"/ (sum({label}) * sum(1 - {label})) END FROM (SELECT {label}, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM rows WHERE {label} IS NOT NULL)"
            for model, label, score in (("bug_detector", "label_has_bug", "bug_probability"), ("security_risk", "label_has_security_risk", "security_risk_score")))
        + " UNION ALL SELECT 'quality_scorer', 'mae', avg(abs(label_quality_score - label_readability_score)) FROM rows "
        "UNION ALL SELECT 'quality_scorer', 'r2', 1 - sum(pow(label_quality_score - label_readability_score, 2)) / (var_pop(label_quality_score) * count(*)) FROM rows)")),
    **{f"train_{name}": (fit(name), None) for name in ml.TARGETS},
    "batch_model_scores": (batch_scores, None),
    "model_metadata": (metadata, None),
    "feature_importances": (importances, None),
}
