"""Scores and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import features, long, programs, reviewed, rounded, sql_rounded, table
from oracle.base import from_features, from_review, round1
from reviewlake.operators import scoring

HEURISTICS = ("bug_probability", "security_risk_score", "quality_score", "maintainability_score", "readability_score")
WEIGHTS = {"quality": 0.1, "security": 0.6, "maintainability": 0.1, "performance": 0.1, "readability": 0.1}


def column(*names):
    return lambda spark, folder: reviewed(spark, folder).select("path", *rounded(*names))


def heuristic(name):
    def run(spark, folder):
        df = features(programs(spark, folder)).withColumn(name, scoring.HEURISTICS[name]())
        return df.select("path", name) if name == "predicted_severity" else df.select("path", *rounded(name))
    return run


def overall_weighted(spark, folder):
    return reviewed(spark, folder, weights=WEIGHTS).select("path", "overall")


def labels(spark, folder):
    """Grades, labels and colours of the scan scores."""
    score = F.least(F.col("value"), F.lit(100.0))
    return table(spark, folder, "events").select(
        "event_id", scoring.grade(score).alias("grade"), scoring.label(score).alias("label"),
        scoring.colour(score).alias("colour"))


def ratings(spark, folder):
    """Report ratings, with and without the lowest step."""
    return table(spark, folder, "events").select(
        "event_id", scoring.label(F.col("value")).alias("rating"), scoring.short_label(F.col("value")).alias("short_rating"))


def fallback(spark, folder):
    """A quality model that answers for odd files only; no other model exists."""
    number = F.regexp_extract("path", r"src/(\d+)", 1).cast("long")
    df = features(programs(spark, folder)).withColumn(
        "model_quality_score", F.when(F.pmod(number, F.lit(2)) == 1, F.pmod(number, F.lit(101)).cast("double")))
    done = scoring.with_fallback(df, {"quality_score"})
    return done.select("path", "predicted_severity", *rounded(*HEURISTICS))


_ladder = lambda x, steps, low: "CASE " + " ".join(f"WHEN {x} >= {a} THEN '{b}'" for a, b in steps) + f" ELSE '{low}' END"
_grade = _ladder("s", ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D")), "F")
_label = lambda x: _ladder(x, ((85, "Excellent"), (70, "Good"), (55, "Fair"), (40, "Poor")), "Critical")
_short = _ladder("value", ((85, "Excellent"), (70, "Good"), (55, "Fair")), "Poor")
_colour = _ladder("s", ((85, "excellent"), (70, "good"), (55, "fair")), "poor")
_scored = lambda *names: from_review(f"SELECT path, {sql_rounded(*names)} FROM reviewed")
_number = "CAST(regexp_extract(path, 'src/([0-9]+)', 1) AS BIGINT)"

ENTRIES = {
    "performance_score": (column("performance"), _scored("performance")),
    "security_score": (column("security"), _scored("security")),
    "health_score": (column("overall"), _scored("overall")),
    "health_score_weights": (overall_weighted, from_review(
        "SELECT path, overall FROM reviewed", weights=(0.1, 0.6, 0.1, 0.1, 0.1))),
    "score_grades": (labels, f"SELECT event_id, {_grade} AS grade, {_label('s')} AS label, {_colour} AS colour "
                             "FROM (SELECT event_id, least(value, 100) AS s FROM events)"),
    "report_ratings": (ratings, f"SELECT event_id, {_label('value')} AS rating, {_short} AS short_rating FROM events"),
    **{f"heuristic_{n.removesuffix('_score')}": (heuristic(n), from_review(f"SELECT path, {sql_rounded(n)} FROM heuristics"))
       for n in HEURISTICS},
    "heuristic_severity": (heuristic("predicted_severity"), from_review("SELECT path, predicted_severity FROM heuristics")),
    "model_fallback": (fallback, from_review(
        f"SELECT path, predicted_severity, {sql_rounded(*[n for n in HEURISTICS if n != 'quality_score'])}, "
        f"round(CAST(CASE WHEN {_number} % 2 = 1 THEN {_number} % 101 ELSE quality_score END AS DOUBLE), 6) AS quality_score FROM heuristics")),
}
