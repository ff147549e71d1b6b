"""Scores and labels: projections over features and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.text import round1

# --- Fixed values -----------------------------------------------------------
WEIGHTS = {"quality": 0.30, "security": 0.25, "maintainability": 0.20, "performance": 0.15, "readability": 0.10}
SCORES = ("overall", "quality", "security", "maintainability", "performance", "readability")
PERFORMANCE_COST = {"CRITICAL": 20, "HIGH": 12, "MEDIUM": 6, "LOW": 2}
GRADES = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D"))
LABELS = ((85, "Excellent"), (70, "Good"), (55, "Fair"), (40, "Poor"))
COLOURS = ((85, "excellent"), (70, "good"), (55, "fair"))
# ----------------------------------------------------------------------------

ML_SCORES = ("bug_probability", "security_risk_score", "quality_score", "maintainability_score",
             "readability_score", "predicted_severity")


def _clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _upto(limit: float, x: Column) -> Column:
    return F.least(F.lit(limit), x)


def _ladder(score: Column, steps, bottom: str) -> Column:
    result = None
    for floor, label in steps:
        result = F.when(score >= floor, label) if result is None else result.when(score >= floor, label)
    return result.otherwise(bottom)


def grade(score: Column) -> Column:
    return _ladder(score, GRADES, "F")


def label(score: Column) -> Column:
    return _ladder(score, LABELS, "Critical")


def short_label(score: Column) -> Column:
    """Label scale without the lowest step (used by the plain-text report)."""
    return _ladder(score, LABELS[:3], "Poor")


def colour(score: Column) -> Column:
    return _ladder(score, COLOURS, "poor")


def bug_probability() -> Column:
    f = F.col
    complexity = (F.when(f("cyclomatic_complexity") > 20, 0.3)
                  .when(f("cyclomatic_complexity") > 10, 0.15).otherwise(0.0))
    step = lambda test, points: F.when(test, points).otherwise(0.0)
    total = (complexity + step(f("duplicate_ratio") > 0.2, 0.1) + step(f("nested_loops") > 3, 0.15)
             + step((f("exception_handling") == 0) & (f("function_count") > 3), 0.1)
             + step(f("long_methods") > 5, 0.1))
    return _upto(1.0, total)


def security_risk() -> Column:
    f = F.col
    total = (_upto(0.4, f("hardcoded_credentials") * 0.2) + _upto(0.3, f("eval_usage") * 0.15)
             + _upto(0.2, f("shell_executions") * 0.1) + _upto(0.1, f("sql_queries") * 0.02))
    return _upto(1.0, total)


def quality() -> Column:
    f = F.col
    return _clamp(70.0 - _upto(30.0, f("cyclomatic_complexity") * 0.8) - _upto(15.0, f("magic_numbers") * 0.5)
                  - _upto(15.0, f("duplicate_ratio") * 50) + _upto(10.0, f("comment_ratio") * 30)
                  - _upto(10.0, f("naming_violations") * 0.3))


def maintainability() -> Column:
    return F.col("maintainability_index")


def readability() -> Column:
    f = F.col
    return _clamp(70.0 + _upto(15.0, f("comment_ratio") * 50) - _upto(20.0, f("avg_function_length") * 0.1)
                  - _upto(15.0, f("naming_violations") * 0.5) - _upto(10.0, f("magic_numbers") * 0.3))


def predicted_severity() -> Column:
    f = F.col
    return (F.when((f("hardcoded_credentials") > 0) | (f("eval_usage") > 2), "CRITICAL")
            .when((f("cyclomatic_complexity") > 30) | (f("shell_executions") > 3), "HIGH")
            .when((f("cyclomatic_complexity") > 15) | (f("duplicate_ratio") > 0.3), "MEDIUM")
            .when((f("magic_numbers") > 10) | (f("naming_violations") > 10), "LOW")
            .otherwise("INFO"))


HEURISTICS = {
    "bug_probability": bug_probability, "security_risk_score": security_risk, "quality_score": quality,
    "maintainability_score": maintainability, "readability_score": readability,
    "predicted_severity": predicted_severity,
}


def with_heuristics(files: DataFrame) -> DataFrame:
    """Add the six rule-based scores."""
    return files.withColumns({name: make() for name, make in HEURISTICS.items()})


def with_fallback(files: DataFrame, available: set[str]) -> DataFrame:
    """Use model outputs (``model_<score>`` columns) where a model exists.

    A missing model falls back to that score's heuristic; a null model output
    (failed prediction) makes all six scores of the file heuristic.
    """
    usable = [n for n in ML_SCORES if n in available]
    if not usable:
        return with_heuristics(files)
    complete = None
    for name in usable:
        ok = F.col(f"model_{name}").isNotNull()
        complete = ok if complete is None else complete & ok
    chosen = {}
    for name, make in HEURISTICS.items():
        chosen[name] = F.when(complete, F.col(f"model_{name}")).otherwise(make()) if name in usable else make()
    return files.withColumns(chosen).drop(*[f"model_{n}" for n in usable])


def performance_score() -> Column:
    """From performance findings of the file and its nesting features."""
    cost = F.lit(0.0)
    for severity, points in PERFORMANCE_COST.items():
        n = F.expr(f"size(filter(hits, h -> h.category = 'performance' AND h.severity = '{severity}'))")
        cost = cost + n * points
    return _clamp(100.0 - cost - _upto(20.0, F.col("nested_loops") * 5) - _upto(10.0, F.col("nested_iterations") * 3))


def health(weights: dict[str, float] | None = None) -> Column:
    """Weighted overall score, clamped to 0-100 and rounded to one decimal."""
    w = {**WEIGHTS, **(weights or {})}
    total = None
    for name in WEIGHTS:
        part = F.col(name) * w[name]
        total = part if total is None else total + part
    return round1(_clamp(total))


def with_scores(files: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add quality, security, maintainability, performance, readability, overall."""
    df = files.withColumns({
        "quality": F.col("quality_score"),
        "security": (1.0 - F.col("security_risk_score")) * 100,
        "maintainability": F.col("maintainability_score"),
        "performance": performance_score(),
        "readability": F.col("readability_score"),
    })
    return df.withColumn("overall", health(weights))


def with_issue_counts(files: DataFrame) -> DataFrame:
    """Add total / critical / high / medium / low / info counts of the file."""
    counts = {"total": F.size("hits").cast("long")}
    for severity in ("critical", "high", "medium", "low", "info"):
        counts[severity] = F.expr(f"CAST(size(filter(hits, h -> h.severity = '{severity.upper()}')) AS BIGINT)")
    return files.withColumns(counts)


def score_series(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The five component scores unpivoted to (label, value), without overall."""
    return scores.unpivot(keys, [F.col(s) for s in SCORES[1:]], "label", "value")
