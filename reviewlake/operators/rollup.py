"""Project roll-ups of reviewed files and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.functions.text import exact_mean, round1
from reviewlake.operators.scoring import ML_SCORES, SCORES
from reviewlake.operators.topk import keep_where, top_per_group
from reviewlake.packs.rules import SEVERITIES

COUNTS = ("total", "critical", "high", "medium", "low", "info")

# --- Fixed values -----------------------------------------------------------
PROBLEM_FILES = 10
DASHBOARD_FILES = 5
TOP_ISSUES = 50
PREDICTION_ROWS = 10
PROBLEM_WEIGHT = {"critical": 100, "high": 10, "medium": 1}
# ----------------------------------------------------------------------------


def file_summary(reviewed: DataFrame) -> DataFrame:
    """Issue counts of every file, clean files included."""
    return reviewed.select("project_id", "path", "language", *COUNTS)


def project_scores(reviewed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the six scores over files without error (0.0 when there is none).

    Scores of failed files are null and drop out of the means by themselves.
    Sums accumulate as decimals, so the result does not depend on task order.
    """
    means = [F.coalesce(round1(exact_mean(F.col(s))), F.lit(0.0)).alias(s) for s in SCORES]
    return reviewed.groupBy(*(by or ["project_id"])).agg(*means)


def project_issue_counts(reviewed: DataFrame) -> DataFrame:
    """Sum of the file summaries."""
    return reviewed.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def file_counts(reviewed: DataFrame) -> DataFrame:
    """Files seen, analysed and failed."""
    failed = F.count("error")
    return reviewed.groupBy("project_id").agg(
        F.count("*").alias("total_files"), (F.count("*") - failed).alias("analyzed_files"),
        failed.alias("failed_files"))


def project_reviews(reviewed: DataFrame) -> DataFrame:
    """The whole project summary in one aggregation (one shuffle)."""
    failed = F.count("error")
    return reviewed.groupBy("project_id").agg(
        F.count("*").alias("total_files"), (F.count("*") - failed).alias("analyzed_files"),
        failed.alias("failed_files"),
        *[F.coalesce(round1(exact_mean(F.col(s))), F.lit(0.0)).alias(s) for s in SCORES],
        *[F.sum(c).alias(c) for c in COUNTS])


def language_distribution(reviewed: DataFrame) -> DataFrame:
    """Files per project and language, failed ones included, with share in %."""
    counts = reviewed.groupBy("project_id", "language").agg(F.count("*").alias("files"))
    total = F.sum("files").over(Window.partitionBy("project_id"))  # one row per language
    return counts.withColumn("percentage", round1(F.col("files") / total * 100))


def problem_weight() -> Column:
    total = F.lit(0)
    for name, weight in PROBLEM_WEIGHT.items():
        total = total + F.col(name) * weight
    return total


def problem_files(reviewed: DataFrame, k: int = PROBLEM_FILES) -> DataFrame:
    """Per project the ``k`` files with the heaviest findings."""
    scored = reviewed.select(
        "project_id", "path", "language", "overall", *COUNTS,
        F.when(F.col("error").isNull(), problem_weight()).alias("weight"))
    # Failed files have a null weight and sort last; they are dropped after ranking.
    ranked = top_per_group(scored, ["project_id"], [F.desc_nulls_last("weight"), F.col("path")], k)
    return ranked.where(F.col("weight").isNotNull())


def top_issues(issues: DataFrame, k: int = TOP_ISSUES) -> DataFrame:
    """Per project the first ``k`` CRITICAL / HIGH findings, CRITICAL first."""
    severe = issues.where(F.col("severity").isin("CRITICAL", "HIGH"))
    return top_per_group(severe, ["project_id"], [F.col("severity_rank"), F.col("path"), F.col("line_number"),
                                                  F.col("detect_seq")], k)


def severity_share(project_counts: DataFrame) -> DataFrame:
    """Share of each severity in a project's findings, in %."""
    long = project_counts.unpivot(["project_id", "total"], list(COUNTS[1:]), "severity", "issues")
    return long.select("project_id", F.upper("severity").alias("severity"), "issues",
                       (F.col("issues") / F.greatest("total", F.lit(1)) * 100).alias("share"))


def files_with_severity(reviewed: DataFrame, severity: str = "ALL") -> DataFrame:
    """Files with a finding of the severity; ALL: any finding or an error."""
    if severity == "ALL":
        test = (F.col("total") > 0) | F.col("error").isNotNull()
    else:
        test = F.col(severity.lower()) > 0
    return keep_where(reviewed.select("project_id", "path", "language", "total", test.alias("_test")),
                      F.col("_test")).drop("_test")


def severity_series(issues: DataFrame) -> DataFrame:
    """Five severities in fixed order per project, 0 where none were found."""
    counted = issues.groupBy("project_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    slots = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("severity"), F.col(s).alias("issues"))
                      for i, s in enumerate(SEVERITIES)])
    return counted.select("project_id", F.inline(slots))


def hide_info(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("severity") != "INFO")


def model_averages(reviewed: DataFrame) -> DataFrame:
    """Model scores averaged over all files; a missing score counts as 0."""
    return reviewed.groupBy("project_id").agg(
        *[exact_mean(F.coalesce(F.col(s), F.lit(0.0))).alias(f"avg_{s}") for s in ML_SCORES[:5]])


def first_predictions(files: DataFrame, review, k: int = PREDICTION_ROWS) -> DataFrame:
    """First ``k`` files by path with their model scores; ``review`` reads no other file."""
    first = files.select("path").orderBy("path").limit(k)  # the bound allows a broadcast
    chosen = files.join(F.broadcast(first.distinct()), "path", "left_semi")
    return review(chosen).select("path", "language", *ML_SCORES).orderBy("path").limit(k)
