"""Scan history: look-up, comparison, search and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.operators.topk import top_per_group

# --- Fixed values -----------------------------------------------------------
HISTORY_ROWS = 20
SEARCH_ROWS = 50
SUMMARY = ("analysis_id", "project_id", "created_at", "duration_seconds", "overall_score", "total_files",
           "total_issues", "critical_issues")
# ----------------------------------------------------------------------------


def newest_first() -> list[Column]:
    """Total order: newest scan first, later id first on equal times."""
    return [F.desc("created_at"), F.desc("analysis_id")]


def get(table: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values (pushed down to the scan)."""
    for name, value in keys.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def latest_per_project(analyses: DataFrame) -> DataFrame:
    """Newest scan of each project; a plain aggregate, partial on the map side."""
    row = F.struct(*analyses.columns)
    newest = analyses.groupBy("project_id").agg(
        F.max_by(row, F.struct("created_at", "analysis_id")).alias("row"))
    return newest.select("row.*")


def history(analyses: DataFrame, k: int = HISTORY_ROWS) -> DataFrame:
    """Newest ``k`` scans of each project, summary columns only."""
    return top_per_group(analyses.select(*SUMMARY), ["project_id"], newest_first(), k)


def list_projects(projects: DataFrame) -> DataFrame:
    """Last analysed first (never analysed last), then newest first."""
    return projects.orderBy(F.desc_nulls_last("last_analyzed"), F.desc("created_at"), "project_id")


def compare(analyses: DataFrame, left: int, right: int) -> DataFrame:
    """Two scans side by side with their differences; one pass, one row."""
    pick = lambda scan, column: F.max(F.when(F.col("analysis_id") == scan, F.col(column)))
    both = analyses.where(F.col("analysis_id").isin(left, right)).agg(*[
        pick(scan, column).alias(f"{side}_{name}")
        for side, scan in (("left", left), ("right", right))
        for name, column in (("date", "created_at"), ("score", "overall_score"), ("issues", "total_issues"),
                             ("files", "total_files"))])
    return both.withColumns({f"diff_{n}": F.col(f"right_{n}") - F.col(f"left_{n}")
                             for n in ("score", "issues", "files")})


def compare_consecutive(analyses: DataFrame, bucket: str = "hour") -> DataFrame:
    """Every scan against the one before it in its project.

    A window over a whole project would put a hot project into one task.  The
    lag runs inside (project, time bucket) instead, and the first scan of a
    bucket takes the last scan of the project's previous bucket, found from one
    aggregated row per bucket.
    """
    values = ("analysis_id", "overall_score", "total_issues", "total_files")
    df = analyses.select("project_id", "created_at", *values,
                         F.date_trunc(bucket, "created_at").alias("_bucket"))
    when = F.struct("created_at", "analysis_id")
    inside = Window.partitionBy("project_id", "_bucket").orderBy("created_at", "analysis_id")
    across = Window.partitionBy("project_id").orderBy("_bucket")
    last = (df.groupBy("project_id", "_bucket").agg(F.max_by(F.struct(*values), when).alias("_last"))
            .withColumn("_carried", F.lag("_last").over(across)).select("project_id", "_bucket", "_carried"))
    pairs = (df.withColumn("_prev", F.lag(F.struct(*values)).over(inside))
             .join(last, ["project_id", "_bucket"], "left")
             .withColumn("_prev", F.coalesce("_prev", "_carried")))
    return pairs.where(F.col("_prev").isNotNull()).select(
        "project_id", F.col("_prev.analysis_id").alias("left_id"), F.col("analysis_id").alias("right_id"),
        (F.col("overall_score") - F.col("_prev.overall_score")).alias("diff_score"),
        (F.col("total_issues") - F.col("_prev.total_issues")).alias("diff_issues"),
        (F.col("total_files") - F.col("_prev.total_files")).alias("diff_files"))


def search_text() -> Column:
    """Lower-cased JSON of the finding's own columns."""
    return F.lower(F.to_json(F.struct("title", "description", "severity", "category", "line_number", "suggestion",
                                      "reason", "rule_id", "code_snippet")))


def search_issues(analyses: DataFrame, issues: DataFrame, query: str = "", severity: str | None = None,
                  language: str | None = None, category: str | None = None, limit: int = SEARCH_ROWS,
                  scans: int | None = None) -> DataFrame:
    """Matching findings, first ``limit`` by newest scan, then in report order.

    All scans are searched unless the caller asks for the newest ``scans``.
    """
    searched = analyses.groupBy("analysis_id").agg(F.max("created_at").alias("created_at"))  # a scan may hold many projects
    if scans is not None:
        searched = searched.orderBy(*newest_first()).limit(scans)
    found = issues.join(searched, "analysis_id")
    for name, wanted in (("severity", severity), ("language", language), ("category", category)):
        if wanted:
            found = found.where(F.lower(name) == wanted.lower())
    if query:
        found = found.where(F.contains(search_text(), F.lit(query.lower())))
    order = [*newest_first(), F.col("project_id"), F.col("path"), F.col("severity_rank"), F.col("line_number"), F.col("detect_seq")]
    return found.orderBy(*order).limit(limit)


def rehydrate(analyses: DataFrame, payload: str, schema: str) -> DataFrame:
    """Fixed columns overlaid by the keys of the JSON payload; bad JSON is ignored."""
    parsed = analyses.withColumn("_json", F.from_json(payload, schema))
    for name in parsed.schema["_json"].dataType.fieldNames():
        over = F.col(f"_json.{name}")
        parsed = parsed.withColumn(name, F.coalesce(over, F.col(name)) if name in analyses.columns else over)
    return parsed.drop("_json")


def create_projects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing projects plus incoming ones with a new path.

    Of several incoming rows with one path the smallest stays, column by column
    in their order.
    """
    first = incoming.groupBy("path").agg(F.min(F.struct(*incoming.columns)).alias("row")).select("row.*")
    fresh = first.join(existing.select("path"), "path", "left_anti")
    return existing.unionByName(fresh)


def delete_projects(projects: DataFrame, analyses: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given project ids."""
    ids = doomed.select("project_id").distinct()
    return (projects.join(ids, "project_id", "left_anti"), analyses.join(ids, "project_id", "left_anti"))


def touch_projects(projects: DataFrame, analyses: DataFrame) -> DataFrame:
    """Set last_analyzed to the newest scan of the project."""
    newest = analyses.groupBy("project_id").agg(F.max("created_at").alias("_scanned"))
    return (projects.join(newest, "project_id", "left")
            .withColumn("last_analyzed", F.greatest("last_analyzed", "_scanned")).drop("_scanned"))


def throughput(analyses: DataFrame) -> DataFrame:
    """Per project: total and mean duration, files per second."""
    seconds = F.sum(F.col("duration_seconds").cast("decimal(28,6)")).cast("double")
    return analyses.groupBy("project_id").agg(
        F.count("*").alias("scans"), F.sum("total_files").alias("files"), seconds.alias("seconds"),
        (seconds / F.count("*")).alias("mean_seconds"),
        F.try_divide(F.sum("total_files"), seconds).alias("files_per_second"))


def dashboard(analyses: DataFrame, projects: DataFrame) -> DataFrame:
    """Totals and the newest scan in one row."""
    newest = F.max_by(F.struct(*SUMMARY), F.struct("created_at", "analysis_id"))
    scans = analyses.agg(F.count("*").alias("total_analyses"), newest.alias("latest"))
    known = projects.agg(F.count("*").alias("total_projects"))
    both = scans.unionByName(known, allowMissingColumns=True).agg(
        F.max("total_analyses").alias("total_analyses"), F.max("total_projects").alias("total_projects"),
        F.max("latest").alias("latest"))
    return both.select("total_analyses", "total_projects", *[F.col(f"latest.{c}").alias(f"latest_{c}") for c in SUMMARY])
