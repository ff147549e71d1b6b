"""Writers: findings as CSV, results as JSON, scan history, report data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.functions.text import round1
from reviewlake.operators import rollup, scoring
from reviewlake.operators.files import file_name
from reviewlake.packs.metric_patterns import FEATURES
from reviewlake.sources.snapshots import _fs

# --- Fixed values -----------------------------------------------------------
CSV_COLUMNS = ("file", "language", "severity", "category", "title", "description", "line_number", "suggestion",
               "rule_id", "overall_score")
NO_ISSUES = "No issues found"
REPORT_LISTING = 50
SCORE_TITLES = (("Overall Health", "overall"), ("Code Quality", "quality"), ("Security", "security"),
                ("Maintainability", "maintainability"), ("Performance", "performance"), ("Readability", "readability"))
SECTION_FILES = {"markdown": 10, "html": 15, "pdf": 0}
SECTION_ISSUES = {"markdown": 20, "html": 20, "pdf": 15}
# ----------------------------------------------------------------------------


def csv_rows(reviewed: DataFrame, packs=None) -> DataFrame:
    """One row per finding in the CSV layout; one sentinel row when there is none.

    Scores and findings share a row in ``reviewed``, so nothing is joined back.
    """
    from reviewlake.operators.rules import explode_issues

    keys = ("project_id", "path", "language", "overall")
    rows = explode_issues(reviewed, packs, keys).select(
        file_name(F.col("path")).alias("file"), "language", "severity", "category", "title", "description",
        F.col("line_number").cast("string").alias("line_number"), "suggestion", "rule_id",
        round1(F.col("overall")).cast("string").alias("overall_score"))
    sentinel = reviewed.agg(F.sum("total").alias("n")).where("coalesce(n, 0) = 0").select(
        *[F.lit(NO_ISSUES if c == "file" else "").alias(c) for c in CSV_COLUMNS])
    return rows.unionByName(sentinel)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def _per_project(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A short ranked list of each project as one array."""
    return rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def json_records(reviewed: DataFrame, packs=None, seconds: float | None = None) -> DataFrame:
    """JSON lines: one ``file`` record per file, one ``project`` record per project.

    A single document per project would gather a whole project in one task; the
    findings of a file are nested inside the file's own row instead.
    """
    from reviewlake.operators.rules import described, explode_issues, rule_texts

    def finding(h):
        rule = rule_texts(packs, h["rule_no"])
        return F.struct(
            rule["rule_id"].alias("rule_id"), rule["title"].alias("title"),
            described(rule["template"], h["line_number"], h["detail"], h["snippet"]).alias("description"),
            h["severity"].alias("severity"), h["category"].alias("category"), h["line_number"].alias("line_number"),
            F.lit(0).alias("column"), F.lit(0).alias("end_line"), rule["suggestion"].alias("suggestion"),
            rule["reason"].alias("reason"), h["snippet"].alias("code_snippet"))

    named = F.transform("hits", finding)
    files = reviewed.select(
        "project_id", F.lit("file").alias("record"),
        F.to_json(F.struct(
            F.col("path").alias("file_path"), file_name(F.col("path")).alias("filename"), "language",
            F.struct(*scoring.SCORES).alias("scores"), F.struct(*scoring.ML_SCORES).alias("ml_scores"),
            F.struct(*FEATURES).alias("features"), named.alias("issues"),
            F.struct(*rollup.COUNTS).alias("issue_summary"), "parse_errors", "error")).alias("value"))
    summary = rollup.project_reviews(reviewed)
    found = explode_issues(reviewed, packs)
    lists = (
        _per_project(rollup.language_distribution(reviewed), "language_distribution", "language", "files", "percentage"),
        _per_project(rollup.problem_files(reviewed), "most_problematic_files", "rank", "path", "overall", "language"),
        _per_project(rollup.top_issues(found), "top_critical_issues", "rank", "title", "severity", "path", "line_number"))
    heads = summary.withColumn("duration_seconds", F.lit(seconds).cast("double"))
    for part in lists:  # at most a few dozen entries per project
        heads = heads.join(part, "project_id", "left")
    heads = heads.select(
        "project_id", F.lit("project").alias("record"),
        F.to_json(F.struct(
            F.struct(F.current_timestamp().alias("generated_at"), F.lit("json").alias("format")).alias("report_metadata"),
            F.struct(*summary.columns, "duration_seconds").alias("summary"),
            "language_distribution", "most_problematic_files", "top_critical_issues")).alias("value"))
    return files.unionByName(heads)


def write_json(records: DataFrame, path: str) -> None:
    """JSON lines in a folder per kind of record, each written by itself: a dynamic partition would sort all rows first."""
    fs, at = _fs(records.sparkSession, path)
    if fs.exists(at):
        raise FileExistsError(path)
    kinds = records.select("project_id", "record", "value")
    for kind in ("file", "project"):
        kinds.where(F.col("record") == kind).drop("record").write.mode("errorifexists").json(f"{path}/record={kind}")


def analysis_rows(reviewed: DataFrame, scan_id: int, created_at, seconds: float) -> DataFrame:
    """Summary row of one scan per project, in the history layout."""
    s = rollup.project_reviews(reviewed)
    renamed = {f"{n}_score": n for n in scoring.SCORES} | {f"{n}_issues": n for n in rollup.COUNTS}
    return s.select(F.lit(scan_id).cast("long").alias("analysis_id"), "project_id",
                    F.lit(created_at).cast("timestamp").alias("created_at"),
                    F.lit(float(seconds)).alias("duration_seconds"), "total_files",
                    *[F.col(v).alias(k) for k, v in renamed.items()])


def report_sections(reviewed: DataFrame, issues: DataFrame, form: str = "markdown") -> DataFrame:
    """Data of a project report as (project_id, section, rank, label, value, extra).

    Reads ``reviewed`` several times: pass a stored review, not a lazy one.
    """
    named = scoring.short_label if form == "markdown" else scoring.label

    def row(section, rank, title, value, extra):
        return F.struct(F.lit(section).alias("section"), F.lit(rank).alias("rank"), F.lit(title).alias("label"),
                        value.cast("double").alias("value"), extra.alias("extra"))

    summary = rollup.project_reviews(reviewed)
    score_rows = [row("scores", i, title, F.col(name), named(F.col(name)))
                  for i, (title, name) in enumerate(SCORE_TITLES)]
    count_rows = [row("issues", i, name.title(), F.col(name), F.lit(""))
                  for i, name in enumerate((*rollup.COUNTS[1:], "total"))]
    numbers = summary.select("project_id", F.inline(F.array(*score_rows, *count_rows)))
    languages = rollup.language_distribution(reviewed).select(
        "project_id", F.lit("languages").alias("section"), F.lit(0).alias("rank"), F.col("language").alias("label"),
        F.col("files").cast("double").alias("value"), F.col("percentage").cast("string").alias("extra"))
    parts = [numbers, languages]
    if SECTION_FILES[form]:
        listed = rollup.problem_files(reviewed, SECTION_FILES[form])
        parts.append(listed.select(
            "project_id", F.lit("files").alias("section"), "rank", F.col("path").alias("label"),
            round1(F.col("overall")).alias("value"), F.col("language").alias("extra")))
    parts.append(rollup.top_issues(issues, SECTION_ISSUES[form]).select(
        "project_id", F.lit("top_issues").alias("section"), "rank", F.col("title").alias("label"),
        F.col("line_number").cast("double").alias("value"), F.col("path").alias("extra")))
    return reduce(DataFrame.unionByName, parts)


def list_reports(spark: SparkSession, folder: str, k: int = REPORT_LISTING) -> DataFrame:
    """Newest ``k`` report files; only file metadata is read, never the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(file_name(F.col("path")).alias("name"), "path", F.col("length").alias("size"),
                        F.col("modificationTime").alias("created"),
                        F.regexp_extract("path", r"\.([^./]*)$", 1).alias("format")).orderBy(
        F.desc("created"), "path").limit(k)
