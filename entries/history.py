"""Scan history, search and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import found, long, projects, reviewed, rounded, scans, table
from oracle.base import from_issues
from reviewlake.operators import enrich, history, rules
from reviewlake.packs.explanations import FIELDS

SUMMARY = history.SUMMARY
SCANS = (
    "scans AS (SELECT event_id AS analysis_id, user_id AS project_id, ts AS created_at, value / 10 AS duration_seconds, "
    "least(greatest(value, 0.0), 100.0)::DOUBLE AS overall_score, event_id % 40 + 1 AS total_files, event_id % 17 AS total_issues, "
    "event_id % 3 AS critical_issues FROM events), "
    "projects AS (SELECT user_id AS project_id, 'user' || user_id AS name, '/data/user' || user_id AS path, "
    "min(ts) AS created_at, max(CASE WHEN event_type = 'error' THEN ts END) AS last_analyzed FROM events GROUP BY user_id)")


def _scans(select):
    return f"WITH {SCANS} {select}"


_summary = ", ".join(SUMMARY)


def scan_by_id(spark, folder):
    return history.get(scans(spark, folder), analysis_id=7).select(*SUMMARY)


def project_by_path(spark, folder):
    return history.get(projects(spark, folder), path="/data/user8").select("project_id", "name")


def latest(spark, folder):
    return history.latest_per_project(scans(spark, folder)).select(*SUMMARY)


def newest(spark, folder):
    return history.history(scans(spark, folder)).select(*SUMMARY, *long("rank"))


def project_list(spark, folder):
    return history.list_projects(projects(spark, folder)).select("project_id", "name", "last_analyzed", "created_at")


def compare(spark, folder):
    return history.compare(scans(spark, folder), 10, 20).select(
        "left_score", "right_score", "left_issues", "right_issues", "left_files", "right_files",
        *rounded("diff_score"), "diff_issues", "diff_files")


def consecutive(spark, folder):
    return history.compare_consecutive(scans(spark, folder)).select(
        "project_id", "left_id", "right_id", *rounded("diff_score"), "diff_issues", "diff_files")


def _scan_findings(spark, folder):
    """Findings with the scan they belong to: a file's number names its scan."""
    issues = rules.explode_issues(reviewed(spark, folder))
    number = F.regexp_extract("path", r"src/(\d+)", 1).cast("long")
    return issues.withColumn("analysis_id", number)


def search(**options):
    def run(spark, folder):
        hits = history.search_issues(scans(spark, folder), _scan_findings(spark, folder), **options)
        return hits.select("analysis_id", "project_id", "path", "language", "rule_id", "title", "description", "severity", "category", *long("line_number"),
                           F.coalesce("suggestion", F.lit("")).alias("suggestion"), "code_snippet")
    return run


def rehydrate(spark, folder):
    """The event properties overlay the scan's own columns; every fifth payload is broken."""
    payload = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("{broken")).otherwise(F.col("props"))
    df = table(spark, folder, "events").select("event_id", F.col("value").alias("overall"), F.lit(-1).cast("long").alias("k"),
                                               payload.alias("payload"))
    return history.rehydrate(df, "payload", "k long").select("event_id", "overall", "k")


def create(spark, folder):
    """Projects of users plus one per customer; paths that exist already are kept."""
    known = projects(spark, folder).select("path", "name")
    incoming = table(spark, folder, "customer").select(
        F.concat(F.lit("/data/user"), F.col("c_custkey").cast("string")).alias("path"),
        F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("name"))
    return history.create_projects(known, incoming)


def _doomed(spark, folder):
    return table(spark, folder, "events").where("event_type = 'error' AND value > 90").select(F.col("user_id").alias("project_id"))


def delete_cascade(spark, folder):
    kept_projects, kept_scans = history.delete_projects(
        projects(spark, folder), scans(spark, folder), _doomed(spark, folder))
    sizes = kept_scans.groupBy("project_id").agg(F.count("*").alias("scans"))
    return kept_projects.join(sizes, "project_id", "left").select("project_id", "scans")


def touch(spark, folder):
    return history.touch_projects(projects(spark, folder), scans(spark, folder)).select("project_id", "last_analyzed")


def throughput(spark, folder):
    return history.throughput(scans(spark, folder)).select(
        "project_id", "scans", *long("files"), *rounded("seconds", "mean_seconds", "files_per_second"))


def dashboard(spark, folder):
    return history.dashboard(scans(spark, folder), projects(spark, folder))


def explained(spark, folder):
    return enrich.explain(found(spark, folder)).select(
        "path", "rule_id", *long("line_number"), *FIELDS)


def standards(spark, folder):
    return enrich.standards(found(spark, folder)).select("standard", *long("findings"))


def _explanation_ctes() -> str:
    from oracle.base import _values
    from reviewlake.packs.explanations import EXPLANATIONS, FIELDS

    rows = _values((k, *v) for k, v in EXPLANATIONS.items())
    return (f"texts(explained_by, {', '.join(FIELDS)}) AS (VALUES {rows}), "
            "keyed AS (SELECT i.*, CASE WHEN rule_id IN (SELECT explained_by FROM texts) THEN rule_id "
            "WHEN contains(title, 'eval') THEN 'PYSec002' WHEN contains(title, 'Credential') OR contains(title, 'password') THEN 'PYSec003' "
            "WHEN contains(title, 'SELECT *') THEN 'SQL001' WHEN contains(title, 'gets') THEN 'CSec001' END AS key FROM issues i)")


def _explained_sql(select: str) -> str:
    from reviewlake.packs.explanations import DEFAULTS, FIELDS
    from oracle.base import text

    d = {f: text(v) for f, v in zip(FIELDS, DEFAULTS)}
    quoted = "CASE WHEN code_snippet <> '' THEN code_snippet ELSE 'at line ' || line_number END"
    cells = [f"coalesce(t.{f}, {d[f]}) AS {f}" for f in FIELDS if f != "problematic_explain"]
    explain = f"coalesce(t.problematic_explain, replace({d['problematic_explain']}, '{{fragment}}', {quoted})) AS problematic_explain"
    inner = (f"{_explanation_ctes()}, explained AS (SELECT k.path, k.rule_id, k.line_number, {explain}, {', '.join(cells)} "
             "FROM keyed k LEFT JOIN texts t ON t.explained_by = k.key)")
    body = from_issues("SELECT")
    return f"{body[:-len(' SELECT')]}, {inner} {select}"


_search = ("SELECT analysis_id, project_id, path, language, rule_id, title, description, severity, category, line_number, coalesce(suggestion, '') AS suggestion, code_snippet FROM (SELECT i.*, "
           "CAST(regexp_extract(path, 'src/([0-9]+)', 1) AS BIGINT) AS analysis_id FROM issues i) "
           "JOIN (SELECT event_id AS analysis_id, ts AS created_at FROM events) USING (analysis_id) WHERE {} "
           "ORDER BY created_at DESC, analysis_id DESC, project_id, path, severity_rank, line_number, rule_no LIMIT {}")
_joined = "lower(title || ' ' || description || ' ' || coalesce(suggestion, '') || ' ' || code_snippet || ' ' || rule_id)"

ENTRIES = {
    "scan_by_id": (scan_by_id, _scans(f"SELECT {_summary} FROM scans WHERE analysis_id = 7")),
    "project_by_path": (project_by_path, _scans("SELECT project_id, name FROM projects WHERE path = '/data/user8'")),
    "latest_scan_per_project": (latest, _scans(
        f"SELECT {_summary} FROM scans QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, analysis_id DESC) = 1")),
    "scan_history": (newest, _scans(
        f"SELECT * FROM (SELECT {_summary}, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, analysis_id DESC) AS rank FROM scans) "
        "WHERE rank <= 20")),
    "list_projects": (project_list, _scans(
        "SELECT project_id, name, last_analyzed, created_at FROM projects ORDER BY last_analyzed DESC NULLS LAST, created_at DESC, project_id")),
    "compare_scans": (compare, _scans(
        "SELECT l.overall_score AS left_score, r.overall_score AS right_score, l.total_issues AS left_issues, r.total_issues AS right_issues, "
        "l.total_files AS left_files, r.total_files AS right_files, round(r.overall_score - l.overall_score, 6) AS diff_score, "
        "r.total_issues - l.total_issues AS diff_issues, r.total_files - l.total_files AS diff_files "
        "FROM scans l, scans r WHERE l.analysis_id = 10 AND r.analysis_id = 20")),
    "compare_consecutive_scans": (consecutive, _scans(
        "SELECT project_id, left_id, analysis_id AS right_id, round(overall_score - ls, 6) AS diff_score, total_issues - li AS diff_issues, "
        "total_files - lf AS diff_files FROM (SELECT *, lag(analysis_id) OVER w AS left_id, lag(overall_score) OVER w AS ls, "
        "lag(total_issues) OVER w AS li, lag(total_files) OVER w AS lf FROM scans WINDOW w AS (PARTITION BY project_id ORDER BY created_at, analysis_id)) "
        "WHERE left_id IS NOT NULL")),
    "search_by_text": (search(query="injection"), from_issues(_search.format(f"contains({_joined}, 'injection')", 50))),
    "search_by_filters": (search(severity="critical", language="php", category="Security", limit=30), from_issues(
        _search.format("severity = 'CRITICAL' AND language = 'PHP' AND category = 'security'", 30))),
    "rehydrate_results": (rehydrate,
        "SELECT event_id, value AS overall, CASE WHEN event_id % 5 = 0 THEN -1 ELSE coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) END AS k FROM events"),
    "create_projects": (create, _scans(
        "SELECT path, name FROM projects UNION ALL SELECT '/data/user' || c_custkey, 'customer' || c_custkey FROM customer "
        "WHERE '/data/user' || c_custkey NOT IN (SELECT path FROM projects)")),
    "delete_projects": (delete_cascade, _scans(
        "SELECT p.project_id, (SELECT count(*) FROM scans s WHERE s.project_id = p.project_id) AS scans FROM projects p "
        "WHERE project_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")),
    "touch_projects": (touch, _scans("SELECT project_id, max(created_at) AS last_analyzed FROM scans GROUP BY project_id")),
    "scan_throughput": (throughput, _scans(
        "SELECT project_id, scans, files, round(s, 6) AS seconds, round(s / scans, 6) AS mean_seconds, "
        "round(CASE WHEN s > 0 THEN files / s END, 6) AS files_per_second FROM (SELECT project_id, count(*) AS scans, "
        "CAST(sum(total_files) AS BIGINT) AS files, CAST(sum(CAST(duration_seconds AS DECIMAL(28,6))) AS DOUBLE) AS s FROM scans GROUP BY project_id)")),
    "dashboard_totals": (dashboard, _scans(
        "SELECT (SELECT count(*) FROM scans) AS total_analyses, (SELECT count(*) FROM projects) AS total_projects, "
        + ", ".join(f"{c} AS latest_{c}" for c in SUMMARY) + " FROM scans ORDER BY created_at DESC, analysis_id DESC LIMIT 1")),
    "explain_findings": (explained, _explained_sql(
        f"SELECT path, rule_id, line_number, {', '.join(FIELDS)} FROM explained")),
    "standards_rollup": (standards, _explained_sql(
        "SELECT standard, count(*) AS findings FROM (SELECT unnest(string_split(standards, ', ')) AS standard FROM explained) GROUP BY standard")),
}
