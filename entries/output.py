"""Exports and report data."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import found, long, projects, reviewed, scans, table
from entries.history import _scans
from oracle.base import from_issues, from_review, mean, round1
from reviewlake.operators import rules
from reviewlake.operators.scoring import SCORES
from reviewlake.session import shared_folder, store
from reviewlake.sources import exports, scans as stored

SCAN_TIMES = ("2024-05-01 08:00:00", "2024-06-01 08:00:00")


def csv_rows(spark, folder):
    """Written as CSV and read back."""
    path = f"{shared_folder(spark, 'csv')}/issues"
    exports.write_csv(exports.csv_rows(store(reviewed(spark, folder), "review")), path)
    schema = ", ".join(f"{c} string" for c in exports.CSV_COLUMNS)
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select("file", "language", "severity", "category", "title", F.col("line_number").cast("long"), "rule_id",
                       F.col("overall_score").cast("double"), F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def no_issue_rows(spark, folder):
    """The sentinel row of a review without findings (no rules applied)."""
    done = store(reviewed(spark, folder, packs={"JSON": ()}).where("language = 'JSON'"), "review")
    return exports.csv_rows(done, {"JSON": ()}).select("file", "language", "rule_id")


def json_records(spark, folder):
    """Written as JSON lines and read back."""
    path = f"{shared_folder(spark, 'json')}/report"
    exports.write_json(exports.json_records(store(reviewed(spark, folder), "review")), path)
    back = spark.read.schema("project_id string, value string, record string").json(path)
    finding = ("struct<rule_id:string,title:string,description:string,severity:string,line_number:bigint,column:int,end_line:int,"
               "suggestion:string,reason:string,code_snippet:string>")
    listed = "array<struct<rank:int,path:string,title:string,language:string>>"
    parsed = back.select("record", "project_id", F.from_json(
        "value", f"struct<issues:array<{finding}>,summary:struct<total:bigint>,language_distribution:{listed},"
                 f"most_problematic_files:{listed},top_critical_issues:{listed}>").alias("v"))
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    issue = F.aggregate("v.issues", F.lit(0).cast("long"), lambda n, i: n + number(
        i["rule_id"], i["title"], i["description"], i["severity"], i["line_number"].cast("string"), i["code_snippet"]))
    ranked = lambda name, *fields: F.aggregate(f"v.{name}", F.lit(0).cast("long"), lambda n, x: n + number(
        *[x[f].cast("string") for f in fields]))
    heads = ranked("language_distribution", "language") + ranked("most_problematic_files", "rank", "path") + F.coalesce(
        ranked("top_critical_issues", "rank", "title", "path"), F.lit(0))
    file = F.col("record") == "file"
    return parsed.groupBy("record", "project_id").agg(
        F.count("*").alias("records"), F.sum(F.when(file, F.size("v.issues")).otherwise(F.col("v.summary.total"))).cast("long").alias("findings"),
        F.sum(F.when(file, issue).otherwise(heads)).alias("contents"))


def sections(form):
    def run(spark, folder):
        done = store(reviewed(spark, folder), "review")
        rows = exports.report_sections(done, rules.explode_issues(done), form)
        return rows.select("project_id", "section", *long("rank"), "label", "value", "extra")
    return run


def scan_append(spark, folder):
    """Two scans appended to a history, the second one twice, then read back whole."""
    path = shared_folder(spark, "history")
    done = store(reviewed(spark, folder), "review")
    for number in (0, 1, 1):
        stored.append_scan(spark, exports.analysis_rows(done, number, SCAN_TIMES[number], 12.5), path)
    back = stored.Snapshot.newest(spark, path).read("analyses")
    return back.select("analysis_id", "project_id", "overall_score", *long("total_files", "total_issues", "critical_issues"))


def stored_search(query, limit):
    def run(spark, folder):
        """Two scans stored with their findings and index, one of them twice, then searched."""
        path = shared_folder(spark, "scans")
        done = store(reviewed(spark, folder), "review")
        for number in (0, 1, 1):
            stored.store_scan(done, path, number, SCAN_TIMES[number], 12.5)
        hits = stored.search_scans(spark, path, query, limit=limit)
        return hits.select("analysis_id", "project_id", "path", "rule_id", "severity", *long("line_number"), "description", "code_snippet")
    return run


def stored_projects(spark, folder):
    """Projects and their scans stored; customers created, failed users deleted with their scans, the rest touched; then read back."""
    root = shared_folder(spark, "projects")
    stored.save_projects(projects(spark, folder), root)
    stored.append_scan(spark, scans(spark, folder).withColumn("analysis_id", F.pmod("analysis_id", F.lit(3))), root)
    customers = table(spark, folder, "customer").select(
        (F.col("c_custkey") + 1_000_000).alias("project_id"), F.concat(F.lit("customer"), "c_custkey").alias("name"),
        F.concat(F.lit("/data/user"), "c_custkey").alias("path"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_analyzed"))
    missing = {c: F.lit(None).cast(t) for c, t in projects(spark, folder).dtypes if c not in customers.columns}
    stored.create_projects(customers.withColumns(missing).select(*projects(spark, folder).columns), root)
    failed = table(spark, folder, "events").where("event_type = 'error' AND value > 90").select(F.col("user_id").alias("project_id"))
    stored.delete_projects(failed, root)
    now = stored.touch_projects(spark, root)
    sizes = now.read("analyses").groupBy("project_id").agg(F.count("*").alias("scans"))
    return now.read("projects").join(sizes, "project_id", "left").select("project_id", "path", "name", "last_analyzed", "scans")


def report_listing(spark, folder):
    """Files of a CSV export, newest first."""
    path = f"{shared_folder(spark, 'reports')}/issues"
    exports.write_csv(found(spark, folder).select("path", "rule_id", "line_number").repartition(4, "path"), path)
    return exports.list_reports(spark, path).select("name", "format", *long("size"))


_named = {"markdown": (("85", "Excellent"), ("70", "Good"), ("55", "Fair")),
          "html": (("85", "Excellent"), ("70", "Good"), ("55", "Fair"), ("40", "Poor"))}
_named["pdf"] = _named["html"]


def _sections_sql(form: str) -> str:
    low = "Poor" if form == "markdown" else "Critical"
    rating = lambda x: "CASE " + " ".join(f"WHEN {x} >= {a} THEN '{b}'" for a, b in _named[form]) + f" ELSE '{low}' END"
    parts = [f"SELECT project_id, 'scores' AS section, CAST({i} AS BIGINT) AS rank, '{t}' AS label, {n} AS value, {rating(n)} AS extra FROM means"
             for i, (t, n) in enumerate(exports.SCORE_TITLES)]
    parts += [f"SELECT project_id, 'issues', CAST({i} AS BIGINT), '{n.title()}', CAST(sum({n}) AS DOUBLE), '' FROM reviewed GROUP BY project_id"
              for i, n in enumerate(("critical", "high", "medium", "low", "info", "total"))]
    parts.append("SELECT project_id, 'languages', CAST(0 AS BIGINT), language, CAST(n AS DOUBLE), CAST("
                 + round1("CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY project_id) AS DOUBLE) * 100")
                 + " AS VARCHAR) FROM (SELECT project_id, language, count(*) AS n FROM reviewed GROUP BY ALL)")
    parts.append("SELECT project_id, 'files', rank, path, overall, language FROM (SELECT *, row_number() OVER (PARTITION BY project_id "
                 "ORDER BY critical * 100 + high * 10 + medium DESC, path) AS rank FROM reviewed) WHERE rank <= " + str(exports.SECTION_FILES[form]))
    parts.append("SELECT project_id, 'top_issues', rank, title, CAST(line_number AS DOUBLE), path FROM (SELECT *, row_number() OVER "
                 "(PARTITION BY project_id ORDER BY severity_rank, path, line_number, rule_no) AS rank FROM issues "
                 f"WHERE severity IN ('CRITICAL','HIGH')) WHERE rank <= {exports.SECTION_ISSUES[form]}")
    means = ", ".join(f"{round1(mean(s))} AS {s}" for s in SCORES)
    body = from_review("SELECT")
    return (f"{body[:-len(' SELECT')]}, means AS (SELECT project_id, {means} FROM reviewed GROUP BY project_id) "
            + " UNION ALL ".join(parts))


def _stored_sql(query: str, limit: int) -> str:
    return from_issues(
        "SELECT analysis_id, project_id, path, rule_id, severity, line_number, description, code_snippet FROM (SELECT i.*, CAST(v.n AS BIGINT) AS analysis_id "
        f"FROM issues i, (VALUES (0), (1)) v(n)) WHERE contains(lower(title || ' ' || description || ' ' || coalesce(suggestion, '') || ' ' || code_snippet "
        f"|| ' ' || rule_id), '{query}') ORDER BY analysis_id DESC, project_id, path, severity_rank, line_number, rule_no LIMIT {limit}")


_number = lambda names: f"('0x' || substr(md5(concat_ws('|', {names})), 1, 8))::BIGINT"

ENTRIES = {
    "export_csv": (csv_rows, from_review(
        "SELECT string_split(i.path, '/')[-1] AS file, i.language, i.severity, i.category, i.title, i.line_number, i.rule_id, "
        "r.overall AS overall_score, i.suggestion FROM issues i JOIN reviewed r USING (path)")),
    "export_csv_without_findings": (no_issue_rows,
        "SELECT 'No issues found' AS file, '' AS language, '' AS rule_id FROM documents LIMIT 1"),
    "export_json": (json_records, from_review(
        f"SELECT 'file' AS record, project_id, count(*) AS records, CAST(sum(total) AS BIGINT) AS findings, CAST(coalesce((SELECT "
        f"sum({_number('rule_id, title, description, severity, line_number, code_snippet')}) FROM issues i WHERE i.project_id = r.project_id), 0) AS BIGINT) "
        "AS contents FROM reviewed r GROUP BY project_id "
        "UNION ALL SELECT 'project', project_id, 1, CAST(sum(total) AS BIGINT), CAST("
        f"(SELECT sum({_number('language')}) FROM (SELECT DISTINCT language FROM reviewed l WHERE l.project_id = r.project_id)) + "
        f"(SELECT sum({_number('rank, path')}) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY critical * 100 + high * 10 + medium DESC, path) "
        "AS rank FROM reviewed) f WHERE rank <= 10 AND f.project_id = r.project_id) + "
        f"coalesce((SELECT sum({_number('rank, title, path')}) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY severity_rank, path, "
        "line_number, rule_no) AS rank FROM issues WHERE severity IN ('CRITICAL','HIGH')) t WHERE rank <= 50 AND t.project_id = r.project_id), 0) AS BIGINT) "
        "FROM reviewed r GROUP BY project_id")),
    "report_sections_markdown": (sections("markdown"), _sections_sql("markdown")),
    "report_sections_html": (sections("html"), _sections_sql("html")),
    "report_sections_pdf": (sections("pdf"), _sections_sql("pdf")),
    "append_scan": (scan_append, from_review(
        f"SELECT CAST(s AS BIGINT) AS analysis_id, project_id, overall_score, total_files, total_issues, critical_issues FROM "
        f"(SELECT project_id, {round1(mean('overall'))} AS overall_score, count(*) AS total_files, CAST(sum(total) AS BIGINT) AS total_issues, "
        "CAST(sum(critical) AS BIGINT) AS critical_issues FROM reviewed GROUP BY project_id), (VALUES (0), (1)) v(s)")),
    "search_stored_scans": (stored_search("injection", 300), _stored_sql("injection", 300)),
    "search_stored_snippets": (stored_search("exec", 1000), _stored_sql("exec", 1000)),
    "stored_projects": (stored_projects, _scans(
        "SELECT project_id, path, name, CASE WHEN last_analyzed IS NULL THEN newest WHEN newest IS NULL THEN last_analyzed ELSE greatest(last_analyzed, newest) END AS last_analyzed, scans "
        "FROM (SELECT project_id, path, name, last_analyzed FROM projects UNION ALL SELECT c_custkey + 1000000, '/data/user' || c_custkey, 'customer' || c_custkey, NULL FROM customer "
        "WHERE '/data/user' || c_custkey NOT IN (SELECT path FROM projects)) LEFT JOIN (SELECT project_id, max(created_at) AS newest, count(*) AS scans FROM scans GROUP BY project_id) "
        "USING (project_id) WHERE project_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")),
    "list_report_files": (report_listing, None),
}
