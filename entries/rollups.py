"""Project roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import found, long, programs, reviewed, rounded, sql_rounded
from oracle.base import from_issues, from_review, mean, round1
from reviewlake import review
from reviewlake.operators import rollup
from reviewlake.operators.scoring import SCORES, score_series

COUNTS = rollup.COUNTS


def file_summary(spark, folder):
    return rollup.file_summary(reviewed(spark, folder)).select("path", *long(*COUNTS))


def project_scores(spark, folder):
    return rollup.project_scores(reviewed(spark, folder))


def issue_counts(spark, folder):
    return rollup.project_issue_counts(reviewed(spark, folder))


def languages(spark, folder):
    return rollup.language_distribution(reviewed(spark, folder)).select("project_id", "language", *long("files"))


def language_share(spark, folder):
    return rollup.language_distribution(reviewed(spark, folder)).select("project_id", "language", "percentage")


def problem_files(k):
    def run(spark, folder):
        return rollup.problem_files(reviewed(spark, folder), k).select(
            "project_id", "path", "overall", *long("weight", "critical", "high", "medium", "rank"))
    return run


def top_issues(spark, folder):
    return rollup.top_issues(found(spark, folder)).select(
        "project_id", "path", "rule_id", "severity", *long("line_number", "rank"))


def file_counts(spark, folder):
    return rollup.file_counts(reviewed(spark, folder))


def severity_share(spark, folder):
    shares = rollup.severity_share(rollup.project_issue_counts(reviewed(spark, folder)))
    return shares.select("project_id", "severity", *long("issues"), *rounded("share"))


def with_severity(severity):
    return lambda spark, folder: rollup.files_with_severity(reviewed(spark, folder), severity).select("path", "language")


def severity_series(spark, folder):
    return rollup.severity_series(found(spark, folder)).select("project_id", "severity", *long("position", "issues"))


def scores_as_rows(spark, folder):
    return score_series(rollup.project_scores(reviewed(spark, folder)), ["project_id"])


def without_info(spark, folder):
    return rollup.hide_info(found(spark, folder)).groupBy("project_id", "severity").agg(F.count("*").alias("issues"))


def model_averages(spark, folder):
    averages = rollup.model_averages(reviewed(spark, folder))
    return averages.select("project_id", *rounded(*averages.columns[1:]))


def first_predictions(spark, folder):
    df = rollup.first_predictions(programs(spark, folder), review)
    return df.select("path", "predicted_severity", *rounded("quality_score", "bug_probability"))


def summary(spark, folder):
    return rollup.project_reviews(reviewed(spark, folder))


_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)
_means = ", ".join(f"{round1(mean(s))} AS {s}" for s in SCORES)
_weight = "critical * 100 + high * 10 + medium"


def _problem(k):
    return from_review(
        f"SELECT * FROM (SELECT project_id, path, overall, CAST({_weight} AS BIGINT) AS weight, critical, high, medium, "
        f"row_number() OVER (PARTITION BY project_id ORDER BY {_weight} DESC, path) AS rank FROM reviewed) WHERE rank <= {k}")


ENTRIES = {
    "file_issue_summary": (file_summary, from_review(f"SELECT path, {', '.join(COUNTS)} FROM reviewed")),
    "project_scores": (project_scores, from_review(f"SELECT project_id, {_means} FROM reviewed GROUP BY project_id")),
    "project_issue_summary": (issue_counts, from_review(f"SELECT project_id, {_sums} FROM reviewed GROUP BY project_id")),
    "language_distribution": (languages, from_review("SELECT project_id, language, count(*) AS files FROM reviewed GROUP BY ALL")),
    "language_share": (language_share, from_review(
        "SELECT project_id, language, " + round1("CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY project_id) AS DOUBLE) * 100")
        + " AS percentage FROM (SELECT project_id, language, count(*) AS n FROM reviewed GROUP BY ALL)")),
    "problem_files": (problem_files(10), _problem(10)),
    "dashboard_problem_files": (problem_files(5), _problem(5)),
    "top_critical_issues": (top_issues, from_issues(
        "SELECT * FROM (SELECT project_id, path, rule_id, severity, line_number, row_number() OVER (PARTITION BY project_id "
        "ORDER BY severity_rank, path, line_number, rule_no) AS rank FROM issues WHERE severity IN ('CRITICAL','HIGH')) WHERE rank <= 50")),
    "project_file_counts": (file_counts, from_review(
        "SELECT project_id, count(*) AS total_files, count(*) AS analyzed_files, CAST(0 AS BIGINT) AS failed_files FROM reviewed GROUP BY project_id")),
    "severity_share": (severity_share, from_review(
        "SELECT project_id, upper(severity) AS severity, issues, round(issues / greatest(total, 1)::DOUBLE * 100, 6) AS share FROM "
        f"(SELECT project_id, {_sums} FROM reviewed GROUP BY project_id) UNPIVOT (issues FOR severity IN (critical, high, medium, low, info))")),
    "files_with_critical": (with_severity("CRITICAL"), from_review("SELECT path, language FROM reviewed WHERE critical > 0")),
    "files_with_findings": (with_severity("ALL"), from_review("SELECT path, language FROM reviewed WHERE total > 0")),
    "severity_series": (severity_series, from_issues(
        "SELECT p.project_id, s.severity, CAST(s.position AS BIGINT) AS position, count(i.severity) AS issues "
        "FROM (SELECT DISTINCT project_id FROM issues) p, "
        "(VALUES (0,'CRITICAL'),(1,'HIGH'),(2,'MEDIUM'),(3,'LOW'),(4,'INFO')) s(position, severity) "
        "LEFT JOIN issues i ON i.project_id = p.project_id AND i.severity = s.severity GROUP BY ALL")),
    "score_series": (scores_as_rows, from_review(
        f"SELECT project_id, label, value FROM (SELECT project_id, {_means} FROM reviewed GROUP BY project_id) "
        f"UNPIVOT (value FOR label IN ({', '.join(SCORES[1:])}))")),
    "hide_info_findings": (without_info, from_issues(
        "SELECT project_id, severity, count(*) AS issues FROM issues WHERE severity <> 'INFO' GROUP BY ALL")),
    "model_score_averages": (model_averages, from_review(
        "SELECT project_id, " + ", ".join(f"round({mean(s)}, 6) AS avg_{s}" for s in (
            "bug_probability", "security_risk_score", "quality_score", "maintainability_score", "readability_score"))
        + " FROM reviewed GROUP BY project_id")),
    "first_predictions": (first_predictions, from_review(
        f"SELECT path, predicted_severity, {sql_rounded('quality_score', 'bug_probability')} FROM reviewed ORDER BY path LIMIT 10")),
    "project_review": (summary, from_review(
        "SELECT project_id, count(*) AS total_files, count(*) AS analyzed_files, CAST(0 AS BIGINT) AS failed_files, "
        f"{_means}, {_sums} FROM reviewed GROUP BY project_id")),
}
