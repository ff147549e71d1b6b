"""Streaming forms, run until everything that has arrived is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import programs, table
from oracle.base import from_issues
from reviewlake.operators import rules
from reviewlake.session import shared_folder
from reviewlake.sources import tables
from reviewlake.sources.tree import write_tree
from reviewlake.streaming import (as_rows, first_deliveries, latest_totals, review_job, review_stream, run_available, running_totals,
                                  windowed_totals)

BATCHES = 8
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def streamed_review(spark, folder):
    """Documents reviewed as a stream; the findings land in a parquet table."""
    root = shared_folder(spark, "stream")
    schema = table(spark, folder, "documents").schema
    done = review_stream(spark, tables.stream_path(folder, "documents"), schema, tables.program_corpus)
    run_available(rules.explode_issues(done), f"{root}/issues", f"{root}/checkpoint")
    issues = spark.read.parquet(f"{root}/issues")
    return issues.groupBy("project_id", "language", "rule_id").agg(F.count("*").alias("findings"))


def _directory_job(spark, folder):
    """Every document as a program file of its own below a directory, reviewed as a job in ``BATCHES`` batches."""
    root, steps = shared_folder(spark, "directory"), []
    named = F.concat_ws("/", F.coalesce("project_id", F.lit("none")), "path").alias("relative_path")
    write_tree(programs(spark, folder).select(named, "content"), f"{root}/files")
    project = F.nullif(F.substring_index("relative_path", "/", 1), F.lit("none"))
    k = max(1, -(-table(spark, folder, "documents").count() // BATCHES))
    review_job(spark, f"{root}/files", f"{root}/issues", f"{root}/checkpoint", steps.append, project, k)
    return root, steps


def directory_review(spark, folder):
    root, _ = _directory_job(spark, folder)
    issues = spark.read.parquet(f"{root}/issues")
    return issues.groupBy("project_id", "language", "rule_id").agg(F.count("*").alias("findings"))


def review_progress(spark, folder):
    """Stage and percent of the job, one row a step."""
    _, steps = _directory_job(spark, folder)
    return as_rows(spark, steps).select(F.col("step").cast("long").alias("step"), "stage", "done", "total", "percent")


def redelivered_totals(spark, folder):
    """Findings that are delivered again, as a whole, change nothing."""
    root = shared_folder(spark, "redelivered")
    for n in range(2):
        table(spark, folder, "events").write.parquet(f"{root}/landing/{n}/events.parquet")
        landed = spark.readStream.schema(table(spark, folder, "events").schema).option("recursiveFileLookup", "true").parquet(f"{root}/landing")
        run_available(running_totals(first_deliveries(_findings_of(landed), ("event_id",))), f"{root}/out", f"{root}/checkpoint", "update")
    return latest_totals(spark, f"{root}/out")


def _event_findings(spark, folder):
    return _findings_of(spark.readStream.schema(table(spark, folder, "events").schema).parquet(tables.stream_path(folder, "events")))


def _findings_of(events):
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return events.select("event_id", F.col("user_id").alias("project_id"), severity.alias("severity"), F.col("ts").alias("created_at"))


def streamed_totals(spark, folder):
    root = shared_folder(spark, "totals")
    run_available(running_totals(_event_findings(spark, folder)), f"{root}/out", f"{root}/checkpoint", "update")
    return latest_totals(spark, f"{root}/out")


def streamed_windows(spark, folder):
    """Hourly windows that the watermark has closed."""
    root = shared_folder(spark, "windows")
    run_available(windowed_totals(_event_findings(spark, folder)), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


_severity = "(['CRITICAL','HIGH','MEDIUM','LOW','INFO'])[event_id % 5 + 1]"

_counted = from_issues("SELECT project_id, language, rule_id, count(*) AS findings FROM issues GROUP BY ALL")
_steps = (f"WITH n AS (SELECT count(*) AS n, greatest(1, (count(*) + {BATCHES - 1}) // {BATCHES}) AS k FROM documents), "
          "batch AS (SELECT n, unnest(range(1, (n + k - 1) // k + 1)) AS i, k FROM n), "
          "running AS (SELECT i + 1 AS step, 'running' AS stage, least(i * k, n) AS done, n AS total, "
          "15 + CAST(75 * least(i * k, n) AS DOUBLE) / n AS percent FROM batch), "
          "m AS (SELECT count(*) AS m, (SELECT n FROM n) AS n FROM batch) "
          "SELECT 0 AS step, 'queued' AS stage, 0 AS done, 0 AS total, 0.0 AS percent UNION ALL SELECT 1, 'collecting', 0, 0, 10.0 "
          "UNION ALL SELECT * FROM running UNION ALL SELECT m + 2, 'saving', n, n, 92.0 FROM m UNION ALL SELECT m + 3, 'completed', n, n, 100.0 FROM m")
ENTRIES = {
    "stream_review": (streamed_review, _counted),
    "stream_directory_review": (directory_review, _counted),
    "stream_review_progress": (review_progress, f"SELECT CAST(step AS BIGINT) AS step, stage, CAST(done AS BIGINT) AS done, "
        f"CAST(total AS BIGINT) AS total, CAST(percent AS DOUBLE) AS percent FROM ({_steps})"),
    "stream_totals_redelivered": (redelivered_totals,
        f"SELECT user_id AS project_id, {_severity} AS severity, count(*) AS issues FROM events GROUP BY ALL"),
    "stream_running_totals": (streamed_totals,
        f"SELECT user_id AS project_id, {_severity} AS severity, count(*) AS issues FROM events GROUP BY ALL"),
    "stream_windowed_totals": (streamed_windows,
        f"SELECT date_trunc('hour', ts) AS window_start, user_id AS project_id, {_severity} AS severity, count(*) AS issues FROM events "
        "WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL"),
}
