"""Headline queries, timed.

Prints one JSON line.  BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from entries import QUERIES  # noqa: E402
from entries import common  # noqa: E402
from entries.learning import rows as training_rows  # noqa: E402
from reviewlake import issues, review, session, store  # noqa: E402
from reviewlake.operators import ml, rollup  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
SIMPLE = ("language_stats", "project_file_listing", "compare_consecutive_scans", "scan_history", "dashboard_totals",
          "stream_running_totals", "split_stratified")


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = session("bench", master=f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    times, state = {}, {}

    def timed(name, run):
        started = time.time()
        run()
        times[name] = round(time.time() - started, 3)

    def review_to_table():
        state["done"] = store(common.reviewed(spark, FOLDER), "review")

    sink(common.table(spark, FOLDER, "documents").limit(1))  # start the executors
    timed("rule_matching", lambda: sink(issues(common.reviewed(spark, FOLDER)).groupBy("project_id", "severity").count()))
    timed("review_to_table", review_to_table)
    timed("page_review", lambda: sink(review(common.pages(spark, FOLDER)).select("path", "overall", "total")))
    done = state["done"]
    timed("rollup_projects", lambda: sink(rollup.project_reviews(done)))
    timed("rollup_languages", lambda: sink(rollup.language_distribution(done)))
    timed("rollup_problem_files", lambda: sink(rollup.problem_files(done)))
    timed("rollup_top_issues", lambda: sink(rollup.top_issues(issues(done))))
    for name in SIMPLE:
        timed(name, lambda: sink(QUERIES[name](spark, FOLDER)))
    timed("training_rows", lambda: state.update(rows=store(training_rows(spark, FOLDER), "rows")))
    timed("train_six_models", lambda: ml.train(state["rows"]))

    counted = done.agg(F.count("*").alias("files"), F.sum("loc").alias("lines"), F.sum("total").alias("findings")).first()
    seconds = times["review_to_table"]
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": int(CPUS),
        "files_per_second": round(counted.files / seconds, 1), "lines_per_second": round(counted.lines / seconds, 1),
        "findings_per_second": round(counted.findings / seconds, 1)}))


if __name__ == "__main__":
    main()
