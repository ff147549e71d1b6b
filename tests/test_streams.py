"""Streams: each file and finding once, progress, stored totals that do not grow with batches."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from conftest import TESTDATA
from reviewlake.sources.snapshots import Snapshot
from reviewlake.streaming import first_deliveries, latest_totals, review_job, run_available, running_totals
from tools.check_oracle import TABLES, comparable


@pytest.mark.parametrize("name", ["stream_directory_review", "stream_review_progress", "stream_totals_redelivered", "stream_running_totals"])
def test_stream_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    df = queries()[name](spark, TESTDATA)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(rel.fetchall(), rel.columns)


def test_files_are_reviewed_once(spark, tmp_path):
    def put(name):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("eval('1')\n")

    def run():
        steps = []
        review_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), steps.append, files_per_batch=2)
        found = spark.read.parquet(str(tmp_path / "out"))
        paths = [r.path for r in found.select("path", "rule_id").where(F.col("rule_id") == first_rule(found)).collect()]
        return steps, sorted(p.rsplit("/", 1)[-1] for p in paths)

    def first_rule(found):
        return found.agg(F.min("rule_id")).first()[0]

    for n in range(3):
        put(f"a/{n}.py")
    for name in ("node_modules/x.py", ".git/y.py", "z.txt"):
        put(name)
    steps, names = run()
    assert names == ["0.py", "1.py", "2.py"]
    assert [s.stage for s in steps if s.stage != "running"] == ["queued", "collecting", "saving", "completed"]
    percents = [s.percent for s in steps]
    assert percents == sorted(percents) and [s.percent for s in steps if s.stage == "running"][-1] == 90 and steps[-1].done == 3
    put("a/late.py")
    steps, names = run()
    assert names == ["0.py", "1.py", "2.py", "late.py"] and steps[-1].done == 1 and steps[-1].total == 4


def test_totals_do_not_grow_with_batches(spark, tmp_path):
    """Findings come in twelve batches, every second one a repetition; a batch that runs again changes nothing."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    start, sizes = datetime(2024, 5, 1), []
    schema = "finding bigint, project_id string, severity string, created_at timestamp"
    for n in range(12):
        rows = [(m, f"p{m % 3}", "HIGH", start + timedelta(minutes=m)) for m in range(n // 2 * 5, n // 2 * 5 + 5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        df = running_totals(first_deliveries(spark.readStream.schema(schema).parquet(landing), ("finding",)))
        run_available(df, out, str(tmp_path / "checkpoint"), "update")
        sizes.append(sum(name.endswith(".parquet") for _, _, files in os.walk(out) for name in files))
    got = {r.project_id: r.issues for r in latest_totals(spark, out).collect()}
    assert got == {f"p{k}": 10 for k in range(3)}
    assert max(sizes) <= 6 and len(os.listdir(f"{out}/_manifests")) <= 6  # three counters, two versions (and checksums)
    now = Snapshot.newest(spark, out)
    from reviewlake.streaming.review import merge_totals
    merge_totals(spark.createDataFrame([("p0", "HIGH", 99)], "project_id string, severity string, issues bigint"), now.tables["totals"]["batch"], out)
    assert Snapshot.newest(spark, out).version == now.version


@pytest.mark.parametrize("name", ["stream_review", "stream_running_totals"])
def test_streams_read_tables_of_part_files(spark, tmp_path, name):
    """A table is one file or a folder of part files; a table whose name only begins alike is another one."""
    for t in ("documents", "events"):
        given = spark.read.parquet(f"{TESTDATA}/{t}.parquet")
        given.repartition(3).write.parquet(str(tmp_path / "tables" / f"{t}.parquet"))
        given.limit(5).write.parquet(str(tmp_path / "tables" / f"{t}.parquet.old"))
    whole, parts = (sorted(map(tuple, queries()[name](spark, folder).collect()), key=str) for folder in (TESTDATA, str(tmp_path / "tables")))
    assert whole == parts and whole


def test_jobs_stream_their_listing_and_not_every_file(spark, tmp_path):
    """Spark's file reader lists the files of a batch once more, by a task each; a batch here is one file of paths."""
    for n in range(23):
        (tmp_path / "in" / f"d{n % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{n % 3}" / f"{n}.py").write_text(f"eval('{n}')\n")
    for run, (done, batches) in enumerate(((23, 3), (1, 4), (0, 4))):
        steps = []
        review_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), steps.append, files_per_batch=10)
        assert [s.done for s in steps if s.stage == "running"] == ([10, 20, 23] if not run else [done] * (done > 0)) and steps[-1].total == 23 + (run > 0)
        log = tmp_path / "checkpoint" / "sources" / "0"
        streamed = {line for f in log.iterdir() if not f.name.endswith(".crc") for line in f.read_text().splitlines() if line.startswith("{")}
        assert len(streamed) == batches
        (tmp_path / "in" / "d1" / "late.py").write_text("eval('late')\n")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("path").distinct().count() == 24


def test_a_directory_without_files_is_reviewed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for total in (0, 1):
        steps = []
        review_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), steps.append)
        assert steps[-1][:3] == ("completed", total, total)
        (tmp_path / "in" / "a.py").write_text("eval('1')\n")
