"""Stored scans: snapshots, the index of findings, and changes of projects."""

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from entries.common import projects as project_table
from reviewlake import review, store
from reviewlake.operators import history
from reviewlake.session import shared_folder
from reviewlake.sources import scans, tables
from reviewlake.sources.snapshots import Snapshot

FIELDS = ("analysis_id", "project_id", "path", "rule_id", "line_number", "title", "description", "code_snippet")


@pytest.fixture(scope="module")
def done(spark):
    return store(review(tables.program_corpus(tables.read(spark, TESTDATA, "documents"))), "review")


@pytest.fixture(scope="module")
def stored(spark, done):
    """Three scans with small buckets and blocks, the last of them only of some projects."""
    root = shared_folder(spark, "stored")
    for n, part in enumerate((done, done, done.where("language IN ('PHP', 'C', 'SQL')"))):
        scans.store_scan(part, root, n, f"2024-0{n + 1}-01", 1.0, bucket_rows=200, block_rows=16)
    return root


QUERIES = ["injection", "exec", "eval(", "select *", "docstring", "no such text at all", "qu", "", "severity\":\"critical", "MAGIC", "password", "src"]


@pytest.mark.parametrize("query", QUERIES)
def test_the_index_finds_what_a_full_scan_finds(spark, stored, query):
    analyses, findings = scans.read_scans(spark, stored)
    for options in ({"limit": 40}, {"limit": 5000}, {"limit": 100, "scans": 1}, {"limit": 100, "severity": "critical"}):
        want = history.search_issues(analyses, findings, query=query, **options).select(*FIELDS).collect()
        assert scans.search_scans(spark, stored, query, **options).select(*FIELDS).collect() == want


def test_only_candidate_buckets_are_read(spark, stored):
    now = Snapshot.newest(spark, stored)
    every = now.parts("findings")
    assert len({p.split("/")[1] for p in every}) > 2  # several buckets a scan
    rare = spark.createDataFrame([("zzqqx",)], "t string")
    assert rare.count() and scans.candidates(now, "zzqqx") == {}
    assert scans.candidates(now, "ab") is None
    at = scans.candidates(now, "parsererror")
    some = now.read("findings").where(F.contains(history.search_text(), F.lit("gets("))).select("analysis_id", "bucket", "block").distinct().collect()
    at = scans.candidates(now, "gets(")
    assert {(f"{r.analysis_id}/{r.bucket}", r.block) for r in some} <= {(p, b) for p, blocks in at.items() for b in blocks}
    found = scans.search_scans(spark, stored, "gets(", limit=10_000)
    opened = {f.split("/findings/")[1] for f in found.inputFiles() if "/findings/" in f}
    assert {x.rsplit("/", 1)[0] for x in opened} == {every[p].removeprefix("findings/") for p in at}
    blocks = now.read("findings").select("analysis_id", "bucket", "block").distinct().count()
    assert sum(map(len, at.values())) < blocks / 2


def test_buckets_and_blocks_are_bounded(spark, stored):
    findings = Snapshot.newest(spark, stored).read("findings")
    assert findings.groupBy("analysis_id", "bucket", "block").count().agg(F.max("count")).first()[0] <= 16
    assert findings.where("analysis_id = 0").count() == findings.where("analysis_id = 1").count()


def test_a_scan_that_is_stored_again_replaces_itself(spark, done, tmp_path):
    root = str(tmp_path)
    scans.store_scan(done, root, 7, "2024-01-01", 1.0, bucket_rows=100)
    few = done.where("language = 'PHP'")
    scans.store_scan(few, root, 7, "2024-01-02", 1.0)
    analyses, findings = scans.read_scans(spark, root)
    assert analyses.agg(F.sum("total_issues")).first()[0] == findings.count() == few.agg(F.sum("total")).first()[0]
    assert scans.search_scans(spark, root, "docstring").count() == 0


def test_a_run_that_ends_in_the_middle_changes_nothing(spark, done, stored, tmp_path):
    root = str(tmp_path)
    scans.store_scan(done.where("language = 'C'"), root, 1, "2024-01-01", 1.0)
    before = Snapshot.newest(spark, root)
    old = [x.count() for x in scans.read_scans(spark, root)]
    half = before.written("findings", before.read("findings").limit(1), "1/0")  # written, not committed
    assert Snapshot.newest(spark, root).tables == before.tables
    assert [x.count() for x in scans.read_scans(spark, root)] == old
    after = before.commit(half)
    assert after.version == before.version + 1 and Snapshot.newest(spark, root).tables == after.tables
    with pytest.raises(RuntimeError):
        before.commit(half)  # a second writer that started from the same version


def test_stored_projects(spark, tmp_path):
    root = str(tmp_path)
    held = project_table(spark, TESTDATA)
    usual, scans.SUMMARY_ROWS = scans.SUMMARY_ROWS, 4
    try:
        scans.save_projects(held, root)
    finally:
        scans.SUMMARY_ROWS = usual
    before = Snapshot.newest(spark, root)
    assert len(before.parts("projects")) > 2
    row = held.orderBy("project_id").first()
    made = lambda **cells: tuple({**dict.fromkeys(held.columns), "description": "", "created_at": row.created_at, **cells}[c] for c in held.columns)
    fresh = spark.createDataFrame([made(project_id=10**6, name="new", path="/new"), made(project_id=5, name="known path", path=row.path)], held.schema)
    now = scans.create_projects(fresh, root)
    changed = {p for p, f in now.parts("projects").items() if before.parts("projects").get(p) != f}
    assert 1 <= len(changed) <= 2  # the buckets of the two paths
    paths = [r.path for r in scans.read_projects(spark, root).collect()]
    assert len(paths) == len(set(paths)) == held.count() + 1 and "/new" in paths
    analyses = tables.scan_history(tables.read(spark, TESTDATA, "events")).withColumn("analysis_id", F.pmod("analysis_id", F.lit(2)))
    scans.append_scan(spark, analyses, root)
    now = scans.touch_projects(spark, root)
    newest = {r.project_id: r.t for r in analyses.groupBy("project_id").agg(F.max("created_at").alias("t")).collect()}
    assert all(r.last_analyzed == newest.get(r.project_id) for r in scans.read_projects(spark, root).collect())
    assert scans.touch_projects(spark, root).version == now.version  # nothing newer
    scans.delete_projects(spark.createDataFrame([(row.project_id,)], "project_id long"), root)
    now = Snapshot.newest(spark, root)
    assert now.read("projects").where(F.col("project_id") == row.project_id).count() == 0
    assert now.read("analyses").count() == analyses.where(F.col("project_id") != row.project_id).count()


def test_projects_of_an_empty_store(spark, tmp_path):
    scans.create_projects(project_table(spark, TESTDATA), str(tmp_path))
    assert scans.read_projects(spark, str(tmp_path)).count() == project_table(spark, TESTDATA).count()


def test_trigrams_by_table_and_by_sorting(monkeypatch):
    texts = ["", "ab", "abcabc", "x\n\"é \U0001f600y", "abc", "zzzz", "q", "rs"]
    want = {t[i:i + 3] for t in texts for i in range(len(t) - 2)}
    assert scans.grams_of(texts) == want
    monkeypatch.setattr(scans, "GRAM_TABLE", 0)
    assert scans.grams_of(texts) == want
    assert scans.grams_of([]) == scans.grams_of(["ab", "cd"]) == set()


def test_blocks_are_indexed_in_many_tasks(spark, done, tmp_path):
    """Packed texts are small: dealt by key alone, all blocks would be gathered in one task."""
    root = str(tmp_path)
    scans.store_scan(done, root, 1, "2024-01-01", 1.0, bucket_rows=200, block_rows=16)
    findings = Snapshot.newest(spark, root).read("findings")
    index = scans.postings(findings)
    assert "REPARTITION_BY_COL" not in index._jdf.queryExecution().toString()
    texts = findings.select("bucket", "block", history.search_text().alias("t")).collect()
    want = {(r.bucket, r.block, r.t[i:i + 3]) for r in texts for i in range(len(r.t) - 2)}
    assert {(r.bucket, b, r.gram) for r in index.collect() for b in r.blocks} == want
