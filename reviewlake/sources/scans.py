"""Stored scans: summaries, findings, an index of their text, and the projects they belong to.

Four tables in one snapshot folder.  ``analyses`` has a row per scan and project.
``findings`` has every field of every finding, in buckets whose number follows from the
number of findings (a project is spread by path, so none is too large for one), inside a
bucket in blocks of ``BLOCK_ROWS`` findings ordered by rule.  ``postings`` has, for every
trigram of the searched text, the blocks of each bucket that hold it.  ``projects`` is
the table of projects.  A scan that is stored again replaces itself in all tables at once.

A search intersects the postings of its trigrams, opens the buckets that are left, keeps
their candidate blocks and verifies the text; queries below three characters have no
trigram and read everything.
"""

from __future__ import annotations

import sys
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewlake.operators import history
from reviewlake.session import store
from reviewlake.sources.exports import analysis_rows
from reviewlake.sources.snapshots import Snapshot

# Ship the trigram helpers with each task: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Findings of a bucket (one folder, one task's sort) and of a block.
BUCKET_ROWS, BLOCK_ROWS = 500_000, 2048
#: Summaries or projects of a bucket.
SUMMARY_ROWS = 1_000_000
GRAM = 3
#: Trigrams over an alphabet are marked in a table of at most so many entries, beyond that they are sorted.
GRAM_TABLE = 1 << 24


def _buckets(rows: int, of_bucket: int) -> int:
    return max(1, -(-rows // of_bucket))


def _bucketed(rows: DataFrame, buckets: int, *by: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))


def blocked(found: DataFrame, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Findings with bucket and block; the window sorts one bucket, whose size is bounded."""
    rows = _bucketed(found, _buckets(found.count(), bucket_rows), "project_id", "path")
    order = Window.partitionBy("bucket").orderBy("rule_id", "project_id", "path", "line_number", "detect_seq")
    return rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / block_rows).cast("int"))


def _gram_codes(texts: list[str]) -> np.ndarray:
    """The distinct trigrams of some texts, a row of three code points each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < GRAM:
        return np.zeros((0, GRAM), np.uint32)
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    at, size = place[codes], len(alphabet)
    keys = (at[:-2] * size + at[1:-1]) * size + at[2:]
    ends = np.cumsum([len(t) for t in texts])
    within = np.ones(len(keys), bool)  # no trigram reaches into the next text
    for back in (1, 2):
        within[(ends - back)[(ends >= back) & (ends - back < len(keys))]] = False
    keys = keys[within]
    if size ** 3 <= GRAM_TABLE:
        held = np.zeros(size ** 3, bool)
        held[keys] = True
        keys = np.flatnonzero(held)
    else:
        keys = np.unique(keys)
    return alphabet[np.stack((keys // (size * size), keys // size % size, keys % size), axis=1)].astype(np.uint32)


def grams_of(texts: list[str]) -> set[str]:
    """The distinct trigrams of some texts."""
    found = _gram_codes(texts).tobytes().decode("utf-32-le", "surrogatepass")
    return {found[i:i + GRAM] for i in range(0, len(found), GRAM)}


def postings(findings: DataFrame) -> DataFrame:
    """(analysis_id, bucket, gram, blocks): the trigrams of each block, turned around.

    A block leaves its task as its distinct trigrams, not as those of every finding.
    """
    spark = findings.sparkSession
    # A number of our own: texts are small when packed, and blocks would be gathered in a task or two.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = findings.select("analysis_id", "bucket", "block", history.search_text().alias("text"))
    text = text.repartition(tasks, "analysis_id", "bucket", "block").sortWithinPartitions("analysis_id", "bucket", "block")

    def run(batches):
        key, grams = None, set()
        for batch in batches:
            done = []
            *keys, texts = (c.to_pylist() for c in batch.columns)
            first = 0
            for at, rows in groupby(zip(*keys, strict=True)):
                last = first + sum(1 for _ in rows)
                if at != key:
                    if key is not None:
                        done.append((*key, list(grams)))
                    key, grams = at, set()
                grams |= grams_of(texts[first:last])
                first = last
            if done:
                yield packed(done)
        if key is not None:
            yield packed([(*key, list(grams))])

    def packed(done):
        scan, bucket, block, grams = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(scan, pa.int64()), pa.array(bucket, pa.int32()), pa.array(block, pa.int32()), pa.array(grams, pa.list_(pa.string()))],
                                          ["analysis_id", "bucket", "block", "grams"])

    held = text.mapInArrow(run, "analysis_id bigint, bucket int, block int, grams array<string>")
    each = held.select("analysis_id", "bucket", "block", F.explode("grams").alias("gram"))
    return each.groupBy("analysis_id", "bucket", "gram").agg(F.sort_array(F.collect_list("block")).alias("blocks"))  # at most BUCKET_ROWS / BLOCK_ROWS


def store_scan(reviewed: DataFrame, root: str, scan_id: int, created_at, seconds: float, packs=None,
               bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> Snapshot:
    """One scan with summaries, findings and index; ``reviewed`` should be a stored review."""
    from reviewlake.operators.rules import explode_issues

    now = Snapshot.newest(reviewed.sparkSession, root)
    part = str(scan_id)
    found = explode_issues(reviewed, packs).withColumn("analysis_id", F.lit(scan_id).cast("long"))
    rows = blocked(found, bucket_rows, block_rows)
    findings = now.written("findings", rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block"), part, "bucket")
    fresh = Snapshot(now.spark, now.root, now.version, findings)  # written, but not committed
    index = now.written("postings", postings(fresh.read("findings")).repartition("gram").sortWithinPartitions("gram"), part)
    return _appended(now, analysis_rows(reviewed, scan_id, created_at, seconds), part, findings, index)


def _appended(now: Snapshot, summaries: DataFrame, part: str, *changes: dict) -> Snapshot:
    summaries = store(summaries, "summaries")  # counted, then written
    rows = _bucketed(summaries, _buckets(summaries.count(), SUMMARY_ROWS), "project_id")
    analyses = now.written("analyses", rows.repartition("bucket"), part, "bucket")
    mine = lambda t: [p for p in now.parts(t) if p == part or p.startswith(f"{part}/")]
    return now.commit(analyses, *changes, gone={t: mine(t) for t in ("analyses", "findings", "postings")})


def append_scan(spark: SparkSession, analyses: DataFrame, root: str) -> Snapshot:
    """Append summaries alone; a scan that is appended again replaces itself."""
    now = Snapshot.newest(spark, root)
    for r in analyses.select("analysis_id").distinct().collect():  # one scan as a rule
        now = _appended(now, analyses.where(F.col("analysis_id") == r.analysis_id), str(r.analysis_id))
    return now


def read_scans(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored (analyses, findings), as ``history.search_issues`` takes them."""
    now = Snapshot.newest(spark, root)
    return now.read("analyses").drop("bucket"), now.read("findings").drop("bucket", "block")


def candidates(now: Snapshot, query: str, scans: list[int] | None = None) -> dict[str, list[int]] | None:
    """Part of ``findings`` -> blocks that hold all trigrams of the query; None where the query has none.

    One entry per bucket at most, as the manifest has.
    """
    text = query.lower()
    grams = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not grams:
        return None
    parts = None if scans is None else {str(s) for s in scans}
    lists = now.read("postings", parts).where(F.col("gram").isin(grams)).groupBy("analysis_id", "bucket").agg(F.collect_list("blocks").alias("lists"))
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), F.array_intersect)
    found = lists.where(F.size("lists") == len(grams)).select("analysis_id", "bucket", both.alias("blocks")).where(F.size("blocks") > 0)
    return {f"{r.analysis_id}/{r.bucket}": r.blocks for r in found.collect()}


def search_scans(spark: SparkSession, root: str, query: str = "", limit: int = history.SEARCH_ROWS, scans: int | None = None, **filters) -> DataFrame:
    """``history.search_issues`` over the stored scans, through the index."""
    now = Snapshot.newest(spark, root)
    analyses = now.read("analyses").drop("bucket")
    newest = None
    if scans is not None:
        times = analyses.groupBy("analysis_id").agg(F.max("created_at").alias("created_at"))
        newest = [r.analysis_id for r in times.orderBy(*history.newest_first()).limit(scans).collect()]
    at = candidates(now, query, newest)
    if at is None:
        parts = None if newest is None else {p for p in now.parts("findings") if int(p.split("/")[0]) in newest}
        findings = now.read("findings", parts)
    else:
        rows = [(*map(int, p.split("/")), b) for p, blocks in at.items() for b in blocks]
        wanted = spark.createDataFrame(rows, "analysis_id long, bucket int, block int")
        findings = now.read("findings", set(at)).join(wanted, ["analysis_id", "bucket", "block"], "left_semi")
    return history.search_issues(analyses, findings.drop("bucket", "block"), query=query, limit=limit, scans=scans, **filters)


# --- projects ----------------------------------------------------------------

def _touched(now: Snapshot, table: str, keys: DataFrame, *by: str) -> set[str]:
    """Parts of a table that hold rows with one of the keys; one row per part comes to the driver."""
    prefix = ["analysis_id"] if table != "projects" else []
    hit = now.read(table).join(keys.select(*by).distinct(), list(by), "left_semi").select(*prefix, "bucket").distinct()
    return {"/".join(map(str, (*(["0"] if not prefix else []), *r))) for r in hit.collect()}


def _replaced(now: Snapshot, table: str, parts: set[str], change) -> tuple[dict, dict[str, list[str]]]:
    """New folders for some parts of a table, by a function of their rows."""
    changes: dict = {}
    for scan in sorted({p.split("/")[0] for p in parts}):
        mine = {p for p in parts if p.split("/")[0] == scan}
        done = now.written(table, change(now.read(table, mine)).repartition("bucket"), scan, "bucket")
        changes = {table: {"schema": done[table]["schema"], "parts": {**changes.get(table, {}).get("parts", {}), **done[table]["parts"]}}}
    return changes, {table: sorted(parts)}


def save_projects(projects: DataFrame, root: str) -> Snapshot:
    """All projects, in buckets by path."""
    now = Snapshot.newest(projects.sparkSession, root)
    buckets = _buckets(projects.count(), SUMMARY_ROWS)
    change = now.written("projects", _bucketed(projects, buckets, "path").repartition("bucket"), "0", "bucket")
    change["projects"]["buckets"] = buckets
    return now.commit(change, gone={"projects": list(now.parts("projects"))})


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    return Snapshot.newest(spark, root).read("projects").drop("bucket")


def create_projects(incoming: DataFrame, root: str) -> Snapshot:
    """Store incoming projects with a new path; only the buckets of their paths are rewritten."""
    now = Snapshot.newest(incoming.sparkSession, root)
    if "projects" not in now.tables:
        return save_projects(history.create_projects(incoming.limit(0), incoming), root)
    rows = store(_bucketed(incoming, now.tables["projects"]["buckets"], "path"), "incoming")
    parts = {f"0/{r.bucket}" for r in rows.select("bucket").distinct().collect()}
    change, gone = _replaced(now, "projects", parts, lambda held: history.create_projects(held, rows.select(*held.columns)))
    return now.commit(change, gone=gone)


def delete_projects(doomed: DataFrame, root: str) -> Snapshot:
    """Delete projects by id with their summaries and findings, at once; untouched buckets stay as they are.

    The index keeps blocks of deleted findings, which the search no longer verifies.
    """
    now = Snapshot.newest(doomed.sparkSession, root)
    ids = store(doomed.select("project_id").distinct(), "doomed")
    changes, gone = [], {}
    for table in ("projects", "analyses", "findings"):
        if now.parts(table) and (parts := _touched(now, table, ids, "project_id")):
            change, old = _replaced(now, table, parts, lambda held: held.join(ids, "project_id", "left_anti"))
            changes.append(change)
            gone |= old
    return now.commit(*changes, gone=gone)


def touch_projects(spark: SparkSession, root: str) -> Snapshot:
    """Set last_analyzed of stored projects to their newest stored scan; buckets without a newer scan stay."""
    now = Snapshot.newest(spark, root)
    held, analyses = now.read("projects"), now.read("analyses")
    newer = history.touch_projects(held.withColumn("_before", F.col("last_analyzed")), analyses).where("NOT last_analyzed <=> _before")
    parts = {f"0/{r.bucket}" for r in newer.select("bucket").distinct().collect()}
    if not parts:
        return now
    change, gone = _replaced(now, "projects", parts, lambda rows: history.touch_projects(rows, analyses).select(*rows.columns))
    return now.commit(change, gone=gone)
