"""Reviewing files as they land, and running totals of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlake.plans.review import review
from reviewlake.session import store
from reviewlake.sources.files import stream_files
from reviewlake.sources.snapshots import Snapshot

TOTALS = "totals"
TOTAL_KEYS = ("project_id", "severity")
#: Parts of the stored totals; a batch rewrites those it touches.
TOTAL_BUCKETS = 32


def review_stream(spark: SparkSession, landing: str, schema, make_files=None, files_per_batch: int = 1000,
                  pattern: str | None = None, **options) -> DataFrame:
    """Review every parquet file that lands in a folder (stateless, same plan as in batch)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    arrived = reader.parquet(landing)
    return review(make_files(arrived) if make_files else arrived, **options)


def review_directory(spark: SparkSession, root: str, project_id="project", files_per_batch: int = 1000,
                     max_bytes: int | None = None, own=(), **options) -> DataFrame:
    """Review every source file that lands below a directory, each once."""
    return review(stream_files(spark, root, project_id, max_bytes, own, files_per_batch), own=own, **options)


def first_deliveries(issues: DataFrame, keys: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """Findings without those delivered before, by ``keys``.

    Rows older than the watermark are dropped as late, whether seen before or not, so a
    finding counts once however often it comes; state holds the keys of the last ``late``.
    """
    timed = issues.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def running_totals(issues: DataFrame) -> DataFrame:
    """Findings per project and severity so far; state is one counter per pair."""
    return issues.groupBy("project_id", "severity").agg(F.count("*").alias("issues"))


def windowed_totals(issues: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Findings per window, project and severity; rows later than ``late`` are dropped."""
    return (issues.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
            .groupBy(F.window("created_at", window).alias("w"), "project_id", "severity")
            .agg(F.count("*").alias("issues"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "project_id", "severity", "issues"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Process everything that has arrived, write it, stop.

    Append output goes to the exactly-once parquet sink.  Update output holds changed
    counters; each batch merges them into the stored totals (:func:`merge_totals`),
    which :func:`latest_totals` reads.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, number: merge_totals(batch, number, out)).start()
    query.awaitTermination()
    return query


def merge_totals(batch: DataFrame, number: int, out: str) -> None:
    """Replace the changed counters in the stored totals.

    The manifest carries the number of the last batch, so one that runs again changes
    nothing; only touched buckets are written, and versions before the last two are
    removed: the size follows the counters, not the batches.
    """
    spark = batch.sparkSession
    now = Snapshot.newest(spark, out)
    if now.tables.get(TOTALS, {}).get("batch", -1) >= number:
        return
    bucket = F.pmod(F.xxhash64("project_id"), F.lit(TOTAL_BUCKETS)).cast("int")
    changed = store(batch.withColumn("bucket", bucket), "changes")  # the state is run through once
    touched = [f"all/{r.bucket}" for r in changed.select("bucket").distinct().collect()]
    if not touched:
        return
    rows = changed
    if now.parts(TOTALS):
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in TOTAL_KEYS]
        rows = now.read(TOTALS, touched).alias("o").join(changed.alias("n"), same, "left_anti").select(*changed.columns).unionByName(changed)
    change = now.written(TOTALS, rows.repartition("bucket"), "all", "bucket")
    change[TOTALS]["batch"] = number
    now.commit(change).vacuum()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """Newest counter per project and severity."""
    now = Snapshot.newest(spark, out)
    if not now.parts(TOTALS):
        return spark.createDataFrame([], "project_id string, severity string, issues bigint")
    return now.read(TOTALS).drop("bucket")
