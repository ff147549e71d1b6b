"""Directories of source files as DataFrames."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.functions.text import unify_newlines
from reviewlake.operators.files import detect_language, file_name, pack_language, select_files, size_in_bounds
from reviewlake.packs.languages import EXTENSIONS
from reviewlake.packs.own import extensions_of
from reviewlake.session import store
from reviewlake.sources import tree


def decode(content: Column) -> Column:
    """UTF-8 when valid, else latin-1; line ends unified."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1"))
    return unify_newlines(text)


def _relative(path: Column, root: str) -> Column:
    plain = root.removeprefix("file:").rstrip("/") + "/"
    return F.substring(path, F.instr(path, F.lit(plain)) + len(plain), F.length(path))


def _globbed(spark: SparkSession, root: str, own=()) -> DataFrame:
    """Files with a supported extension by Spark's own reader, for stores that only Spark can open."""
    return _records(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                    .option("pathGlobFilter", supported_glob(own)).load(root), root)


def supported_glob(own=()) -> str:
    """File names with a supported extension, in any case."""
    either = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "*{" + ",".join(map(either, EXTENSIONS | extensions_of(own))) + "}"


def _records(found: DataFrame, root: str) -> DataFrame:
    return found.select("path", _relative(F.col("path"), root).alias("relative_path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("mtime"), "content")


def listing(spark: SparkSession, root: str, own=()) -> DataFrame:
    """Files below ``root`` without their contents, where the store can be walked."""
    return tree.list_tree(spark, root) if tree.reachable(root) else _globbed(spark, root, own)


def skipped_files(spark: SparkSession, root: str, max_bytes: int, own=()) -> DataFrame:
    """Supported files beyond the limit that a caller has set, with the reason; nothing is opened."""
    found = select_files(listing(spark, root, own), None, own).select("path", "size")
    return found.where(F.col("size") > max_bytes).withColumn("error", F.concat(F.lit("Larger than "), F.lit(str(max_bytes)), F.lit(" bytes.")))


def read_files(spark: SparkSession, root: str, project_id: str | Column = "project",
               max_bytes: int | None = None, own=(), opened=None) -> DataFrame:
    """Reviewable files under ``root`` with decoded content.

    The tree is walked without entering excluded and hidden directories, the files are
    selected by name and size, and only those selected are opened (``opened``, an
    accumulator, counts them).  Stores that only Spark can open are read by its binary
    reader, which lists everything and opens what has a supported extension.
    """
    if tree.reachable(root):
        raw = tree.with_content(select_files(tree.list_tree(spark, root), max_bytes, own), opened)
    else:
        raw = select_files(_globbed(spark, root, own).where(size_in_bounds(F.col("size"), max_bytes)), max_bytes, own)
    return _decoded(raw, project_id, own)


def stream_files(spark: SparkSession, root: str, project_id: str | Column = "project", max_bytes: int | None = None,
                 own=(), files_per_batch: int = 1000) -> DataFrame:
    """The files of :func:`read_files` as a stream, each once, as they land below ``root``.

    Spark's own reader finds them: files of excluded directories are dropped by name after it.
    """
    found = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("recursiveFileLookup", "true").option("pathGlobFilter", supported_glob(own))
             .option("maxFilesPerTrigger", files_per_batch).load(root))
    return _decoded(select_files(_records(found, root), max_bytes, own), project_id, own)


def arrivals(spark: SparkSession, root: str, known: str, max_bytes: int | None = None, own=(), files_per_batch: int = 1000) -> int:
    """List the reviewable files below ``root`` that ``known`` does not name and add them there; returns how many files ``root`` has.

    ``known`` holds one parquet file of paths and sizes for each ``files_per_batch`` files, which
    :func:`stream_listed` takes as one batch.  Files are known by their path.
    """
    chosen = store(select_files(listing(spark, root, own), max_bytes, own), "chosen")
    total, fresh = chosen.count(), chosen
    if tree.exists(spark, known):
        before = spark.read.schema(chosen.schema).option("recursiveFileLookup", "true").parquet(known)
        fresh = store(chosen.join(before, "path", "left_anti").select(*chosen.columns), "fresh")
    # Numbers without gaps: those before a row's partition, and its place in the partition.
    numbered = store(fresh.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = sorted(map(tuple, numbered.groupBy(part).count().collect()))
    if sizes:
        before = dict(zip((k for k, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
        start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
        batch = F.floor((start + F.col("_id").bitwiseAND((1 << 33) - 1)) / files_per_batch)
        rows = numbered.withColumn("batch", batch).drop("_id")
        rows.repartition("batch").write.partitionBy("batch").parquet(f"{known}/{uuid.uuid4().hex}")
    return total


def stream_listed(spark: SparkSession, known: str, project_id: str | Column = "project", own=()) -> DataFrame:
    """The files that :func:`arrivals` has listed as a stream, a batch for each of its parts; only listed files are opened."""
    held = spark.read.option("recursiveFileLookup", "true").parquet(known)
    # Batches are of like size, as they hold as many files; the largest says how many partitions the contents need.
    largest = held.groupBy(F.input_file_name()).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
    found = spark.readStream.schema(held.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(known)
    return _decoded(tree.opened_files(found, largest), project_id, own)


def _decoded(raw: DataFrame, project_id: str | Column, own) -> DataFrame:
    text = raw.withColumn("content", decode(F.col("content")))
    return text.select((project_id if isinstance(project_id, Column) else F.lit(project_id)).alias("project_id"), "path", "relative_path",
                       file_name(F.col("path")).alias("filename"), pack_language(F.col("path"), own).alias("language"),
                       detect_language(F.col("path"), F.col("content"), own).alias("detected_language"),
                       "size", "mtime", "content")
