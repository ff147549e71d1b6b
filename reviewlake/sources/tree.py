"""Directory trees: listed by a data source that prunes while it walks, opened only after selection.

``spark.read.format("source_tree")`` gives one row per file, without its content.  Excluded
and hidden directories are dropped as they are met, so nothing below them is listed.
The first levels are walked on the driver until there are enough directories to share out;
each remaining one is a partition that walks on by itself.  Symbolic links to
directories are not followed.

Contents are read in a second step, from the files that are left after selection, in
partitions of like size whatever directory they lie in.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reviewlake.packs.languages import EXCLUDED_DIRS
from reviewlake.session import store

NAME = "source_tree"
#: Directories that the driver finds before it shares them out, files per partition of those it met itself.
FANOUT, LISTED = 64, 1000
#: Contents of one partition, and of one batch inside it.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


def is_local(uri: str) -> bool:
    return uri.startswith("file:") or "://" not in uri


def local_path(uri: str) -> str:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def reachable(uri: str) -> bool:
    """Whether tasks can list and open this address themselves; other stores are left to Spark's own reader."""
    return is_local(uri) or uri.split(":", 1)[0] in ("hdfs", "s3", "gs", "abfs", "abfss")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def entries(uri: str) -> tuple[list[str], list[tuple[str, int, datetime]]]:
    """Addresses of the directories in a directory, and (address, size, time of change) of its files, by name."""
    dirs, files = [], []
    if is_local(uri):
        with os.scandir(local_path(uri)) as found:
            for e in sorted(found, key=lambda e: e.name):
                at = f"{uri.rstrip('/')}/{e.name}"
                if e.is_dir(follow_symlinks=False):
                    dirs.append(at)
                elif e.is_file():
                    s = e.stat()
                    files.append((at, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)))
        return dirs, files
    from pyarrow import fs

    system, path = _store(uri)
    for e in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda e: e.base_name):
        at = f"{uri.rstrip('/')}/{e.base_name}"
        if e.type == fs.FileType.Directory:
            dirs.append(at)
        elif e.type == fs.FileType.File:
            files.append((at, e.size, e.mtime))
    return dirs, files


def walked(uri: str) -> bool:
    name = uri.rstrip("/").rsplit("/", 1)[-1]
    return name not in EXCLUDED_DIRS and not name.startswith(".")


def walk(uri: str, listing=entries) -> Iterator[tuple[str, int, datetime]]:
    """Files below a directory; excluded and hidden directories are not entered."""
    pending = [uri]
    while pending:
        dirs, files = listing(pending.pop())
        yield from files
        pending += filter(walked, reversed(dirs))


class Share(InputPartition):
    """Files that the driver met, or a directory to walk."""

    def __init__(self, files, directory=None):
        super().__init__(None)
        self.files, self.directory = files, directory


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.fanout = int(options.get("fanout", FANOUT))

    def partitions(self):
        pending, met = deque([self.root]), []
        while pending and len(pending) < self.fanout:
            dirs, files = entries(pending.popleft())
            met += files
            pending += filter(walked, dirs)
        return [Share(met[i:i + LISTED]) for i in range(0, len(met), LISTED)] + [Share([], d) for d in pending] or [Share([])]

    def read(self, partition):
        for path, size, mtime in (walk(partition.directory) if partition.directory else partition.files):
            yield path, path[len(self.root) + 1:], size, mtime


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "path string, relative_path string, size bigint, mtime timestamp"

    def reader(self, schema):
        return SourceTreeReader(self.options)


def list_tree(spark: SparkSession, root: str, fanout: int = FANOUT) -> DataFrame:
    """Files below ``root``: path, relative_path, size, mtime; nothing is opened."""
    spark.dataSource.register(SourceTree)
    root = root if not is_local(root) else "file:" + os.path.abspath(local_path(root))
    return spark.read.format(NAME).option("fanout", fanout).load(root)


def _read(uri: str) -> bytes:
    if is_local(uri):
        with open(local_path(uri), "rb") as f:
            return f.read()
    system, path = _store(uri)
    with system.open_input_file(path) as f:
        return f.read()


def with_content(files: DataFrame, opened=None) -> DataFrame:
    """Add ``content``; ``opened`` is an accumulator that counts the files that were opened.

    The selection is stored first: its sizes say how many partitions the contents need.
    Rows go out as soon as a batch is full.
    """
    chosen = store(files, "selected")
    return opened_files(chosen, chosen.agg(F.sum("size")).first()[0] or 0, opened)


def opened_files(chosen: DataFrame, total: int, opened=None) -> DataFrame:
    """Add ``content`` to listed files of ``total`` bytes, or to each batch of a stream of them."""
    least = chosen.sparkSession.sparkContext.defaultParallelism if total > BATCH_BYTES else 1
    names = chosen.columns

    def run(batches):
        for batch in batches:
            start, contents, waiting = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                contents.append(_read(path))
                if opened is not None:
                    opened.add(1)
                waiting += len(contents[-1])
                if waiting >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*names, "content"])
                    start, contents, waiting = i + 1, [], 0

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.repartition(max(least, -(-total // PARTITION_BYTES)), "path").mapInArrow(run, f"{shape}, content binary")


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_tree(rows: DataFrame, root: str) -> None:
    """Write each row's ``content`` (binary) as the file ``relative_path`` below ``root``; a task that runs again writes the same files."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("relative_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{root.rstrip('/')}/{name}"
                if is_local(target):
                    os.makedirs(os.path.dirname(local_path(target)), exist_ok=True)
                    with open(local_path(target), "wb") as f:
                        f.write(content or b"")
                else:
                    system, path = _store(target)
                    system.create_dir(os.path.dirname(path))
                    with system.open_output_stream(path) as f:
                        f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    rows.select("relative_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()
