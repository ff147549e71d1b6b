"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # File contents travel to the syntax helper in bounded Arrow batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def session(app: str = "reviewlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"reviewlake-{application}-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a local-mode session (tests) gets its own folder; a
    cluster session must name one, since executors cannot share a driver disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage with data that outlives executors; used where one result
    feeds several aggregations.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
