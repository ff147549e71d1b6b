"""What several operators share: tables, words, stable row identity, digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as bytes and as a Java character class.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def identity() -> Column:
    """Identity of a document beside its id: repeated ids with different texts stay apart."""
    return F.xxhash64("text")


def word_count(text: Column) -> Column:
    """Words of a text, inside the JVM; null counts as no words."""
    inner = F.btrim(text, F.lit(SPACE.decode()))
    return F.when(inner.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, SPACE_CLASS))).cast("long")


def uniform(*columns, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the given values alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    x = values ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join that keeps one copy of the keys."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        part = left[k].eqNullSafe(right[f"_r_{k}"])
        on = part if on is None else on & part
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
