"""Row selection: top rows per group under skew, and filters evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 256


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank",
                  slices: int | None = None) -> DataFrame:
    """First ``k`` rows of each group in the given (total) order, with their rank.

    Two steps, so that no task sees a whole hot group: each group is cut into
    hash slices that keep their own first ``k`` rows, then the survivors (at most
    ``k * slices`` per group) are ranked.  Exact: a row outside its slice's first
    ``k`` has ``k`` better rows already.  Spark adds a partial group limit below
    both shuffles for small ``k``.
    """
    slices = slices or SLICES
    salt = F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if _hashable(t)]), F.lit(slices))
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    local = (df.withColumn("_slice", salt).withColumn("_local", F.row_number().over(first))
             .where(F.col("_local") <= k).drop("_slice", "_local"))
    return local.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)


def keep_where(df: DataFrame, test: Column) -> DataFrame:
    """Filter on a costly computed column without computing it twice.

    A plain ``where`` on a review column is pushed below the projections that
    make it, so its whole expression runs once for the filter and once more for
    the output.  A filter on a generated column stays above them.
    """
    kept = df.select("*", F.explode_outer(F.when(test, F.array(F.lit(True)))).alias("_kept"))
    return kept.where(F.col("_kept")).drop("_kept")


def _hashable(dtype: str) -> bool:
    return not dtype.startswith(("map", "array", "struct", "variant"))
