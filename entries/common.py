"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake import review, spread
from reviewlake.operators import metrics, rules
from reviewlake.sources import tables

DIGITS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read(spark, folder, name)


def programs(spark: SparkSession, folder: str) -> DataFrame:
    """Program files built from the documents table."""
    return tables.program_corpus(spread(table(spark, folder, "documents"), "doc_id"))


def syntax_files(spark: SparkSession, folder: str) -> DataFrame:
    """Python and JSON files built from the documents table."""
    return tables.syntax_corpus(spread(table(spark, folder, "documents"), "doc_id"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return tables.page_corpus(spread(table(spark, folder, "pages"), "page_id"))


def event_files(spark: SparkSession, folder: str) -> DataFrame:
    return tables.event_corpus(spread(table(spark, folder, "events"), "event_id"))


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return tables.path_corpus(table(spark, folder, "documents"))


def features(files: DataFrame) -> DataFrame:
    return metrics.with_features(metrics.with_syntax(metrics.with_lines(files)))


def reviewed(spark: SparkSession, folder: str, **options) -> DataFrame:
    return review(programs(spark, folder), **options)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the program files."""
    return rules.explode_issues(reviewed(spark, folder))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    return tables.scan_history(table(spark, folder, "events"))


def projects(spark: SparkSession, folder: str) -> DataFrame:
    return tables.projects(table(spark, folder, "events"))


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names: str) -> list[Column]:
    return [F.round(F.col(n), DIGITS).alias(n) for n in names]


def sql_long(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def sql_rounded(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {DIGITS}) AS {n}" for n in names)
