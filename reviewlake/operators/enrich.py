"""Explanations and security standards of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.packs.explanations import DEFAULTS, EXPLANATIONS, FIELDS, TITLE_KEYS


def explanation_table(spark: SparkSession) -> DataFrame:
    """One row per explanation key (a fixed handful)."""
    schema = ", ".join(f"{c} string" for c in ("explained_by", *FIELDS))
    return spark.createDataFrame([(k, *v) for k, v in EXPLANATIONS.items()], schema)


def explanation_key() -> Column:
    """The rule's own key, else the key of the first matching title text."""
    own = F.when(F.col("rule_id").isin(list(EXPLANATIONS)), F.col("rule_id"))
    by_title = [F.when(F.contains(F.col("title"), F.lit(text)), F.lit(key)) for text, key in TITLE_KEYS]
    return F.coalesce(own, *by_title)


def explain(issues: DataFrame) -> DataFrame:
    """Add the 13 explanation texts; fields without own text take the default."""
    texts = F.broadcast(explanation_table(issues.sparkSession))  # fixed table
    joined = issues.withColumn("explained_by", explanation_key()).join(texts, "explained_by", "left")
    quoted = F.when(F.col("code_snippet") != "", F.col("code_snippet")).otherwise(
        F.concat(F.lit("at line "), F.col("line_number").cast("string")))
    filled = {}
    for name, default in zip(FIELDS, DEFAULTS):
        text = F.lit(default)
        if "{fragment}" in default:
            text = F.replace(text, F.lit("{fragment}"), quoted)
        filled[name] = F.coalesce(F.col(name), text)
    return joined.withColumns(filled)


def standards(issues: DataFrame) -> DataFrame:
    """Findings per standard tag (CWE, OWASP, CERT, style guides).

    Findings are first counted per (rule, title), a table no larger than the rule
    set, so only those counts are enriched and exploded.
    """
    counted = issues.groupBy("rule_id", "title").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("explained_by", explanation_key())
    texts = F.broadcast(explanation_table(issues.sparkSession).select("explained_by", "standards"))
    default = DEFAULTS[FIELDS.index("standards")]
    tags = keyed.join(texts, "explained_by", "left").select(
        "n", F.explode(F.split(F.coalesce("standards", F.lit(default)), ", ")).alias("standard"))
    return tags.groupBy("standard").agg(F.sum("n").alias("findings"))
