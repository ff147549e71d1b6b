"""The full file review: features, findings and scores in one narrow plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.syntax import Limits
from reviewlake.operators import metrics, rules, scoring
from reviewlake.operators.files import has_pack
from reviewlake.packs.metric_patterns import FEATURES
from reviewlake.packs.rules import builtin_packs, with_rules

NO_PACK = "No plugin available for this file type."


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan of fewer partitions than cores to all of them, for the regex work.

    A table may sit in a single row group, which one task reads whole however many
    splits the file is cut into.  Larger scans come in more partitions as they are.
    """
    if df.isStreaming:
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def review(files: DataFrame, packs=None, extra_rules=None, weights=None, models=None, own=(), limits: Limits = Limits()) -> DataFrame:
    """Review files given as (project_id, path, language, content).

    Returns one row per file with the 51 features, ``hits`` (findings), the six
    model scores, the six combined scores, issue counts, ``parse_errors`` and
    ``error``.  ``extra_rules`` maps a language to rules to add, ``weights``
    overrides health weights, ``models`` is an optional fitted scorer set, ``own``
    are the user's languages (``LanguagePack``), ``limits`` say when Python functions,
    parameter lists and classes are too large.  Language names match in any case.
    """
    packs = builtin_packs() if packs is None else packs
    if extra_rules:
        packs = with_rules(packs, extra_rules)
    packs = packs | {p.language: p.rules for p in own}
    names = F.create_map(*[F.lit(x) for name in packs for x in (name.lower(), name)])
    files = files.withColumn("language", F.coalesce(F.try_element_at(names, F.lower("language")), F.col("language")))
    known = F.col("language").isin(list(packs)) & has_pack(F.col("path"), own)
    df = files.withColumn("_reviewable", F.coalesce(known, F.lit(False)))
    df = df.withColumn("content", F.when(F.col("_reviewable"), F.col("content")).otherwise(F.lit("")))
    df = metrics.with_syntax(metrics.with_lines(df), limits)
    df = rules.with_hits(metrics.with_features(rules.validity(df), own), packs)
    df = df.withColumn("error", F.when(~F.col("_reviewable"), F.lit(NO_PACK)).otherwise(F.col("syntax.failure")))
    ok = F.col("error").isNull()
    df = df.withColumn("hits", F.when(ok, F.col("hits")).otherwise(F.array().cast(f"array<{rules.HIT_TYPE}>")))
    if models is None:
        df = scoring.with_heuristics(df)
    else:
        df = scoring.with_fallback(models.predict(df), models.available)
    df = scoring.with_issue_counts(scoring.with_scores(df, weights))
    blank = {c: F.when(ok, F.col(c)) for c in (*FEATURES, *scoring.ML_SCORES, *scoring.SCORES)}
    return df.withColumns(blank).drop(
        "content", "folded", "lines", "folded_lines", "stripped", "syntax", "_reviewable")


def issues(reviewed: DataFrame, packs=None) -> DataFrame:
    """Findings of reviewed files, one row each."""
    return rules.explode_issues(reviewed, packs)
