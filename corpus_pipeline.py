"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Language ID, line dedup, SimHash near-dedup, benchmark decontamination and mixing,
in this order.  All but the last return the columns of ``documents``.

Defined cases, beside those of the operators: a null or letterless text is rejected by
the first stage; repeated rows pass the first two stages and leave one row in the third;
ties go to the smallest doc_id, null last; empty tables give empty results; further
columns of the documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm import decontaminate, language, lines, mixing, simhash
from reviewlake.llm.common import identity, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its language is no likelier than this many times chance.
LEAST_LEAD = 1.2
#: A line found in so many documents stays in the first one only.
LINE_DOCS = 10
#: Shingle length and bit distance of near-duplicates.
SHINGLE_WORDS, BIT_DISTANCE = 4, 4
#: Items of fewer words are evidence of a leak only where at most this share of the documents holds them.
ITEM_WORDS, RARE_SHARE = 5, 0.001


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` is filled in where it was unknown."""
    model = language.train(docs, F.lit(True))
    found = language.identify(docs, model, tuple(COLUMNS))
    least = LEAST_LEAD / len(model.languages) if len(model.languages) > 1 else 0.0
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has and many share; a null text becomes an empty one."""
    out = lines.dedup_lines(docs, LINE_DOCS, True, carry=("doc_id", "lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints chain within the bit distance; texts without words are one group."""
    return simhash.keep_one(docs.select(*COLUMNS), SHINGLE_WORDS, BIT_DISTANCE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; an item shorter than a window is one.

    Items of one to four words are common speech as often as leaks: they count where they
    are rare in the documents.  Documents without words stay.
    """
    hits, _ = decontaminate.occurrences(docs, table(spark, sf_dir, "benchmark"))
    short = hits.where(F.col("n") < ITEM_WORDS).select("wtext", "doc_id", "_text").distinct().groupBy("wtext").agg(F.count("*").alias("held"))
    usual = short.where(F.col("held") > RARE_SHARE * docs.count()).select("wtext")
    leaks = hits.join(usual, "wtext", "left_anti").select(F.xxhash64("doc_id").alias("_id"), "_text").distinct()
    marked = docs.select(*COLUMNS, F.xxhash64("doc_id").alias("_id"), identity().alias("_text"))
    return marked.join(leaks, ["_id", "_text"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken; ``copy`` counts its repeats from 0.

    Repeated rows are one document, taken as often as they are together; documents
    without words are never taken, a null source is a source.
    """
    taken = mixing.mix(docs).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    # The tie names the document, id and text; texts meet it once and repeats on the same key.
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("tie"))
    taken = taken.select(F.xxhash64("doc_id").alias("_id"), "tie", "copies")
    rows = rows.join(taken, ["_id", "tie"]).dropDuplicates(["_id", "tie"])
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: No SQL: learned weights, fingerprints and random rounding are checked against plain versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
