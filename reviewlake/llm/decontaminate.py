"""Benchmark decontamination (5): prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``window`` words (a shorter item is one
window).  A window is the set of its word shingles.  A document contains it only if
it contains all of them, so the join needs one shingle of each window, its prefix:
the rarest in the documents.  A candidate must have room for the whole window at
that offset (position and length bounds); then the words are compared exactly.

The prefixes are broadcast if their measured size allows it and the comparison runs
inside the scan of the documents.  Otherwise the join is shuffled by shingle and the
candidates are joined to their documents for the comparison.

Defined cases: null texts have no words; items without words have no windows;
repeated items share their windows; repeated rows of a document get the same result;
null ids are ids like any other; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.common import identity, same, table

#: Runs of ASCII characters other than letters and digits separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Broadcast limit of the prefixes.
PREFIX_BYTES = 32 << 20


def raw_words(text: Column) -> Column:
    """Words in their given case: case never moves a word's bounds."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shingle_at(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a position; lower() only widens what the exact comparison sees."""
    return F.xxhash64(*[F.lower(F.get(words, at + i)) for i in range(size)])


def windows_of(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, joined words of each window, its number of words and its shingle size."""
    words = F.split(F.array_join(raw_words(lowered(F.col("text"))), " "), " ")
    cut = items.select("item_id", words.alias("w")).where(F.col("w")[0] != "")
    size = F.least(F.size("w"), F.lit(window)).alias("n")
    cut = cut.select("item_id", "w", size).select(
        "item_id", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("i"))
    return cut.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("wtext"), "n",
                      F.least(F.col("n"), F.lit(shingle)).alias("k")).distinct()


def positions(docs: DataFrame) -> DataFrame:
    """One row per word position, with the words of the document at hand."""
    return docs.select("doc_id", identity().alias("_text"), raw_words(F.col("text")).alias("words")).select(
        "doc_id", "_text", "words", F.posexplode("words").alias("pos", "_word"))


def tokens(docs: DataFrame, sizes: list[int], *columns: str) -> DataFrame:
    """Shingles of the documents at the sizes that windows have."""
    at = positions(docs)
    parts = [at.select(*columns, F.lit(k).alias("k"), shingle_at(F.col("words"), F.col("pos"), k).alias("token")) for k in sizes]
    return reduce(DataFrame.unionByName, parts)


def small(df: DataFrame, text: str, limit: int) -> bool:
    return (df.agg(F.sum(F.length(text) + 48)).first()[0] or 0) <= limit


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                prefix_bytes: int = PREFIX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _text, start, n, wtext) of every window found in a document, and the windows of the items."""
    docs = docs.select("doc_id", "text")
    of_items = store(windows_of(items.select("item_id", "text"), window, shingle), "windows")
    unique = of_items.select("wtext", "n", "k").distinct()
    sizes = [r.k for r in of_items.select("k").distinct().orderBy("k").collect()] or [shingle]  # at most ``shingle`` values

    words = unique.select("*", F.split("wtext", " ").alias("words"))
    spots = words.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("offset"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, shingle_at(F.col("words"), F.col("offset"), k)) for k in sizes])
    spots = store(spots.select("wtext", "n", "k", "offset", hashed.alias("token")), "spots")

    # Rarity: how often each shingle of a window occurs in all documents.
    wanted = spots.select("k", "token").distinct()
    wanted = F.broadcast(wanted) if small(spots, "wtext", prefix_bytes) else wanted
    counts = store(tokens(docs, sizes).join(wanted, ["k", "token"]).groupBy("k", "token").agg(F.count("*").alias("found")), "rarity")

    # Shingles that no document has rule their windows out; the rarest of the others is the prefix.
    rated = spots.join(counts, ["k", "token"], "left").groupBy("wtext", "n", "k").agg(
        F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "token", "offset")).alias("first"))
    prefix = store(rated.where(F.col("first.found") > 0).select(
        "wtext", "n", "k", F.col("first.token").alias("token"), F.col("first.offset").alias("offset")), "prefixes")

    start = F.col("pos") - F.col("offset")
    room = (start >= 0) & (start + F.col("n") <= F.size("words"))
    equal = lowered(F.array_join(F.slice("words", start + 1, F.col("n")), " ")) == F.col("wtext")
    hit = ["doc_id", "_text", start.alias("start"), "n", "wtext"]
    if small(prefix, "wtext", prefix_bytes):
        # Each size is joined on its own: the words of a document stand beside its positions
        # only until the comparison, in one pass; a union below the join would copy them.
        parts = [tokens(docs, [k], "doc_id", "_text", "words", "pos").join(F.broadcast(prefix.where(F.col("k") == k)), ["k", "token"])
                 .where(room).where(equal).select(*hit) for k in sizes]
        found = reduce(DataFrame.unionByName, parts)
    else:
        near = tokens(docs, sizes, "doc_id", "_text", "pos").join(prefix, ["k", "token"]).where(start >= 0)
        near = near.select("doc_id", "_text", "pos", "offset", "n", "wtext").distinct()
        full = docs.select("doc_id", identity().alias("_text"), raw_words(F.col("text")).alias("words")).dropDuplicates(["doc_id", "_text"])
        found = same(near, full, ["doc_id", "_text"], "inner").where(room).where(equal).select(*hit)
    return store(found.distinct(), "hits"), of_items


def covered(hits: DataFrame) -> DataFrame:
    """doc_id, _text, n_hit: words inside any occurrence, each counted once."""
    spans = hits.groupBy("doc_id", "_text", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("doc_id", "_text").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    return spans.select("doc_id", "_text", fresh.alias("fresh")).groupBy("doc_id", "_text").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids found, sorted as strings)."""
    hits, of_items = occurrences(docs, items, window, shingle, prefix_bytes)
    seen = hits.select("doc_id", "_text", "wtext").distinct().join(of_items.select("item_id", "wtext"), "wtext")
    ids = seen.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = same(covered(hits), ids, ["doc_id", "_text"])
    every = docs.select("doc_id", identity().alias("_text"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return same(every, found, ["doc_id", "_text"]).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op5_decontaminate(spark, folder):
    out = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS t
  FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM i)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(w[p + 1:p + n], ' ') AS t FROM spots) JOIN windows USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
