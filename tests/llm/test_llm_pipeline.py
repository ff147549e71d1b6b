"""The pipeline, stage by stage, against plain versions of its decisions."""

import collections

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from conftest import TESTDATA
from test_llm_operators import ITEM, LONG, ODD, PASSAGE, odd_docs

COLUMNS = pipeline.COLUMNS
STAGE = dict(pipeline.STAGES)


def texts(frame):
    rows = frame.collect()
    assert list(frame.columns)[:5] == COLUMNS
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


def test_language_stage(spark, docs):
    assert texts(STAGE["language_id"](spark, docs, TESTDATA)) == texts(docs)
    odd = odd_docs(spark, [(1000 + n, t) for n, (_, t) in enumerate(ODD)] + [(2040, "12 34 !?"), (2041, "La é le de de.")])
    kept = texts(STAGE["language_id"](spark, docs.unionByName(odd.select(*COLUMNS)), TESTDATA))
    assert 2040 not in kept and 2041 in kept and all(t and any(map(str.isalpha, t)) for t in kept.values())


def test_line_stage(spark, docs):
    got = texts(STAGE["line_dedup"](spark, docs, TESTDATA))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    key = lambda x: brute.ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    found, first = collections.Counter(), {}
    for i, t in rows:
        for n, x in enumerate(t.split("\n")):
            first.setdefault(key(x), (i, n))
        found.update({key(x) for x in t.split("\n")})
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if not (key(x) and found[key(x)] >= 10 and first[key(x)] != (i, n))) for i, t in rows}
    assert got == want and want != dict(rows)


def near_kept(spark, rows):
    """Texts that the stage keeps by id, and the ids that it must keep."""
    frame = odd_docs(spark, rows).select(*COLUMNS)
    return texts(STAGE["simhash_near_dedup"](spark, frame, TESTDATA)), {i for i, (_, least) in brute.simhash([r for r in rows if r[0] is not None]).items() if i == least}


def test_near_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = texts(STAGE["simhash_near_dedup"](spark, docs, TESTDATA))
    assert set(got) == {i for i, (_, least) in brute.simhash(rows).items() if i == least} and len(got) < len(rows)
    long = [f"w{n * n % 7919}" for n in range(4000)]
    edited = lambda *at: " ".join("changed" if n in at else w for n, w in enumerate(long))
    rows = [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (4, edited()), (5, edited(7)), (3, edited(7, 2000)), (6, None), (7, ""), (9, " \n"),
            (8, "few words"), (None, "few words"), (10, LONG), (11, LONG + " x")]
    got, want = near_kept(spark, rows)
    assert set(got) == want == {1, 3, 6, 8, 10} and got[3] == edited(7, 2000)


def test_near_stage_ids(spark):
    """One id with different texts: every group keeps one; nulls stay where a group has no other id."""
    frame = odd_docs(spark, [(1, PASSAGE), (1, "quite another text"), (2, "quite another text"), (None, "only null has this"), (None, "only null has this")])
    kept = sorted(map(str, ((r.doc_id, r.text) for r in STAGE["simhash_near_dedup"](spark, frame.select(*COLUMNS), TESTDATA).collect())))
    assert kept == sorted(map(str, [(1, PASSAGE), (1, "quite another text"), (None, "only null has this")]))


def test_line_stage_odd(spark):
    """Repeated rows are one document; null, empty and very long texts; a line stays in its first document."""
    rows = [(2, "Shared\nown")] * 12 + [(n, f" shared \n{n}") for n in range(10, 18)] + [(3, None), (4, ""), (5, LONG)]
    kept = lambda rows: sorted((r.doc_id, r.text) for r in STAGE["line_dedup"](spark, odd_docs(spark, rows).select(*COLUMNS), TESTDATA).collect())
    assert kept(rows) == sorted((i, t or "") for i, t in rows)
    rows += [(20, "SHARED")]
    want = [(i, "" if i == 20 else t.split("\n")[1] if 10 <= i < 18 else t or "") for i, t in rows]
    assert kept(rows) == sorted(want)


def test_leak_stage(spark, docs, tmp_path):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    hits = brute.decontaminate([(r.doc_id, r.text) for r in docs.collect()], items)
    got = texts(STAGE["benchmark_decontamination"](spark, docs, TESTDATA))
    assert set(got) == {i for i, h in hits.items() if not h[1]} and len(got) < len(hits)
    spark.createDataFrame([(1, "one"), (2, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd_docs(spark)
    kept = texts(STAGE["benchmark_decontamination"](spark, odd.select(*COLUMNS), str(tmp_path)))
    assert set(kept) == {i for i, _ in ODD} - {10, 11}
    spark.createDataFrame([(1, "the"), (2, "zyxq vvut")], "item_id bigint, text string").write.parquet(f"{tmp_path}/short/benchmark.parquet")
    clean = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the words of "), "id").alias("text"),
                                     *[F.lit(None).cast("string").alias(c) for c in ("lang", "source")], F.lit(None).cast("bigint").alias("n_chars"))
    many = clean.unionByName(odd_docs(spark, [(9001, "so zyxq, VVUT it is"), (9001, "so zyxq, VVUT it is"), (9002, "zyxq then vvut")]).select(*COLUMNS))
    kept = texts(STAGE["benchmark_decontamination"](spark, many, f"{tmp_path}/short"))
    assert 9001 not in kept and 9002 in kept and len(kept) == 2001


def test_mix_stage(spark, docs):
    rows = STAGE["source_mixing"](spark, docs, TESTDATA).collect()
    copies = collections.Counter((r.doc_id, r.text) for r in rows)
    assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(n)) for (i, _), n in copies.items())
    source = {r.doc_id: r.source for r in docs.collect()}
    aims = brute.targets([(r.source, r.text) for r in docs.collect()])
    taken, largest = collections.Counter(), collections.Counter()
    for (i, t), n in copies.items():
        assert n <= 2
        taken[source[i]] += n * len(brute.words(t))
    for r in docs.collect():
        largest[r.source] = max(largest[r.source], len(brute.words(r.text)))
    assert all(abs(taken[s] - aim) <= largest[s] for s, (_, aim) in aims.items())


def test_mix_stage_odd(spark):
    rows = STAGE["source_mixing"](spark, odd_docs(spark, [*ODD, ODD[7], ODD[7]]).select(*COLUMNS), TESTDATA).collect()
    copies = collections.Counter((r.doc_id, r.text) for r in rows)
    assert all(n <= (6 if i == 8 else 2) and brute.words(t) for (i, t), n in copies.items())
    assert all(sorted(r.copy for r in rows if r.doc_id == i and r.text == t) == list(range(n)) for (i, t), n in copies.items())


def test_whole_pipeline(spark, docs):
    rows = pipeline.run(spark, TESTDATA).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in docs.collect()} and len(rows) >= len(ids) > 0
    assert {name for name, _ in pipeline.STAGES} == set(STAGE) and 4 <= len(STAGE) <= 5


def test_empty_tables(spark, docs):
    frame = docs.limit(0)
    for name, stage in pipeline.STAGES:
        frame = stage(spark, docs.limit(0), TESTDATA)
        assert frame.count() == 0, name
