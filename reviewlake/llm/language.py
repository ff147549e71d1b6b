"""Language ID (2): error-correcting output codes over character trigrams.

Every language has a codeword of bits.  For each bit a binary classifier tells the
languages with a 1 from those with a 0: its weight of a trigram is the log of the
ratio of the trigram's mean frequencies on the two sides.  A text's margin of a bit
is the mean weight of its trigrams, drawn towards 0 for very short texts.  Decoding
adds the logistic losses of the bits, each weighted by how well its classifier
separates the languages, and takes the codeword with the least loss; a small lead
over the next codeword marks the result as ambiguous.

Frequencies are counted by Spark, one row per language and used trigram bucket; the
driver holds languages x buckets numbers, however large the corpus.

Defined cases: null texts and texts without letters are ``und`` with score 0; with
one learned language every text with letters is of that language; with none all are
``und``; repeated rows get the same result; further columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import table, uniform

BUCKET_BITS = 16
#: About so many labelled documents are learned from per language.
ROWS_PER_LANGUAGE = 5000
SMOOTH = 0.1
#: Trigrams that a short text is filled up with, of no weight.
PRIOR_GRAMS = 8
#: A result is ambiguous if its score is below this.
CLEAR = 0.6
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of the letter trigrams of a text; empty if it has no letters."""
    clean = NOT_LETTERS.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, clean)):
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {clean.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + c[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 / -1: all splits for few languages, else seeded random words far apart."""
    if languages <= 7:
        bits = max(1, 2 ** (languages - 1) - 1)
        splits = np.arange(1, bits + 1)[None, :] << 1
        return np.where(splits >> np.arange(languages)[:, None] & 1, 1, -1)
    rng, best = np.random.default_rng(17), None
    width = int(np.ceil(10 * np.log2(languages)))
    for _ in range(50):
        code = rng.choice([-1, 1], (languages, width))
        near = (code @ code.T - 2 * width * np.eye(languages)).max()  # most equal bits of two words
        if (best is None or near < best[0]) and (abs(code.sum(axis=0)) < languages).all():
            best = near, code
    return best[1]


class Model(NamedTuple):
    """Languages, their codewords, and the weights and the trust of all bit classifiers."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray


def fit(languages: list[str], counts: np.ndarray) -> Model:
    code = codewords(len(languages)) if languages else np.zeros((0, 1), int)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1, 1), np.float32), np.ones(1))
    p = counts + SMOOTH
    p = p / p.sum(axis=1, keepdims=True)

    def side(sign):
        members = (code * sign > 0).astype(float)
        return (members / members.sum(axis=0)).T @ p

    weight = np.log(side(1) / side(-1)).T.astype(np.float32)
    # A classifier is trusted by the expected margin of the language that it serves least.
    trust = np.maximum(((p @ weight) * code).min(axis=0), 0.05)
    return Model(languages, code, weight, trust / trust.mean())


def decode(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score, ambiguous."""
    languages, code, weight, trust = model
    b = buckets(text)
    if not len(b) or not languages:
        return UNKNOWN, 0.0, True
    if len(languages) == 1:
        return languages[0], 1.0, False
    margin = weight[b].sum(axis=0, dtype=np.float64) / (len(b) + PRIOR_GRAMS)
    loss = (np.logaddexp(0, -code * margin) * trust).sum(axis=1)
    score = float(1 / np.exp(loss.min() - loss).sum())
    return languages[int(loss.argmin())], score, score < CLEAR


def train(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on about ``rows_per_language`` of the usable documents of each language, chosen by a hash of their id."""
    known = docs.select("doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return fit([], np.zeros((0, 1)))
    rates = F.create_map(*[F.lit(v) for k in languages for v in (k, rows_per_language / sizes[k])])
    sample = known.where(uniform("doc_id", seed=2) < rates[F.col("lang")])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
                np.add.at(counts[lang], buckets(text), 1)
        for lang, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(c[used])], ["lang", "bucket", "n"])

    totals = sample.select("lang", "text").mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    at = {k: i for i, k in enumerate(languages)}
    rows = totals.toArrow()
    counts[[at[k] for k in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return fit(languages, counts)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, lang_pred, score, ambiguous of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))  # bits x buckets numbers

    def run(batches):
        for batch in batches:
            found = [decode(held.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], [*carry, "lang_pred", "score", "ambiguous"])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, f"{shape}, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op2_language(spark, folder):
    docs = table(spark, folder, "documents")
    usable = F.coalesce(~held_out(), F.lit(True))
    out = identify(docs, train(docs, usable))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
