"""Quality rules (4): boosted trees over document statistics, scored from flat node arrays.

Every document gets base counts and a vector of statistics.  Trees are fitted on a
bounded sample of labelled documents (at most ``MAX_ROWS`` vectors reach the driver)
with monotonic constraints on chosen statistics: more repetition or more symbols
never raise the score.  All trees are flattened into arrays of feature, threshold,
children and value, and a batch walks them with one numpy lookup per level.

Defined cases: null and empty texts have zero counts and fail the base rule; labels
without a value are ignored, repeated labels of a document are averaged; without
labels of both classes there is no model and the base rule decides; repeated rows
get the same result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import SPACE, table, texts

#: Bound of the labelled sample.
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, RIDGE = 60, 3, 0.2, 32, 10, 1.0
#: Documents the model scores below this are not kept.
CUT = 0.5

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
REPEAT = 8
FACTOR = np.uint64(0x5851F42D4C957F2D)

#: Statistics and the direction in which the score may move with them (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "unique_word_share": 0,
    "upper_share": 0, "digit_share": 0, "exclaim_per_word": -1, "stop_per_word": 0, "comma_per_word": 0, "words_per_line": 0,
    "top_word_share": 0, "other_share": 0, "top_sentence_share": 0,
}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of REPEAT words that the text holds twice or more."""
    if len(words) <= REPEAT:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - REPEAT + 1
    for width in (1, 2, 4):
        shift = np.uint64(pow(int(FACTOR), width, 1 << 64))
        h = h[:-width] * shift + h[width:]
    _, group, count = np.unique(h, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[group] > 1)
    if not len(again):
        return 0
    covered = np.zeros(n + REPEAT, np.int64)
    covered[again] += 1
    np.subtract.at(covered, again + REPEAT, 1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(data: bytes | None) -> tuple[list[int], list[float]]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the feature vector."""
    data = data or b""
    words = data.split()
    n = len(words)
    solid = data.translate(None, SPACE)
    chars = len(solid.decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines, seen, dup = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    per = max(n, 1)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    stops = data.count(b".") + data.count(b"?")
    sentences = [s for s in data.split(b".") if len(s) > 2]
    letters = len(data) - len(data.translate(None, LETTERS))
    upper = len(data) - len(data.translate(None, UPPER))
    digits = len(data) - len(data.translate(None, DIGITS))
    vector = [
        np.log1p(n), chars / per, symbols / per, dup / max(lines, 1), repeat / per, len(count) / per, upper / max(letters, 1),
        digits / max(chars, 1), data.count(b"!") / per, stops / per, data.count(b",") / per, n / max(lines, 1),
        max(count.values(), default=0) / per, (len(solid) - letters - digits) / max(len(solid), 1),
        1 - len(set(sentences)) / max(len(sentences), 1)]
    return [n, chars, symbols, dup, repeat], vector


@dataclass
class Trees:
    """All trees end to end; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for rows of statistics."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, direction: list[int]) -> Trees:
    """Second-order boosting over quantile bins, depth-wise, with bounds that keep monotonic directions."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), start)
    nodes, roots = [], []  # feature, threshold, left, right, value

    def weight(g, h, low, high):
        return float(np.clip(-g / (h + RIDGE), low, high))

    def grow(rows, grad, hess, depth, low, high):
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, me, me, RATE * weight(g, h, low, high)])
        if depth == DEPTH or len(rows) < 2 * LEAF_ROWS:
            total[rows] += nodes[me][4]
            return me
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + RIDGE) + (g - gs)**2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
            ok = (ns >= LEAF_ROWS) & (len(rows) - ns >= LEAF_ROWS)
            if direction[f]:
                a, c = np.clip(-gs / (hs + RIDGE), low, high), np.clip(-(g - gs) / (h - hs + RIDGE), low, high)
                ok &= (c - a) * direction[f] >= 0
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, weight(gs[k], hs[k], low, high), weight(g - gs[k], h - hs[k], low, high)))
        if best[1] is None:
            total[rows] += nodes[me][4]
            return me
        f, k, a, c = best[1]
        bounds = [(low, high), (low, high)]
        if direction[f]:
            middle = (a + c) / 2
            bounds = [(low, middle), (middle, high)] if direction[f] > 0 else [(middle, high), (low, middle)]
        goes = binned[rows, f] <= k
        nodes[me][:2] = f, edges[f][k]
        nodes[me][2] = grow(rows[goes], grad, hess, depth + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], grad, hess, depth + 1, *bounds[1])
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return Trees(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float), np.array(roots), start)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of a sample of the labelled documents, at most ``max_rows``."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the bound allows a broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").drop("doc_id")

    def run(batches):
        for batch in batches:
            rows = [statistics(t)[1] for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("quality")], ["x", "quality"])

    rows = sample.mapInArrow(run, "x array<double>, quality double").orderBy(F.xxhash64("x"), "quality", "x").limit(2 * max_rows).toArrow()  # repeated documents lose no class
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return x, (rows["quality"].to_numpy() >= 0.5).astype(float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees | None:
    x, y = training_rows(docs, labels, max_rows)
    return fit(x, y, list(FEATURES.values())) if 0 < y.sum() < len(y) else None


def rate(docs: DataFrame, model: Trees | None, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, score (null without a model), kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in texts(batch, "text")]
            base = np.array([b for b, _ in rows], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
            score = model.score(np.array([v for _, v in rows]).reshape(-1, len(FEATURES))) if model else None
            kept = ~failed if score is None else ~failed & (score >= cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in base.T], pa.array(failed),
                 pa.array(score) if model else pa.nulls(len(rows), pa.float64()), pa.array(kept)],
                ["doc_id", *names, "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_failed boolean, score double, kept boolean")


def op4_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return rate(docs, train(docs, table(spark, folder, "labels")))
