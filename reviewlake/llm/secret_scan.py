"""Secret scans (7): Boolean trigram queries over an inverted index, then exact verification.

Each rule's regex is read once and turned into a query: strings that every match must
contain become conjunctions of their trigrams, alternatives become disjunctions.  A
rule whose query is always true (no mandatory trigram) scans all texts.

The index is built per segment, a batch of documents inside a task: for every
trigram that some rule asks for, the posting list of the segment's documents that
hold it.  Rules intersect and unite postings and run their regex on the documents
that are left.  Segments are independent, so nothing is shuffled and memory is one
batch, however large the corpus.

Defined cases: null texts are empty; offsets are code points, ends exclusive; spans
of one rule are leftmost and do not overlap, spans of different rules may; repeated
rows are scanned each; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.literals import PatternReader, all_of, any_of
from reviewlake.functions.text import FOLDED_SPECIALLY
from reviewlake.llm.common import table


@dataclass(frozen=True)
class SecretRule:
    """``least``: shortest accepted length of ``group``; ``screened`` is an equal regex that rejects earlier."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    screened: str | None = None


#: Rules whose spans always count, in their order.
BASE = (
    SecretRule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs are maximal either way, so asking for 32 in the regex gives the same spans.
    SecretRule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
)
#: Further rules.
MORE = (
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    SecretRule("code_host_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("url_password", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)

def trigrams(strings) -> object:
    """A text must hold all ASCII trigrams of one of the strings (other letters fold in ways of their own)."""
    return any_of(all_of(*(s[i:i + 3] for i in range(len(s) - 2) if s[i:i + 3].isascii())) for s in strings)


def query_of(pattern: str) -> object:
    """Boolean trigram query of a regex over folded text; None is always true, as for a regex that the reader can't read."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"no regex: {pattern}") from e
    try:
        return PatternReader(pattern, trigrams).query()
    except ValueError:
        return None


def fold(text: str) -> bytes:
    """Lower case in which every character that matches an ASCII letter in any case is that letter."""
    if not text.isascii():
        for odd, plain in FOLDED_SPECIALLY.items():
            text = text.replace(odd, plain)
    return text.lower().encode()


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def candidates(query, postings: dict[str, np.ndarray], every: np.ndarray) -> np.ndarray:
    """Documents of a segment that satisfy a query."""
    if query is None:
        return every
    if isinstance(query, str):
        return postings[query]
    lists = sorted((candidates(q, postings, every) for q in query[1]), key=len)
    found = lists[0]
    for more in lists[1:]:
        found = np.intersect1d(found, more, assume_unique=True) if query[0] == "and" else np.union1d(found, more)
    return found


def spans_in(texts: list[str], rules, queries, wanted: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) of every text of a segment."""
    folded = [fold(x) for x in texts]
    postings = {t.decode(): np.array([i for i, x in enumerate(folded) if t in x], np.int64) for t in wanted}
    every, out = np.arange(len(texts)), [[] for _ in texts]
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = re.compile(rule.screened or rule.pattern)
        for i in candidates(query, postings, every).tolist():
            for m in regex.finditer(texts[i]):
                if len(m[rule.group]) >= rule.least:
                    out[i].append((m.start(), n, m.end()))
    return [sorted(x) for x in out]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE + MORE) -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end) by start, then by order of the rules."""
    queries = [query_of(r.pattern) for r in rules]
    wanted = sorted({t.encode() for q in queries for t in trigrams_of(q)})
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            spans = [[{"kind": kinds[n], "start": a, "end": b} for a, n, b in x] for x in spans_in(texts, rules, queries, wanted)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPAN)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secrets(spark, folder):
    out = find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
