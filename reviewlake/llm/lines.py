"""Line dedup (3): two Bloom filters pick suspected repeats, an exact count confirms them.

1. Every line key is hashed; the repeat filter (``bloom``) learns which hashes
   occur in more than one document.  No line leaves its task.
2. Only suspected lines are sent, once per document, and counted exactly by their
   key with map-side sums, together with their first occurrence.  A document is its
   doc_id and text: rows that repeat both are found by hashes and sent once.
3. Confirmed keys are dropped from every document, or from all but the first.

The confirmed keys are broadcast if their measured size allows it; otherwise the
line numbers to drop reach each document by two joins.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` are never dropped; a key repeated inside one document counts once;
repeated rows (doc_id and text) count as one document and are treated alike; first occurrences go by doc_id (null
first), then line; further columns are carried only when named in ``carry``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.bloom import repeat_filter
from reviewlake.llm.common import SPACE, identity, same, table, texts

#: Broadcast limit of the confirmed keys.
KEYS_BYTES = 32 << 20


def keys_of(text: bytes | None) -> list[bytes]:
    """Keys of a text's lines: stripped, A-Z in lower case."""
    return [x.strip(SPACE) for x in (text or b"").lower().split(b"\n")]


def hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))


def counted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def once(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, _text), repeated ones once; only texts that repeat are shuffled."""
    key = ["_id", "_text"]
    named = docs.withColumn("_id", F.xxhash64("doc_id"))
    again = store(named.groupBy(*key).count().where("count > 1").select(*key), "repeated")
    if again.isEmpty():
        return docs
    lone, repeated = named.join(again, key, "left_anti"), named.join(again, key, "left_semi")
    return lone.unionByName(repeated.dropDuplicates(key)).select(*docs.columns)


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1,
                carry: tuple[str, ...] = ("doc_id",), keys_bytes: int = KEYS_BYTES) -> DataFrame:
    """Rows of ``docs``: carried columns, kept text, n_lines, n_dropped."""
    slim = docs.select("doc_id", "text", identity().alias("_text"))
    min_chars = max(1, min_chars)

    def distinct(text):
        return [k for k in dict.fromkeys(keys_of(text)) if counted(k, min_chars)]

    attach, probes = repeat_filter(slim, lambda batch: (hashes(distinct(t)) for t in texts(batch, "text")))

    def suspects(batches):
        for batch in batches:
            rows, ids = [], []
            for i, (text, probe) in enumerate(zip(texts(batch, "text"), probes(batch), strict=True)):
                keys = keys_of(text)
                first = {}
                for line, k in enumerate(keys):
                    if k not in first and counted(k, min_chars):
                        first[k] = line
                if first:
                    for (k, line), hit in zip(first.items(), probe(hashes(list(first))).tolist(), strict=True):
                        if hit:
                            rows.append((k, line))
                            ids.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())], ["doc_id", "line", "key"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    repeated = store(
        attach(once(slim)).mapInArrow(suspects, f"doc_id {kind}, line bigint, key string").groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line")).alias("first"))
        .where(F.col("n_docs") >= min_docs).select("key", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")),
        "lines")
    size = repeated.agg(F.sum(F.length("key") + 24)).first()[0] or 0
    columns = list(dict.fromkeys([*carry, "doc_id"]))
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    out = f"{shape}, kept string, n_lines bigint, n_dropped bigint"
    if size <= keys_bytes:
        known = docs.sparkSession.sparkContext.broadcast(
            {r.key.encode(): (r.first_doc, r.first_line) for r in repeated.toLocalIterator()})

        def gone(text, doc):
            table = known.value
            for line, k in enumerate(keys_of(text)):
                first = table.get(k)
                if first is not None and not (keep_first and first == (doc, line)):
                    yield line

        wanted, source = lambda batch: map(gone, texts(batch, "text"), batch.column("doc_id").to_pylist()), docs
    else:
        def spread(batches):
            for batch in batches:
                rows = [(i, line, k) for i, t in enumerate(texts(batch, "text")) for line, k in enumerate(keys_of(t))]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("_text").take(at), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], ["doc_id", "_text", "line", "key"])

        lines = slim.distinct().mapInArrow(spread, f"doc_id {kind}, _text bigint, line bigint, key string")
        lines = lines.join(repeated, "key")
        if keep_first:
            lines = lines.where(~(F.col("first_doc").eqNullSafe(F.col("doc_id")) & (F.col("first_line") == F.col("line"))))
        dropped = lines.groupBy("doc_id", "_text").agg(F.collect_set("line").alias("_gone"))
        source = same(docs.select(*columns, "text", identity().alias("_text")), dropped, ["doc_id", "_text"]).drop("_text")
        wanted = lambda batch: (x or () for x in batch.column("_gone").to_pylist())

    def cut(batches):
        for batch in batches:
            kept, total, lost = [], [], []
            for text, lines in zip(texts(batch, "text"), wanted(batch), strict=True):
                out, drop = (text or b"").split(b"\n"), set(lines)
                kept.append(b"\n".join([x for i, x in enumerate(out) if i not in drop]) if drop else text or b"")
                total.append(len(out))
                lost.append(len(drop))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())],
                [*columns, "kept", "n_lines", "n_dropped"])

    source = source.select(*columns, "text", *(["_gone"] if "_gone" in source.columns and size > keys_bytes else []))
    return source.mapInArrow(cut, out).select(*carry, "kept", "n_lines", "n_dropped")


def op3_lines(spark, folder):
    out = dedup_lines(table(spark, folder, "documents"), min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


STRIPPED = r"trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP3_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row(doc_id, md5(text)) AS doc, row_number() OVER () AS rid FROM documents),
lines AS (
  SELECT doc_id, doc, rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
keyed AS (SELECT doc_id, doc, rid, i, line, {STRIPPED} AS key FROM lines),
heavy AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(heavy.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (heavy.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN heavy USING (key) GROUP BY rid
"""
