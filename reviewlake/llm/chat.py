"""Chat formatting (8): schema fingerprints choose the mapping from a record to turns.

A record is a JSON object.  Its nested field paths, as far as some layout knows
them, are sorted and hashed; the hash finds a declarative mapping, which turns the
record into canonical (role, text) turns.  A template renders the turns with a
loss mask over the assistant texts and can be read back without loss.

Defined cases: null texts are empty; null roles are empty; a record that is null,
not an object or of an unknown layout keeps its row with null layout, turns and
formatted text; turns of a conversation table are ordered by turn (null first),
then role, then text, repeated rows included; further columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import digest, table

START, END = "<|im_start|>", "<|im_end|>"

#: Layout name: list to walk, role and text fields in it; or (role, fields joined by a blank line) in order.
LAYOUTS = {
    "messages": {"each": "messages", "role": "role", "text": "content"},
    "conversations": {"each": "conversations", "role": "from", "text": "value"},
    "dialog": {"each": "dialog", "role": "speaker", "text": "utterance"},
    "instruction": {"turns": [("system", ["system?"]), ("user", ["instruction", "input?"]), ("assistant", ["output"])]},
    "prompt_completion": {"turns": [("system", ["system?"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"turns": [("system", ["system?"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "question_answer": {"turns": [("user", ["context?", "question"]), ("assistant", ["answer"])]},
    "nested_prompt": {"turns": [("system", ["prompt.system?"]), ("user", ["prompt.user"]), ("assistant", ["response.text"])]},
}
#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, prefix="") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


def registry(layouts=LAYOUTS) -> tuple[frozenset, dict[int, str]]:
    """Paths that layouts know, and the layout of each fingerprint."""
    known, found = set(), {}
    for name, layout in layouts.items():
        if "each" in layout:
            variants = [{f"{layout['each']}[].{layout[k]}" for k in ("role", "text")}, {f"{layout['each']}[]"}]
        else:
            fields = [f for _, fs in layout["turns"] for f in fs]
            fixed = {f for f in fields if f[-1] != "?"}
            optional = [f[:-1] for f in fields if f[-1] == "?"]
            variants = [fixed | set(x) for n in range(len(optional) + 1) for x in itertools.combinations(optional, n)]
        for v in variants:
            known |= v
            found.setdefault(fingerprint(v), name)
    return frozenset(known), found


def reach(record, path):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: dict) -> list[tuple[str, str]]:
    if "each" in layout:
        rows = [(as_text(x.get(layout["role"])), as_text(x.get(layout["text"]))) for x in record[layout["each"]]]
        return [(r if layout["each"] == "messages" else ROLES.get(r, r), t) for r, t in rows]
    out = []
    for role, fields in layout["turns"]:
        values = [as_text(reach(record, f.rstrip("?"))) for f in fields]
        given = [v for v, f in zip(values, fields, strict=True) if v or f[-1] != "?"]
        if given:
            out.append((role, "\n\n".join(given)))
    return out


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text, and the code point spans of the assistant texts in it."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT = "layout string, turns array<struct<role:string,text:string>>, formatted string, mask array<struct<start:bigint,end:bigint>>"


def format_records(df: DataFrame, key: str, record: str, layouts=None) -> DataFrame:
    """One row per record: key, layout, turns, formatted text and loss mask."""
    layouts = layouts or LAYOUTS
    known, found = registry(layouts)

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
            name = found.get(fingerprint(field_paths(value) & known)) if isinstance(value, dict) else None
        except (ValueError, RecursionError):  # no JSON, or nested beyond what any layout has
            name = None
        if name is None or "each" in layouts[name] and not all(isinstance(x, dict) for x in value[layouts[name]["each"]]):
            return None, None, None, None
        turns = turns_of(value, layouts[name])
        formatted, mask = render(turns)
        return name, [{"role": r, "text": t} for r, t in turns], formatted, [{"start": a, "end": b} for a, b in mask]

    def run(batches):
        for batch in batches:
            rows = [one(x) for x in batch.column(1).to_pylist()]
            names, turns, formatted, mask = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(turns, TURNS), pa.array(formatted, pa.string()), pa.array(mask, MASK)],
                [key, "layout", "turns", "formatted", "mask"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, record).mapInArrow(run, f"`{key}` {kind}, {OUT}")


def records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation from rows by turn."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kept = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(kept.alias("messages"))).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests, read back from the formatted text and its mask alone."""

    def run(batches):
        for batch in batches:
            out = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"]:m["end"]]) for m in mask)
                out.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns).encode()), len(loss), digest(loss.encode()), len(text)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "mask").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    probe = probe.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns])
    return digests(format_records(records(rows.union(probe)), "conv_id", "record"))


ESCAPED = r"length(replace(replace(%s, '\', '\\'), '<|', '<\|'))"

OP8_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + {ESCAPED % "role"} + length(role) - length(replace(role, chr(10), '')) + {ESCAPED % "text"}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
