"""Conversation structure repair (13): run-length dynamic programming over role and fault symbols.

Every row of a conversation becomes a symbol: must be deleted (blank or repeated), or the
initial of its role with or without a truncated text.  Equal consecutive symbols collapse
to a run.  A symbol is a min-plus matrix between the four states of the grammar
``(s?(ua)+)?`` (what was kept last), insertions before the row included; its powers of
two are cached, so a run of any length moves the costs back in as many products as its
length has bits.  The audit is unrolled forwards: from the known costs of what follows,
each step takes the ASCII-least edit that stays cheapest; runs are halved by the
same powers until a piece is short.

Rows meet twice.  First without their texts (turn, role, the head and a digest of the text):
repeats are ranked by a window inside the shuffle by conversation, rows arrive sorted and
stream through the dynamic programme, which keeps a byte per row of one conversation.  Then
with their texts, behind the audit of their conversation, sorted the same way: texts stream
through the repair, so a conversation with many or long rows needs no memory for them.
The digest of a repaired conversation is sequential, so a conversation is one task's work.

Defined cases: rows of one turn go by role, then by the first ``HEAD`` code points and
the digest of the text; null roles and texts are one space, a null turn comes first, a
null conv_id is a conversation; initials are first code points, any other than s, u, a
and an empty role are legal nowhere; a repeated row is a duplicate; empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import table

# --- Fixed values -----------------------------------------------------------
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs; keeping is free
LEGAL_PAIRS = ("su", "ua", "au")
# ----------------------------------------------------------------------------

#: Code points of a text that order rows of one turn and role.
HEAD = 32
#: Pieces of a run that are unrolled row by row.
PIECE = 64
FAR = 1 << 60

# States: nothing kept yet, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a kept initial leads.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where the only legal user or assistant row leads, which an insertion or a new role gives.
NEXT = (USER, USER, ASSISTANT, USER)
DONE = (0, FAR, FAR, 0)
#: Symbol 0 must be deleted; symbol 1 + 2 * i + t has initial i of INITIALS and a truncated text if t is 1.
INITIALS = ("s", "u", "a", "")

Matrix = tuple[tuple[int, ...], ...]


def inserted() -> Matrix:
    """Cost of reaching a state by insertions alone."""
    rows = []
    for s in STATES:
        cost, at, n = [FAR] * 4, s, 0
        while cost[at] == FAR:
            cost[at] = n * INSERT
            at, n = NEXT[at], n + 1
        rows.append(tuple(cost))
    return tuple(rows)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[s][m] + b[m][t] for m in STATES) for t in STATES) for s in STATES)


def times(a: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(FAR, *(a[s][t] + costs[t] for t in STATES)) for s in STATES)


INSERTED = inserted()


@lru_cache
def choices(symbol: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits that consume a row: letter, cost, next state; in ASCII order."""
    out = []
    for s in STATES:
        edits = [("D", DELETE, s)]
        if symbol:
            initial, late = INITIALS[(symbol - 1) // 2], (symbol - 1) % 2 * TRUNCATED
            if (s, initial) in KEEP:
                edits.append(("K", late, KEEP[s, initial]))
            edits.append(("R", REROLE + late, NEXT[s]))
        out.append(tuple(edits))
    return tuple(out)


@lru_cache(maxsize=1024)
def power(symbol: int, k: int) -> Matrix:
    """Transition of 2**k rows of one symbol, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    step = [[FAR] * 4 for _ in STATES]
    for s in STATES:
        for _, cost, t in choices(symbol)[s]:
            step[s][t] = min(step[s][t], cost)
    return product(INSERTED, tuple(map(tuple, step)))


def before(symbol: int, n: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a run, from those behind it."""
    k = 0
    while n:
        if n & 1:
            costs = times(power(symbol, k), costs)
        n, k = n >> 1, k + 1
    return costs


def unrolled(symbol: int, n: int, state: int, costs: tuple[int, ...]) -> Iterator[tuple[str, int]]:
    """Pieces of the audit of a run and the state behind each; ``costs`` hold behind the run."""
    if n > PIECE:
        half = n // 2
        for letters, state in unrolled(symbol, half, state, before(symbol, n - half, costs)):
            yield letters, state
        yield from unrolled(symbol, n - half, state, costs)
        return
    behind = [costs]
    for _ in range(n):
        behind.append(times(power(symbol, 0), behind[-1]))
    letters = []
    for i in range(n, 0, -1):
        here, then, edits = behind[i], behind[i - 1], choices(symbol)
        while True:
            letter, state_behind = next(
                (x, t) for x, cost, t in sorted([*edits[state], ("I", INSERT, NEXT[state])])
                if cost + (here if x == "I" else then)[t] == here[state])
            letters.append(letter)
            state = state_behind
            if letter != "I":
                break
    yield "".join(letters), state


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of equal consecutive symbols."""
    out, at = [], 0
    while at < len(symbols):
        symbol, n = symbols[at], 1
        while symbols[at:at + n] == symbols[at:at + 1] * n and at + n < len(symbols):
            n *= 2
        n = len(symbols[at:at + n]) - len(symbols[at:at + n].lstrip(symbols[at:at + 1]))
        out.append((symbol, n))
        at += n
    return out


def cheapest(symbols: bytes) -> tuple[int, str]:
    """Cost and audit of one conversation."""
    runs = runs_of(symbols)
    behind = [times(INSERTED, DONE)]
    for symbol, n in reversed(runs):
        behind.append(before(symbol, n, behind[-1]))
    cost, state, letters = behind.pop()[START], START, []
    for symbol, n in runs:
        for piece, state in unrolled(symbol, n, state, behind.pop()):
            letters.append(piece)
    while DONE[state]:
        letters.append("I")
        state = NEXT[state]
    return cost, "".join(letters)


class Conversation:
    """What one conversation's rows add up to, in their order; keeps one byte per row."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, bytearray()
        self.faults = [0, 0, 0]
        self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None

    def add(self, turn, initial: str, symbol: int, fault: int) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if fault:
            self.faults[fault - 1] += 1
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL_PAIRS
        self.initial = initial
        self.symbols.append(symbol)

    def row(self) -> tuple:
        cost, audit = cheapest(bytes(self.symbols))
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, (1 << 63) - 1)
        return (self.conv_id, gaps, *self.faults, self.illegal, cost, audit)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversation rows with the faults of the contract; ``dropped`` marks rows that are gone."""
    conv, turn = _key()
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn)), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("dropped"),
                       F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


ORDER = ("turn", "role", "head", "digest")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with what orders them: null values as one space, head and digest of the text, whether they are dropped."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))})


def _last_character() -> Column:
    """Last character of the text that is no white space; empty for blank texts."""
    return F.right(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), F.lit(1))


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost and audit.  Conversations whose rows are all dropped have zeros."""
    last = _last_character()
    light = prepared(rows).select("conv_id", *ORDER, "dropped", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("late"))
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "digest").orderBy("turn")) > 1
    light = light.repartition("conv_id").withColumn("again", again)
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("late"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[:3])), initial) - 1, F.lit(-1))
    place = F.when(place < 0, len(INITIALS) - 1).otherwise(place)
    symbol = F.when(F.col("blank") | F.col("again"), 0).otherwise(1 + 2 * place + F.col("late").cast("int"))
    light = light.sortWithinPartitions("conv_id", *ORDER, "again")
    light = light.select("conv_id", "turn", "dropped", initial.alias("initial"), symbol.cast("int").alias("symbol"), fault.alias("fault"))

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv_id, turn, dropped, initial, symbol, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv_id)
                if not dropped:
                    now.add(turn, initial, symbol, fault)
            if done:
                yield packed(done)
        if now is not None:
            yield packed([now.row()])

    def packed(done):
        ids, *counts, audit = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, key), *[pa.array(c, pa.int64()) for c in counts], pa.array(audit, pa.string())], ["conv_id", *COUNTS, "audit"])

    key = _arrow_type(rows, "conv_id")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return light.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


class Mender:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _role(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state, role[0]]
            yield role, text
        elif letter == "R":
            yield self._role(), text


def _mended(rows: DataFrame, planned: DataFrame, run, shape: str) -> DataFrame:
    """Rows behind the plan of their conversation, sorted, through ``run``."""
    kinds = dict(rows.dtypes)
    texts = prepared(rows).where("NOT dropped").select("conv_id", F.lit(1).alias("part"), *ORDER, "text", F.lit(None).cast("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">").alias("counts"))
    heads = planned.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(kinds["turn"]).alias("turn"), F.lit("").alias("role"), F.lit("").alias("head"),
                           F.lit(b"").alias("digest"), F.col("audit").alias("text"), F.struct(*COUNTS).alias("counts"))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    return both.select("conv_id", "part", "role", "text", "counts").mapInArrow(run, shape)


def _rows(batch):
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    key, kind = _arrow_type(rows, "conv_id"), rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, place = None, 0
        for batch in batches:
            out = []
            for conv_id, part, role, text, _ in _rows(batch):
                if part == 0:
                    if now:
                        out += ((now[0], *x) for x in now[1].inserts())
                    now = conv_id, Mender(text)
                else:
                    out += ((conv_id, *x) for x in now[1].row(role, text))
            place, numbered = _numbered(out, place)
            yield packed(numbered)
        if now:
            yield packed(_numbered([(now[0], *x) for x in now[1].inserts()], place)[1])

    def _numbered(out, place):
        # ``place`` is the conversation and number of the last row so far.
        numbered = []
        last, n = place or ((), -1)
        for conv_id, role, text in out:
            n = n + 1 if (conv_id,) == last else 0
            last = (conv_id,)
            numbered.append((conv_id, n, role, text))
        return (last, n), numbered

    def packed(out):
        ids, places, roles, texts = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                                          ["conv_id", "place", "role", "text"])

    return _mended(rows, plans(rows), run, f"conv_id {kind}, place bigint, role string, text string")


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit and the digest of the repaired ``role:text`` lines."""
    key, kind = _arrow_type(rows, "conv_id"), rows.schema["conv_id"].dataType.simpleString()

    class Digest:
        def __init__(self, conv_id, counts, audit):
            self.head, self.audit, self.mender = (conv_id, *(counts[c] for c in COUNTS)), audit, Mender(audit)
            self.sha, self.some = hashlib.sha256(), False

        def feed(self, lines):
            for role, text in lines:
                self.sha.update(("\n" * self.some + f"{role}:{text}").encode())
                self.some = True

        def row(self):
            self.feed(self.mender.inserts())
            return (*self.head, self.audit, self.sha.hexdigest())

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv_id, part, role, text, counts in _rows(batch):
                if part == 0:
                    if now:
                        done.append(now.row())
                    now = Digest(conv_id, counts, text)
                else:
                    now.feed(now.mender.row(role, text))
            if done:
                yield packed(done)
        if now:
            yield packed([now.row()])

    def packed(done):
        ids, *counts, audit, sha = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, key), *[pa.array(c, pa.int64()) for c in counts], pa.array(audit, pa.string()), pa.array(sha, pa.string())],
                                          ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    return _mended(rows, plans(rows), run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")


def op13_repair(spark, folder):
    return repair_report(damage(table(spark, folder, "conversations")))


def _sql() -> str:
    """The same forwards: the cheapest, then ASCII-least audit into each state, row by row; CRC-32 from its bitwise definition."""
    closure = [(s, t, "I" * (cost // INSERT), cost) for s in STATES for t, cost in enumerate(INSERTED[s]) if cost < FAR]
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    bits = "list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda r, c: xor(r // 256, l[xor(r % 256, c) + 1])))")
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list({bits} ORDER BY i) AS l FROM range(256) t(i)),
ins(s, t, letters, cost) AS (VALUES {values(closure)}),
keep(s, initial, t) AS (VALUES {values([(s, i, t) for (s, i), t in KEEP.items()])}),
nxt(s, t) AS (VALUES {values(enumerate(NEXT))}),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, l FROM conversations, crc),
coded AS (SELECT *, {crc} % 20 AS d FROM keyed),
copies(c) AS (VALUES (1), (2)),
rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, copies WHERE d <> 0 AND (c = 1 OR d = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, regexp_replace(text, '{space}+\\z', '') AS bare FROM rows),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, {HEAD}), sha256(length(role) || ':' || role || ':' || text), again) AS j,
  bare = '' AS blank, again AND bare <> '' AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, substr(role, 1, 1) AS initial FROM seen),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY j) AS previous FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(j) AS n FROM pairs GROUP BY conv_id),
-- What a row can do in each state.
acts AS (
  SELECT conv_id, j, s, s AS t, 'D' AS letter, {DELETE} AS cost FROM marked, range(4) x(s)
  UNION ALL SELECT conv_id, j, s, t, 'K', truncated::INT FROM marked JOIN keep USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, j, s, t, 'R', {REROLE} + truncated::INT FROM marked, nxt WHERE NOT blank AND NOT duplicate),
moves AS (SELECT conv_id, j, ins.s, acts.t, ins.cost + acts.cost AS cost, ins.letters || acts.letter AS letters FROM acts JOIN ins ON ins.t = acts.s),
best AS (
  SELECT conv_id, 0::BIGINT AS j, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': ''}} AS v FROM counts
  UNION ALL SELECT b.conv_id, b.j + 1, m.t::BIGINT, min({{'cost': v.cost + m.cost::BIGINT, 'audit': v.audit || m.letters}})
  FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.j = b.j + 1 AND m.s = b.s GROUP BY b.conv_id, b.j + 1, m.t),
plan AS (SELECT b.conv_id, min({{'cost': v.cost + ins.cost::BIGINT, 'audit': v.audit || ins.letters}}) AS v
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.j JOIN ins ON ins.s = b.s AND ins.t IN (0, 3) GROUP BY b.conv_id),
letters AS (SELECT conv_id, unnest(range(1, length(v.audit) + 1)) AS i, v.audit AS audit FROM plan),
placed AS (SELECT conv_id, i, audit[i:i] AS letter, i - length(regexp_replace(audit[1:i], '[^I]', '', 'g')) AS j FROM letters),
kept AS (SELECT p.conv_id, i, letter, m.role, m.initial, m.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY i) AS place
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.j = p.j AND p.letter <> 'I' WHERE letter <> 'D'),
led AS (SELECT conv_id, max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS system FROM kept GROUP BY conv_id),
said AS (SELECT k.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS sha
  FROM kept k JOIN led l ON l.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = _sql()
