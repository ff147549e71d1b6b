"""Personal data (11): regular expressions propose, validators confirm, context words adjust.

Each kind has a regex that proposes spans, leftmost and without overlap.  A validator
then confirms a proposal (ranges of octets, the Luhn sum of card numbers, the mod-97
remainder of account numbers, plausible dates) or drops it; a dropped proposal is not
tried again further in.  A confirmed span starts with the score of its kind; words near
it that speak for personal data add to the score, words that speak for examples and
versions take from it.  Spans of the base kinds are always reported, spans of the
further kinds if their score reaches ``LEAST``.

The work of a document is one pass over its own text: nothing is shuffled, and the
proposing patterns are linear in its length (runs are entered at their first character
only, possessively), so that long texts without spaces cost no more than others.

Defined cases: null texts are empty and have no spans; offsets are code points, ends
exclusive; spans of different kinds may overlap; repeated rows are scanned each; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import table

# --- Fixed values -----------------------------------------------------------
#: Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VG": 24, "XK": 20,
}
#: Words that lower the score of whatever they stand beside.
AGAINST = ("example", "sample", "dummy", "test", "version", "invoice", "order", "beispiel", "exemple", "ejemplo")
# ----------------------------------------------------------------------------

#: Code points before and after a span that count as near.
BEFORE, AFTER = 60, 20
#: What a near word for, or against, changes in the score (hundredths).
FOR_POINTS, AGAINST_POINTS = 30, 20
#: Least score of a reported span of the further kinds.
LEAST = 50


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Luhn checksum of a string of digits."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Remainder 1 by 97 of an account number, country and check digits moved to the end, letters as 10 to 35."""
    rest = 0
    for c in account[4:] + account[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


#: A validator gets the text and the ends of a proposal and returns the end of the confirmed span, or None.
Validator = Callable[[str, int, int], "int | None"]


def any_span(text: str, start: int, end: int) -> int | None:
    return end


def octets(text: str, start: int, end: int) -> int | None:
    parts = [x.lstrip("0") for x in text[start:end].split(".")]
    return end if all(len(x) < 4 and (not x or int(x) <= 255) for x in parts) else None


def card_number(least: int, most: int, first: str = "0123456789") -> Validator:
    def check(text, start, end):
        if not least <= end - start <= 2 * most or text[start] not in first:
            return None
        number = digits(text[start:end])
        return end if least <= len(number) <= most and luhn(number) else None
    return check


def phone_number(text: str, start: int, end: int) -> int | None:
    return end if 8 <= len(digits(text[start:end])) <= 15 else None


def alone(text: str, start: int, end: int, beside: str = "0123456789-") -> bool:
    return (start == 0 or text[start - 1] not in beside) and (end == len(text) or text[end] not in beside)


LETTERS_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def account_number(text: str, start: int, end: int) -> int | None:
    """The country tells the length; what the proposal holds beyond it is cut off."""
    wanted, at = IBAN_LENGTHS.get(text[start:start + 2], 0), start
    account = []
    while at < end and len(account) < wanted:
        if text[at] != " ":
            account.append(text[at])
        at += 1
    if not wanted or len(account) < wanted or not alone(text, start, at, LETTERS_DIGITS):
        return None
    return at if mod97("".join(account)) else None


def social_number(text: str, start: int, end: int) -> int | None:
    area, group, serial = text[start:end].split("-")
    issued = area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"
    return end if issued and alone(text, start, end) else None


def calendar_date(text: str, start: int, end: int) -> int | None:
    """A day and month in either order, and a year from 1900 to 2099."""
    a, b, c = map(int, re.split("[-./]", text[start:end]))
    year, x, y = (a, b, c) if a > 31 else (c, a, b)
    fits = 1900 <= year <= 2099 and min(x, y) >= 1 and min(x, y) <= 12 and max(x, y) <= 31
    return end if fits and alone(text, start, end, "0123456789./-") else None


def leftmost(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """All matches of a regex that is linear as written."""
    regex = re.compile(pattern)
    return lambda text: ((m.start(), m.end()) for m in regex.finditer(text))


def mail_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``local@label(.label)+``.

    A run of local characters is entered at its first character, or at the end of the
    match before: every later start in it would meet the same ``@``.
    """
    if "@" not in text:
        return
    at = 0
    while m := MAIL.match(text, at) or MAIL_RUN.search(text, at):
        yield m.start(), m.end()
        at = m.end()


MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
MAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])" + MAIL.pattern)
#: Runs of digits with single spaces or hyphens inside.
DIGIT_GROUPS = r"[0-9]++(?:[\x20-][0-9]++)*+"


@dataclass(frozen=True)
class PersonalKind:
    """``propose`` is a regex or a function from a text to spans; ``score`` in hundredths."""

    kind: str
    propose: str | Callable[[str], Iterator[tuple[int, int]]]
    confirm: Validator
    score: int
    words: tuple[str, ...]
    least: int = LEAST


#: Kinds whose confirmed spans always count, in their order.
BASE = (
    PersonalKind("email", mail_addresses, any_span, 80, ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"), 0),
    PersonalKind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 50, ("ip", "address", "host", "login", "adresse"), 0),
    PersonalKind("card", DIGIT_GROUPS, card_number(16, 19), 70, ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"), 0),
    PersonalKind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_number, 60, ("phone", "tel", "call", "mobile", "telefon", "fax"), 0),
)
#: Further kinds.
MORE = (
    PersonalKind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", account_number, 80, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    PersonalKind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", social_number, 30, ("ssn", "social", "security", "taxpayer")),
    PersonalKind("short_card", DIGIT_GROUPS, card_number(13, 15, "3456"), 40, ("card", "amex", "credit", "payment", "karte", "carte", "tarjeta")),
    PersonalKind("birth_date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}", calendar_date, 20,
                 ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "naissance", "nacimiento")),
)


def near(words: tuple[str, ...]) -> re.Pattern:
    """Whole words, ASCII letters in either case."""
    return re.compile(rf"(?ai:(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9]))")


class Finder:
    """Spans of one text; built once per task."""

    def __init__(self, kinds: tuple[PersonalKind, ...]):
        propose: dict[object, list[int]] = {}
        for n, k in enumerate(kinds):
            propose.setdefault(k.propose, []).append(n)  # kinds with one pattern share its proposals
        self.propose = [(leftmost(p) if isinstance(p, str) else p, of) for p, of in propose.items()]
        self.kinds, self.words, self.against = kinds, [near(k.words) for k in kinds], near(AGAINST)

    def score(self, n: int, text: str, start: int, end: int) -> int:
        beside = text[max(0, start - BEFORE):start], text[end:end + AFTER]
        points = self.kinds[n].score
        points += FOR_POINTS * any(map(self.words[n].search, beside)) - AGAINST_POINTS * any(map(self.against.search, beside))
        return max(0, min(100, points))

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(number of the kind, start, end, score), by kind, then start."""
        out = []
        for propose, of in self.propose:
            for start, end in propose(text):
                for n in of:
                    stop = self.kinds[n].confirm(text, start, end)
                    if stop is None:
                        continue
                    score = self.score(n, text, start, stop)
                    if score >= self.kinds[n].least:
                        out.append((n, start, stop, score))
        return sorted(out)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,score:int>>"


def redacted(text: str, spans: list[tuple[int, int, int, int]], kinds) -> str:
    """Spans replaced by their kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for n, start, end, _ in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= at:
            out += [text[at:start], f"[{kinds[n].kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal(docs: DataFrame, kinds: tuple[PersonalKind, ...] = BASE + MORE, redact: bool = False) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, score) by kind, then start; with ``redact`` also the text without them."""
    columns = ["doc_id", "spans"] + ["redacted"] * redact

    def run(batches):
        find = Finder(kinds)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            found = [find(x) for x in texts]
            spans = [[{"kind": kinds[n].kind, "start": a, "end": b, "score": s} for n, a, b, s in x] for x in found]
            rows = [batch.column("doc_id"), pa.array(spans, SPAN)]
            if redact:
                rows.append(pa.array([redacted(t, x, kinds) for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(rows, columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPAN_DDL}" + ", redacted string" * redact)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_personal(spark, folder):
    out = find_personal(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[k.kind for k in BASE]))
    return out.select("doc_id", *[count(k.kind) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                      F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def _sql() -> str:
    """The same by plain patterns: matches and the pieces between them give the offsets."""
    near_words = lambda words: f"(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])"
    proposals = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ("short_card", r"[0-9]([\x20-]?[0-9])+"),
        ("birth_date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}")]
    lists = "\nUNION ALL ".join(
        f"SELECT rid, {n} AS n, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS pieces FROM d"
        for n, (kind, p) in enumerate(proposals))
    lengths = "CASE substr(found, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items()) + " ELSE 0 END"
    luhn_sum = ("list_sum(list_transform(range(1, length(num) + 1), lambda i: CASE WHEN (length(num) - i) % 2 = 0 THEN num[i]::INT "
                "ELSE (num[i]::INT * 2) // 10 + (num[i]::INT * 2) % 10 END)) % 10 = 0")
    turned = "string_split(substr(acc, 5) || substr(acc, 1, 4), '')"
    rest = (f"list_reduce(list_prepend(0::BIGINT, list_transform({turned}, lambda c: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::BIGINT)), "
            "lambda r, v: (r * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1")
    clear = lambda chars: f"NOT regexp_matches(text[start:start], '[{chars}]') AND NOT regexp_matches(text[stop + 1:stop + 1], '[{chars}]')"
    parts = "list_transform(string_split_regex(found, '[-./]'), lambda x: x::BIGINT)"
    score = "CASE kind " + " ".join(
        f"WHEN '{k.kind}' THEN {k.score} + CASE WHEN regexp_matches(before, '{near_words(k.words)}') OR regexp_matches(after, '{near_words(k.words)}') THEN {FOR_POINTS} ELSE 0 END"
        for k in BASE + MORE) + " END"
    against = near_words(AGAINST)
    lower = lambda s: f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    one = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS ({lists}),
m AS (SELECT rid, n, kind, unnest(found) AS found, unnest(pieces[1:len(found)]) AS piece, unnest(range(1, len(found) + 1)) AS i FROM l WHERE len(found) > 0),
p AS (SELECT rid, n, kind, found, CAST(sum(length(piece) + length(found)) OVER (PARTITION BY rid, n ORDER BY i) - length(found) AS BIGINT) AS start FROM m),
q AS (SELECT *, start + CASE WHEN kind = 'iban' THEN length(regexp_extract(found, '^([A-Z0-9]\\x20?){{' || greatest({lengths} - 1, 0) || '}}[A-Z0-9]')) ELSE length(found) END AS stop,
  regexp_replace(found, '[^0-9]', '', 'g') AS num, regexp_replace(found, '[^A-Z0-9]', '', 'g') AS whole, {lengths} AS wanted FROM p
  WHERE n NOT IN (2, 6) OR length(found) >= 13),
r AS (SELECT q.*, d.text, whole[1:wanted] AS acc, {lower(f"text[greatest(start - {BEFORE - 1}, 1):start]")} AS before, {lower(f"text[stop + 1:stop + {AFTER}]")} AS after FROM q JOIN d USING (rid)),
ok AS (SELECT rid, n, kind, start, stop, least(100, greatest(0, {score} - CASE WHEN regexp_matches(before, '{against}') OR regexp_matches(after, '{against}') THEN {AGAINST_POINTS} ELSE 0 END)) AS score FROM r
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(found, '.'), lambda x: length(ltrim(x, '0')) < 4 AND coalesce(try_cast(x AS BIGINT), 0) <= 255))
    WHEN 'card' THEN length(num) BETWEEN 16 AND 19 AND {luhn_sum}
    WHEN 'phone' THEN length(num) BETWEEN 8 AND 15
    WHEN 'iban' THEN wanted > 0 AND length(whole) >= wanted AND {clear("A-Za-z0-9")} AND {rest}
    WHEN 'ssn' THEN found[1:3] NOT IN ('000', '666') AND found[1:1] <> '9' AND found[5:6] <> '00' AND found[8:11] <> '0000' AND {clear("0-9-")}
    WHEN 'short_card' THEN length(num) BETWEEN 13 AND 15 AND found[1:1] IN ('3', '4', '5', '6') AND {luhn_sum}
    ELSE {clear("0-9./-")} AND (CASE WHEN {parts}[1] > 31 THEN {parts}[1] BETWEEN 1900 AND 2099 AND least({parts}[2], {parts}[3]) BETWEEN 1 AND 12 AND greatest({parts}[2], {parts}[3]) <= 31
      ELSE {parts}[3] BETWEEN 1900 AND 2099 AND least({parts}[1], {parts}[2]) BETWEEN 1 AND 12 AND greatest({parts}[1], {parts}[2]) <= 31 END) END),
g AS (SELECT rid, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p,
  string_agg({one}, ',' ORDER BY n, start) FILTER (n < {len(BASE)}) AS base, string_agg({one}, ',' ORDER BY n, start) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY n, start) AS scores
  FROM ok WHERE n < {len(BASE)} OR score >= {LEAST} GROUP BY rid)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (rid)
"""


OP11_SQL = _sql()
