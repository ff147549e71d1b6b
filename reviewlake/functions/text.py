"""Text helpers: regex dialect, line splitting, stripping, rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewlake.functions.literals import required_words

# --- Fixed values -----------------------------------------------------------
# Characters that end a line, and characters removed by stripping.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Characters outside ASCII that match an ASCII letter when case is ignored.
FOLDED_SPECIALLY = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}
# ----------------------------------------------------------------------------

# Zero-width split after each terminator, so lines keep their line end.
_LINE_SPLIT = "(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"


def dialect(pattern: str, flags: str = "") -> str:
    """A rule pattern for Java's engine: Unicode classes, only ``\\n`` ends lines."""
    return f"(?Ud{flags}){pattern}"


def literal(text: str) -> str:
    """A Spark SQL string literal.

    The rule and metric expressions are written as SQL text: one parse in the
    JVM instead of thousands of calls from Python to build the same columns.
    """
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_fold(text: str) -> str:
    """Lower case in which every character that matches an ASCII letter is that letter."""
    odd = " OR ".join(f"contains({text}, {literal(c)})" for c in FOLDED_SPECIALLY)
    plain = f"translate({text}, {literal(''.join(FOLDED_SPECIALLY))}, {literal(''.join(FOLDED_SPECIALLY.values()))})"
    return f"lower(IF({odd}, {plain}, {text}))"


def sql_may_match(folded: str, pattern: str, flags: str = "") -> str | None:
    """A substring test that holds wherever the pattern matches (null: none known).

    Substring search is many times cheaper than a regex scan, and most patterns
    need some word that most files lack.
    """
    def test(query):
        if isinstance(query, str):
            return f"contains({folded}, {literal(query)})"
        return "(" + f" {query[0].upper()} ".join(sorted(map(test, query[1]))) + ")"

    words = required_words(pattern, flags)
    return test(words) if words is not None else None


def sql_matches(text: str, pattern: str, flags: str = "", folded: str | None = None) -> str:
    test = f"{text} RLIKE {literal(dialect(pattern, flags))}"
    first = sql_may_match(folded, pattern, flags) if folded else None
    return f"({first} AND {test})" if first else test


def sql_count(text: str, pattern: str, flags: str = "", folded: str | None = None) -> str:
    count = f"regexp_count({text}, {literal(dialect(pattern, flags))})"
    first = sql_may_match(folded, pattern, flags) if folded else None
    return f"IF({first}, {count}, 0)" if first else count


def sql_case(branches, default: str) -> str:
    """CASE over (condition, value) pairs."""
    branches = list(branches)
    if not branches:
        return default
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


def in_languages(languages) -> str:
    return f"language IN ({', '.join(map(literal, languages))})"


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(dialect(pattern, flags))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (one linear pass, no regex)."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def split_lines(content: Column) -> Column:
    """Lines of a text with their terminators; no empty trailing line.

    Texts whose only line end is ``\\n`` are cut at a marker put after each one,
    a plain substring split; the look-behind regex serves all others.
    """
    marker = "\0"
    others = F.lit(False)
    for end in (*LINE_ENDS.replace("\n", ""), marker):
        others = others | F.contains(content, F.lit(end))
    marked = F.split(F.replace(content, F.lit("\n"), F.lit("\n" + marker)), marker, -1)
    return F.filter(F.when(others, F.split(content, _LINE_SPLIT, -1)).otherwise(marked), lambda l: l != "")


def unify_newlines(content: Column) -> Column:
    """Text-mode reading: ``\\r\\n`` and ``\\r`` become ``\\n``."""
    return F.regexp_replace(content, "\r\n?", "\n")


def round1(x: Column) -> Column:
    """Round to one decimal: the nearest tenth of the exact binary value.

    Ties (which need the value to be exactly halfway in binary) go to the even
    tenth.  ``16x - (2k+1)`` is exact for doubles near the midpoint, so the sign
    of ``(16x - (2k+1)) + 4x`` decides without rounding error.
    """
    k = F.floor(x * 10)
    side = (x * 16 - (k * 2 + 1)) + x * 4
    up = (side > 0) | ((side == 0) & (F.pmod(k, F.lit(2)) == 1))
    return (k + F.when(up, 1).otherwise(0)).cast("double") / F.lit(10.0)


def exact_mean(value: Column, digits: int = 9) -> Column:
    """Mean whose sum does not depend on row order (decimal accumulation)."""
    total = F.sum(value.cast(f"decimal(28,{digits})")).cast("double")
    return total / F.count(value)
