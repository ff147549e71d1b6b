"""File metrics: 51 features per file, computed without any shuffle.

Each feature is a projection over the file's own row: array functions over its
lines and regex counts over its content, guarded by the file's language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.syntax import Limits, syntax_report
from reviewlake.functions.text import (dialect, in_languages, literal, split_lines, sql_case, sql_count, sql_fold,
                                       sql_matches, strip)
from reviewlake.packs import metric_patterns as mp
from reviewlake.packs.languages import LANGUAGES

C_HEAD_END = r"\)\s*\{"
_NO_STRINGS = "CAST(array() AS array<string>)"


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``lines`` (with terminators), ``stripped`` and case-folded text.

    Folding keeps line ends, so ``folded_lines`` has the positions of ``lines``.
    """
    return (files.withColumn("folded", F.expr(sql_fold("content")))
            .withColumns({"lines": split_lines(F.col("content")), "folded_lines": split_lines(F.col("folded"))})
            .withColumn("stripped", F.transform("lines", strip)))


def numbered_lines(files: DataFrame) -> DataFrame:
    """One row per line: project_id, path, language, line_number, raw, stripped."""
    exploded = files.select("project_id", "path", "language",
                            F.posexplode_outer(split_lines(F.col("content"))).alias("pos", "raw"))
    exploded = exploded.where("raw IS NOT NULL")  # the split runs once (no inferred size filter)
    return exploded.select("project_id", "path", "language", (F.col("pos") + 1).alias("line_number"),
                           "raw", strip(F.col("raw")).alias("stripped"))


def _inherited(table: dict, own=(), entry=lambda pack: None) -> dict:
    """language -> entry, taking the parent language's entry where there is none.

    ``own`` are the user's languages; ``entry`` picks the like entry of one.
    """
    found = {}
    for language in LANGUAGES:
        source = next((s for s in mp.lineage(language) if s in table), None)
        if source:
            found[language] = table[source]
    for pack in own:
        value = entry(pack) or found.get(pack.like)
        if value:
            found[pack.language] = value
    return found


def _per_language(values: dict[str, str], default: str) -> str:
    """CASE on language; languages with the same expression share a branch."""
    groups: dict[str, list[str]] = {}
    for language, sql in values.items():
        groups.setdefault(sql, []).append(language)
    return sql_case([(in_languages(langs), sql) for sql, langs in groups.items()], default)


def pattern_count(metric: str, own=()) -> str:
    """Count metric of the row's language (0 where it has none)."""
    counts = {lang: sql_count("content", pattern, flags, "folded")
              for lang, (flags, pattern) in _inherited(mp.patterns_for(metric), own, lambda p: p.pattern(metric)).items()}
    if metric == "function_count":
        # A C function head ends in ") {": without one the backtracking scan is skipped.
        for lang in ("C", "C++"):
            counts[lang] = f"IF({sql_matches('content', C_HEAD_END)}, {counts[lang]}, 0)"
    return _per_language(counts, "0")


def _starts_with(prefixes: tuple[str, ...]) -> str:
    return " OR ".join(f"startswith(l, {literal(p)})" for p in prefixes)


def _occurrences(text: str) -> str:
    return f"(length(content) - length(replace(content, {literal(text)}, ''))) DIV {len(text)}"


def comment_lines(own=()) -> str:
    prefixed = {k: f"size(filter(stripped, l -> {_starts_with(p)}))"
                for k, p in _inherited(mp.COMMENT_PREFIXES, own, lambda p: p.comment_prefixes).items()}
    counted = {k: _occurrences(t) for k, t in _inherited(mp.COMMENT_LITERALS, own, lambda p: p.comment_literal).items()}
    return _per_language({k: " + ".join(d[k] for d in (prefixed, counted) if k in d)
                          for k in dict.fromkeys([*prefixed, *counted])}, "0")


def _counted_lines(own=()) -> str:
    """Lines that take part in duplicate counting, per language."""
    return _per_language({k: f"filter(stripped, l -> l != '' AND NOT startswith(l, {literal(skip)}))"
                          for k, skip in _inherited(mp.DUPLICATE_SKIP, own, lambda p: p.duplicate_skip).items()}, _NO_STRINGS)


def _tokens(metric: str, own=()) -> str:
    return _per_language({k: f"regexp_extract_all(content, {literal(dialect(pattern, flags))}, 0)"
                          for k, (flags, pattern) in _inherited(mp.patterns_for(metric), own, lambda p: p.pattern(metric)).items()}, _NO_STRINGS)


def _add(df: DataFrame, **expressions: str) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in expressions.items()})


def with_syntax(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add the ``syntax`` report struct (Python, JSON and CSS only)."""
    return files.withColumn("syntax", syntax_report(F.col("language"), F.col("content"), limits))


def with_line_counts(files: DataFrame, own=()) -> DataFrame:
    """loc, blank_lines, comment_lines, sloc, comment_ratio."""
    df = _add(files, loc="CAST(size(lines) AS DOUBLE)",
              blank_lines="CAST(size(filter(stripped, l -> l = '')) AS DOUBLE)",
              comment_lines=f"CAST({comment_lines(own)} AS DOUBLE)")
    return _add(df, sloc="loc - blank_lines - IF(language = 'Python', comment_lines, 0)",
                comment_ratio="comment_lines / greatest(loc, 1)")


def _halstead_values(df: DataFrame) -> DataFrame:
    defined = "_parsed AND _d1 > 0 AND _d2 > 0"
    df = _add(df, halstead_length=f"IF({defined}, CAST(_t1 + _t2 AS DOUBLE), 0D)",
              halstead_volume=f"IF({defined}, (_t1 + _t2) * log2(CAST(_d1 + _d2 AS DOUBLE)), 0D)",
              halstead_difficulty=f"IF({defined}, (_d1 / 2D) * (_t2 / greatest(_d2, 1)), 0D)")
    return _add(df, halstead_effort="halstead_difficulty * halstead_volume").drop("_t1", "_t2", "_d1", "_d2")


def with_halstead(files: DataFrame, own=()) -> DataFrame:
    """Halstead length, volume, difficulty and effort from token counts."""
    df = _add(files, _operators=_tokens("operators", own), _operands=_tokens("operands", own))
    df = _add(df, _t1="size(_operators)", _d1="size(array_distinct(_operators))",
              _t2="size(_operands)", _d2="size(array_distinct(_operands))").drop("_operators", "_operands")
    return _halstead_values(df)


def with_duplicates(files: DataFrame, own=()) -> DataFrame:
    """duplicate_lines and duplicate_ratio; exact, inside the file's row."""
    df = _add(files, _counted=_counted_lines(own))
    df = _add(df, _kept="size(_counted)", _repeats="IF(_parsed, size(_counted) - size(array_distinct(_counted)), 0)")
    return _add(df, duplicate_lines="IF(language = 'CSS', syntax.css_repeats, CAST(_repeats AS DOUBLE))",
                duplicate_ratio="_repeats / greatest(_kept, 1)").drop("_counted", "_kept", "_repeats")


_COMPUTED_ELSEWHERE = {
    "loc", "sloc", "blank_lines", "comment_lines", "comment_ratio", "cyclomatic_complexity",
    "halstead_length", "halstead_volume", "halstead_difficulty", "halstead_effort",
    "maintainability_index", "duplicate_lines", "duplicate_ratio", "method_count"}


def _count_feature(name: str, own=()) -> str:
    """Structural count of one feature: syntax tree for Python, patterns else."""
    value = pattern_count(name, own)
    if name == "class_count":
        value = f"{value} + {pattern_count('extra_types', own)}"
    if name in mp.SYNTAX_FEATURES:
        value = f"IF(language = 'Python', syntax.{name}, {value})"
    elif name not in ("todo_count", "fixme_count"):
        value = f"IF(_parsed, {value}, 0)"  # an unparsable Python file has no counts
    return f"CAST({value} AS DOUBLE)"


def with_features(files: DataFrame, own=()) -> DataFrame:
    """Add all 51 features as DOUBLE columns (needs lines, stripped, syntax)."""
    df = _add(with_line_counts(files, own), _parsed="language != 'Python' OR syntax.has_tree")
    df = with_duplicates(with_halstead(df, own), own)
    df = _add(df, **{n: _count_feature(n, own) for n in mp.FEATURES if n not in _COMPUTED_ELSEWHERE})
    df = _add(df, method_count=("CASE WHEN language = 'Python' THEN syntax.method_count "
                                "WHEN language IN ('Java', 'C#') THEN function_count ELSE 0D END"),
              cyclomatic_complexity=("CASE WHEN NOT _parsed THEN 0D WHEN language IN ('HTML', 'CSS', 'JSON') THEN 1D "
                                     "ELSE 1D + conditional_count + loop_count "
                                     "+ IF(language = 'C++', 0D, exception_handling) END"))
    fixed = [(f"language = {literal(k)}", f"{v}D") for k, v in (mp.FIXED_MAINTAINABILITY | {p.language: p.maintainability for p in own if p.maintainability is not None}).items()]
    index = ("greatest(0D, least(100D, 171D - 5.2D * ln(halstead_volume) - 0.23D * cyclomatic_complexity"
             " - 16.2D * ln(sloc)))")
    return _add(df, maintainability_index=sql_case(
        [*fixed, ("halstead_volume > 0 AND sloc > 0", index)], "0D")).drop("_parsed")


def feature_map() -> Column:
    """MAP<STRING, DOUBLE> of all features."""
    return F.expr("map(" + ", ".join(f"'{n}', {n}" for n in mp.FEATURES) + ")")


def features_long(features: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (file, feature)."""
    return features.unpivot(keys, list(mp.FEATURES), "feature", "value")


def clean_vector(df: DataFrame) -> DataFrame:
    """Model inputs: NaN and -inf become 0, +inf becomes 100."""
    return _add(df, **{n: f"CASE WHEN isnan({n}) OR {n} = double('-infinity') THEN 0D "
                          f"WHEN {n} = double('infinity') THEN 100D ELSE {n} END" for n in mp.FEATURES})
