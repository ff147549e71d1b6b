"""Rule matching.

Each language's rules become literal regex expressions over the file's own row,
so matching is a narrow projection: no rule-by-line join, no shuffle, patterns
compiled once per task.  A rule first scans the whole content; only when that
succeeds are the single lines tested, which skips the per-line work for the
many rules that never fire in a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reviewlake.functions.literals import reads_context
from reviewlake.functions.text import literal, sql_case, sql_count, sql_matches, sql_may_match
from reviewlake.packs.rules import PHASES, SEVERITIES, Rule, builtin_packs

HIT_TYPE = ("struct<rule_no:int,line_number:int,sub:int,severity:string,category:string,"
            "snippet:string,detail:string>")
SNIPPET_CHARS = 120
TEXT_CHARS = 80


def catalogue(packs: dict[str, tuple[Rule, ...]] | None = None) -> list[tuple[str, int, Rule]]:
    """(language, rule_no, rule) of every pack; rule_no keeps detection order."""
    packs = builtin_packs() if packs is None else packs
    entries, number = [], 0
    for language in sorted(packs):
        for rule in packs[language]:
            number += 1
            entries.append((language, number, rule))
    return entries


RULE_SCHEMA = T.StructType([
    T.StructField("rule_no", T.IntegerType()), T.StructField("language", T.StringType()),
    T.StructField("rule_id", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("template", T.StringType()),
    T.StructField("suggestion", T.StringType()), T.StructField("reason", T.StringType()),
])


def rule_table(spark: SparkSession, packs=None) -> DataFrame:
    """The rule dimension; its size is the number of rules handed in."""
    rows = [(n, lang, r.rule_id, r.phase, r.severity, r.category, r.title, r.description, r.suggestion, r.reason)
            for lang, n, r in catalogue(packs)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_texts(packs, rule_no: Column) -> Column:
    """Texts of a rule by its number: rule_id, phase, title, template, suggestion, reason."""
    entries = catalogue(packs)
    names = (("rule_id", "rule_id"), ("phase", "phase"), ("title", "title"), ("template", "description"), ("suggestion", "suggestion"), ("reason", "reason"))
    rows = [", ".join(f"'{name}', CAST({literal(getattr(r, field))} AS STRING)" for name, field in names) for _, _, r in entries]
    # One parse in the JVM: as columns, thousands of calls from Python came to seconds for each use of the texts.
    texts = "array(" + ", ".join(f"named_struct({row})" for row in rows) + ")"
    return F.get(F.expr(texts), rule_no - 1) if rows else F.lit(None).cast("struct<" + ",".join(f"{name}:string" for name, _ in names) + ">")


def _found(number: int, line: str, sub: str = "0", detail: str = "CAST(NULL AS STRING)") -> str:
    return f"named_struct('n', {number}, 'i', {line}, 's', {sub}, 'd', {detail})"


def _line_test(rule: Rule) -> str:
    tests = [sql_matches("l", rule.pattern, rule.flags, "get(folded_lines, i)")]
    tests += [f"contains(l, {literal(t)})" for t in rule.has]
    tests += [f"NOT contains(l, {literal(t)})" for t in rule.lacks]
    if rule.lacks_pattern:
        tests.append("NOT " + sql_matches("l", rule.lacks_pattern, rule.flags))
    if rule.kind == "follows":
        tests.append(sql_matches(f"get(lines, greatest(i - {rule.threshold}, 0))", rule.near))
    elif rule.kind == "unfreed":
        tail = f"substring(content, instr(content, get(stripped, i)), {rule.threshold})"
        tests.append(f"NOT contains({tail}, {literal(rule.near)})")
    return " AND ".join(tests)


def _content_screen(rule: Rule) -> str:
    """True for every content in which some line can match.

    A line match is also a match inside the whole content, except where the pattern
    sees the ends of its text.  Those patterns, and dot-all ones that would run
    across the whole file, are screened by their words alone.
    """
    if "s" in rule.flags or reads_context(rule.pattern):
        return sql_may_match("folded", rule.pattern, rule.flags) or "TRUE"
    return sql_matches("content", rule.pattern, rule.flags, "folded")


def _rule_hits(number: int, rule: Rule) -> str:
    """SQL for the array of this rule's hits in the row's file (or null)."""
    if rule.kind in ("line", "follows", "unfreed"):
        test = _content_screen(rule) + (" AND syntax.has_tree" if rule.needs_tree else "")
        hits = (f"filter(transform(lines, (l, i) -> IF({_line_test(rule)}, {_found(number, 'i + 1')}, NULL)), "
                "h -> h IS NOT NULL)")
    elif rule.kind == "syntax":
        test = f"exists(syntax.findings, f -> f.rule_id = {literal(rule.rule_id)})"
        hits = (f"transform(filter(syntax.findings, f -> f.rule_id = {literal(rule.rule_id)}), "
                f"f -> {_found(number, 'f.line', 'f.sub', 'f.detail')})")
    elif rule.kind == "complex":
        test = f"cyclomatic_complexity > {rule.threshold}"
        hits = f"array({_found(number, '1', detail='CAST(CAST(cyclomatic_complexity AS BIGINT) AS STRING)')})"
    elif rule.kind == "absent":
        test = "NOT " + sql_matches("content", rule.pattern, rule.flags, "folded")
        hits = f"array({_found(number, '1')})"
    elif rule.kind == "count":
        n = sql_count("content", rule.pattern, rule.flags, "folded")
        test, hits = f"{n} > {rule.threshold}", f"array({_found(number, '1', detail=f'CAST({n} AS STRING)')})"
    elif rule.kind == "large":
        test = f"syntax.has_tree AND length(content) > {rule.threshold}"
        hits = f"array({_found(number, '1', detail='CAST(length(content) DIV 1024 AS STRING)')})"
    else:
        raise ValueError(f"unknown rule kind: {rule.kind}")
    return f"CASE WHEN {test} THEN {hits} END"


_FOUND_TYPE = "array<struct<n:int,i:int,s:int,d:string>>"
_QUOTING = ("line", "follows", "unfreed")


def with_hits(files: DataFrame, packs=None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``hits``: the array of findings of each file.

    Bounded by the file itself (one entry per rule and line); keeping the
    findings in the file's row lets scores follow without a join.
    """
    entries = catalogue(packs)
    by_language: dict[str, list[str]] = {}
    for language, number, rule in entries:
        if kinds is None or rule.kind in kinds:
            by_language.setdefault(language, []).append(_rule_hits(number, rule))
    found = sql_case([(f"language = {literal(k)}", f"flatten(array_compact(array({', '.join(v)})))")
                      for k, v in by_language.items()], f"CAST(array() AS {_FOUND_TYPE})")
    of_rule = lambda value: f"element_at(array({', '.join(value(r) for _, _, r in entries)}), h.n)"
    quoting = of_rule(lambda r: str(r.kind in _QUOTING).lower())
    described = (
        "transform(_found, h -> named_struct('rule_no', h.n, 'line_number', h.i, 'sub', h.s, "
        f"'severity', {of_rule(lambda r: literal(r.severity))}, 'category', {of_rule(lambda r: literal(r.category))}, "
        f"'snippet', IF({quoting}, substring(get(stripped, h.i - 1), 1, {SNIPPET_CHARS}), ''), 'detail', h.d))")
    return files.withColumn("_found", F.expr(found)).withColumn("hits", F.expr(described)).drop("_found")


def explode_issues(reviewed: DataFrame, packs=None, keys: tuple[str, ...] = ("project_id", "path", "language")) -> DataFrame:
    """One row per finding, with the rule's texts filled in."""
    # Outer explode: the plain form makes the optimizer push "size(hits) > 0" below
    # the projections, where the whole rule set would be evaluated a second time.
    hits = reviewed.select(*keys, F.posexplode_outer("hits").alias("_at", "h")).where("h IS NOT NULL").select(
        *keys, (F.col("_at") + 1).alias("position"), "h.*")
    # Texts are looked up in a literal array: a rule that fires on most lines is no hot key of a join.
    joined = hits.withColumn("_rule", rule_texts(packs, F.col("rule_no"))).select("*", "_rule.*")
    return joined.select(
        *keys, "rule_id", "phase", "title",
        described(F.col("template"), F.col("line_number"), F.col("detail"), F.col("snippet")).alias("description"),
        "severity", "category", "line_number", F.lit(0).alias("column"), F.lit(0).alias("end_line"),
        "suggestion", "reason", F.col("snippet").alias("code_snippet"),
        severity_rank(F.col("severity")).alias("severity_rank"),
        (F.col("rule_no").cast("long") * 1_000_000_000 + F.col("sub")).alias("detect_seq"), "position")


def described(template: Column, line_number: Column, detail: Column, snippet: Column) -> Column:
    """Description of a finding from its rule's template."""
    text = F.replace(template, F.lit("{line}"), line_number.cast("string"))
    text = F.replace(text, F.lit("{n}"), F.coalesce(detail, F.lit("")))
    # The quoted line comes last, so braces inside it are left alone.
    text = F.replace(text, F.lit("{text}"), F.substring(snippet, 1, TEXT_CHARS))
    return F.coalesce(F.when(template == "{n}", detail), text)


def severity_rank(severity: Column) -> Column:
    """0 (CRITICAL) .. 4 (INFO), 99 for anything else."""
    ranked = reduce(lambda acc, kv: acc.when(severity == kv[1], kv[0]), list(enumerate(SEVERITIES)),
                    F.when(F.lit(False), 0))
    return ranked.otherwise(99)


def order_issues(issues: DataFrame) -> DataFrame:
    """Report order: per project and file by severity, line, then detection order."""
    return issues.orderBy("project_id", "path", "severity_rank", "line_number", "detect_seq")


def in_report_order(reviewed: DataFrame) -> DataFrame:
    """Files whose ``hits`` stand in report order, sorted inside the file's own row."""
    rank = "CASE h.severity " + " ".join(f"WHEN {literal(s)} THEN {i}" for i, s in enumerate(SEVERITIES)) + " ELSE 99 END"
    keyed = f"transform(hits, h -> named_struct('a', {rank}, 'b', h.line_number, 'c', h.rule_no, 'd', h.sub, 'h', h))"
    return reviewed.withColumn("hits", F.expr(f"transform(array_sort({keyed}), x -> x.h)"))


def validity(files: DataFrame) -> DataFrame:
    """Add ``parse_errors`` and ``is_valid`` (needs the ``syntax`` column)."""
    content = F.col("content")
    count = lambda c: F.length(content) - F.length(F.replace(content, F.lit(c), F.lit("")))  # single characters
    message = (F.when(F.col("language") == "JavaScript", "Warning: Unbalanced curly braces detected.")
               .when(F.col("language").isin("TypeScript", "Java"), "Warning: Unbalanced curly braces.")
               .when(F.col("language").isin("C", "C++"), "Unbalanced curly braces.")
               .when(F.col("language") == "C#", "Unbalanced braces.")
               .when(F.col("language") == "CSS", "Unbalanced curly braces in CSS."))
    uneven = (F.when(message.isNotNull() & (count("{") != count("}")), message)
              .when((F.col("language") == "HTML") & (count("<") != count(">")), "Warning: Unbalanced angle brackets."))
    parsed = F.col("language").isin("Python", "JSON")
    errors = (F.when(parsed, F.col("syntax.parse_errors"))
              .when(uneven.isNotNull(), F.array(uneven)).otherwise(F.array().cast("array<string>")))
    return (files.withColumn("parse_errors", errors)
            .withColumn("is_valid", ~parsed | (F.size("parse_errors") == 0)))


__all__ = ["catalogue", "rule_table", "rule_texts", "with_hits", "explode_issues", "order_issues", "in_report_order", "severity_rank",
           "validity", "PHASES", "HIT_TYPE"]
