"""Common table expressions: corpus, lines, features, findings, scores."""

from __future__ import annotations

import re

from reviewlake.functions.text import STRIP_CHARS
from reviewlake.packs import metric_patterns as mp
from reviewlake.packs.languages import LANGUAGES
from reviewlake.packs.rules import SEVERITIES, builtin_packs
from reviewlake.sources.tables import PROGRAMS

LINE_END = r"[\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str, flags: str) -> str:
    return text((f"(?{flags})" if flags else "") + pattern)


def round1(x: str) -> str:
    k = f"floor(({x}) * 10)"
    side = f"((({x}) * 16 - ({k} * 2 + 1)) + ({x}) * 4)"
    return f"(({k} + CASE WHEN {side} > 0 OR ({side} = 0 AND {k} % 2 = 1) THEN 1 ELSE 0 END) / 10.0)"


def mean(x: str, digits: int = 9) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(28,{digits}))) AS DOUBLE) / count({x}))"


def _values(rows) -> str:
    def one(v):
        return text(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


PROGRAM_FILES = (
    "programs(ix, language, ext, program) AS (VALUES "
    + _values((i, *p) for i, p in enumerate(PROGRAMS)) + "), "
    "documents_n AS (SELECT *, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents), "
    "files AS (SELECT d.source AS project_id, 'src/' || d.doc_id || p.ext AS path, p.language, "
    f"CASE WHEN ix = 0 THEN program || chr(10) || '# ' || replace(t, chr(10), chr(10) || '# ') "
    f"WHEN ix = {len(PROGRAMS) - 1} THEN program ELSE program || chr(10) || t END AS content "
    f"FROM documents_n d JOIN programs p ON d.doc_id % {len(PROGRAMS)} = p.ix)")

PAGE_FILES = ("files AS (SELECT 'site' || (page_id % 20) AS project_id, 'site/' || page_id || '.html' AS path, "
              "'HTML' AS language, regexp_replace(html, '\\r\\n?', chr(10), 'g') AS content FROM pages)")

EVENT_FILES = ("files AS (SELECT 'user' || user_id AS project_id, 'events/' || event_id || '.json' AS path, "
               "'JSON' AS language, regexp_replace(props, '\\r\\n?', chr(10), 'g') AS content FROM events)")

LINES = (
    f"parts AS (SELECT *, string_split_regex(content, {text(LINE_END)}) AS p FROM files), "
    "numbered AS (SELECT project_id, path, language, content, p, unnest(range(1, len(p) + 1)) AS line_number FROM parts), "
    "lines AS MATERIALIZED (SELECT project_id, path, language, line_number, "
    "p[line_number] || CASE WHEN line_number < len(p) THEN chr(10) ELSE '' END AS raw, "
    f"trim(p[line_number], {text(STRIP_CHARS)}) AS stripped, "
    "p[greatest(line_number - 4, 1)] AS four_above, content FROM numbered "
    "WHERE line_number < len(p) OR p[line_number] <> '')")


def _inherit(table: dict) -> dict:
    out = {}
    for lang in LANGUAGES:
        for source in mp.lineage(lang):
            if source in table:
                out[lang] = table[source]
                break
    return out


def _case(values: dict[str, str], default: str) -> str:
    if not values:
        return default
    return "CASE language " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _count(pattern: str, flags: str) -> str:
    if "(?<!" in pattern:  # whole numbers of two or more digits, not after a dot
        return (f"len(list_filter(regexp_extract_all(content, '[.]?{WORD}'), "
                "lambda x: regexp_matches(x, '^[0-9]{2,}$')))")
    return f"len(regexp_extract_all(content, {re2(pattern, flags)}))"


def pattern_count(metric: str) -> str:
    return _case({k: _count(p, f) for k, (f, p) in _inherit(mp.patterns_for(metric)).items()}, "0")


def _tokens(metric: str) -> str:
    found = {}
    for lang, (flags, pattern) in _inherit(mp.patterns_for(metric)).items():
        if metric == "operands":
            keep = "" if lang == "Python" else ", lambda x: regexp_matches(x, '^[A-Za-z_]')"
            words = f"regexp_extract_all(content, {text(WORD)})"
            found[lang] = f"list_filter({words}{keep})" if keep else words
        else:
            found[lang] = f"regexp_extract_all(content, {re2(pattern, flags)})"
    return _case(found, "CAST([] AS VARCHAR[])")


# What the syntax tree of the Python example program holds (counted by hand).
PYTHON_TREE = {
    "function_count": 1, "class_count": 0, "method_count": 0, "import_count": 1, "global_variables": 0,
    "constants": 0, "parameter_count": 2, "return_statements": 1, "exception_handling": 0, "loop_count": 1,
    "nested_loops": 0, "conditional_count": 0, "recursion_count": 0, "max_nesting_depth": 1,
    "avg_function_length": 8.0, "avg_class_size": 0.0, "avg_identifier_length": 51.0 / 14.0,
    "naming_violations": 0, "long_methods": 0, "large_classes": 0, "long_parameter_lists": 0, "magic_numbers": 0,
    "eval_usage": 1, "file_operations": 0, "network_operations": 0,
}


def _prefix_test(prefixes) -> str:
    return "(" + " OR ".join(f"starts_with(stripped, {text(p)})" for p in prefixes) + ")"


# A declaration is the end of a piece between semicolons, from some letter of a name on; it repeats where a
# later piece ends alike.  The walk goes on behind the last repetition of the first declaration that has one.
CSS_REPEATS = (
    "css_pieces AS (SELECT path, unnest(p[:-2]) AS piece, unnest(range(1, len(p))) AS i FROM "
    "(SELECT path, string_split(content, ';') AS p FROM files WHERE language = 'CSS')), "
    "css_names AS (SELECT path, i, piece, unnest(regexp_extract_all(piece, '[a-z-]+:')) AS name, "
    "unnest(string_split_regex(piece, '[a-z-]+:')[:-2]) AS gap, unnest(range(1, len(regexp_extract_all(piece, '[a-z-]+:')) + 1)) AS k FROM css_pieces), "
    "css_starts AS (SELECT path, i, piece, length(name) AS wide, "
    "CAST(sum(length(gap) + length(name)) OVER (PARTITION BY path, i ORDER BY k) AS BIGINT) AS upto FROM css_names), "
    "css_letters AS (SELECT path, i, piece, unnest(range(upto - wide + 1, upto)) AS spot FROM css_starts WHERE upto < length(piece)), "
    # A piece that ends like this suffix has the same suffix at a letter of one of its own names.
    "css_last AS (SELECT path, i, spot, max(i) OVER (PARTITION BY path, substr(piece, spot)) AS j FROM css_letters), "
    "css_moves AS (SELECT path, i, coalesce(arg_min(j, spot) FILTER (j > i) + 1, i + 1) AS next, CAST(count(*) FILTER (j > i) > 0 AS BIGINT) AS repeats "
    "FROM css_pieces LEFT JOIN css_last USING (path, i) GROUP BY path, i), "
    "css_walk AS (SELECT path, i, 0::BIGINT AS n FROM css_pieces WHERE i = 1 UNION ALL "
    "SELECT w.path, m.next, w.n + m.repeats FROM css_walk w JOIN css_moves m ON m.path = w.path AND m.i = w.i), "
    "css_counts AS (SELECT path, max(n) AS css_repeats FROM css_walk GROUP BY path)")


def features() -> str:
    """CTEs line_stats, counted, features (one row per file)."""
    comment = _case({k: _prefix_test(p) for k, p in _inherit(mp.COMMENT_PREFIXES).items()}, "FALSE")
    literal = _case({k: f"(length(content) - length(replace(content, {text(t)}, ''))) // {len(t)}"
                     for k, t in _inherit(mp.COMMENT_LITERALS).items()}, "0")
    kept = _case({k: f"stripped <> '' AND NOT starts_with(stripped, {text(s)})"
                  for k, s in _inherit(mp.DUPLICATE_SKIP).items()}, "FALSE")
    stats = ("line_stats AS (SELECT path, count(*) AS loc, CAST(count_if(stripped = '') AS BIGINT) AS blank_lines, "
             f"count_if({comment}) AS prefixed, count_if({kept}) AS kept, "
             f"count(DISTINCT CASE WHEN {kept} THEN stripped END) AS kept_distinct FROM lines GROUP BY path)")
    plain = [n for n in mp.FEATURES if n not in (
        "loc", "sloc", "blank_lines", "comment_lines", "comment_ratio", "cyclomatic_complexity", "halstead_length",
        "halstead_volume", "halstead_difficulty", "halstead_effort", "maintainability_index", "duplicate_lines",
        "duplicate_ratio", "method_count")]
    columns = []
    for name in plain:
        value = pattern_count(name)
        if name == "class_count":
            value = f"{value} + {pattern_count('extra_types')}"
        if name in PYTHON_TREE:
            value = f"CASE WHEN language = 'Python' THEN {PYTHON_TREE[name]} ELSE {value} END"
        columns.append(f"CAST({value} AS DOUBLE) AS {name}")
    counted = ("counted AS (SELECT f.project_id, f.path, f.language, f.content, "
               "s.loc, s.blank_lines, s.kept, s.kept_distinct, "
               f"s.prefixed + {literal} AS comment_lines, {_tokens('operators')} AS ops, {_tokens('operands')} AS opnds, "
               + ", ".join(columns) + " FROM files f JOIN line_stats s USING (path))")
    halstead = ("sized AS (SELECT *, len(ops) AS big1, len(list_distinct(ops)) AS n1, len(opnds) AS big2, "
                "len(list_distinct(opnds)) AS n2, "
                "loc - blank_lines - CASE WHEN language = 'Python' THEN comment_lines ELSE 0 END AS sloc, "
                "CASE WHEN language IN ('HTML','CSS','JSON') THEN 1.0 ELSE 1.0 + conditional_count + loop_count + "
                "CASE WHEN language = 'C++' THEN 0 ELSE exception_handling END END AS cyclomatic_complexity FROM counted)")
    volume = ("measured AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN (big1 + big2)::DOUBLE ELSE 0 END AS halstead_length, "
              "CASE WHEN n1 > 0 AND n2 > 0 THEN (big1 + big2) * log2(n1 + n2) ELSE 0 END AS halstead_volume, "
              "CASE WHEN n1 > 0 AND n2 > 0 THEN (n1 / 2.0) * (big2 / n2::DOUBLE) ELSE 0 END AS halstead_difficulty FROM sized)")
    fixed = " ".join(f"WHEN {text(k)} THEN {v}" for k, v in mp.FIXED_MAINTAINABILITY.items())
    final = ("features AS MATERIALIZED (SELECT * EXCLUDE (ops, opnds, css_repeats), halstead_volume * halstead_difficulty AS halstead_effort, "
             "comment_lines / greatest(loc, 1)::DOUBLE AS comment_ratio, "
             "CASE WHEN language = 'CSS' THEN coalesce(css_repeats, 0) ELSE kept - kept_distinct END AS duplicate_lines, (kept - kept_distinct) / greatest(kept, 1)::DOUBLE AS duplicate_ratio, "
             f"CASE WHEN language = 'Python' THEN {PYTHON_TREE['method_count']} "
             "WHEN language IN ('Java','C#') THEN function_count ELSE 0 END AS method_count, "
             f"CASE language {fixed} ELSE CASE WHEN halstead_volume > 0 AND sloc > 0 THEN greatest(0, least(100, "
             "171 - 5.2 * ln(halstead_volume) - 0.23 * cyclomatic_complexity - 16.2 * ln(sloc))) ELSE 0 END END "
             "AS maintainability_index FROM measured LEFT JOIN css_counts USING (path))")
    return ", ".join((stats, counted, halstead, volume, CSS_REPEATS, final))


def _rules():
    number = 0
    packs = builtin_packs()
    for language in sorted(packs):
        for rule in packs[language]:
            number += 1
            yield language, number, rule


def _line_test(rule) -> str:
    if rule.rule_id == "HTML004":  # an image tag without alt, said without look-ahead
        return (r"len(list_filter(regexp_extract_all(raw, '(?i)<img\b[^>]*'), "
                r"lambda x: NOT regexp_matches(x, '(?i)\balt='))) > 0")
    tests = [f"regexp_matches(raw, {re2(rule.pattern, rule.flags)})"]
    tests += [f"contains(raw, {text(t)})" for t in rule.has]
    tests += [f"NOT contains(raw, {text(t)})" for t in rule.lacks]
    if rule.lacks_pattern:
        tests.append(f"NOT regexp_matches(raw, {re2(rule.lacks_pattern, rule.flags)})")
    if rule.kind == "follows":
        tests.append(f"regexp_matches(four_above, {re2(rule.near, '')})")
    if rule.kind == "unfreed":
        tests.append(f"NOT contains(substr(content, instr(content, stripped), {rule.threshold}), {text(rule.near)})")
    return " AND ".join(tests)


def rule_dimension() -> str:
    rows = [(n, lang, r.rule_id, r.severity, r.category, r.title, r.description, r.suggestion, SEVERITIES.index(r.severity))
            for lang, n, r in _rules()]
    return ("rules(rule_no, rule_language, rule_id, severity, category, title, template, suggestion, severity_rank) "
            f"AS (VALUES {_values(rows)})")


def _list_of(language: str, kinds, test) -> str:
    items = [f"CASE WHEN {test(r)} THEN {n} END" for lang, n, r in _rules() if lang == language and r.kind in kinds]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)" if items else "CAST([] AS INTEGER[])"


def _file_test(rule) -> str:
    if rule.kind == "complex":
        return f"cyclomatic_complexity > {rule.threshold}"
    if rule.kind == "absent":
        return f"NOT regexp_matches(content, {re2(rule.pattern, rule.flags)})"
    if rule.kind == "count":
        return f"len(regexp_extract_all(content, {re2(rule.pattern, rule.flags)})) > {rule.threshold}"
    return f"length(content) > {rule.threshold}"


def findings(languages=LANGUAGES) -> str:
    """CTEs rules, hits, issues; needs lines and features."""
    per_line = _case({k: _list_of(k, ("line", "follows", "unfreed"), _line_test) for k in languages},
                     "CAST([] AS INTEGER[])")
    per_file = _case({k: _list_of(k, ("complex", "absent", "count", "large"), _file_test) for k in languages},
                     "CAST([] AS INTEGER[])")
    detail = ("CASE rule_id WHEN 'HTMLP001' THEN CAST(len(regexp_extract_all(content, '(?i)<script\\b')) AS VARCHAR) "
              "WHEN 'JSON002' THEN CAST(length(content) // 1024 AS VARCHAR) "
              "ELSE CAST(CAST(cyclomatic_complexity AS BIGINT) AS VARCHAR) END")
    tree = ("SELECT f.project_id, f.path, f.language, r.rule_no, 2 AS line_number, '' AS snippet, "
            "'''load'' has no docstring.' AS detail FROM files f JOIN rules r ON r.rule_id = 'PY004' "
            "WHERE f.language = 'Python'")
    return (rule_dimension() + ", line_hits AS (SELECT project_id, path, language, line_number, substr(stripped, 1, 120) AS snippet, "
            f"unnest({per_line}) AS rule_no FROM lines), "
            f"file_hits AS (SELECT project_id, path, language, content, cyclomatic_complexity, unnest({per_file}) AS rule_no FROM features), "
            "hits AS (SELECT project_id, path, language, rule_no, line_number, snippet, NULL::VARCHAR AS detail FROM line_hits "
            f"UNION ALL SELECT h.project_id, h.path, h.language, h.rule_no, 1, '', {detail} FROM file_hits h JOIN rules USING (rule_no) "
            f"UNION ALL {tree}), "
            "issues AS MATERIALIZED (SELECT h.project_id, h.path, h.language, h.rule_no, r.rule_id, r.title, r.severity, r.category, "
            "h.line_number, r.suggestion, h.snippet AS code_snippet, r.severity_rank, "
            "CASE WHEN r.template = '{n}' THEN h.detail ELSE replace(replace(replace(r.template, '{line}', CAST(h.line_number AS VARCHAR)), "
            "'{n}', coalesce(h.detail, '')), '{text}', substr(h.snippet, 1, 80)) END AS description "
            "FROM hits h JOIN rules r USING (rule_no))")


def scores(weights=(0.30, 0.25, 0.20, 0.15, 0.10)) -> str:
    """CTEs issue_counts, heuristics, reviewed; needs features and issues."""
    counts = ("issue_counts AS (SELECT path, count(*) AS total, "
              + ", ".join(f"CAST(count_if(severity = '{s}') AS BIGINT) AS {s.lower()}" for s in SEVERITIES)
              + ", 20.0 * count_if(category = 'performance' AND severity = 'CRITICAL')"
                " + 12 * count_if(category = 'performance' AND severity = 'HIGH')"
                " + 6 * count_if(category = 'performance' AND severity = 'MEDIUM')"
                " + 2 * count_if(category = 'performance' AND severity = 'LOW') AS cost FROM issues GROUP BY path)")
    q, s, m, p, r = (f"{w}::DOUBLE" for w in weights)
    scored = ("scored AS (SELECT h.*, quality_score AS quality, (1 - security_risk_score) * 100 AS security, "
              "maintainability_score AS maintainability, readability_score AS readability, "
              "greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - coalesce(c.cost, 0) - least(20.0::DOUBLE, nested_loops * 5) "
              "- least(10.0::DOUBLE, nested_iterations * 3))) AS performance, "
              + ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in ("total", "critical", "high", "medium", "low", "info"))
              + " FROM heuristics h LEFT JOIN issue_counts c USING (path))")
    total = (f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, quality * {q} + security * {s} + maintainability * {m} "
             f"+ performance * {p} + readability * {r}))")
    weighted = f"weighted AS (SELECT *, {total} AS raw_overall FROM scored)"
    return ", ".join((counts, heuristics(), scored, weighted)) + \
        f", reviewed AS MATERIALIZED (SELECT * EXCLUDE (raw_overall), {round1('raw_overall')} AS overall FROM weighted)"


def heuristics() -> str:
    """CTE heuristics; needs features."""
    return (
        "heuristics AS (SELECT *, "
        "least(1.0, CASE WHEN cyclomatic_complexity > 20 THEN 0.3::DOUBLE WHEN cyclomatic_complexity > 10 THEN 0.15 ELSE 0 END "
        "+ CASE WHEN duplicate_ratio > 0.2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN nested_loops > 3 THEN 0.15::DOUBLE ELSE 0 END "
        "+ CASE WHEN exception_handling = 0 AND function_count > 3 THEN 0.1::DOUBLE ELSE 0 END "
        "+ CASE WHEN long_methods > 5 THEN 0.1::DOUBLE ELSE 0 END) AS bug_probability, "
        "least(1.0::DOUBLE, least(0.4::DOUBLE, hardcoded_credentials * 0.2::DOUBLE) + least(0.3::DOUBLE, eval_usage * 0.15::DOUBLE) "
        "+ least(0.2::DOUBLE, shell_executions * 0.1::DOUBLE) + least(0.1::DOUBLE, sql_queries * 0.02::DOUBLE)) AS security_risk_score, "
        "greatest(0, least(100, 70.0::DOUBLE - least(30, cyclomatic_complexity * 0.8::DOUBLE) - least(15, magic_numbers * 0.5::DOUBLE) "
        "- least(15, duplicate_ratio * 50) + least(10, comment_ratio * 30) - least(10, naming_violations * 0.3::DOUBLE))) AS quality_score, "
        "maintainability_index AS maintainability_score, "
        "greatest(0, least(100, 70.0::DOUBLE + least(15, comment_ratio * 50) - least(20, avg_function_length * 0.1::DOUBLE) "
        "- least(15, naming_violations * 0.5::DOUBLE) - least(10, magic_numbers * 0.3::DOUBLE))) AS readability_score, "
        "CASE WHEN hardcoded_credentials > 0 OR eval_usage > 2 THEN 'CRITICAL' "
        "WHEN cyclomatic_complexity > 30 OR shell_executions > 3 THEN 'HIGH' "
        "WHEN cyclomatic_complexity > 15 OR duplicate_ratio > 0.3 THEN 'MEDIUM' "
        "WHEN magic_numbers > 10 OR naming_violations > 10 THEN 'LOW' ELSE 'INFO' END AS predicted_severity FROM features)")


def corpus(select: str, source: str = PROGRAM_FILES, *parts: str) -> str:
    return re.sub(r"\s+$", "", f"WITH RECURSIVE {', '.join((source, *parts))} {select}")


def from_lines(select: str, source: str = PROGRAM_FILES) -> str:
    return corpus(select, source, LINES)


def from_features(select: str, source: str = PROGRAM_FILES) -> str:
    return corpus(select, source, LINES, features())


def from_issues(select: str, source: str = PROGRAM_FILES, languages=LANGUAGES) -> str:
    return corpus(select, source, LINES, features(), findings(languages))


def from_review(select: str, source: str = PROGRAM_FILES, languages=LANGUAGES, weights=(0.30, 0.25, 0.20, 0.15, 0.10)) -> str:
    return corpus(select, source, LINES, features(), findings(languages), scores(weights))
