"""Rule matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import event_files, features, found, long, pages, paths, programs, reviewed, syntax_files, table
from entries.files import PATHS
from oracle.base import EVENT_FILES, LINES, PAGE_FILES, PROGRAM_FILES, corpus, from_issues, from_review, round1, text
from reviewlake import LanguagePack, issues, keep_where, review, spread
from reviewlake.functions.syntax import Limits
from reviewlake.functions.text import unify_newlines
from reviewlake.operators import metrics, rules
from reviewlake.operators.files import pack_language
from reviewlake.packs.languages import LANGUAGES
from reviewlake.packs.rules import FOUND, Rule, builtin_packs, override

LINE_KINDS = ("line", "follows", "unfreed")
FILE_KINDS = ("complex", "absent", "count", "large")
ALLOCATING = "  buf = malloc(64);\n"
RELEASING = "\n  free(buf);"


def _hits(files, kinds):
    hits = rules.explode_issues(rules.with_hits(features(files), kinds=kinds))
    return hits.select("path", "language", "rule_id", *long("line_number"))


def line_rules(spark, folder):
    return _hits(programs(spark, folder), LINE_KINDS)


def file_rules(spark, folder):
    return _hits(programs(spark, folder), FILE_KINDS)


def page_rules(spark, folder):
    return _hits(pages(spark, folder), LINE_KINDS + FILE_KINDS)


def event_rules(spark, folder):
    return _hits(event_files(spark, folder), LINE_KINDS + FILE_KINDS + ("syntax",))


def tree_rules(spark, folder):
    hits = rules.with_hits(features(programs(spark, folder)), kinds=("syntax",))
    return rules.explode_issues(hits).select("path", "rule_id", "description", *long("line_number"))


def syntax_rules(spark, folder):
    hits = rules.with_hits(features(syntax_files(spark, folder)), kinds=("syntax",))
    return rules.explode_issues(hits).select("path", "rule_id", "description", *long("line_number"))


def syntax_validity(spark, folder):
    df = rules.validity(metrics.with_syntax(syntax_files(spark, folder)))
    return df.select("path", "language", "is_valid", F.concat_ws("|", "parse_errors").alias("parse_errors"))


# What the parser and the tree rules say of the six programs, by hand.
SYNTAX_ERRORS = {1: "SyntaxError at line 1: invalid syntax", 5: "JSON parse error at line 1: Expecting value"}
SYNTAX_FINDINGS = (
    (0, "PY004", 1, "'Shape' has no docstring."), (0, "PY004", 6, "'scale' has no docstring."),
    (0, "PY007", 9, "Using bare `except:` catches all exceptions including system exits."),
    (1, "PY001", 1, SYNTAX_ERRORS[1]), (2, "PY008", 1, "Import 'json' may be unused."),
    (2, "PYP001", 4, "Function 'walk' has loops nested 3 levels deep (O(n^3) complexity)."),
    (3, "PY003", 3, "Function 'fetch' has 8 parameters."), (3, "PYP002", 3, "Function 'fetch' has nested loops (O(n²) complexity)."),
    (5, "JSON001", 1, SYNTAX_ERRORS[5]),
)


def query_in_loop(spark, folder):
    return _hits(programs(spark, folder), ("follows",))


def unfreed_memory(spark, folder):
    """Documents as C files that allocate, and release only now and then."""
    docs = spread(table(spark, folder, "documents"), "doc_id")
    tail = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit(RELEASING)).otherwise(F.lit(""))
    files = docs.select(F.col("source").alias("project_id"),
                        F.concat(F.lit("mem/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"),
                        F.lit("C").alias("language"),
                        F.concat(F.lit(ALLOCATING), unify_newlines(F.col("text")), tail).alias("content"))
    return _hits(files, ("unfreed",))


def validity(spark, folder):
    df = rules.validity(metrics.with_syntax(programs(spark, folder)))
    return df.select("path", "language", "is_valid", F.concat_ws("|", "parse_errors").alias("parse_errors"))


def inherited_rules(spark, folder):
    df = found(spark, folder).where(F.col("language").isin("TypeScript", "C++"))
    return df.groupBy("language", "rule_id").agg(F.count("*").alias("findings"))


def shaped_issues(spark, folder):
    return found(spark, folder).select(
        "path", "rule_id", "title", "description", "severity", "category", *long("line_number"), "suggestion",
        "code_snippet")


def ordered_issues(spark, folder):
    """Position of every finding in its file's report."""
    return rules.explode_issues(rules.in_report_order(reviewed(spark, folder))).select(
        "path", "rule_id", *long("line_number"), F.col("position").cast("long").alias("position"))


def file_review(spark, folder):
    df = reviewed(spark, folder)
    return df.select("project_id", "path", "language", *long("loc", "total", "critical", "high", "medium", "low", "info"),
                     F.round("cyclomatic_complexity", 6).alias("cyclomatic_complexity"), "overall", "predicted_severity")


def page_review(spark, folder):
    df = review(pages(spark, folder))
    return df.select("project_id", "path", *long("total", "info"), "overall")


def unsupported_files(spark, folder):
    df = paths(spark, folder).withColumn("language", F.coalesce(pack_language(F.col("path")), F.lit("Unknown")))
    done = review(spread(df, "doc_id"))
    return done.select("path", "language", "error", *long("total"), F.col("overall").isNull().alias("unscored"))


def extra_rules(spark, folder):
    """A user rule, a changed severity and other weights, handed to the review."""
    mine = {"SQL": (Rule("USR001", "static", "HIGH", "style", "line", "i", r"\bgrant\b", "Grant statement", FOUND),)}
    packs = override(builtin_packs(), "SQL", "SQL001", severity="LOW")
    files = programs(spark, folder).where("language = 'SQL'")
    done = review(files, packs=packs, extra_rules=mine, weights={"quality": 0.5, "security": 0.05})
    return done.select("path", *long("total", "high", "medium", "low"), "overall")


def user_pack(spark, folder):
    """A pack for a language of its own: rules only, no built-in metrics."""
    packs = {"Bash": (Rule("OPS001", "security", "CRITICAL", "security", "line", "", r"chmod\s+777", "World-writable", FOUND),)}
    done = review(programs(spark, folder).where("language = 'Bash'"), packs=packs)
    return issues(done, packs).select("path", "rule_id", "description", *long("line_number"))


# Patterns that see the ends of their line, set flags inside or look around: each of
# them must be found wherever a plain test of the single lines finds it.
USER_PATTERNS = (
    Rule("USR101", "static", "LOW", "style", "line", "", r"^[a-z]+ ", "Starts in lower case", FOUND),
    Rule("USR102", "static", "LOW", "style", "line", "", r"\.$", "Ends in a full stop", FOUND),
    Rule("USR103", "static", "LOW", "style", "line", "", r"(?i)THE", "Article", FOUND),
    Rule("USR104", "static", "LOW", "style", "line", "", r"(?i:OF|DE) [a-z]", "Preposition", FOUND),
    Rule("USR105", "static", "LOW", "style", "line", "i", r" of(?! the)", "Not before an article", FOUND),
    Rule("USR106", "static", "LOW", "style", "line", "", r"(?<=[a-z])\.\s*$", "Stop after a letter", FOUND),
    Rule("USR107", "static", "LOW", "style", "line", "", r"\A[A-Z]\w*\Z", "One word", FOUND),
    Rule("USR108", "static", "LOW", "style", "absent", "", r"(?i)\bTHE\b", "No article", FOUND),
    Rule("USR109", "static", "LOW", "style", "count", "", r"(?i:AND) ", "Many conjunctions", "{n}", threshold=3),
)


def user_patterns(spark, folder):
    """The same user rules in the packs of all languages."""
    packs = {language: USER_PATTERNS for language in LANGUAGES}
    done = rules.with_hits(features(programs(spark, folder)), packs)
    return issues(done, packs).select("path", "language", "rule_id", *long("line_number"))


NOTES = LanguagePack(
    "Notes", ("note", ".MEMO"), (Rule("NOTE001", "static", "LOW", "style", "line", "i", r"^the\b", "Article first", FOUND),),
    comment_prefixes=("Th", "|"), duplicate_skip="Th", maintainability=42.0, patterns=(("function_count", "", r"\w+ed "), ("conditional_count", "i", r" of ")))


def own_language(spark, folder):
    """Documents as files of a language that only the user knows, named in another case."""
    files = spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("source").alias("project_id"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".memo")).alias("path"),
        F.lit("NOTES").alias("language"), unify_newlines(F.col("text")).alias("content"))
    done = review(files, own=(NOTES,))
    return done.select("path", "language", *long("loc", "comment_lines", "function_count", "cyclomatic_complexity", "maintainability_index",
                                                 "duplicate_lines", "total"))


_kind = lambda kinds: " OR ".join(f"rule_id = '{r}'" for r in sorted(
    {r.rule_id for pack in builtin_packs().values() for r in pack if r.kind in kinds}))
_select = "SELECT path, language, rule_id, line_number FROM issues"

MEMORY_FILES = (
    "files AS (SELECT source AS project_id, 'mem/' || doc_id || '.c' AS path, 'C' AS language, "
    f"'{ALLOCATING.strip(chr(10))}' || chr(10) || regexp_replace(text, '\\r\\n?', chr(10), 'g') || "
    f"CASE WHEN doc_id % 2 = 0 THEN chr(10) || '{RELEASING.strip(chr(10))}' ELSE '' END AS content FROM documents)")

_uneven = ("CASE WHEN language = 'JavaScript' AND braces THEN 'Warning: Unbalanced curly braces detected.' "
           "WHEN language IN ('TypeScript','Java') AND braces THEN 'Warning: Unbalanced curly braces.' "
           "WHEN language IN ('C','C++') AND braces THEN 'Unbalanced curly braces.' "
           "WHEN language = 'C#' AND braces THEN 'Unbalanced braces.' "
           "WHEN language = 'CSS' AND braces THEN 'Unbalanced curly braces in CSS.' "
           "WHEN language = 'HTML' AND angles THEN 'Warning: Unbalanced angle brackets.' ELSE '' END")
_diff = lambda a, b: f"length(replace(content, '{a}', '')) <> length(replace(content, '{b}', ''))"

ENTRIES = {
    "match_line_rules": (line_rules, from_issues(f"{_select} WHERE {_kind(LINE_KINDS)}")),
    "match_file_rules": (file_rules, from_issues(f"{_select} WHERE {_kind(FILE_KINDS)}")),
    "match_page_rules": (page_rules, from_issues(_select, PAGE_FILES, ("HTML",))),
    "match_json_rules": (event_rules, from_issues(_select, EVENT_FILES, ("JSON",))),
    "match_tree_rules": (tree_rules, from_issues(
        f"SELECT path, rule_id, description, CAST(line_number AS BIGINT) AS line_number FROM issues WHERE {_kind(('syntax',))}")),
    "match_syntax_rules": (syntax_rules,
        "SELECT 'syn/' || doc_id || CASE WHEN doc_id % 6 < 4 THEN '.py' ELSE '.json' END AS path, rule_id, description, CAST(line AS BIGINT) AS line_number "
        "FROM documents JOIN (VALUES " + ", ".join(f"({n}, {text(r)}, {line}, {text(d)})" for n, r, line, d in SYNTAX_FINDINGS)
        + ") v(n, rule_id, line, description) ON doc_id % 6 = n"),
    "check_syntax_validity": (syntax_validity,
        "SELECT 'syn/' || doc_id || CASE WHEN doc_id % 6 < 4 THEN '.py' ELSE '.json' END AS path, CASE WHEN doc_id % 6 < 4 THEN 'Python' ELSE 'JSON' END "
        "AS language, doc_id % 6 NOT IN (1, 5) AS is_valid, CASE doc_id % 6 " + " ".join(f"WHEN {n} THEN {text(e)}" for n, e in SYNTAX_ERRORS.items())
        + " ELSE '' END AS parse_errors FROM documents"),
    "match_query_in_loop": (query_in_loop, from_issues(f"{_select} WHERE rule_id = 'PHPPERF001'")),
    "match_unfreed_memory": (unfreed_memory, from_issues(f"{_select} WHERE rule_id = 'CP001'", MEMORY_FILES, ("C",))),
    "check_validity": (validity, corpus(
        f"SELECT path, language, TRUE AS is_valid, {_uneven} AS parse_errors FROM "
        f"(SELECT *, {_diff('{', '}')} AS braces, {_diff('<', '>')} AS angles FROM files)")),
    "rule_inheritance": (inherited_rules, from_issues(
        "SELECT language, rule_id, count(*) AS findings FROM issues WHERE language IN ('TypeScript','C++') GROUP BY ALL")),
    "issue_shaping": (shaped_issues, from_issues(
        "SELECT path, rule_id, title, description, severity, category, line_number, suggestion, code_snippet FROM issues")),
    "issue_order": (ordered_issues, from_issues(
        "SELECT path, rule_id, line_number, row_number() OVER (PARTITION BY path ORDER BY severity_rank, line_number, rule_no) "
        "AS position FROM issues")),
    "review_files": (file_review, from_review(
        "SELECT project_id, path, language, loc, CAST(total AS BIGINT) AS total, critical, high, medium, low, info, "
        "round(CAST(cyclomatic_complexity AS DOUBLE), 6) AS cyclomatic_complexity, overall, predicted_severity FROM reviewed")),
    "review_pages": (page_review, from_review("SELECT project_id, path, total, info, overall FROM reviewed", PAGE_FILES, ("HTML",))),
    "review_unsupported_files": (unsupported_files, None),
    "user_rules_and_weights": (extra_rules, None),
    "user_language_pack": (user_pack, None),
    "user_own_language": (own_language, corpus(
        "SELECT path, 'Notes' AS language, count(*) AS loc, CAST(count_if(starts_with(stripped, 'Th') OR starts_with(stripped, '|')) AS BIGINT) AS comment_lines, "
        "any_value(len(regexp_extract_all(content, '[\\p{L}\\p{N}_]+ed '))) AS function_count, "
        "any_value(1 + len(regexp_extract_all(content, '(?i) of '))) AS cyclomatic_complexity, CAST(42 AS BIGINT) AS maintainability_index, "
        "CAST(count_if(stripped <> '' AND NOT starts_with(stripped, 'Th')) - count(DISTINCT CASE WHEN stripped <> '' AND NOT starts_with(stripped, 'Th') "
        "THEN stripped END) AS BIGINT) AS duplicate_lines, CAST(count_if(regexp_matches(lower(raw), '^the([^\\p{L}\\p{N}_]|$)')) AS BIGINT) AS total FROM lines GROUP BY path",
        "files AS (SELECT source AS project_id, 'notes/' || doc_id || '.memo' AS path, 'Notes' AS language, "
        "regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content FROM documents)", LINES)),
    "user_rule_patterns": (user_patterns, corpus(
        "SELECT path, language, rule_id, line_number FROM (SELECT path, language, line_number, unnest(list_filter(["
        "CASE WHEN regexp_matches(raw, '^[a-z]+ ') THEN 'USR101' END, "
        "CASE WHEN regexp_matches(one, '\\.$') THEN 'USR102' END, "
        "CASE WHEN contains(lower(raw), 'the') THEN 'USR103' END, "
        "CASE WHEN regexp_matches(raw, '(of|oF|Of|OF|de|dE|De|DE) [a-z]') THEN 'USR104' END, "
        "CASE WHEN regexp_matches(regexp_replace(lower(raw), ' of the', ' zz', 'g'), ' of') THEN 'USR105' END, "
        "CASE WHEN regexp_matches(raw, '[a-z]\\.\\s*$') THEN 'USR106' END, "
        "CASE WHEN regexp_matches(one, '^[A-Z][\\p{L}\\p{N}_]*$') THEN 'USR107' END], lambda x: x IS NOT NULL)) AS rule_id "
        "FROM (SELECT *, rtrim(raw, chr(10)) AS one FROM lines)) "
        "UNION ALL SELECT path, language, 'USR108', 1 FROM files WHERE NOT regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') "
        "UNION ALL SELECT path, language, 'USR109', 1 FROM files WHERE len(regexp_extract_all(lower(content), 'and ')) > 3", PROGRAM_FILES, LINES)),
}
# Files without a pack carry an error and no scores; the others are checked above.
ENTRIES["review_failed_files"] = (
    lambda spark, folder: keep_where(unsupported_files(spark, folder), F.col("error").isNotNull()).select("path", "language", "unscored"),
    f"WITH {PATHS} SELECT path, 'Unknown' AS language, TRUE AS unscored FROM placed WHERE language IS NULL OR extension = '.fish'")
# SQL files: SQL001 lowered to LOW (4 points back), one user rule on GRANT lines, other weights.
_custom = round1("greatest(0, least(100, quality * 0.5::DOUBLE + security * 0.05::DOUBLE + maintainability * 0.2::DOUBLE "
                 "+ (performance + 4 * stars) * 0.15::DOUBLE + readability * 0.1::DOUBLE))")
def user_limits(spark, folder):
    """Tighter limits of the user's own for Python functions and parameter lists."""
    done = review(programs(spark, folder), limits=Limits(function_lines=7, parameters=1))
    found = issues(done).where(F.col("rule_id").isin("PY002", "PY003"))
    lists = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("rule_id", *long("line_number"), "description"))).alias("f"))
    counts = done.where("language = 'Python'").select("path", *long("long_methods", "long_parameter_lists"))
    return counts.join(lists, "path", "left").select("path", "long_methods", "long_parameter_lists", F.inline_outer("f"))


ENTRIES["user_limits"] = (user_limits, corpus(
    "SELECT path, CAST(1 AS BIGINT) AS long_methods, CAST(1 AS BIGINT) AS long_parameter_lists, rule_id, CAST(2 AS BIGINT) AS line_number, description FROM files, "
    "(VALUES ('PY002', 'Function ''load'' is 8 lines long.'), ('PY003', 'Function ''load'' has 2 parameters.')) v(rule_id, description) WHERE language = 'Python'"))
ENTRIES["user_rules_and_weights"] = (extra_rules, from_review(
    f"SELECT path, total + grants AS total, high + grants AS high, medium - stars AS medium, low + stars AS low, {_custom} AS overall "
    "FROM reviewed JOIN (SELECT path, CAST(count_if(regexp_matches(raw, '(?i)\\bgrant\\b')) AS BIGINT) AS grants, "
    "CAST(count_if(regexp_matches(raw, '(?i)\\bselect\\s+\\*')) AS BIGINT) AS stars FROM lines GROUP BY path) USING (path) WHERE language = 'SQL'"))
ENTRIES["user_language_pack"] = (user_pack, corpus(
    "SELECT path, 'OPS001' AS rule_id, 'Found at line ' || line_number || ': ' || substr(stripped, 1, 80) AS description, line_number "
    "FROM lines WHERE language = 'Bash' AND regexp_matches(raw, 'chmod\\s+777')", PROGRAM_FILES, LINES))
