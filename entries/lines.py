"""Lines and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import event_files, features, long, pages, programs, rounded, sql_long, sql_rounded, syntax_files, table
from oracle.base import CSS_REPEATS, EVENT_FILES, PAGE_FILES, PYTHON_TREE, corpus, from_features, from_lines
from reviewlake import spread
from reviewlake.functions.text import unify_newlines
from reviewlake.operators import metrics
from reviewlake.packs.metric_patterns import FEATURES, SYNTAX_FEATURES

LINE_COUNTS = ("loc", "blank_lines", "comment_lines", "sloc")
STRUCTURE = ("function_count", "class_count", "method_count", "import_count", "global_variables", "loop_count",
             "nested_loops", "conditional_count", "exception_handling", "eval_usage", "magic_numbers", "sql_queries",
             "shell_executions", "network_operations", "file_operations")
HALSTEAD = ("halstead_length", "halstead_volume", "halstead_difficulty", "halstead_effort")


def split_lines(spark, folder):
    return metrics.numbered_lines(programs(spark, folder)).select(
        "path", *long("line_number"), F.md5("stripped").alias("line_md5"))


def line_counts(spark, folder):
    df = metrics.with_line_counts(metrics.with_lines(programs(spark, folder)))
    return df.select("path", "language", *long(*LINE_COUNTS), *rounded("comment_ratio"))


def page_line_counts(spark, folder):
    df = metrics.with_line_counts(metrics.with_lines(pages(spark, folder)))
    return df.select("path", *long(*LINE_COUNTS), *rounded("comment_ratio"))


def columns(names):
    return lambda spark, folder: features(programs(spark, folder)).select("path", "language", *long(*names))


def measures(names):
    return lambda spark, folder: features(programs(spark, folder)).select("path", "language", *rounded(*names))


def duplicates(spark, folder):
    df = features(programs(spark, folder))
    return df.select("path", *long("duplicate_lines"), *rounded("duplicate_ratio"))


def css_duplicates(spark, folder):
    """Every document as a style sheet: each two words a declaration, so that some repeat."""
    declared = F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z]+)[ ,.]+([a-z]+)", "$1: $2;")
    files = table(spark, folder, "documents").select(
        F.col("source").alias("project_id"), F.concat(F.lit("css/"), "doc_id", F.lit(".css")).alias("path"), F.lit("CSS").alias("language"),
        unify_newlines(declared).alias("content"))
    return features(spread(files, "path")).select("path", *long("duplicate_lines"))


def python_tree(spark, folder):
    df = features(programs(spark, folder).where("language = 'Python'"))
    return df.select("path", *rounded(*SYNTAX_FEATURES))


def syntax_metrics(spark, folder):
    df = features(syntax_files(spark, folder).where("language = 'Python'"))
    return df.select("path", *rounded(*SYNTAX_FEATURES))


# Counted by hand for the four Python programs of the syntax files (the second is broken).
BY_HAND = {
    "function_count": (2, 0, 1, 1), "class_count": (1, 0, 0, 0), "method_count": (2, 0, 0, 0), "import_count": (0, 0, 3, 1),
    "global_variables": (0, 0, 0, 1), "constants": (1, 0, 0, 2), "parameter_count": (5, 0, 1, 8), "return_statements": (3, 0, 1, 1),
    "exception_handling": (1, 0, 0, 0), "loop_count": (0, 0, 3, 2), "nested_loops": (0, 0, 1, 1), "conditional_count": (0, 0, 1, 0),
    "recursion_count": (0, 0, 1, 0), "max_nesting_depth": (0, 0, 3, 2), "avg_function_length": (4.0, 0, 11.0, 9.0),
    "avg_class_size": (2.0, 0, 0, 0), "avg_identifier_length": (8 / 4, 0, 59 / 15, 46 / 15), "naming_violations": (2, 0, 0, 3),
    "long_methods": (0, 0, 0, 0), "large_classes": (0, 0, 0, 0), "long_parameter_lists": (0, 0, 0, 1), "magic_numbers": (1, 0, 1, 1),
    "eval_usage": (0, 0, 1, 0), "file_operations": (0, 0, 0, 1), "network_operations": (0, 0, 0, 1),
}


def one_language(language, names, corpus_of=programs):
    def run(spark, folder):
        return features(corpus_of(spark, folder).where(F.col("language") == language)).select("path", *long(*names))
    return run


def vector(spark, folder):
    cleaned = metrics.clean_vector(features(programs(spark, folder)))
    return cleaned.select("path", *rounded(*FEATURES))


def feature_rows(spark, folder):
    df = metrics.features_long(features(programs(spark, folder)), ["path", "language"])
    return df.groupBy("language", "feature").agg(
        F.count("*").alias("files"), F.round(F.sum(F.col("value").cast("decimal(28,4)")).cast("double"), 1).alias("total"))


def feature_maps(spark, folder):
    df = features(event_files(spark, folder)).select("path", metrics.feature_map().alias("m"))
    return df.select("path", F.size("m").cast("long").alias("entries"),
                     *[F.round(F.col("m")[n], 6).alias(n) for n in ("loc", "magic_numbers", "maintainability_index")])


def _features(names, kind=sql_long, where="", lead="path, language"):
    return from_features(f"SELECT {lead}, {kind(*names)} FROM features {where}")


_melt = " UNION ALL ".join(f"SELECT language, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM features" for n in FEATURES)

ENTRIES = {
    "split_lines": (split_lines, from_lines("SELECT path, line_number, md5(stripped) AS line_md5 FROM lines")),
    "line_counts": (line_counts, from_features(
        f"SELECT path, language, {sql_long(*LINE_COUNTS)}, {sql_rounded('comment_ratio')} FROM features")),
    "page_line_counts": (page_line_counts, from_features(
        f"SELECT path, {sql_long(*LINE_COUNTS)}, {sql_rounded('comment_ratio')} FROM features", PAGE_FILES)),
    "todo_fixme_counts": (columns(("todo_count", "fixme_count")), _features(("todo_count", "fixme_count"))),
    "structure_counts": (columns(STRUCTURE), _features(STRUCTURE)),
    "cyclomatic_complexity": (measures(("cyclomatic_complexity",)), _features(("cyclomatic_complexity",), sql_rounded)),
    "halstead_metrics": (measures(HALSTEAD), _features(HALSTEAD, sql_rounded)),
    "maintainability_index": (measures(("maintainability_index",)), _features(("maintainability_index",), sql_rounded)),
    "duplicate_lines": (duplicates, from_features(
        f"SELECT path, {sql_long('duplicate_lines')}, {sql_rounded('duplicate_ratio')} FROM features")),
    "css_duplicate_declarations": (css_duplicates, corpus(
        "SELECT path, coalesce(css_repeats, 0) AS duplicate_lines FROM files LEFT JOIN css_counts USING (path)",
        "files AS (SELECT source AS project_id, 'css/' || doc_id || '.css' AS path, 'CSS' AS language, regexp_replace(regexp_replace("
        "coalesce(text, ''), '([a-z]+)[ ,.]+([a-z]+)', '\\1: \\2;', 'g'), '\\r\\n?', chr(10), 'g') AS content FROM documents)", CSS_REPEATS)),
    "python_syntax_metrics": (python_tree, corpus(
        "SELECT path, " + ", ".join(f"round(CAST({PYTHON_TREE[n]} AS DOUBLE), 6) AS {n}" for n in SYNTAX_FEATURES)
        + " FROM files WHERE language = 'Python'")),
    "python_syntax_programs": (syntax_metrics,
        "SELECT 'syn/' || doc_id || '.py' AS path, " + ", ".join(
            f"round(([{', '.join(f'{float(v)!r}::DOUBLE' for v in BY_HAND[n])}])[1 + doc_id % 6], 6) AS {n}" for n in SYNTAX_FEATURES)
        + " FROM documents WHERE doc_id % 6 < 4"),
    "typescript_extras": (one_language("TypeScript", ("class_count", "naming_violations")),
                          _features(("class_count", "naming_violations"), where="WHERE language = 'TypeScript'", lead="path")),
    "cpp_overrides": (one_language("C++", ("class_count", "exception_handling", "function_count")),
                      _features(("class_count", "exception_handling", "function_count"), where="WHERE language = 'C++'", lead="path")),
    "json_metrics": (one_language("JSON", ("hardcoded_credentials", "magic_numbers"), event_files), from_features(
        f"SELECT path, {sql_long('hardcoded_credentials', 'magic_numbers')} FROM features", EVENT_FILES)),
    "feature_vector": (vector, from_features(f"SELECT path, {sql_rounded(*FEATURES)} FROM features")),
    "feature_rows": (feature_rows, from_features(
        "SELECT language, feature, count(*) AS files, round(CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE), 1) AS total "
        f"FROM ({_melt}) GROUP BY language, feature")),
    "feature_map": (feature_maps, from_features(
        f"SELECT path, CAST({len(FEATURES)} AS BIGINT) AS entries, {sql_rounded('loc', 'magic_numbers', 'maintainability_index')} "
        "FROM features", EVENT_FILES)),
}
