"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import TESTDATA
from tools.check_oracle import TABLES, comparable

SOME = ["scan_select_files", "scan_file_cap", "language_stats", "split_lines", "halstead_metrics", "match_line_rules",
        "issue_order", "check_validity", "review_files", "project_review", "problem_files", "compare_consecutive_scans",
        "search_by_text", "explain_findings", "standards_rollup", "training_rows", "split_stratified", "split_labelled", "scaler_statistics", "class_weights_bug", "user_rule_patterns", "user_own_language",
        "search_stored_scans", "match_syntax_rules", "check_syntax_validity", "python_syntax_programs", "export_json",
        "report_sections_pdf", "first_predictions",
        "stream_running_totals", "report_sections_html"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    df = queries()[name](spark, TESTDATA)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracle_names_are_registered():
    assert set(oracle_sql()) <= set(queries())
