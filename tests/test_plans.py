"""Roll-ups, history, files, exports, models and plan shapes."""

import os
import random

import pytest
from pyspark.sql import Window, functions as F

from conftest import TESTDATA
from reviewlake import issues, keep_where, review, store
from entries.learning import rows as training_rows
from reviewlake.operators import files, history, metrics, ml, rollup, scoring
from reviewlake.operators.topk import top_per_group
from reviewlake.packs.metric_patterns import FEATURES
from reviewlake.session import shared_folder
from reviewlake.sources import exports, tables, tree
from reviewlake.sources.files import read_files, skipped_files


@pytest.fixture(scope="module")
def done(spark):
    return store(review(tables.program_corpus(tables.read(spark, TESTDATA, "documents"))), "review")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_review_is_one_narrow_plan(spark):
    text = plan(review(tables.program_corpus(tables.read(spark, TESTDATA, "documents"))))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1
    found = plan(issues(review(tables.program_corpus(tables.read(spark, TESTDATA, "documents")))))
    assert found.count("ArrowEvalPython") == 1 and "SortMergeJoin" not in found


def test_only_selected_features_are_computed(spark):
    files = tables.program_corpus(tables.read(spark, TESTDATA, "documents"))
    text = plan(metrics.with_features(metrics.with_syntax(metrics.with_lines(files))).select("path", "loc"))
    assert "regexp_extract_all" not in text and "ArrowEvalPython" not in text


def test_keep_where_runs_the_review_once(spark):
    reviewed = review(tables.program_corpus(tables.read(spark, TESTDATA, "documents")))
    kept = keep_where(reviewed.select("path", "critical"), F.col("critical") > 0)
    assert plan(kept).count("ArrowEvalPython") == 1


def test_summaries_add_up(done):
    files_sum = done.agg(*[F.sum(c).alias(c) for c in rollup.COUNTS]).first()
    projects = rollup.project_issue_counts(done).agg(*[F.sum(c).alias(c) for c in rollup.COUNTS]).first()
    assert files_sum == projects
    assert done.agg(F.sum("total")).first()[0] == issues(done).count()
    assert files_sum.total == sum(files_sum[c] for c in rollup.COUNTS[1:])
    bad = done.where(" OR ".join(f"{s} < 0 OR {s} > 100 OR {s} IS NULL" for s in scoring.SCORES))
    assert bad.count() == 0
    shares = rollup.language_distribution(done).groupBy("project_id").agg(F.sum("percentage").alias("s")).collect()
    assert all(abs(r.s - 100) < 1 for r in shares)


def test_heuristics_example(spark):
    values = dict.fromkeys(FEATURES, 0.0) | {"loc": 100.0, "sloc": 80.0, "cyclomatic_complexity": 25.0, "hardcoded_credentials": 1.0}
    df = spark.createDataFrame([tuple(values[f] for f in FEATURES)], ", ".join(f"{f} double" for f in FEATURES))
    r = scoring.with_heuristics(df).first()
    assert (r.bug_probability, r.security_risk_score, r.quality_score, r.predicted_severity) == (0.3, 0.2, 50.0, "CRITICAL")


def test_unsupported_file_and_empty_project(corpus):
    r = review(corpus({"a.fish": ("Bash", "eval x"), "b.xyz": ("Unknown", "?")}))
    assert {x.error for x in r.select("error").collect()} == {"No plugin available for this file type."}
    summary = rollup.project_reviews(r).first()
    assert (summary.total_files, summary.analyzed_files, summary.overall, summary.total) == (2, 0, 0.0, 0)


def test_top_per_group_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 else rng.randrange(50), rng.randrange(40), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = top_per_group(df, ["g"], [F.desc("v"), F.col("id")], 7)
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id"))).where("rank <= 7")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_file_cap(spark):
    df = spark.createDataFrame([("a", f"/f{i:04d}") for i in range(30)] + [("b", "/x")], "project_id string, path string")
    kept = files.first_files(df, 10).collect()
    assert sorted(r.path for r in kept if r.project_id == "a") == [f"/f{i:04d}" for i in range(10)]
    assert len(kept) == 11


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_consecutive_scans_equal_a_plain_lag(spark, bucket):
    scans = tables.scan_history(tables.read(spark, TESTDATA, "events"))
    w = Window.partitionBy("project_id").orderBy("created_at", "analysis_id")
    plain = scans.select("project_id", F.lag("analysis_id").over(w).alias("l"), F.col("analysis_id").alias("r")).where("l IS NOT NULL")
    got = history.compare_consecutive(scans, bucket).select("project_id", "left_id", "right_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_split_keeps_exact_shares(spark):
    df = spark.range(5000).select(F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"))
    counts = {(r.c, r.is_train): r["count"] for r in ml.split_train(df, "c").groupBy("c", "is_train").count().collect()}
    assert counts[("x", True)] == round(1667 * 0.8) and counts[("y", True)] == round(3333 * 0.8)


def test_read_files(spark, tmp_path):
    made = {"src/a.py": b"x = 1\r\ny = 2\n", "src/b.js": "café".encode("latin-1"), "node_modules/c.js": b"x", ".git/d.py": b"x",
            "e.min.js": b"x", "f.txt": b"x", "g.sql": b"", "h.h": b"class A {};", "i.fish": b"eval x", "j.generated.ts": b"x"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.relative_path: r for r in read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py", "src/b.js", "h.h", "i.fish"}
    assert rows["src/a.py"].content == "x = 1\ny = 2\n" and rows["src/b.js"].content == "café"
    assert (rows["h.h"].language, rows["h.h"].detected_language) == ("C", "C++")
    assert rows["i.fish"].language is None and rows["i.fish"].detected_language == "Bash"
    reviewed = review(read_files(spark, str(tmp_path)))
    assert {r.relative_path: r.error is None for r in reviewed.collect()} == {
        "src/a.py": True, "src/b.js": True, "h.h": True, "i.fish": False}


def test_only_selected_files_are_opened(spark, tmp_path):
    """300 files in excluded and hidden directories, and unsupported ones, are not opened, nor those directories listed."""
    for n in range(100):
        for name in (f"a/b{n % 7}/{n}.py", f"a/node_modules/{n}.py", f".git/x/{n}.py", f"build/{n}.js", f"a/{n}.txt"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(b"x = 1\r\n" if n else b"")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    opened, listed = spark.sparkContext.accumulator(0), []

    def listing(uri):
        listed.append(uri)
        return tree.entries(uri)

    assert read_files(spark, str(tmp_path), opened=opened).count() == 99 and opened.value == 99
    assert len(list(tree.walk(str(tmp_path), listing))) == 200
    assert len(listed) == 9 and not any(x in u for u in listed for x in ("node_modules", ".git", "build", "loop"))
    for fanout in (1, 3, 1000):  # partitions that walk on, and files that the driver met
        assert tree.list_tree(spark, str(tmp_path), fanout).count() == 200
    assert {r.size for r in skipped_files(spark, str(tmp_path), 3).collect()} == {7}


def test_empty_tree(spark, tmp_path):
    assert read_files(spark, str(tmp_path)).count() == 0


def test_language_detection(spark):
    cases = [("a.PY", "", "Python"), ("run", "#!/usr/bin/env python3\n", "Python"), ("p", "<?php echo 1;", "PHP"),
             ("x.h", "#include <iostream>", "C++"), ("x.h", "int f(void);", "C"), ("q", "plain words", None),
             (".bashrc", "#!/bin/bash", "Bash"), ("d", "\n  {", "JSON")]
    df = spark.createDataFrame([(p, c) for p, c, _ in cases], "path string, content string")
    got = [r.l for r in df.select(files.detect_language(F.col("path"), F.col("content")).alias("l")).collect()]
    assert got == [l for _, _, l in cases]


def test_exports(spark, done):
    root = shared_folder(spark, "test")
    exports.write_csv(exports.csv_rows(done), f"{root}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{root}/csv")
    assert tuple(back.columns) == exports.CSV_COLUMNS and back.count() == issues(done).count()
    exports.write_json(exports.json_records(done), f"{root}/json")
    assert spark.read.json(f"{root}/json").where("record = 'file'").count() == done.count()
    listed = exports.list_reports(spark, f"{root}/csv").collect()
    assert listed and all(r.format in ("csv", "crc", "") for r in listed)


def test_models_round_trip(spark, done):
    rows = training_rows(spark, TESTDATA)
    models, predictions = ml.train(rows, ["bug_detector", "quality_scorer", "severity_classifier"], trees=5, rounds=3)
    scores = {(r.model, r.metric): r.value for r in ml.evaluation(predictions).collect()}
    assert scores["bug_detector", "accuracy"] > 0.7 and scores["severity_classifier", "accuracy"] > 0.8
    path = shared_folder(spark, "models")
    models.save(path, spark)
    again = ml.Scorers.load(path, spark)
    assert again.available == {"bug_probability", "quality_score", "predicted_severity"}
    a = models.predict(done).select("path", "model_bug_probability", "model_quality_score").orderBy("path").collect()
    b = again.predict(done).select("path", "model_bug_probability", "model_quality_score").orderBy("path").collect()
    assert a == b and all(0 <= r.model_bug_probability <= 1 and 0 <= r.model_quality_score <= 100 for r in a)
    mixed = scoring.with_fallback(again.predict(done.drop(*scoring.ML_SCORES)), again.available)
    assert mixed.where("readability_score IS NULL OR quality_score IS NULL").count() == 0


def test_rehydrate_ignores_bad_json(spark):
    df = spark.createDataFrame([(1, 5.0, '{"overall": 7.5, "extra": "x"}'), (2, 5.0, "{oops")], "id int, overall double, j string")
    got = {r.id: (r.overall, r.extra) for r in history.rehydrate(df, "j", "overall double, extra string").collect()}
    assert got == {1: (7.5, "x"), 2: (5.0, None)}


def test_report_sections(done):
    rows = exports.report_sections(done, issues(done), "pdf")
    assert {r.section for r in rows.select("section").distinct().collect()} == {"scores", "issues", "languages", "top_issues"}


def test_rule_texts_are_one_expression(spark, monkeypatch):
    """Built as columns, the texts of all rules are thousands of calls to the JVM for each use."""
    from dataclasses import replace

    from reviewlake.operators import rules
    from reviewlake.packs.rules import JSON, builtin_packs

    odd = replace(JSON[0], title="it's \\ \"quoted\"\n\\n {n}", suggestion="", reason="50 % é '")
    packs = builtin_packs() | {"JSON": (odd,)}
    calls = []
    lit = rules.F.lit
    monkeypatch.setattr(rules.F, "lit", lambda x: calls.append(x) or lit(x))
    texts = rules.rule_texts(packs, rules.F.col("n"))
    assert len(calls) < 10
    entries = rules.catalogue(packs)
    got = {r.n: r.t for r in spark.range(1, len(entries) + 2).selectExpr("CAST(id AS INT) AS n").select("n", texts.alias("t")).collect()}
    for _, n, r in entries:
        assert tuple(got[n]) == (r.rule_id, r.phase, r.title, r.description, r.suggestion, r.reason)
    assert got[len(entries) + 1] is None


def test_json_records_are_written_once_and_apart(spark, done):
    path = f"{shared_folder(spark, 'test')}/json"
    records = exports.json_records(done)
    exports.write_json(records, path)
    back = spark.read.json(path)
    assert sorted(map(tuple, back.select("project_id", "record", "value").where("record = 'file'").collect())) == sorted(
        map(tuple, records.select("project_id", "record", "value").where("record = 'file'").collect()))
    assert back.where("record = 'project'").count() == done.select("project_id").distinct().count()
    with pytest.raises(FileExistsError):
        exports.write_json(records, path)
