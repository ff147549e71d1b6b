"""Corpora derived from plain tables (documents, pages, events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.functions.text import unify_newlines

# --- Fixed values -----------------------------------------------------------
# One short program per language; a table document is appended as its tail.
# (language, file extension, program text)
PROGRAMS: tuple[tuple[str, str, str], ...] = (
    ("Python", ".py", """import os
def load(path, cfg):
    # TODO tidy up
    val = eval(path)
    api_key = "abcd1234"
    os.system(path)
    for i in range(len(cfg)):
        rows.append(i)
    return hashlib.md5(val)"""),
    ("JavaScript", ".js", """var total = 10;
function run(el) {
  if (total == 3) { console.log(total); }
  el.innerHTML += eval(total);
  const secret = "abcd1234";
  return JSON.parse(JSON.stringify(el));
}"""),
    ("TypeScript", ".ts", """interface Row { id: number }
// @ts-ignore
export function pick(arg: any): Row {
  var out = arg as any;
  location.href = out;
  return out;
}"""),
    ("Java", ".java", """import java.util.*;
public class Box {
  public void run(String q) {
    try { System.out.println(q); } catch (Exception e) {}
    Runtime.getRuntime().exec(q);
    String password = "abcd1234";
  }
}"""),
    ("C", ".c", """#include <stdio.h>
int main(void) {
  char b[16];
  gets(b);
  strcpy(b, b);
  goto end;
end: return 0;
}"""),
    ("C++", ".cpp", """#include <vector>
using namespace std;
int main() {
  int* p = new int[4];
  v.push_back(*p);
  system("ls");
  return 0;
}"""),
    ("C#", ".cs", """using System;
class App {
  void Run() {
    try { Console.WriteLine("x"); } catch (Exception e) {}
    var h = MD5.Create();
    string s = ""; s += "string";
  }
}"""),
    ("PHP", ".php", """<?php
foreach ($ids as $id) {
  $u = $_GET['u'];
  echo $_POST['v'];
  $h = md5($u);
  $r = $db->query($id);
}"""),
    ("HTML", ".html", """<html>
<body>
<img src="a.png">
<a href="javascript:go()">x</a>
<script>go()</script>
<!-- password: abcd -->
</body>
</html>"""),
    ("CSS", ".css", """* { margin: 0 }
#top { color: red !important; }
.box { width: 12px; }
.bg { background: url("data:x"); }"""),
    ("SQL", ".sql", """-- TODO tidy
SELECT * FROM t WITH (NOLOCK);
GRANT ALL ON t TO u;
SELECT a FROM t WHERE a NOT IN (SELECT b FROM s);"""),
    ("Bash", ".sh", """#!/bin/bash
if [ $a == b ]; then eval $cmd; fi
chmod 777 run.sh
cat f.txt | grep x
echo $@"""),
    ("JSON", ".json", """{
  "password": "abcd1234",
  "private_key": "x",
  "port": 8080
}"""),
)

# Python and JSON files that need a parser; two of them are broken.
SYNTAX_PROGRAMS: tuple[tuple[str, str, str], ...] = (
    ("Python", ".py", '''class Shape:
    SIDES = 4
    def area(self, w, h):
        """Area."""
        return w * h
    def scale(self, f):
        try:
            return f * 7
        except:
            return 0'''),
    ("Python", ".py", '''def broken(:
    pass'''),
    ("Python", ".py", '''import json
import os.path as osp
from sys import argv, path
def walk(rows):
    """Walk."""
    total = 12
    for row in rows:
        for cell in row:
            while cell > 3:
                cell = cell - 1
    if total == 5:
        walk(rows)
    open(osp)
    return eval(argv)'''),
    ("Python", ".py", '''import requests
LIMIT = 9
def fetch(a, b, c, d, e, f, g, h):
    """Fetch."""
    global STATE
    STATE = requests.get(a)
    f.write(b)
    for i in range(3):
        for j in range(c):
            print(i, j)
    return STATE'''),
    ("JSON", ".json", '''{"a": [1, 2]}'''),
    ("JSON", ".json", '''{"a": }'''),
)

# Path shapes for corpora that exercise file selection: (directory, name prefix, suffix).
PATH_SHAPES: tuple[tuple[str, str, str], ...] = (
    ("src", "mod", ".py"),
    ("node_modules/lib", "index", ".js"),
    ("web/.cache", "page", ".html"),
    ("web", "app", ".min.js"),
    ("include", "head", ".h"),
    ("docs", "notes", ".txt"),
    ("build", "out", ".cpp"),
    ("scripts", "run", ".SH"),
    ("", "package-lock", ".json"),
    ("shell", "prompt", ".fish"),
    ("api", "types.generated", ".ts"),
)
# ----------------------------------------------------------------------------


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stream_path(folder: str, table: str) -> str:
    """Address of a table for a stream, whether it is one file or a folder of part files.

    A file stream takes a plain address as a folder; one with a glob is resolved to what is there.
    """
    return f"{folder}/[{table[0]}]{table[1:]}.parquet"


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def program_corpus(documents: DataFrame) -> DataFrame:
    """Documents as source files of 13 languages.

    The language follows the document number; a file is that language's program
    followed by the document's text (commented out in Python, left out in JSON).
    """
    index = F.pmod(F.col("doc_id"), F.lit(len(PROGRAMS)))
    text = unify_newlines(F.col("text"))
    commented = F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))
    tail = (F.when(index == 0, F.concat(F.lit("\n"), commented)).when(index == len(PROGRAMS) - 1, F.lit(""))
            .otherwise(F.concat(F.lit("\n"), text)))
    content = F.concat(_pick(index, [p[2] for p in PROGRAMS]), tail)
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), _pick(index, [p[1] for p in PROGRAMS]))
    return documents.select(F.col("source").alias("project_id"), path.alias("path"),
                            _pick(index, [p[0] for p in PROGRAMS]).alias("language"),
                            content.alias("content"))


def syntax_corpus(documents: DataFrame) -> DataFrame:
    """Documents as the comments of Python and JSON files, one of six programs by document number."""
    index = F.pmod(F.col("doc_id"), F.lit(len(SYNTAX_PROGRAMS)))
    mark = F.when(_pick(index, [p[0] for p in SYNTAX_PROGRAMS]) == "JSON", F.lit("// ")).otherwise(F.lit("# "))
    comment = F.concat(F.lit("\n"), mark, F.replace(unify_newlines(F.col("text")), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    return documents.select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("syn/"), F.col("doc_id").cast("string"), _pick(index, [p[1] for p in SYNTAX_PROGRAMS])).alias("path"),
        _pick(index, [p[0] for p in SYNTAX_PROGRAMS]).alias("language"),
        F.concat(_pick(index, [p[2] for p in SYNTAX_PROGRAMS]), comment).alias("content"))


def page_corpus(pages: DataFrame) -> DataFrame:
    """Web pages as HTML files, twenty projects."""
    return pages.select(
        F.concat(F.lit("site"), F.pmod("page_id", F.lit(20)).cast("string")).alias("project_id"),
        F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit("HTML").alias("language"), unify_newlines(F.col("html")).alias("content"))


def event_corpus(events: DataFrame) -> DataFrame:
    """Event properties as JSON files, one project per user."""
    return events.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("project_id"),
        F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        F.lit("JSON").alias("language"), unify_newlines(F.col("props")).alias("content"))


def path_corpus(documents: DataFrame) -> DataFrame:
    """File records whose paths cover kept and skipped directories and names."""
    index = F.pmod(F.col("doc_id"), F.lit(len(PATH_SHAPES)))
    directory = _pick(index, [p[0] for p in PATH_SHAPES])
    number = F.when(_pick(index, [p[1] for p in PATH_SHAPES]) == "package-lock", F.lit("")).otherwise(
        F.col("doc_id").cast("string"))
    name = F.concat(F.regexp_replace(_pick(index, [p[1] for p in PATH_SHAPES]), r"^([a-z]+)", F.concat(F.lit("$1"), number)),
                    _pick(index, [p[2] for p in PATH_SHAPES]))
    relative = F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))
    return documents.select(F.col("doc_id"), F.col("source").alias("project_id"), relative.alias("relative_path"),
                            F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), relative).alias("path"),
                            F.when(F.pmod("doc_id", F.lit(97)) == 0, F.lit(0)).otherwise(F.col("n_chars")).alias("size"),
                            unify_newlines(F.col("text")).alias("content"), F.col("text"))


def scan_history(events: DataFrame) -> DataFrame:
    """Events as scans: one analysis row per event, one project per user."""
    value = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0))
    return events.select(
        F.col("event_id").alias("analysis_id"), F.col("user_id").alias("project_id"), F.col("ts").alias("created_at"),
        (F.col("value") / 10).alias("duration_seconds"), value.alias("overall_score"),
        (F.pmod("event_id", F.lit(40)) + 1).alias("total_files"),
        F.pmod("event_id", F.lit(17)).alias("total_issues"), F.pmod("event_id", F.lit(3)).alias("critical_issues"))


def projects(events: DataFrame) -> DataFrame:
    """Projects of the scan history; those without an error event were never analysed."""
    return events.groupBy(F.col("user_id").alias("project_id")).agg(
        F.min("ts").alias("created_at"),
        F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_analyzed")).select(
        "project_id", F.concat(F.lit("user"), F.col("project_id").cast("string")).alias("name"),
        F.concat(F.lit("/data/user"), F.col("project_id").cast("string")).alias("path"),
        F.lit("").alias("description"), "created_at", "last_analyzed")
