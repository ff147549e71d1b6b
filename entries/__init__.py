"""Registered queries, one per operator, with their DuckDB statements."""

from entries import files, history, learning, lines, matching, output, rollups, scores, streams

MODULES = (files, lines, matching, scores, rollups, history, output, learning, streams)

QUERIES = {name: run for m in MODULES for name, (run, _) in m.ENTRIES.items()}
ORACLE = {name: sql for m in MODULES for name, (_, sql) in m.ENTRIES.items() if sql}
