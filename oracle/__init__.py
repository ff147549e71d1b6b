"""DuckDB statements that check the Spark queries.

Only the fixed values (patterns, words, thresholds, example programs) are shared
with the package; the computation is written independently as SQL.
"""
