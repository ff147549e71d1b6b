"""Readers of source files and corpora derived from tables."""
