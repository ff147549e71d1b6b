"""Operators over files, lines, findings, scores and scan history."""
