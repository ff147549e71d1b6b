"""Language and file-selection tables."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------
# File extension -> language.
EXTENSIONS: dict[str, str] = {
    ".py": "Python",
    ".java": "Java",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".mjs": "JavaScript",
    ".cjs": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".mts": "TypeScript",
    ".c": "C",
    ".h": "C",
    ".cpp": "C++",
    ".hpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".hxx": "C++",
    ".cs": "C#",
    ".php": "PHP",
    ".html": "HTML",
    ".htm": "HTML",
    ".xhtml": "HTML",
    ".css": "CSS",
    ".scss": "CSS",
    ".sass": "CSS",
    ".less": "CSS",
    ".sql": "SQL",
    ".sh": "Bash",
    ".bash": "Bash",
    ".zsh": "Bash",
    ".fish": "Bash",
    ".json": "JSON",
    ".jsonc": "JSON",
}

# Extensions known to the detector but reviewed by no language pack.
UNREVIEWED_EXTENSIONS = (".fish",)

# Literals that make a ".h" file C++ (looked for anywhere).
CPP_HEADER_MARKS = (
    "class ",
    "namespace ",
    "template<",
    "#include <iostream>",
    "std::",
    "virtual ",
    "override",
    "nullptr",
)

# Content heuristics, first match wins: (flags, pattern, language).
CONTENT_HINTS: tuple[tuple[str, str, str], ...] = (
    ("im", r"^#!.*python", "Python"),
    ("im", r"^#!.*/bash", "Bash"),
    ("im", r"^#!.*/sh\b", "Bash"),
    ("im", r"^\s*<\?php\b", "PHP"),
    ("i", r"<!DOCTYPE html>", "HTML"),
    ("i", r"<html\b", "HTML"),
    ("m", r"^\s*import java\.", "Java"),
    ("m", r"^\s*package\s+\w+;", "Java"),
    ("m", r"^\s*using System", "C#"),
    ("m", r"^\s*namespace\s+\w+", "C#"),
    ("m", r"^\s*#include\s*<", "C"),
    ("im", r"^\s*SELECT\s+\w+", "SQL"),
    ("im", r"^\s*CREATE TABLE", "SQL"),
    ("m", r"^\s*\{", "JSON"),
)

# Directory names that are never walked (hidden ones are skipped as well).
EXCLUDED_DIRS = (
    "node_modules", ".git", "__pycache__", "venv", ".venv",
    "env", "dist", "build", ".next", "coverage", ".pytest_cache",
    ".mypy_cache", "target", "bin", "obj", ".idea", ".vscode",
    "vendor", "packages", "bower_components",
)

# File-name globs that are never reviewed.
EXCLUDED_GLOBS = (
    "*.min.js", "*.min.css", "*.map", "*.lock",
    "package-lock.json", "yarn.lock", "*.generated.*",
)

FILE_LISTING_ROWS = 200
# ----------------------------------------------------------------------------

LANGUAGES: tuple[str, ...] = tuple(sorted(set(EXTENSIONS.values())))
