"""Metric patterns per language: what each count metric counts.

A value is the number of non-overlapping matches in the whole content.
``operators`` and ``operands`` feed the Halstead metrics.
"""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------
# (language, metric, flags, pattern); flags: i ignore case, m multiline, s dot-all.
METRIC_PATTERNS: tuple[tuple[str, str, str, str], ...] = (
    ("Python", "todo_count", "i", r"#.*\bTODO\b"),
    ("Python", "fixme_count", "i", r"#.*\bFIXME\b"),
    ("Python", "operators", "", r"[\+\-\*\/\%\=\<\>\!\&\|\^~]+"),
    ("Python", "operands", "", r"\b\w+\b"),
    ("Python", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b"),
    ("Python", "shell_executions", "", r"\b(os\.system|subprocess\.|popen|shell=True)\b"),
    ("JavaScript", "function_count", "", r"\b(function\s+\w+|const\s+\w+\s*=\s*\(|=>\s*\{|\bfunction\s*\()"),
    ("JavaScript", "class_count", "", r"\bclass\s+\w+"),
    ("JavaScript", "import_count", "", r"\b(import|require)\s*[\(\{]"),
    ("JavaScript", "loop_count", "", r"\b(for|while|do)\s*\("),
    ("JavaScript", "nested_loops", "s", r"\bfor\s*\([^)]*\)\s*\{[^}]*\bfor\b"),
    ("JavaScript", "conditional_count", "", r"\b(if|else if|switch)\s*\("),
    ("JavaScript", "exception_handling", "", r"\btry\s*\{"),
    ("JavaScript", "eval_usage", "", r"\beval\s*\("),
    ("JavaScript", "todo_count", "i", r"//.*\bTODO\b"),
    ("JavaScript", "fixme_count", "i", r"//.*\bFIXME\b"),
    ("JavaScript", "magic_numbers", "", r"\b(?<!\.)\d{2,}\b"),
    ("JavaScript", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE)\b"),
    ("JavaScript", "shell_executions", "", r"\b(exec|spawn|execSync|spawnSync)\s*\("),
    ("JavaScript", "network_operations", "", r"\b(fetch|axios|XMLHttpRequest|http\.get)\b"),
    ("JavaScript", "file_operations", "", r"\bfs\.(read|write|append|unlink)\b"),
    ("JavaScript", "operators", "", r"[\+\-\*\/\%\=\<\>\!\&\|\^]+"),
    ("JavaScript", "operands", "", r"\b[a-zA-Z_]\w*\b"),
    ("TypeScript", "extra_types", "", r"\b(interface|type)\s+\w+"),
    ("TypeScript", "naming_violations", "", r":\s*any\b"),
    ("Java", "class_count", "", r"\b(class|interface|enum)\s+\w+"),
    ("Java", "function_count", "", r"\b(public|private|protected|static)\s+\w+[\w<>\[\],\s]+\w+\s*\("),
    ("Java", "import_count", "m", r"^\s*import\s+"),
    ("Java", "loop_count", "", r"\b(for|while|do)\s*[\(\{]"),
    ("Java", "nested_loops", "s", r"\bfor\s*\([^)]*\)\s*\{[^}]*\bfor\b"),
    ("Java", "conditional_count", "", r"\b(if|else if|switch)\s*\("),
    ("Java", "exception_handling", "", r"\btry\s*\{"),
    ("Java", "todo_count", "i", r"//.*\bTODO\b"),
    ("Java", "fixme_count", "i", r"//.*\bFIXME\b"),
    ("Java", "magic_numbers", "", r"\b(?<!\.)(?!0x)\d{2,}\b"),
    ("Java", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE)\b"),
    ("Java", "operators", "", r"[\+\-\*\/\%\=\<\>\!\&\|\^]+"),
    ("Java", "operands", "", r"\b[a-zA-Z_]\w*\b"),
    ("C", "function_count", "m", r"^\w[\w\s\*]+\s+\w+\s*\([^)]*\)\s*\{"),
    ("C", "import_count", "m", r'^\s*#include\s*[<"]'),
    ("C", "global_variables", "m", r"^(int|char|float|double|long|short)\s+\w+\s*[=;]"),
    ("C", "loop_count", "", r"\b(for|while|do)\s*\("),
    ("C", "nested_loops", "s", r"\bfor\s*\([^)]*\)\s*\{[^}]*\bfor\b"),
    ("C", "conditional_count", "", r"\b(if|else if|switch)\s*\("),
    ("C", "todo_count", "i", r"//.*\bTODO\b"),
    ("C", "fixme_count", "i", r"//.*\bFIXME\b"),
    ("C", "magic_numbers", "", r"\b(?<!\.)(?!0x)\d{2,}\b"),
    ("C", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE)\b"),
    ("C", "shell_executions", "", r"\b(system|popen)\s*\("),
    ("C", "operators", "", r"[\+\-\*\/\%\=\<\>\!\&\|\^]+"),
    ("C", "operands", "", r"\b[a-zA-Z_]\w*\b"),
    ("C++", "class_count", "", r"\bclass\s+\w+"),
    ("C++", "exception_handling", "", r"\btry\s*\{"),
    ("C++", "template_count", "", r"\btemplate\s*<"),
    ("C#", "class_count", "", r"\b(class|interface|struct|enum)\s+\w+"),
    ("C#", "function_count", "", r"\b(public|private|protected|internal|static)\s+[\w<>\[\]]+\s+\w+\s*\("),
    ("C#", "import_count", "m", r"^\s*using\s+[\w.]+\s*;"),
    ("C#", "loop_count", "", r"\b(for|foreach|while|do)\s*[\(\{]"),
    ("C#", "conditional_count", "", r"\b(if|else if|switch)\s*\("),
    ("C#", "exception_handling", "", r"\btry\s*\{"),
    ("C#", "todo_count", "i", r"//.*\bTODO\b"),
    ("C#", "fixme_count", "i", r"//.*\bFIXME\b"),
    ("C#", "magic_numbers", "", r"\b(?<!\.)(?!0x)\d{2,}\b"),
    ("C#", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE)\b"),
    ("C#", "operators", "", r"[\+\-\*\/\%\=\<\>\!\&\|\^]+"),
    ("C#", "operands", "", r"\b[a-zA-Z_]\w*\b"),
    ("PHP", "function_count", "", r"\bfunction\s+\w+\s*\("),
    ("PHP", "class_count", "", r"\b(class|interface|trait)\s+\w+"),
    ("PHP", "import_count", "", r"\b(require|include|use)\s+"),
    ("PHP", "loop_count", "", r"\b(for|foreach|while|do)\s*[\(\{]"),
    ("PHP", "conditional_count", "", r"\b(if|elseif|switch)\s*\("),
    ("PHP", "exception_handling", "", r"\btry\s*\{"),
    ("PHP", "eval_usage", "", r"\beval\s*\("),
    ("PHP", "todo_count", "i", r"//.*\bTODO\b"),
    ("PHP", "fixme_count", "i", r"//.*\bFIXME\b"),
    ("PHP", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE)\b"),
    ("PHP", "shell_executions", "", r"\b(exec|system|shell_exec|passthru|popen)\s*\("),
    ("PHP", "operators", "", r"[\+\-\*\/\%\=\<\>\!\&\|\^\.]+"),
    ("PHP", "operands", "", r"\b[a-zA-Z_]\w*\b"),
    ("HTML", "function_count", "i", r"<script\b"),
    ("HTML", "import_count", "i", r"<(script|link)\b"),
    ("HTML", "todo_count", "i", r"<!--.*\bTODO\b"),
    ("HTML", "fixme_count", "i", r"<!--.*\bFIXME\b"),
    ("HTML", "eval_usage", "", r"\beval\s*\("),
    ("CSS", "class_count", "", r"\.[a-zA-Z][\w-]+\s*\{"),
    ("CSS", "todo_count", "i", r"/\*.*\bTODO\b"),
    ("CSS", "magic_numbers", "", r":\s*\d+px"),
    ("CSS", "duplicate_lines", "s", r"([a-z-]+:\s*[^;]+;).*\1"),
    ("SQL", "function_count", "i", r"\bCREATE\s+(OR REPLACE\s+)?FUNCTION\b"),
    ("SQL", "class_count", "i", r"\bCREATE\s+TABLE\b"),
    ("SQL", "sql_queries", "i", r"\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b"),
    ("SQL", "conditional_count", "i", r"\bCASE\s+WHEN\b"),
    ("SQL", "loop_count", "i", r"\bLOOP\b|\bWHILE\b"),
    ("SQL", "todo_count", "i", r"--.*\bTODO\b"),
    ("Bash", "function_count", "m", r"^\s*\w+\s*\(\s*\)\s*\{"),
    ("Bash", "loop_count", "", r"\b(for|while|until)\s+"),
    ("Bash", "conditional_count", "", r"\bif\s+\["),
    ("Bash", "eval_usage", "", r"\beval\s+"),
    ("Bash", "todo_count", "i", r"#.*\bTODO\b"),
    ("Bash", "fixme_count", "i", r"#.*\bFIXME\b"),
    ("Bash", "shell_executions", "", r"`[^`]+`|\$\("),
    ("JSON", "hardcoded_credentials", "i", r'"(password|secret|api_key|apikey|token)"\s*:\s*"[^"]{4,}"'),
    ("JSON", "magic_numbers", "", r":\s*\d{4,}"),
)

# Maintainability index where it is a constant.
FIXED_MAINTAINABILITY = {"HTML": 50.0, "CSS": 70.0, "SQL": 60.0, "Bash": 60.0, "JSON": 80.0}

# Comment lines: prefixes of a stripped line, and literals counted in the content.
COMMENT_PREFIXES: dict[str, tuple[str, ...]] = {
    "Python": ("#",),
    "JavaScript": ("//",),
    "Java": ("//", "*"),
    "C": ("//", "*", "/*"),
    "C#": ("//",),
    "PHP": ("//", "#", "*"),
    "SQL": ("--",),
    "Bash": ("#",),
}
COMMENT_LITERALS: dict[str, str] = {"JavaScript": "/*", "HTML": "<!--", "CSS": "/*"}

# Duplicate-line counting: prefix of the stripped lines that are left out.
DUPLICATE_SKIP: dict[str, str] = {"Python": "#", "JavaScript": "//", "Java": "//"}

# Feature vector, in order.
FEATURES: tuple[str, ...] = (
    "loc", "sloc", "blank_lines", "comment_lines", "comment_ratio",
    "function_count", "class_count", "method_count", "import_count",
    "global_variables", "constants", "parameter_count", "return_statements",
    "exception_handling", "loop_count", "nested_loops", "conditional_count",
    "recursion_count", "switch_statements",
    "cyclomatic_complexity", "halstead_length", "halstead_volume",
    "halstead_difficulty", "halstead_effort", "maintainability_index",
    "max_nesting_depth", "avg_function_length", "avg_class_size",
    "avg_identifier_length", "naming_violations",
    "duplicate_lines", "duplicate_ratio", "dead_code_lines",
    "todo_count", "fixme_count",
    "long_methods", "large_classes", "long_parameter_lists", "magic_numbers",
    "hardcoded_credentials", "sql_queries", "shell_executions",
    "eval_usage", "file_operations", "network_operations",
    "memory_allocations", "nested_iterations", "redundant_calculations",
    "object_creations", "collection_usage", "expensive_operations",
)
# ----------------------------------------------------------------------------

# Languages that start from another language's metrics.
METRIC_PARENT = {"TypeScript": "JavaScript", "C++": "C"}

# Features the syntax-tree helper supplies for Python.
SYNTAX_FEATURES: tuple[str, ...] = (
    "function_count", "class_count", "method_count", "import_count",
    "global_variables", "constants", "parameter_count", "return_statements",
    "exception_handling", "loop_count", "nested_loops", "conditional_count",
    "recursion_count", "max_nesting_depth", "avg_function_length",
    "avg_class_size", "avg_identifier_length", "naming_violations",
    "long_methods", "large_classes", "long_parameter_lists", "magic_numbers",
    "eval_usage", "file_operations", "network_operations",
)


def lineage(language: str) -> tuple[str, ...]:
    """The language followed by the languages whose metrics it inherits."""
    parent = METRIC_PARENT.get(language)
    return (language,) + ((parent,) if parent else ())


def patterns_for(metric: str) -> dict[str, tuple[str, str]]:
    """Own patterns of one metric: language -> (flags, pattern)."""
    return {lang: (flags, pat) for lang, name, flags, pat in METRIC_PATTERNS if name == metric}
