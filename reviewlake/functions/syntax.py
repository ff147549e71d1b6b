"""Syntax reports for Python, JSON and CSS files.

The one place where built-in functions cannot express the semantics: a syntax
tree, or repeated text of unknown form.  A scalar pandas UDF keeps the plan narrow (no join back, no shuffle),
and the caller passes null for every other language so only the files that
need a parser cross into Python.
"""

from __future__ import annotations

import ast
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from reviewlake.packs.metric_patterns import SYNTAX_FEATURES

# Ship these helpers with each task: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("sub", T.IntegerType()),
    T.StructField("detail", T.StringType()),
])
REPORT = T.StructType(
    [T.StructField("has_tree", T.BooleanType()),
     T.StructField("parse_errors", T.ArrayType(T.StringType())),
     T.StructField("findings", T.ArrayType(FINDING)),
     T.StructField("failure", T.StringType()),
     T.StructField("css_repeats", T.DoubleType())]
    + [T.StructField(name, T.DoubleType()) for name in SYNTAX_FEATURES]
)

# --- Fixed values -----------------------------------------------------------
ORDINARY_NUMBERS = (0, 1, -1, 2, 100)
SHORT_NAMES = frozenset("ijkxynefv_")
NETWORK_ATTRIBUTES = ("get", "post", "request", "urlopen")
FILE_ATTRIBUTES = ("open", "read", "write")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Beyond these a Python function is long, a parameter list or class large, a file full of magic numbers."""

    function_lines: int = 50
    parameters: int = 7
    methods: int = 20
    numbers: int = 5


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.While)
_EMPTY = dict.fromkeys((*SYNTAX_FEATURES, "css_repeats"), 0.0)


def _is_magic(node: ast.AST) -> bool:
    return (isinstance(node, ast.Constant) and isinstance(node.value, (int, float))
            and node.value not in ORDINARY_NUMBERS)


def _subtree_facts(tree: ast.AST, order: list[ast.AST]) -> dict[int, tuple[int, int]]:
    """Per node: (functions in the subtree, deepest loop nesting below it)."""
    facts: dict[int, tuple[int, int]] = {}
    for node in reversed(order):  # children come after parents in ``order``
        n_functions = int(isinstance(node, _FUNCTIONS))
        depth = 0
        for child in ast.iter_child_nodes(node):
            child_functions, child_depth = facts[id(child)]
            n_functions += child_functions
            depth = max(depth, child_depth + isinstance(child, _LOOPS))
        # Operator and context nodes are shared between places in the tree;
        # they carry no functions or loops, so their facts are always (0, 0).
        facts[id(node)] = (n_functions, depth)
    return facts


def python_report(content: str, limits: Limits = Limits()) -> dict:
    """Features and findings of one Python file."""
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        return _unparsed(f"SyntaxError at line {e.lineno}: {e.msg}")
    except Exception as e:  # e.g. null bytes, nesting beyond the parser's limit
        return _unparsed(f"Parse error: {e}")

    order = list(ast.walk(tree))
    facts = _subtree_facts(tree, order)
    kinds = Counter(type(n) for n in order)
    functions = [n for n in order if isinstance(n, _FUNCTIONS)]
    classes = [n for n in order if isinstance(n, ast.ClassDef)]
    calls = [n for n in order if isinstance(n, ast.Call)]
    assigns = [n for n in order if isinstance(n, ast.Assign)]
    names = [n.id for n in order if isinstance(n, ast.Name)]
    attributes = Counter(c.func.attr for c in calls if isinstance(c.func, ast.Attribute))
    lengths = [f.end_lineno - f.lineno + 1 for f in functions]
    parameters = [len(f.args.args) + len(f.args.posonlyargs) for f in functions]
    depths = [facts[id(f)][1] for f in functions]
    methods = [facts[id(c)][0] for c in classes]

    def calls_itself(f) -> bool:
        return any(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == f.name
                   for n in ast.walk(f))

    features = {
        "function_count": len(functions),
        "class_count": len(classes),
        "method_count": sum(methods),
        "import_count": kinds[ast.ImportFrom] + sum(len(n.names) for n in order if isinstance(n, ast.Import)),
        "global_variables": sum(len(n.names) for n in order if isinstance(n, ast.Global)),
        "constants": sum(isinstance(t, ast.Name) and t.id.isupper() for a in assigns for t in a.targets),
        "parameter_count": sum(parameters),
        "return_statements": kinds[ast.Return],
        "exception_handling": kinds[ast.Try],
        "loop_count": kinds[ast.For] + kinds[ast.While],
        "nested_loops": sum(d > 1 for d in depths),
        "conditional_count": kinds[ast.If],
        "recursion_count": sum(map(calls_itself, functions)),
        "max_nesting_depth": max(depths, default=0),
        "avg_function_length": sum(lengths) / max(len(lengths), 1),
        "avg_class_size": sum(methods) / max(len(methods), 1),
        "avg_identifier_length": sum(map(len, names)) / max(len(names), 1),
        "naming_violations": sum(len(n) == 1 and n not in SHORT_NAMES for n in names),
        "long_methods": sum(n > limits.function_lines for n in lengths),
        "large_classes": sum(n > limits.methods for n in methods),
        "long_parameter_lists": sum(n > limits.parameters for n in parameters),
        "magic_numbers": sum(_is_magic(n) for a in assigns for n in ast.walk(a)),
        "eval_usage": sum(isinstance(c.func, ast.Name) and c.func.id in ("eval", "exec") for c in calls),
        "file_operations": sum(attributes[a] for a in FILE_ATTRIBUTES),
        "network_operations": sum(attributes[a] for a in NETWORK_ATTRIBUTES),
    }
    findings = list(_python_findings(content, order, functions, lengths, parameters, depths, limits))
    return {"has_tree": True, "parse_errors": [], "failure": None, "css_repeats": 0.0,
            "findings": [dict(rule_id=r, line=line, sub=i, detail=d) for i, (r, line, d) in enumerate(findings)],
            **{k: float(v) for k, v in features.items()}}


def _python_findings(content, order, functions, lengths, parameters, depths, limits):
    """Yield (rule_id, line, description) for the tree rules."""
    for f, length, n_parameters, depth in zip(functions, lengths, parameters, depths):
        if length > limits.function_lines:
            yield "PY002", f.lineno, f"Function '{f.name}' is {length} lines long."
        if n_parameters > limits.parameters:
            yield "PY003", f.lineno, f"Function '{f.name}' has {n_parameters} parameters."
        if depth >= 3:
            yield "PYP001", f.lineno, (f"Function '{f.name}' has loops nested {depth} levels deep "
                                       f"(O(n^{depth}) complexity).")
        elif depth == 2:
            yield "PYP002", f.lineno, f"Function '{f.name}' has nested loops (O(n²) complexity)."

    n_magic = 0
    for node in order:
        n_magic += _is_magic(node)
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            if ast.get_docstring(node, clean=False) is None and not node.name.startswith("_"):
                yield "PY004", node.lineno, f"'{node.name}' has no docstring."
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            yield "PY007", node.lineno, None
        elif isinstance(node, ast.Import):
            for alias in node.names:
                bound = alias.asname or alias.name.partition(".")[0]
                if content.count(bound) <= 1:
                    yield "PY008", node.lineno, f"Import '{alias.name}' may be unused."
    if n_magic > limits.numbers:
        yield "PY005", 1, f"Found {n_magic} magic numbers in the code."


def _unparsed(message: str) -> dict:
    return {"has_tree": False, "parse_errors": [message], "failure": None,
            "findings": [dict(rule_id="PY001", line=1, sub=0, detail=message)], **_EMPTY}


def json_report(content: str) -> dict:
    """Validity of one JSON file (line comments are removed first)."""
    report = {"has_tree": True, "parse_errors": [], "findings": [], "failure": None, **_EMPTY}
    try:
        json.loads(re.sub(r"//[^\n]*", "", content))
    except json.JSONDecodeError as e:
        message = f"JSON parse error at line {e.lineno}: {e.msg}"
        report.update(has_tree=False, parse_errors=[message],
                      findings=[dict(rule_id="JSON001", line=1, sub=0, detail=message)])
    except Exception as e:  # nesting or number size beyond the parser's limits
        report.update(has_tree=False, failure=str(e))
    return report


_FACTOR = 0x5851F42D4C957F2D
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(factor: int, n: int) -> np.ndarray:
    """The powers 0 to n, in 64 bits."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, factor, np.uint64))))


def css_report(content: str) -> dict:
    """Repeated CSS declarations: matches of ``name: value;`` up to its last repetition.

    A declaration reaches from some letter of a property name to the next ``;``,
    so it is a suffix of one ``;``-separated piece and repeats where a later
    piece ends the same way.  One hash per such suffix finds the last piece that
    has it, in memory proportional to the file.  Whole files are hashed at once: a
    suffix's hash is a difference of two running sums, taken back to its piece's end.
    """
    text = content[:content.rfind(";") + 1]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, ends = len(codes), np.flatnonzero(codes == ord(";"))
    named = ((codes >= ord("a")) & (codes <= ord("z"))) | (codes == ord("-"))
    last = np.flatnonzero(named[:-1] & ~named[1:])  # of each run of letters; the text ends in ;
    is_name = (codes[last + 1] == ord(":")) & (codes[np.minimum(last + 2, n - 1)] != ord(";"))
    at = np.flatnonzero(named)
    at = at[is_name[np.searchsorted(last, at)]]
    piece_of = np.searchsorted(ends, at)
    sums = np.cumsum(((codes.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, n)[n - 1::-1][:n])[::-1])[::-1]
    end = ends[piece_of]
    key = (sums[at] - sums[end]) * _powers(_INVERSE, n)[n - end]
    order = np.argsort(key, kind="stable")  # pieces ascend already
    final = np.zeros(len(key), np.int64)
    if len(key):
        differs = np.diff(key[order]) != 0
        final[order] = piece_of[order][np.flatnonzero(np.concatenate((differs, [True])))[np.cumsum(np.concatenate(([0], differs)))]]
    again = np.flatnonzero(final > piece_of)
    pieces, first = np.unique(piece_of[again], return_index=True)
    pieces, final = pieces.tolist(), final[again[first]].tolist()
    repeats, i = 0, 0
    while (k := bisect_left(pieces, i)) < len(pieces):
        repeats, i = repeats + 1, final[k] + 1
    return {"has_tree": True, "parse_errors": [], "findings": [], "failure": None, **_EMPTY,
            "css_repeats": float(repeats)}


_PARSERS = {"Python": python_report, "JSON": json_report, "CSS": css_report}
_COLUMNS = REPORT.fieldNames()


@lru_cache
def _reports(limits: Limits):
    """The Arrow function for some limits."""
    @F.pandas_udf(REPORT)
    def reports(language: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for lang, text in zip(language, content):
            parser = _PARSERS.get(lang)
            if parser is None or text is None:
                rows.append({"has_tree": True, "parse_errors": [], "findings": [], "failure": None, **_EMPTY})
                continue
            try:
                rows.append(parser(text, limits) if lang == "Python" else parser(text))
            except Exception as e:
                rows.append({"has_tree": False, "parse_errors": [], "findings": [], "failure": str(e), **_EMPTY})
        return pd.DataFrame(rows, columns=_COLUMNS)

    return reports


def syntax_report(language: Column, content: Column, limits: Limits = Limits()) -> Column:
    """Struct of syntax features and findings; empty for other languages."""
    return _reports(limits)(language, F.when(language.isin(*_PARSERS), content))
