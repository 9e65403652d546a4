"""Features of Python source texts by batches.  Texts are parsed and tokenized, never run."""

from __future__ import annotations

import ast
import difflib
import hashlib
import io
import tokenize
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHECKS = "parses boolean, jit_kernels array<string>, launched array<string>, entry_found boolean, forbidden array<string>, symbols array<string>, reasons array<string>, ok boolean"
VIEW = "lines array<string>, classes array<string>, bodies array<string>, calls array<string>"


class _Bare(ast.NodeTransformer):
    """The same tree without docstrings."""

    def generic_visit(self, node: ast.AST) -> ast.AST:
        super().generic_visit(node)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Module):
            first = node.body[0] if node.body else None
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                node.body = node.body[1:] or [ast.Pass()]
        return node


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def _parsed(code: str | None) -> ast.Module | None:
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def check(code: str | None, entry: str, forbidden: list[str], follow_aliases: bool) -> tuple:
    """What a kernel file holds and what speaks against it.  With `follow_aliases`, imported and assigned names stand for what they name.  A launch counts wherever it stands; whether anything calls that place is not followed."""
    tree = _parsed(code)
    if tree is None:
        return False, [], [], False, [], [], ["syntax"], False
    alias: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            base = f"{node.module}." if isinstance(node, ast.ImportFrom) and node.module else ""
            for n in node.names:
                if n.asname or base:
                    alias[n.asname or n.name] = base + n.name
        elif follow_aliases and isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and (named := _dotted(node.value)):
            alias[node.targets[0].id] = named

    def name_of(node: ast.AST) -> str:
        dotted = _dotted(node) or ""
        head, _, rest = dotted.partition(".")
        if follow_aliases and head in alias:
            dotted = alias[head] + ("." + rest if rest else "")
        return dotted

    kernels = sorted({f.name for f in ast.walk(tree) if isinstance(f, ast.FunctionDef) and any(name_of(d.func if isinstance(d, ast.Call) else d).endswith("triton.jit") for d in f.decorator_list)})
    launched, symbols, found = set(), set(), set()
    entries = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef | ast.FunctionDef)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Subscript) and name_of(node.func.value) in kernels:
                launched.add(name_of(node.func.value))
            called = name_of(node.func)
            found |= {f for f in forbidden if called == f or called.startswith(f + ".")}
        if isinstance(node, ast.Attribute) and (dotted := _dotted(node)) and dotted.startswith("tl."):
            symbols.add(dotted)
    symbols = {s for s in symbols if not any(o.startswith(s + ".") for o in symbols)}
    reasons = [r for r, bad in (("no kernel", not kernels), ("not launched", bool(kernels) and not launched), ("no entry", entry not in entries), ("forbidden call", bool(found))) if bad]
    return True, kernels, sorted(launched), entry in entries, sorted(found), sorted(symbols), reasons, not reasons


def _told(codes: pd.Series, one: Callable[[str | None], tuple], names: list[str]) -> pd.DataFrame:
    """What `one` tells of each text; texts that are equal within a batch are looked at once."""
    seen: dict[str | None, tuple] = {}
    return pd.DataFrame([seen[c] if c in seen else seen.setdefault(c, one(c)) for c in codes], columns=names)


def parses(code: Column) -> Column:
    """Whether a text is Python; nothing else of it is looked at."""

    def run(codes: pd.Series) -> pd.Series:
        return _told(codes, lambda c: (_parsed(c) is not None,), ["parses"])["parses"].astype(bool)

    return F.pandas_udf(run, "boolean")(code)


def static_check(code: Column, entry: str, forbidden: list[str], follow_aliases: bool = False) -> Column:
    names = [f.split()[0] for f in CHECKS.split(", ")]

    def run(codes: pd.Series) -> pd.DataFrame:
        return _told(codes, lambda c: check(c, entry, forbidden, follow_aliases), names)

    return F.pandas_udf(run, CHECKS)(code)


def view(code: str | None) -> tuple:
    """Lines without comments and white space, dumps of classes and function bodies without docstrings, and calls in order."""
    lines = [s for raw in (code or "").splitlines() if (s := " ".join(raw.split("#")[0].split()))]
    tree = _parsed(code)
    if tree is None:
        return lines, [], [], []
    bare = _Bare().visit(tree)
    classes = sorted(ast.dump(n) for n in ast.walk(bare) if isinstance(n, ast.ClassDef))
    bodies = sorted(ast.dump(ast.Module(n.body, [])) for n in ast.walk(bare) if isinstance(n, ast.FunctionDef))
    calls = [d for n in ast.walk(bare) if isinstance(n, ast.Call) and (d := _dotted(n.func))]
    return lines, classes, bodies, calls


def normal_view(code: Column) -> Column:
    def run(codes: pd.Series) -> pd.DataFrame:
        return _told(codes, view, ["lines", "classes", "bodies", "calls"])

    return F.pandas_udf(run, VIEW)(code)


def rename(code: str | None, names: dict[str, str]) -> str | None:
    """Whole names only, not after a dot, not in strings or comments; a text that doesn't tokenize stays as it is."""
    if code is None:
        return None
    lines, edits, before = code.splitlines(keepends=True), [], ""
    try:
        for token in tokenize.generate_tokens(io.StringIO(code).readline):
            if token.type == tokenize.NAME and token.string in names and before != ".":
                edits.append((token.start, token.end, names[token.string]))
            before = token.string
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return code
    for (row, a), (_, b), new in reversed(edits):
        lines[row - 1] = lines[row - 1][:a] + new + lines[row - 1][b:]
    return "".join(lines)


def renamed(code: Column, names: dict[str, str]) -> Column:
    def run(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: rename(c, names))

    return F.pandas_udf(run, "string")(code)


def likeness(a: Column, b: Column) -> Column:
    """`ratio` of the lines in matching blocks, and the lines that a diff adds and removes."""

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right, strict=True):
            old, new = (x or "").split("\n"), (y or "").split("\n")
            diff = list(difflib.unified_diff(old, new, lineterm="", n=0))[2:]
            rows.append((difflib.SequenceMatcher(None, old, new, autojunk=False).ratio(), [d for d in diff if d[:1] in "+-"]))
        return pd.DataFrame(rows, columns=["ratio", "diff"])

    return F.pandas_udf(run, "ratio double, diff array<string>")(a, b)


FEATURES = "parses boolean, ast_key string, kernels array<string>, launched array<string>, functions array<string>"


def features(code: Column) -> Column:
    """A struct of FEATURES: a key of the syntax tree without docstrings, and the functions, kernels and launches."""

    def one(text: str | None) -> tuple:
        tree = _parsed(text)
        if tree is None:
            return False, None, [], [], []
        _, kernels, launched, *_ = check(text, "", [], False)
        names = sorted(n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef))
        return True, hashlib.sha256(ast.dump(_Bare().visit(tree)).encode()).hexdigest(), kernels, launched, names

    def run(codes: pd.Series) -> pd.DataFrame:
        return _told(codes, one, [f.split()[0] for f in FEATURES.split(", ")])

    return F.pandas_udf(run, FEATURES)(code)


def imports_of(code: Column, module: str) -> Column:
    """The names that a text imports from a module, by pattern."""
    found = F.regexp_extract_all(code, F.lit(rf"(?m)^\s*from {module}(?:\.\w+)* import (.+)$"), 1)
    names = F.flatten(F.transform(found, lambda f: F.split(F.regexp_replace(f, r"\s*#.*$|[()\s]", ""), ",")))
    return F.sort_array(F.array_distinct(F.filter(names, lambda n: n != "")))
