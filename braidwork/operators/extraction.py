"""Table functions over source text, as Arrow-batched maps."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import spread

# The assertion methods of unittest.
UNITTEST = "assertEqual assertNotEqual assertTrue assertFalse assertIs assertIsNot assertIsNone assertIsNotNone assertIn assertNotIn assertIsInstance assertNotIsInstance assertRaises assertRaisesRegex assertWarns assertWarnsRegex assertLogs assertAlmostEqual assertNotAlmostEqual assertGreater assertGreaterEqual assertLess assertLessEqual assertRegex assertNotRegex assertCountEqual assertMultiLineEqual assertSequenceEqual assertListEqual assertTupleEqual assertSetEqual assertDictEqual"
_METHODS = frozenset(UNITTEST.split())
# Methods whose first argument is itself the answer.
_FIRST_ARGUMENT = frozenset("assertTrue assertFalse assertIsNone assertIsNotNone assertRaises assertRaisesRegex assertWarns assertWarnsRegex".split())

ASSERTIONS = "assertion_type string, prefix string, target string, lineno int, col_offset int, test_function string"


def parse(source: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source or "")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


class _Places:
    """Character offsets for the line and byte columns of a syntax tree."""

    def __init__(self, source: str):
        self.source, self.starts = source, [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.lines = source.splitlines(keepends=True)

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode(errors="replace"))

    def start(self, node: ast.AST) -> int:
        return self.at(node.lineno, node.col_offset)

    def end(self, node: ast.AST) -> int:
        return self.at(node.end_lineno, node.end_col_offset)


def _cut(node: ast.AST, places: _Places) -> tuple[str, int, int] | None:
    """(assertion type, where the answer begins, where it ends) of an assertion node."""
    if isinstance(node, ast.Assert):
        test = node.test
        begin = places.start(test.comparators[-1]) if isinstance(test, ast.Compare) else places.start(test)
        return "assert", begin, places.end(node)
    func = node.func
    owner = func.value.id if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name) else ""
    name = func.attr if isinstance(func, ast.Attribute) else func.id if isinstance(func, ast.Name) else ""
    if owner == "self" and name in _METHODS:
        kind, which = f"self.{name}", 0 if name in _FIRST_ARGUMENT else 1
    elif owner == "pytest" and name in ("raises", "approx"):
        kind, which = f"pytest.{name}", 0
    elif name.startswith("assert_"):
        kind, which = "assert_*", 1
    else:
        return None
    arguments = [*node.args, *(k.value for k in node.keywords)]
    if not arguments:
        return None
    return kind, places.start(arguments[min(which, len(arguments) - 1)]), places.end(node)


def assertions(source: str | None) -> list[tuple[str, str, str, int, int, str]]:
    """Each assertion with the whole file before its answer, breadth first; broken source has none.

    The answer of a call ends with the call's bracket. Answers on several lines are joined into one;
    blank answers and those that begin with a comma are left out.
    """
    tree = parse(source)
    if tree is None or not source:
        return []
    places, found = _Places(source), []
    tests = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for node in ast.walk(tree):
        cut = _cut(node, places) if isinstance(node, (ast.Assert, ast.Call)) else None
        if not cut:
            continue
        kind, begin, end = cut
        target = source[begin:end]
        target = re.sub(r"\s+", " ", target).strip() if "\n" in target else target
        if not target.strip() or target.lstrip().startswith(","):
            continue
        around = [t for t in tests if t.lineno <= node.lineno <= t.end_lineno]
        inner = max(around, key=lambda t: t.lineno).name if around else ""
        found.append((kind, source[:begin], target, node.lineno, node.col_offset, inner))
    return found


def chunks(path: str, source: str | None, most: int | None = None) -> list[tuple[str, str]]:
    """(symbol, text) of each top-level function and class; a file that does not parse is one chunk, a blank one none. With `most`, longer texts are cut there and marked."""
    if not (source or "").strip():
        return []
    short = lambda t: t if most is None or len(t) <= most else t[:most] + "\n# ... truncated ..."
    head = lambda symbol: f"# File: {path}\n# Symbol: {symbol}\n"
    tree = parse(source)
    if tree is None:
        return [("<module>", head("<module>") + short(source.strip()))]
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            text = ast.get_source_segment(source, node) or ""
            if text.strip():
                out.append((node.name, head(node.name) + short(text)))
    return out


def compressed(source: str) -> str:
    """Signatures and first docstring lines of a definition, bodies left out; unchanged if it does not parse."""
    tree = parse(source)
    if tree is None:
        return source
    lines = []

    def visit(node: ast.AST, depth: int) -> None:
        pad = "    " * depth
        if isinstance(node, ast.ClassDef):
            lines.append(f"{pad}class {node.name}" + (f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else "") + ":")
        else:
            lines.append(f"{pad}{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)}):")
        doc = ast.get_docstring(node)
        if doc:
            lines.append(f'{pad}    """{doc.splitlines()[0]}"""')
        inner = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if isinstance(node, ast.ClassDef) else []
        for n in inner:
            visit(n, depth + 1)
        if not inner:
            lines.append(f"{pad}    ...")

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            visit(node, 0)
    return "\n".join(lines) or source


def imports(source: str | None) -> list[tuple[str, str, int]]:
    """(module, name, level) of every import; lines are matched where the source does not parse."""
    tree = parse(source)
    if tree is None:
        out = []
        for m in re.finditer(r"(?m)^[ \t]*(?:from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]+([\w*, \t]+)|import[ \t]+([\w., \t]+))", source or ""):
            if m[4]:
                out += [(p.split(" as ")[0].strip(), "", 0) for p in m[4].split(",") if p.strip()]
            else:
                out += [(m[2], p.split(" as ")[0].strip(), len(m[1])) for p in m[3].split(",") if p.strip()]
        return out
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, "", 0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.module or "", a.name, node.level) for a in node.names]
    return out


def tasks(source: str | None) -> list[tuple[str, str, str]]:
    """(name, head, body) of every documented function: write the body for the head."""
    tree = parse(source)
    out = []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node) and len(node.body) > 1:
            lines = source.splitlines(keepends=True)
            split = node.body[0].end_lineno
            out.append((node.name, "".join(lines[node.lineno - 1 : split]), "".join(lines[split : node.end_lineno])))
    return out


def next_blocks(source: str | None, per_test: int = 3) -> list[tuple[str, int, str, str]]:
    """E5: (test, line, text before, next line) at up to per_test evenly spaced statements of each test."""
    tree = parse(source)
    out = []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and "test" in node.name.lower() and len(node.body) > 1:
            lines = source.splitlines(keepends=True)
            step = max(1, (len(node.body) - 1) / per_test)
            for i in sorted({1 + int(k * step) for k in range(per_test) if 1 + int(k * step) < len(node.body)}):
                at = node.body[i]
                out.append((node.name, at.lineno, "".join(lines[node.lineno - 1 : at.lineno - 1]), "".join(lines[at.lineno - 1 : at.end_lineno])))
    return out


def spliced(source: str, lineno: int, column: int, answer: str) -> str:
    """The source with the rest of a line, from a column on, replaced by an answer."""
    lines = source.splitlines(keepends=True)
    if not 0 < lineno <= len(lines):
        raise ValueError(f"line {lineno} is out of range")
    line = lines[lineno - 1]
    lines[lineno - 1] = line[:column] + answer.rstrip("\n") + ("\n" if line.endswith("\n") else "")
    return "".join(lines)


def blame_lines(report: str | None) -> list[tuple[int, str]]:
    """(line, commit) from a porcelain blame report."""
    return [(int(m[2]), m[1]) for m in re.finditer(r"(?m)^([0-9a-f]{40}) \d+ (\d+)", report or "")]


def numstat_lines(report: str | None) -> list[tuple[str, int, int, str]]:
    """(commit, added, deleted, path) from a log with --numstat; binary files count 0."""
    out, sha = [], ""
    for line in (report or "").splitlines():
        if re.fullmatch(r"(?:commit )?[0-9a-f]{40}", line.strip()):
            sha = line.strip()[-40:]
        elif m := re.fullmatch(r"(\d+|-)\t(\d+|-)\t(.+)", line):
            out.append((sha, *(0 if g == "-" else int(g) for g in m.groups()[:2]), m[3]))
    return out


def exploded(df: DataFrame, keys: Sequence[str], text: str, function: Callable[..., list[tuple]], columns: str, with_key: str | None = None) -> DataFrame:
    """Apply a table function to each row's text: (keys..., columns...); rows without results vanish."""
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", " + columns
    names = [c.split()[0] for c in [*keys, *columns.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for values in frame.itertuples(index=False):
                key, value = values[: len(keys)], values[len(keys)]
                value = None if value is None or value != value else value
                rows += [(*key, *r) for r in (function(key[keys.index(with_key)], value) if with_key else function(value))]
            yield pd.DataFrame(rows, columns=names)

    return spread(df.select(*keys, text)).mapInPandas(run, schema)


def source_assertions(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return exploded(df, keys, text, assertions, ASSERTIONS)


def source_chunks(df: DataFrame, keys: Sequence[str], path: str, text: str = "text") -> DataFrame:
    return exploded(df, keys, text, chunks, "symbol string, chunk string", with_key=path)


def separated(df: DataFrame, path: str) -> DataFrame:
    """Which side of the test / regular divide a file falls on."""
    from braidwork.functions.text import is_test_path

    return df.withColumn("kind", F.when(is_test_path(F.col(path)), "test").otherwise("regular"))
