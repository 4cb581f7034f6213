"""Context for assertions from parsed source: prefixes, definitions behind imports, condensed sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.extraction import assertions, compressed, imports, parse

# Methods that prepare a test class, and statements that belong to a module's head.
SETUP = ("setUp", "setUpClass", "tearDown", "setup_method", "setup", "fixture", "__init__")
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _lines_of(lines: Sequence[str], node: ast.AST) -> str:
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    return "\n".join(lines[first - 1 : node.end_lineno])


def _called(decorator: ast.AST) -> str:
    node = decorator.func if isinstance(decorator, ast.Call) else decorator
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def last_lines_prefix(source: str, lineno: int, column: int, most_lines: int | None = 300) -> str:
    """The text before a place, its last lines if a number is given."""
    lines = source.split("\n")
    kept = [*lines[: lineno - 1], lines[lineno - 1][:column]]
    return "\n".join(kept[-most_lines:] if most_lines else kept)


def structured_prefix(source: str, lineno: int, column: int, test: str, most_lines: int | None = 600) -> str | None:
    """What matters before an assertion: the module's head, the class with its preparation, helpers and fixtures, and the test up to that place.

    Other tests are left out. None if the source does not parse or the line is beyond it; with
    most_lines the last lines only, so that the test stays.
    """
    tree, lines = parse(source), source.splitlines()
    if tree is None or not 0 < lineno <= len(lines):
        return None
    head_end = max((n.end_lineno for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.AugAssign))), default=0)
    owner = next((n for n in tree.body if isinstance(n, ast.ClassDef) and n.lineno <= lineno <= n.end_lineno), None)
    before = [n for n in owner.body if n.lineno < lineno] if owner else []
    prepared = [n for n in before if isinstance(n, (ast.Assign, ast.AnnAssign)) or (isinstance(n, _FUNCTIONS) and n.name in SETUP)]
    earlier = [n for n in tree.body if isinstance(n, _FUNCTIONS) and n.end_lineno < lineno]
    helpers = [n for n in earlier if not n.name.startswith("test_") or (n.name == test and any(_called(d) == "fixture" for d in n.decorator_list))]
    own = next((n for n in ast.walk(tree) if isinstance(n, _FUNCTIONS) and n.name == test and n.lineno <= lineno <= n.end_lineno), None)
    start = min([own.lineno, *(d.lineno for d in own.decorator_list)]) if own else max(1, lineno - 100)
    body = [*lines[start - 1 : lineno - 1], lines[lineno - 1][:column].rstrip()]
    sections = ["\n".join(lines[:head_end]), lines[owner.lineno - 1] if owner else "", "\n".join(_lines_of(lines, n) for n in prepared), "\n".join(_lines_of(lines, n) for n in helpers), "\n".join(body)]
    out = "\n\n".join(s for s in sections if s).splitlines()
    return "\n".join(out[-most_lines:] if most_lines else out) + "\n"


def contextual_assertions(source: str | None, most_lines: int | None = 600) -> list[tuple[str, str, str, str, int]]:
    """(assertion type, structured prefix, last lines before, target, line) of every assertion."""
    out = []
    for kind, prefix, target, lineno, _, test in assertions(source):
        at = prefix.count("\n") + 1
        column = len(prefix) - prefix.rfind("\n") - 1
        shaped = structured_prefix(source, at, column, test, most_lines)
        if shaped is not None:
            out.append((kind, shaped, last_lines_prefix(source, at, column), target, lineno))
    return out


def is_test_content(source: str | None) -> bool:
    """imports a test framework, or defines a test; sources that do not parse are searched as text."""
    tree = parse(source)
    if tree is None:
        low = (source or "").lower()
        return any(f"{w} {m}" in low for w in ("import", "from") for m in ("pytest", "unittest"))
    if any(m.split(".")[0] in ("pytest", "unittest") for m, *_ in imports(source)):
        return True
    return any((isinstance(n, _FUNCTIONS) and n.name.startswith("test")) or (isinstance(n, ast.ClassDef) and n.name.startswith("Test")) for n in ast.walk(tree))


def definitions(source: str | None) -> list[tuple[str, str]]:
    """(name, condensed text) of the top-level definitions and small assignments of a source."""
    tree, out = parse(source), []
    for node in tree.body if tree else ():
        text = ast.get_source_segment(source, node) or ""
        if isinstance(node, _DEFINITIONS):
            out.append((node.name, compressed(text)))
        elif isinstance(node, ast.Assign) and len(text) < 200:
            out += [(t.id, text) for t in node.targets if isinstance(t, ast.Name)]
    return out


def condensed_source(source: str | None, wanted: Sequence[str] | None = None, most_lines: int | None = 80) -> str:
    """Imports, signatures and small assignments of a source, only of the wanted names if any are given; cut after most_lines."""
    tree = parse(source)
    if tree is None:
        lines = (source or "").splitlines()
        return "\n".join(lines[:most_lines] if most_lines else lines)
    rows = (source or "").splitlines()
    head = "\n".join(_lines_of(rows, n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)))
    inner = {n.name: {m.name for m in ast.walk(n) if isinstance(m, _FUNCTIONS)} for n in tree.body if isinstance(n, ast.ClassDef)}
    kept = [text for name, text in definitions(source) if not wanted or name in wanted or inner.get(name, set()) & set(wanted)]
    lines = "\n\n".join(s for s in (head, *kept) if s.strip()).splitlines()
    return "\n".join(lines) if not most_lines or len(lines) <= most_lines else "\n".join(lines[:most_lines]) + "\n    # ... (truncated)"


def _absolute(module: str, level: int, path: str) -> str:
    """The dotted name that an import in a file stands for."""
    if not level:
        return module
    base = path.split("/")[:-level]
    return ".".join([*base, module] if module else base)


def import_table(files: DataFrame) -> DataFrame:
    """(repo_id, path, module, name): absolute modules that each file imports names from. files: repo_id, path, text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(repo, path, _absolute(m, level, path), n) for repo, path, text in frame.itertuples(index=False) for m, n, level in imports(text)]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "module", "name"])

    return files.where("repo_id is not null and path is not null").select("repo_id", "path", "text").mapInPandas(read, "repo_id string, path string, module string, name string").distinct()


def definition_table(files: DataFrame) -> DataFrame:
    """(repo_id, module, name, file, definition): what each module of a repository defines; of several definitions of one name the last counts."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(repo, path, name, text) for repo, path, source in frame.itertuples(index=False) for name, text in dict(definitions(source)).items()]
            yield pd.DataFrame(rows, columns=["repo_id", "file", "name", "definition"])

    from braidwork.functions.text import dotted_module

    found = files.where("repo_id is not null and path is not null").select("repo_id", "path", "text").mapInPandas(read, "repo_id string, file string, name string, definition string")
    return found.withColumn("module", dotted_module(F.col("file")))


def resolved_imports(files: DataFrame, roots: Sequence[str] = ("", "src.", "lib.")) -> DataFrame:
    """(repo_id, path, module, name, file, definition) of imported names that the repository itself defines.

    A name is looked for in its module, below each of the roots; then where the module's own
    __init__ imports it from; then as a module of that name, without a definition. The first place
    that knows it counts. All three are equi-joins on (repository, module, name).
    """
    wanted, defined = import_table(files), definition_table(files)
    asked = wanted.where("name <> ''").select("repo_id", "path", "module", "name", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.concat(F.lit(r), F.col("module")).alias("place")) for i, r in enumerate(roots)))).alias("r")).select("repo_id", "path", "module", "name", "r.*")
    there = defined.select("repo_id", F.col("module").alias("place"), "name", "file", "definition")
    exact = asked.join(there, ["repo_id", "place", "name"]).withColumn("step", F.lit(0))
    packages = wanted.where(F.col("path").endswith("__init__.py") & (F.col("name") != "")).select("repo_id", F.regexp_replace(F.regexp_replace("path", r"/?__init__\.py$", ""), "/", ".").alias("place"), "name", F.col("module").alias("source"))
    again = asked.join(packages, ["repo_id", "place", "name"]).join(there.withColumnRenamed("place", "source"), ["repo_id", "source", "name"]).drop("source").withColumn("step", F.lit(1))
    modules = defined.select("repo_id", F.col("module").alias("whole"), "file").distinct()
    below = asked.withColumn("whole", F.concat_ws(".", "place", "name")).join(modules, ["repo_id", "whole"]).drop("whole").withColumn("definition", F.lit(None).cast("string")).withColumn("step", F.lit(2))
    union = exact.unionByName(again).unionByName(below)
    best = union.groupBy("repo_id", "path", "module", "name").agg(F.min(F.struct("step", "rank", "file", "definition")).alias("b"))
    return best.select("repo_id", "path", "module", "name", "b.file", "b.definition")


def import_context(files: DataFrame, budget: int = 24_000) -> DataFrame:
    """(repo_id, path, position, name, file, form) per file: definitions behind its imports, in order of size and name, while they fit the budget of characters."""
    from braidwork.operators.retrieval import packed_context

    found = resolved_imports(files).where("definition is not null")
    blocks = found.select(F.concat_ws("\0", "repo_id", "path").alias("_key"), F.concat_ws("\0", "name", "file").alias("block_id"), (-F.length("definition")).cast("double").alias("score"), F.length("definition").cast("long").alias("full_size"), F.length("definition").cast("long").alias("short_size"))
    part = lambda c, i: F.element_at(F.split(c, "\0"), i)
    return packed_context(blocks, "_key", budget).select(part("_key", 1).alias("repo_id"), part("_key", 2).alias("path"), "position", part("block_id", 1).alias("name"), part("block_id", 2).alias("file"), "form")
