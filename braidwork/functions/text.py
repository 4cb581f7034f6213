"""Column functions over text, code and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's strip() removes, as one regular-expression class for both engines.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Endings that count as source, and folders that are never looked into.
SOURCE_ENDINGS = (".py", ".md", ".rst")
SKIP_FOLDERS = (".git", "__pycache__", ".venv", "venv", "env", "node_modules", "dist", "build", ".tox", ".mypy_cache")
# Marks that a fill-in-the-middle model may leave in its output.
FIM_TOKENS = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
# Fixed value: the code tokenizer.
CODE_TOKEN = r"""[a-zA-Z_]\w*|0[xXoObB][\da-fA-F_]+|\d[\d_]*\.?\d*[eE]?[\d_]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s]"""
BM25_TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|\d+"


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"{BLANK}+\z", "")


def strip(x: Column) -> Column:
    return rstrip(lstrip(x))


def collapse(x: Column) -> Column:
    """Runs of blanks become one space, ends are stripped."""
    return F.btrim(F.regexp_replace(x, f"{BLANK}+", " "))


def one_line(x: Column) -> Column:
    """As X1, but only where there is a line break."""
    return F.when(x.contains("\n"), collapse(x)).otherwise(x)


def repo_key(x: Column) -> Column:
    """X3"""
    return F.lower(strip(x))


def match_form(x: Column) -> Column:
    """The form in which answers are compared."""
    bare = F.regexp_replace(strip(x), r"[:, \t]+\z", "")
    return collapse(F.replace(F.replace(bare, F.lit(", "), F.lit(",")), F.lit(" ,"), F.lit(",")))


def without_comment(x: Column) -> Column:
    """X5"""
    return strip(F.substring_index(x, "#", 1))


def without_fim_tokens(x: Column) -> Column:
    """X6"""
    for token in FIM_TOKENS:
        x = F.replace(x, F.lit(token), F.lit(""))
    return strip(x)


def n_words(x: Column) -> Column:
    return F.when(strip(x) == "", F.lit(0)).otherwise(F.size(F.split(strip(x), f"{BLANK}+")))


def first_word(x: Column) -> Column:
    return F.element_at(F.split(strip(x), f"{BLANK}+"), 1)


def cleaned_prediction(pred: Column, target: Column) -> Column:
    """Cut an answer down to the shape of its target: one line, no comment, no list, one word."""
    out = without_fim_tokens(pred)
    out = F.when(~target.contains("\n") & out.contains("\n"), F.substring_index(out, "\n", 1)).otherwise(out)
    out = without_comment(out)
    ref = without_comment(target)
    cut = F.when(~ref.contains(",") & out.contains(","), strip(F.substring_index(out, ",", 1))).otherwise(out)
    cut = F.when((n_words(ref) == 1) & (n_words(cut) > 1), first_word(cut)).otherwise(cut)
    return strip(F.when(ref != "", cut).otherwise(out))


def exact_match(pred: Column, ref: Column) -> Column:
    """X8"""
    return match_form(pred) == match_form(ref)


def code_tokens(x: Column) -> Column:
    """X10"""
    return F.regexp_extract_all(x, F.lit(f"({CODE_TOKEN})"), F.lit(1))


def search_tokens(x: Column) -> Column:
    """X29"""
    return F.regexp_extract_all(F.lower(x), F.lit(f"({BM25_TOKEN})"), F.lit(1))


def is_valid_pair(prefix: Column, target: Column) -> Column:
    """F4"""
    return (F.length(prefix) > 0) & (F.length(target) > 0) & ~lstrip(target).startswith(",")


def is_trivial_target(target: Column, least: int = 4) -> Column:
    """null, short, or little more than a bracket or comma."""
    t = strip(target)
    return target.isNull() | (F.length(t) < least) | ((F.length(t) <= 6) & (t.endswith(")") | t.startswith(",")))


# Fixed values in the next function: the labels of rejected pairs.
def pair_reason(prefix: Column, target: Column, has_function: Column) -> Column:
    """why a pair is rejected, first reason first; empty if it is kept. A null target is empty."""
    t = strip(F.coalesce(target, F.lit("")))
    last = strip(F.element_at(F.split(rstrip(F.coalesce(prefix, F.lit(""))), "\n"), -1))
    return (
        F.when(t == "", "empty_target")
        .when(t.startswith(","), "comma_leading_target")
        .when(t.isin(")", "))", ")))", "]", "]]", "}"), "paren_only_target")
        .when(F.length(t) > 500, "target_too_long")
        .when(~F.coalesce(has_function, F.lit(False)), "no_enclosing_function")
        .when(last.contains("(,"), "malformed_prefix_comma")
        .otherwise("")
    )


def is_test_path(path: Column) -> Column:
    """F7"""
    return F.lower(path).contains("test")


def in_skipped_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_FOLDERS)))


def path_ending(path: Column) -> Column:
    """Ending of the last part of a path with its dot, in lower case; empty without one or for dot files."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def is_python_test_file(path: Column) -> Column:
    """F8"""
    return (path_ending(path) == ".py") & ~in_skipped_folder(path) & is_test_path(path)


def skips_diff_path(path: Column) -> Column:
    """F9"""
    return ~path_ending(path).isin(*SOURCE_ENDINGS) | in_skipped_folder(path) | is_test_path(path)


def matches_test_name(path: Column) -> Column:
    """test_*.py or *_test.py, or any file in a folder test(s)."""
    return path.rlike(r"(^|/)(test_[^/]*\.py$|[^/]*_test\.py$|tests?/)")


def mentions_tests(text: Column) -> Column:
    """F10, the part that needs no parser."""
    low = F.lower(text)
    return low.contains("import pytest") | low.contains("from pytest") | low.contains("import unittest") | low.contains("from unittest") | text.rlike(r"(?md)^\s*(?:async )?def test")


def filtered_diff(diff: Column) -> Column:
    """the parts of a diff whose new path is source code outside tests and skipped folders; null becomes empty."""
    parts = F.split(F.coalesce(diff, F.lit("")), r"(?md)(?=^diff --git )")
    keep = lambda part: part.startswith("diff --git ") & (F.regexp_extract(part, r"(?d)^diff --git a/(.+?) b/(.+?)(?:\n|\z)", 2) != "") & ~skips_diff_path(F.regexp_extract(part, r"(?d)^diff --git a/(.+?) b/(.+?)(?:\n|\z)", 2))
    return F.array_join(F.filter(parts, keep), "")


def _literal_start(t: Column) -> Column:
    return t.rlike(r"""^(?:['"]|[bf]['"])""")


NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*)?\.?\d+(?:_\d+)*|\d+(?:_\d+)*\.)(?:[eE][+-]?\d+)?$|^(?i)[+-]?(?:inf|infinity|nan)$"


# Fixed values in the next two functions: the classes of targets.
def difficulty(target: Column) -> Column:
    """Eight classes of targets; identifiers and numbers in ASCII."""
    t = F.regexp_replace(strip(target), r"\)+\z", "")
    number = F.regexp_replace(t, "^([^-]*)-", "$1").rlike(NUMBER)
    return (
        F.when(t.isin("True", "False"), "bool_literal").when(t == "None", "none_literal").when(_literal_start(t), "string_literal").when(number, "numeric_literal")
        .when(t.rlike(r"^[\[({]"), "collection").when(target.contains("("), "func_call").when(t.rlike(r"^[A-Za-z_]\w*$"), "variable").otherwise("complex_expr")
    )


def composition_class(target: Column) -> Column:
    """The variant used for composition tables."""
    t = strip(target)
    return (
        F.when(t.isin("True", "False"), "bool_literal").when(t == "None", "none_literal").when(_literal_start(t), "string_literal").when(t.rlike(NUMBER), "numeric_literal")
        .when(t.rlike(r"^[\[({]"), "collection").when(t.contains("(") & t.contains(")"), "func_call").when(t.rlike(r"^[A-Za-z_]\w*$") | t.contains("."), "variable").otherwise("complex_expr")
    )


def assertion_style(prefix: Column) -> Column:
    """By the last line of the prefix."""
    last = strip(F.element_at(F.split(strip(prefix), "\n"), -1))
    return F.when(last.contains("self.assert") | last.contains("self.Assert"), "self.assert*").when(last.contains("pytest."), "pytest.*").otherwise("assert")


def value_type(x: Column) -> Column:
    """Python type a literal shows; other if none."""
    s = strip(x)
    return (
        F.when(s.isin("True", "False"), "bool").when(s == "None", "none").when(s.rlike("^['\"]"), "str").when(s.startswith("["), "list").when(s.startswith("{"), "dict").when(s.startswith("("), "tuple")
        .when(s.rlike(r"^[+-]?\d+(?:_\d+)*$"), "int").when(s.rlike(NUMBER), "float").otherwise("other")
    )


def type_matches(expected: Column, got: Column) -> Column:
    """X17"""
    return (value_type(expected) == value_type(got)) & (value_type(expected) != "other")


# Fixed values in the next function: the names of failures.
def failure_mode(expected: Column, got: Column) -> Column:
    """Why an answer is wrong."""
    return (
        F.when(strip(got) == "", "empty_prediction").when(strip(got) == strip(expected), "whitespace_mismatch").when(F.lower(expected) == F.lower(got), "case_mismatch")
        .when(got.contains(expected), "overgeneration").when(expected.contains(got), "undergeneration").when(type_matches(expected, got), "wrong_value_right_type").otherwise("completely_wrong")
    )


# Fixed values in the next two functions: the marks and names of test frameworks and styles.
def framework(text: Column) -> Column:
    """X19"""
    low = F.lower(text)
    unit = low.contains("import unittest") | low.contains("from unittest") | low.contains("unittest.")
    py = low.contains("import pytest") | low.contains("from pytest") | low.contains("pytest.")
    return F.when(unit & py, "mixed").when(unit, "unittest").when(py, "pytest").otherwise("unknown")


def test_tags(text: Column) -> Column:
    """X20"""
    low = F.lower(text)
    has = lambda *parts: [low.contains(p) for p in parts]
    tags = [
        ("class_based", has("class ")), ("unittest_class", has("unittest")), ("mock", has("mock", "patch(")),
        ("fixture_based", has("@pytest.fixture")), ("parametrized", has("parametrize")), ("async", has("async def ", "pytest.mark.asyncio")),
    ]
    found = []
    for tag, tests in tags:
        met = tests[0]
        for test in tests[1:]:
            met = met | test
        found.append(F.when(met, F.lit(tag)))
    return F.filter(F.array(*found), lambda tag: tag.isNotNull())


def n_asserts(text: Column) -> Column:
    """X21"""
    return F.regexp_count(text, F.lit(r"(?:^|[^\w.])assert[^\w]|self\.assert\w+\(|pytest\.raises\("))


def n_lines(x: Column) -> Column:
    """Number of line breaks."""
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def last_chars(x: Column, n: int) -> Column:
    """X23"""
    return F.right(x, F.lit(n))


def last_lines(x: Column, n: int) -> Column:
    return F.substring_index(x, "\n", -n)


def shortened(x: Column, n: int) -> Column:
    """X24"""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def token_estimate(x: Column, at_least_one: bool = False) -> Column:
    """A quarter of the characters; the second form never says 0 for a text that is there."""
    quarter = F.floor(F.length(x) / 4)
    return F.when(F.length(x) > 0, F.greatest(F.lit(1), quarter)).otherwise(0) if at_least_one else quarter


# What counts as a call, an attribute's owner and an identifier.
CALL, OWNER, IDENTIFIER = r"\b([a-zA-Z_]\w*)\s*\(", r"\b([a-zA-Z_]\w*)\s*\.", r"\b([a-zA-Z_]\w*)\b"


def block_score(names: Column, prefix: Column) -> Column:
    """How relevant a block that defines `names` is to a prefix: called 1.0, owner of an attribute 0.8, mentioned 0.5, else 0.1."""
    held = lambda pattern: F.coalesce(F.arrays_overlap(names, F.regexp_extract_all(prefix, F.lit(pattern), F.lit(1))), F.lit(False))
    return F.when(held(CALL), 1.0).when(held(OWNER), 0.8).when(held(IDENTIFIER), 0.5).otherwise(0.1)


def hash64(*parts: Column) -> Column:
    """H4: a 64-bit key of the parts, null parts included."""
    return F.xxhash64(*parts)


def slug(path: Column) -> Column:
    """X26"""
    return F.replace(path, F.lit("/"), F.lit("__"))


def unslug(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.*?)__", "$1/")


def owner_and_name(url: Column) -> Column:
    """X27"""
    return F.regexp_extract(F.regexp_replace(url, r"(?:\.git)?/*\s*$", ""), r"([^/:\s]+/[^/:\s]+)$", 1)


def dotted_module(path: Column) -> Column:
    """X28"""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(?:^|/)__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def event_key(event_id: Column, file: Column, line: Column, column: Column) -> Column:
    """H2: the event id if there is one, else file, line and column."""
    return F.coalesce(F.nullif(event_id, F.lit("")), F.concat_ws("::", file, line.cast("string"), F.coalesce(column, F.lit(-1)).cast("string")))


def fingerprint(*parts: Column) -> Column:
    """H3: 16 hex digits of SHA-256 over the parts, joined by zero characters."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)
