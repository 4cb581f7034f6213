"""Scores that no built-in expression gives, as Arrow-batched functions."""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from braidwork.functions.text import CODE_TOKEN, exact_match

_TOKEN = re.compile(CODE_TOKEN)


def similarity(a: str | None, b: str | None) -> float | None:
    """Share of characters in matching blocks; null if either is null."""
    if a is None or b is None:
        return None
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def token_bleu(pred: list[str], ref: list[str], most: int = 4) -> float:
    """X11: add-one smoothed n-gram precision times min(1, length ratio); 0 for an empty side."""
    if not pred or not ref:
        return 0.0
    total = 0.0
    for n in range(1, most + 1):
        mine, theirs = (Counter(zip(*(side[i:] for i in range(n)), strict=False)) for side in (pred, ref))
        total += math.log(((mine & theirs).total() + 1) / (max(len(pred) - n + 1, 1) + 1))
    return min(1.0, len(pred) / len(ref)) * math.exp(total / most)


def code_score(pred: str | None, ref: str | None) -> float | None:
    """0 if a side is blank, 1 if both are the same, else X11 over code tokens."""
    if pred is None or ref is None:
        return None
    if not pred.strip() or not ref.strip():
        return 0.0
    return 1.0 if pred.strip() == ref.strip() else token_bleu(_TOKEN.findall(pred), _TOKEN.findall(ref))


@F.pandas_udf(DoubleType())
def edit_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def code_bleu(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([code_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def metrics(pred: Column, ref: Column) -> Column:
    """exact_match, edit_similarity, code_bleu and both texts, of a cleaned answer and its target, as one struct."""
    return F.struct(exact_match(pred, ref).alias("exact_match"), edit_similarity(pred, ref).alias("edit_similarity"), code_bleu(pred, ref).alias("code_bleu"), pred.alias("pred_clean"), ref.alias("ref_clean"))


def _tree(text: str) -> ast.AST | None:
    try:
        return ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


def _parts(tree: ast.AST | None) -> tuple[str, set, set]:
    """Kind of the outermost node, names, constants."""
    if tree is None:
        return "unparseable", set(), set()
    nodes = list(ast.walk(tree))
    names = {n.id for n in nodes if isinstance(n, ast.Name)} | {n.attr for n in nodes if isinstance(n, ast.Attribute)}
    return type(tree.body).__name__, names, {repr(n.value) for n in nodes if isinstance(n, ast.Constant)}


class _Answer:
    """What the rules below ask of an answer and its target; trees are parsed when first asked for."""

    def __init__(self, expected: str, got: str, closeness: float | None):
        self.expected, self.got, self._close = expected, got, closeness
        self._trees: tuple | None = None

    def repeats_itself(self) -> bool:
        words = self.got.split()
        return len(self.got) > 30 and len(words) > 5 and 2 * len(set(words)) < len(words)

    def close(self) -> bool:
        return (similarity(self.expected, self.got) if self._close is None else self._close) > 0.8

    def trees(self) -> tuple:
        if self._trees is None:
            self._trees = _parts(_tree(self.got)), _parts(_tree(self.expected))
        return self._trees

    def differs(self, part: int) -> bool:
        return self.trees()[0][part] != self.trees()[1][part]

    def both_have(self, part: int) -> bool:
        return bool(self.trees()[0][part] and self.trees()[1][part])


KIND, NAMES, VALUES = 0, 1, 2
# The classes of errors, in the order in which they are tried.
ERROR_RULES = (
    ("Empty/Truncated", lambda a: not a.got),
    ("Hallucination", lambda a: len(a.got) > max(100, 3 * len(a.expected)) or a.repeats_itself()),
    ("Near-Miss", lambda a: a.close()),
    ("Syntax Error", lambda a: a.trees()[0][KIND] == "unparseable"),
    ("Wrong Identifier", lambda a: a.both_have(NAMES) and a.differs(NAMES) and not a.differs(VALUES)),
    ("Wrong Literal", lambda a: a.both_have(VALUES) and a.differs(VALUES) and not a.differs(NAMES)),
    ("Type Mismatch", lambda a: a.differs(KIND) and a.trees()[1][KIND] != "unparseable"),
    ("Wrong Identifier", lambda a: a.differs(NAMES)),
    ("Wrong Literal", lambda a: a.differs(VALUES)),
    ("Type Mismatch", lambda a: True),
)


def error_kind(expected: str | None, got: str | None, closeness: float | None = None) -> str:
    """Why an answer is wrong: the first rule that holds. Nulls count as empty."""
    answer = _Answer((expected or "").strip(), (got or "").strip(), closeness)
    return next(label for label, holds in ERROR_RULES if holds(answer))


@F.pandas_udf(StringType())
def error_class(expected: pd.Series, got: pd.Series) -> pd.Series:
    return pd.Series([error_kind(x, y) for x, y in zip(expected, got, strict=True)])


@F.pandas_udf(StringType())
def difficulty_exact(target: pd.Series) -> pd.Series:
    """X14 with Python's own rules for numbers and identifiers."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        bare = text.strip().rstrip(")")
        named = {"True": "bool_literal", "False": "bool_literal", "None": "none_literal"}.get(bare)
        if named or re.match(r"['\"]|[bf]['\"]", bare):
            return named or "string_literal"
        try:
            float(bare.replace("-", "", 1))
            return "numeric_literal"
        except ValueError:
            if bare[:1] in ("[", "(", "{") and bare:
                return "collection"
            return "func_call" if "(" in text else "variable" if bare.isidentifier() else "complex_expr"

    return target.map(one)
