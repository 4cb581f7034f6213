"""Splitting oversized diffs at natural boundaries (problem 2).

Lines too wide to leave room for an overlap are set apart first. The runs between them get balanced
targets: the least number of pieces is computed, equal-length targets are placed, each is snapped to
the strongest boundary near it (file, hunk, line), and pieces are added until every piece, its
overlap with the one before included, keeps the limit; cuts that the limit does not need are then
taken back, the weakest first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import spread

LIMIT, OVERLAP = 4000, 200
FILE, HUNK, LINE, LINE_END, FORCED = 4, 3, 2, 1, 0
KIND = {FILE: "file", HUNK: "hunk", LINE: "line", LINE_END: "line", FORCED: "forced"}

_EOL = re.compile(r"\r\n|\n|\r")
SCHEMA = "commit_sha string, piece_no int, start int, stop int, n_overlap int, cut string, piece string"


def boundaries(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Positions where a cut is natural, and how strong each is."""
    at, strength, line = [], [], 0
    for eol in _EOL.finditer(text):
        end, begin = eol.start(), eol.end()
        if begin - line > limit >= end - line:  # only the line end is too much: it may open the next piece
            at.append(end), strength.append(LINE_END)
        line = begin
        if begin < len(text):
            at.append(begin)
            strength.append(FILE if text.startswith("diff --git ", begin) else HUNK if text.startswith("@@ ", begin) else LINE)
    return at, strength


def _overlap(at: list[int], strength: list[int], cut: int, overlap: int) -> int:
    """Start of the earliest whole line among the last `overlap` characters before a cut."""
    k = bisect_left(at, cut - overlap)
    while k < len(at) and at[k] < cut and strength[k] == LINE_END:
        k += 1
    return at[k] if k < len(at) and at[k] < cut else cut


def _snap(at: list[int], strength: list[int], target: float, reach: float) -> tuple[int, int] | None:
    low, high = bisect_left(at, target - reach), bisect_right(at, target + reach)
    if low == high:
        return None
    k = max(range(low, high), key=lambda i: (strength[i], -abs(at[i] - target)))
    return at[k], strength[k]


def _cuts(at: list[int], strength: list[int], low: int, high: int, limit: int, room: int) -> list[tuple[int, int]]:
    """Cuts strictly inside [low, high) that leave no part longer than `room`, if lines allow, else than `limit`."""
    size = high - low
    if size <= room:
        return []
    if bisect_right(at, low) == bisect_left(at, high):
        if size <= limit:  # one line that fits by itself, without an overlap
            return []
        n = -(-size // room)
        return [(low + size * i // n, FORCED) for i in range(1, n)]
    inside = at[bisect_right(at, low) : bisect_left(at, high)]
    wide = [(a, b) for a, b in zip([low, *inside], [*inside, high], strict=True) if b - a > room]
    if wide:  # they can't keep the room, whatever the number of pieces: each stands alone, the runs between are cut by themselves
        ends = sorted({x for line in wide for x in line if low < x < high})
        apart: list[tuple[int, int]] = []
        for a, b in zip([low, *ends], [*ends, high], strict=True):
            if a > low:
                apart.append((a, strength[bisect_left(at, a)]))
            apart.extend(_cuts(at, strength, a, b, limit, room))
        return apart
    n = -(-size // room)
    while True:  # every line fits, so that targets as dense as the lines end the loop at the latest
        found: list[tuple[int, int]] = []
        for i in range(1, n):
            cut = _snap(at, strength, low + size * i / n, size / n / 2)
            if cut and low < cut[0] < high and (not found or cut[0] > found[-1][0]):
                found.append(cut)
        edges = [low, *(c for c, _ in found), high]
        if all(b - a <= room for a, b in pairwise(edges)):
            return _needed(found, low, high, room)
        n += max(1, n // 8)


def _needed(cuts: list[tuple[int, int]], low: int, high: int, room: int) -> list[tuple[int, int]]:
    """The cuts without those between two pieces that fit together; the weakest go first, of equal ones those of the shortest pieces."""
    edges, kept = [low, *(c for c, _ in cuts), high], dict(cuts)
    before, after = dict(pairwise(edges[::-1])), dict(pairwise(edges))
    for cut, _ in sorted(cuts, key=lambda c: (c[1], after[c[0]] - before[c[0]], c[0])):
        left, right = before[cut], after[cut]
        if right - left <= room:
            del kept[cut]
            after[left], before[right] = right, left
    return sorted(kept.items())


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, stop, overlap start, kind of the cut at start) of each piece; a text within the limit is one piece."""
    if len(text) <= limit:
        return [(0, len(text), 0, LINE)]
    at, strength = boundaries(text, limit)
    cuts = _cuts(at, strength, 0, len(text), limit, limit - overlap)
    edges = [(0, LINE), *cuts]
    out = []
    for (start, kind), (stop, _) in zip(edges, [*cuts, (len(text), LINE)], strict=True):
        reach = min(overlap, limit - (stop - start))
        if not start or reach <= 0:
            begin = start
        elif kind == FORCED:
            begin = start - reach  # the line before is cut anyway
        else:
            begin = _overlap(at, strength, start, reach)
            begin = start - reach if begin == start else begin  # the last line is longer than the overlap
        out.append((start, stop, begin, kind))
    return out


def split_texts(df: DataFrame, row_id: str = "commit_sha", text: str = "production_code_diff", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row per piece of every text longer than limit (code points).

    start and stop are the piece's own part; piece also holds the n_overlap characters before it.
    Null, empty and short texts give no rows. A row delivered again gives its pieces again; use
    `long_diff_pieces` for one set of pieces per id.
    """
    schema = pa.schema([("commit_sha", pa.string()), ("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("n_overlap", pa.int32()), ("cut", pa.string()), ("piece", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (start, stop, begin, kind) in enumerate(pieces(value, limit, overlap)):
                    rows.append((row, n, start, stop, start - begin, KIND[kind] if n else "start", value[begin:stop] if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(df.select(row_id, text).where(F.char_length(text) > limit)).mapInArrow(cut, SCHEMA)


def cut_kinds(commits: DataFrame) -> DataFrame:
    """(commit_sha, cut_kind): whether a long diff could be cut at boundaries only."""
    cut = split_texts(commits, with_text=False).groupBy("commit_sha").agg(F.max((F.col("cut") == "forced").cast("int")).alias("forced"))
    return cut.select("commit_sha", F.when(F.col("forced") == 1, "forced").otherwise("boundary").alias("cut_kind"))


def long_diff_pieces(commits: DataFrame) -> DataFrame:
    """The pieces of each long diff once, in order; only long rows are shuffled to fold redelivered ones."""
    long = commits.select("commit_sha", "production_code_diff").where(F.char_length("production_code_diff") > LIMIT)
    return split_texts(long.dropDuplicates(["commit_sha"]))
