"""Filling fixed-capacity windows with texts (problem 8).

Token counts form a histogram over 1..capacity, whose size does not grow with the corpus. On it the
configuration linear program (fewest windows whose fillings cover every length as often as it
occurs) is solved by multiplicative weights. Each length has a weight that shrinks as it is covered;
weight over demand is its price; a knapsack dynamic program finds the filling worth most, whose
worth also bounds the program from below (all weights over that worth: prices scaled to the worth
are a solution of the dual). The fractional uses are rounded by carrying remainders on, what is left
is filled exactly by subset sums, and items are handed to the fillings by their rank within their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import spread, stored

CAPACITY = 1024
TOKENIZERS = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts a text before merging.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANK_ROWS = 100_000  # pieces of one length that one task ranks, about
GAP = 0.05  # the linear program ends when its value is within this part of the dual bound,
ROUNDS = 300  # or after so many prices; rounding makes up for what is missing then
STEP = 0.25  # part of a length's demand that one filling may cover in a round
RATE = 1.0  # how fast weights shrink with the coverage
NEAR_BEST = 0.05  # fillings worth so much less than the best one still count as best

_ENCODERS: dict = {}


def encoder(folder: str = TOKENIZERS):
    """The tokenizer, loaded once per Python worker."""
    if folder not in _ENCODERS:
        import tiktoken

        with open(os.path.join(folder, RANK_FILE), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[folder] = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[folder]


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens); null and empty texts have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], schema=schema)

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(count, "doc_id long, n_tokens long")


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to capacity the highest total price of lengths that fit, each any number of times, and the last length taken (-1: room left over)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        gains = value[room - lengths[: usable[room]]] + price[: usable[room]]
        k = int(gains.argmax())
        if gains[k] > value[room - 1]:
            value[room], pick[room] = gains[k], k
        else:
            value[room] = value[room - 1]
    return value, pick


def _traced(pick: np.ndarray, lengths: np.ndarray, room: int, filling: dict[int, int]) -> dict[int, int]:
    while room > 0:
        k = int(pick[room])
        if k < 0:
            room -= 1
        else:
            filling[k] = filling.get(k, 0) + 1
            room -= int(lengths[k])
    return filling


def configuration_lp(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[dict[tuple[tuple[int, int], ...], float], float, float]:
    """(uses, value, bound): how often each filling is used, in fractions, to cover all demand; the windows that takes; the dual bound.

    A round prices once and takes, beside the best filling, those with each of the least covered
    lengths that are nearly as good. No length is covered by much more than STEP in a round.
    """
    need, log_weight = demand.astype(float), np.log(lengths * demand.astype(float))
    covered, uses, total, bound, value = np.zeros(len(need)), {}, 0.0, 0.0, np.inf
    for _ in range(rounds):
        weight = np.exp(log_weight - log_weight.max())
        price = weight / need
        worth, pick = knapsack(price, lengths, capacity)
        bound = max(bound, float(weight.sum() / worth[capacity]))
        near = np.flatnonzero(price + worth[capacity - lengths] >= (1 - NEAR_BEST) * worth[capacity])
        fresh = np.zeros(len(need))
        for k in near[np.argsort(covered[near], kind="stable")].tolist():
            if fresh[k] > 0:
                continue
            filling = _traced(pick, lengths, capacity - int(lengths[k]), {k: 1})
            at, times = np.array(list(filling)), np.array(list(filling.values()))
            if (fresh[at] >= STEP).any():
                continue
            used = STEP * float((need[at] / times).min())
            fresh[at] += used * times / need[at]
            key = tuple(sorted(filling.items()))
            uses[key] = uses.get(key, 0.0) + used
            total += used
        covered += fresh
        log_weight -= RATE * fresh
        if covered.min() > 0:
            value = total / float(covered.min())
            if value <= (1 + gap) * bound:
                break
    mean = float((covered * lengths * need).sum() / (lengths * need).sum())
    return {k: x / mean for k, x in uses.items()}, value, bound


def fullest(lengths: np.ndarray, left: np.ndarray, room: int) -> dict[int, int]:
    """The items left that fill a room best, by subset sums held as the bits of one number."""
    reach, mask, parts = 1, (1 << (room + 1)) - 1, []
    for k in range(int(np.searchsorted(lengths, room, side="right")) - 1, -1, -1):
        n, times = min(int(left[k]), room // int(lengths[k])), 1
        while n > 0:
            times = min(times, n)
            parts.append((k, times, times * int(lengths[k]), reach))
            reach |= (reach << parts[-1][2]) & mask
            n -= times
            times *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for k, times, size, before in reversed(parts):
        if not before >> total & 1:
            out[k] = out.get(k, 0) + times
            total -= size
    return out


def rounded(lengths: np.ndarray, demand: np.ndarray, capacity: int, uses: dict[tuple[tuple[int, int], ...], float]) -> list[tuple[dict[int, int], int]]:
    """(filling as index of length -> count, windows of that filling) that hold the demand exactly."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []

    def use(filling: dict[int, int], times: int) -> None:
        for k, n in filling.items():
            left[k] -= n * times
        plan.append((filling, times))

    carry = 0.0
    for key, used in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
        carry += used
        times = min(int(carry), *(int(left[k] // n) for k, n in key))
        carry -= int(carry)
        if times > 0:
            use(dict(key), times)
    longest = len(lengths) - 1
    while True:  # the rest: the longest length left, with the items that fill its window best; every turn ends a length or a window
        while longest >= 0 and not left[longest]:
            longest -= 1
        if longest < 0:
            return plan
        left[longest] -= 1
        filling = fullest(lengths, left, capacity - int(lengths[longest]))
        left[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        use(filling, min(int(left[k] // n) for k, n in filling.items()))


def window_plan(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    return rounded(lengths, demand, capacity, configuration_lp(lengths, demand, capacity)[0])


SLOTS = "n int, begin long, stop long, each int, base long, bound double, lp_value double"


def _planned(capacity: int):
    """The histogram (n, k), as one frame, to the slots of the plan: items of length n with ranks begin to stop go, `each` to a window, to windows from base on."""

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in [pd.concat([pd.DataFrame({"n": [], "k": []}), *frames]).astype("int64").sort_values("n")]:
            slots, base, lengths, demand = [], 0, frame.n.to_numpy(), frame.k.to_numpy()
            if len(lengths):
                uses, value, bound = configuration_lp(lengths, demand, capacity)
                taken = np.zeros(len(lengths), dtype=np.int64)
                for filling, times in rounded(lengths, demand, capacity, uses):
                    for k, n in filling.items():
                        slots.append((int(lengths[k]), int(taken[k]), int(taken[k] + n * times), n, base, bound, value))
                        taken[k] += n * times
                    base += times
            yield pd.DataFrame(slots, columns=[c.split()[0] for c in SLOTS.split(", ")])

    return plan


def pack(sizes: DataFrame, row_id: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(row_id, piece_no, start, n_tokens, window): every piece of every row in exactly one window.

    Only rows larger than the capacity are cut, into full windows and a rest. Rows of size 0 or null
    take no room and get no window. A repeated row_id is packed as often as it occurs.
    """
    return packed(sizes, row_id, size, capacity)[0]


def packed(sizes: DataFrame, row_id: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> tuple[DataFrame, float, float]:
    """What `pack` gives, the dual bound and the value of the linear program (both 0 without items)."""
    spark = sizes.sparkSession
    whole = sizes.where(F.col(size) > 0).select(F.col(row_id).alias("row_id"), F.col(size).cast("long").alias("total"))
    full = F.floor((F.col("total") - 1) / capacity).cast("int")
    pieces = whole.withColumn("piece_no", F.explode(F.sequence(F.lit(0), full)))
    pieces = pieces.withColumn("start", F.col("piece_no").cast("long") * capacity).withColumn("n", F.least(F.lit(capacity), F.col("total") - F.col("start")).cast("int"))
    pieces = stored(pieces.withColumn("h", F.xxhash64("row_id", "piece_no")).drop("total"), "packing-pieces")

    histogram = stored(pieces.groupBy("n").agg(F.count("*").alias("k")), "packing-histogram")  # at most `capacity` rows
    slots = histogram.repartition(1).mapInPandas(_planned(capacity), SLOTS).toPandas()  # fillings x lengths in each: bounded by the rounds and the capacity
    # A length that many items share is ranked in as many buckets as its count asks for.
    parts = F.ceil(F.col("k") / RANK_ROWS).cast("int").alias("parts")
    pieces = pieces.join(F.broadcast(histogram.select("n", parts)), "n").withColumn("bucket", F.pmod("h", F.col("parts")).cast("int")).drop("parts")
    counted = pieces.groupBy("n", "bucket").agg(F.count("*").alias("k"))
    offsets = counted.select("n", "bucket", F.coalesce(F.sum("k").over(Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ends: dict[int, tuple[np.ndarray, ...]] = {}
    for n, mine in slots.groupby("n", sort=True):
        ends[int(n)] = tuple(mine[c].to_numpy() for c in ("stop", "begin", "each", "base"))
    shared = spark.sparkContext.broadcast(ends)
    schema = pa.schema([("row_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("window", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            window = np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                rows = np.flatnonzero(n == length)
                stop, begin, each, first = shared.value[int(length)]
                at = np.searchsorted(stop, rank[rows], side="right")
                window[rows] = first[at] + (rank[rows] - begin[at]) // each[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(window)], schema=schema)

    order = Window.partitionBy("n", "bucket").orderBy("h", "row_id", "piece_no")
    ranked = pieces.join(offsets, ["n", "bucket"]).withColumn("r", F.row_number().over(order) - 1)
    ranked = ranked.select(F.col("row_id").cast("long"), "piece_no", "start", "n", (F.col("offset") + F.col("r")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(place, "row_id long, piece_no int, start long, n_tokens int, window long").withColumnRenamed("row_id", row_id)
    return (placed, float(slots.bound[0]), float(slots.lp_value[0])) if len(slots) else (placed, 0.0, 0.0)


def document_windows(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    return pack(token_counts(documents, folder))


def packing_report(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row: windows used, tokens held, the fullest window, the share of the windows' room in use, the dual bound on the
    windows, the value the linear program reached, and the gap between windows and bound."""
    placed, bound, value = packed(token_counts(documents, folder))
    per_window = placed.groupBy("window").agg(F.sum("n_tokens").alias("used"))
    room = per_window.agg(F.count("*").alias("n_windows"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * CAPACITY)).alias("fill"))
    return room.select("*", F.lit(bound).alias("bound"), F.lit(value).alias("lp_value"), (F.col("n_windows") / F.lit(bound) - 1).alias("gap"))
