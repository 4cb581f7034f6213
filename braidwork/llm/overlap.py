"""Same or near-same records across splits (problem 1).

A weighted cosine join over inverted lists. Terms are (target, word, n-th occurrence), so two
records share a term only if their targets agree. A term weighs more the rarer its word is, by
inverse document frequency scaled to squares between 1 and SPREAD. The pairs wanted have words in
common, in order, of at least `threshold` times the mean of both lengths. Let w be the least weight
squared of a common term and SPREAD * w the most of any other: with a part c of the words common,
the cosine is at least c / (c + SPREAD * (1 - c)). Lists are pruned and joined at that bound, so the
join loses no pair; exact dot products and the order of words are then verified.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import stored

THRESHOLD = 0.75
SPREAD = 2.0  # how much more a rare word weighs than a frequent one, squared
SKETCH = 1 << 18  # counters of the term frequency sketch: its size is fixed, whatever the corpus holds
_WORD = re.compile(r"\w+")
_U64 = (1 << 64) - 1


def target_key(target: Column) -> Column:
    """Equal for targets that differ in whitespace and kind of quote only."""
    bare = F.regexp_replace(target, r"(?U)[\s\x{200b}\x{feff}]+", "")
    return F.xxhash64(F.translate(bare, "\"`‘’“”„‚«»", "'" * 10))


def suite_of(cross: Column, inside: Column) -> Column:
    """train, or the evaluation suite a record belongs to."""
    return F.when((cross == "train") & (inside == "train"), "train").when(cross == "train", F.concat(F.lit("ir_"), inside)).otherwise(F.coalesce(cross, F.lit("unknown")))


def word_sequences(rows: DataFrame) -> DataFrame:
    """(qna_id, side, tkey, cls, seq): words as 32-bit ids in order; cls is the same for the same words and target."""
    schema = pa.schema([("qna_id", pa.int64()), ("side", pa.int32()), ("tkey", pa.int64()), ("cls", pa.int64()), ("seq", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            seqs, classes = [], []
            for prefix, tkey in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = []
                for word in _WORD.findall(prefix):
                    code = known.get(word)
                    if code is None:
                        code = known[word] = xxhash.xxh32_intdigest(word)
                    ids.append(code)
                packed = np.array(ids, dtype="<u4").tobytes()
                seqs.append(packed)
                classes.append(xxhash.xxh3_64_intdigest(packed, seed=tkey & _U64) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(classes, pa.int64()), pa.array(seqs, pa.binary())], schema=schema)

    return rows.select("qna_id", "side", "tkey", "prefix").mapInArrow(read, "qna_id long, side int, tkey long, cls long, seq binary")


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """How many classes hold a word, in a fixed number of counters; any order that comes of it is a valid one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total[np.unique(np.frombuffer(packed, dtype="<u4") % SKETCH)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    rows = classes.select("seq").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    sketch = np.zeros(SKETCH, dtype=np.int64)
    sketch[rows.slot.to_numpy()] = rows.n.to_numpy()
    return sketch


def _occurrences(seq: np.ndarray) -> np.ndarray:
    """n-th occurrence, from 0, of each word of a sequence."""
    order = np.argsort(seq, kind="stable")
    ranked = seq[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(first)
    nth = np.arange(len(seq)) - np.repeat(starts, np.diff(np.append(starts, len(seq))))
    out = np.empty(len(seq), dtype=np.int64)
    out[order] = nth
    return out


def cosine_bound(threshold: float, spread: float = SPREAD) -> float:
    """The least weighted cosine of two records with `threshold` of their words in common."""
    return threshold / (threshold + spread * (1.0 - threshold))


def term_weights(freq: np.ndarray, n_classes: int, spread: float = SPREAD) -> np.ndarray:
    """Inverse document frequencies, scaled so that squares run from 1 (in every class) to spread (in one only)."""
    rarity = 1.0 - np.log(np.clip(freq, 1, n_classes)) / np.log(max(2, n_classes))
    return np.sqrt(1.0 + (spread - 1.0) * rarity)


def indexed_terms(seq: np.ndarray, tkey: int, sketch: np.ndarray, bound: float, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(term, weight, residual norm behind it) of the rarest terms that must be indexed, and the whole norm.

    Terms are left out from the frequent end as long as the norm of what is left out stays under
    the bound: no unit vector can reach the bound with those terms alone.
    """
    nth = _occurrences(seq)
    freq = sketch[seq % SKETCH]
    order = np.lexsort((nth, seq, freq))
    seq, nth, freq = seq[order].astype(np.uint64), nth[order].astype(np.uint64), freq[order]
    weight = term_weights(freq, n_classes)
    norm = float(np.sqrt((weight**2).sum()))
    weight = weight / norm
    tail = np.sqrt(np.maximum(0.0, np.cumsum((weight**2)[::-1])[::-1]))  # norm from here on
    keep = int((tail >= bound - 1e-9).sum())
    with np.errstate(over="ignore"):
        term = (seq * np.uint64(0x9E3779B97F4A7C15)) ^ ((nth + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.uint64(tkey & _U64) * np.uint64(0x165667B19E3779F9))
        term ^= term >> np.uint64(29)
        term *= np.uint64(0xBF58476D1CE4E5B9)
    behind = np.append(tail[1:], 0.0)
    return term[:keep].view(np.int64), weight[:keep], behind[:keep], norm


def postings(classes: DataFrame, sketch: np.ndarray, bound: float, n_classes: int) -> DataFrame:
    """Inverted lists: (term, cls, sides, norm, w, rest)."""
    shared = classes.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([("term", pa.int64()), ("cls", pa.int64()), ("sides", pa.int32()), ("norm", pa.float32()), ("w", pa.float32()), ("rest", pa.float32())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in schema]
            for cls, tkey, sides, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                seq = np.frombuffer(packed, dtype="<u4")
                if not len(seq):
                    continue
                term, w, rest, norm = indexed_terms(seq, tkey, counts, bound, n_classes)
                k = len(term)
                for part, value in zip(parts, (term, np.full(k, cls), np.full(k, sides), np.full(k, norm), w, rest), strict=True):
                    part.append(value)
            columns = [np.concatenate(p) if p else np.empty(0) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return classes.select("cls", "tkey", "sides", "seq").mapInArrow(index, "term long, cls long, sides int, norm float, w float, rest float")


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over one big integer."""
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _verified(sketch, bound: float, n_classes: int, threshold: float):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for one, two in zip(frame.seq_a, frame.seq_b, strict=True):
                a, b = np.frombuffer(one, dtype="<u4"), np.frombuffer(two, dtype="<u4")
                words, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
                squares = term_weights(sketch.value[words % SKETCH], n_classes) ** 2
                in_a, in_b = np.bincount(codes[: len(a)], minlength=len(words)), np.bincount(codes[len(a) :], minlength=len(words))
                dot = float((squares * np.minimum(in_a, in_b)).sum())  # exact, before both norms
                norms = math.sqrt(float((squares * in_a).sum()) * float((squares * in_b).sum()))
                keep.append(dot >= bound * norms - 1e-9 and 2 * common_in_order(a, b) >= threshold * (len(a) + len(b)))
            yield frame.loc[keep, ["cls_a", "cls_b"]]

    return verify


def overlap_classes(qna: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (qna_id, side, cls) of all records whose target occurs on both sides;
    links (cls_a, cls_b) of different classes, a with a training and b with an evaluation record.

    Exact copies share a class, so a hot group of copies is one row in the join. Redelivered rows
    fold by qna_id. Null prefixes or targets match nothing; prefixes without words match each other.
    """
    side = (~((F.coalesce("cross_repo_split", F.lit("")) == "train") & (F.coalesce("in_repo_split", F.lit("")) == "train"))).cast("int")
    rows = qna.where("qna_id is not null and prefix is not null and target is not null").select("qna_id", side.alias("side"), target_key(F.col("target")).alias("tkey"), "prefix")
    both = rows.groupBy("tkey").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("tkey")
    sequences = stored(word_sequences(rows.join(both, "tkey", "left_semi")), "overlap-sequences")
    members = sequences.select("qna_id", "side", "cls").distinct()
    grouped = sequences.groupBy("cls").agg(F.first("tkey").alias("tkey"), F.first("seq").alias("seq"), F.bit_or(F.col("side") + 1).alias("sides"))
    classes = stored(grouped, "overlap-classes")
    sketch, n_classes, bound = frequency_sketch(classes), classes.count(), cosine_bound(threshold)
    lists = stored(postings(classes, sketch, bound, n_classes), "overlap-postings")
    a = lists.where("(sides & 1) > 0").select("term", *(F.col(c).alias(f"{c}_a") for c in ("cls", "norm", "w", "rest")))
    b = lists.where("(sides & 2) > 0").select("term", *(F.col(c).alias(f"{c}_b") for c in ("cls", "norm", "w", "rest")))
    slack = bound - 1e-5
    met = a.join(b, "term").where(F.col("cls_a") != F.col("cls_b"))
    # maximum weight: a shared term weighs the same in both before scaling, so the dot product is at most the smaller norm squared over both norms
    met = met.where(F.least("norm_a", "norm_b") >= slack * F.greatest("norm_a", "norm_b"))
    # residual norm: at the first common term, at most both tails are still to come
    met = met.where(F.col("w_a") * F.col("w_b") + F.col("rest_a") * F.col("rest_b") >= slack)
    pairs = met.select("cls_a", "cls_b").distinct()
    wide = classes.select("cls", "seq")
    pairs = pairs.join(wide.select(F.col("cls").alias("cls_a"), F.col("seq").alias("seq_a")), "cls_a").join(wide.select(F.col("cls").alias("cls_b"), F.col("seq").alias("seq_b")), "cls_b")
    shared = qna.sparkSession.sparkContext.broadcast(sketch)
    return members, pairs.mapInPandas(_verified(shared, bound, n_classes, threshold), "cls_a long, cls_b long")


def overlap_members(qna: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(qna_id, side, overlap_class, n_train, n_eval, n_links): every record whose target occurs on both sides, once, with the
    training and evaluation records of its class of exact copies and the other classes linked to it. No pairs are expanded."""
    members, links = overlap_classes(qna, threshold)
    ends = links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(links.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other"))).distinct().groupBy("cls").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("cls").agg(F.sum(1 - F.col("side")).alias("n_train"), F.sum("side").alias("n_eval"))
    per_class = sizes.join(ends, "cls", "left").select("cls", "n_train", "n_eval", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(per_class, "cls").select("qna_id", "side", F.col("cls").alias("overlap_class"), "n_train", "n_eval", "n_links")


def overlapping_pairs(qna: DataFrame) -> DataFrame:
    """(qna_id_a, qna_id_b), smaller first: all pairs of one training and one evaluation record that overlap."""
    members, links = overlap_classes(qna)
    train = members.where("side = 0").select(F.col("qna_id").alias("t"), F.col("cls").alias("cls_a"))
    held = members.where("side = 1").select(F.col("qna_id").alias("e"), F.col("cls").alias("cls_b"))
    near = train.join(links, "cls_a").join(held, "cls_b").select("t", "e")
    same = train.join(held, F.col("cls_a") == F.col("cls_b")).select("t", "e")
    found = near.unionByName(same)
    return found.select(F.least("t", "e").alias("qna_id_a"), F.greatest("t", "e").alias("qna_id_b")).distinct()


def overlap_report(qna: DataFrame) -> DataFrame:
    """(suite, repo_id, n_records, n_overlapping): evaluation records, and those with a training twin, per suite and repository."""
    members, links = overlap_classes(qna)
    hit_classes = links.select(F.col("cls_b").alias("cls")).unionByName(members.where("side = 0").select("cls")).distinct()
    hit = members.where("side = 1").join(hit_classes, "cls", "left_semi").select("qna_id").distinct().withColumn("hit", F.lit(1))
    suite = suite_of(F.col("cross_repo_split"), F.col("in_repo_split"))
    held = qna.where("qna_id is not null").select("qna_id", "repo_id", suite.alias("suite")).distinct().where("suite <> 'train'")
    return held.join(hit, "qna_id", "left").groupBy("suite", "repo_id").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_overlapping"))
