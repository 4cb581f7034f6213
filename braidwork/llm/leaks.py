"""Evaluation texts leaking into training text (problem 9).

Training tokens are stored once as a positional inverted index, sharded by document. Test items stay
distributed too. Every 15-word window of an item is looked up by its rarest term, by counts over the
whole corpus: the lists of that term are intersected, shifted by their offset, with those of the
next rarest, and each place left meets the windows of its term in a join, words around it included,
where the match is decided word by word. What travels to the shards are sketches of fixed size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.lookalike import skeleton
from braidwork.session import spread, stored

WINDOW = 15
RARE = 3  # terms of a window that must be found in their places before its words are compared
SHARD_TOKENS = 250_000  # tokens in a shard, about; a longer text is a shard of its own
SKETCH_BITS = 1 << 23  # bits of a sketch of keys: its size is fixed; a full one lets more through, but loses nothing

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"""</?[a-zA-Z][a-zA-Z0-9]{0,15}(?:\s+[a-zA-Z-]{1,30}(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"']+))?)*\s*/?>""")
_LINE_MARK = re.compile(r"(?m)^[ \t]*(?:[>*+#|/\-•·]+[ \t]*)*(?:\[[ xX]\]|\(?\d+(?:\.\d+)*[.):\]|]*|\(?[a-zA-Z][.):\]](?=\s))(?=\s|[|:.])")


def readings(text: str) -> list[list[str]]:
    """The words of a text without tags, look-alikes and case; and again without marks at line starts, where that differs. Texts shorter than a window have none."""
    text = skeleton(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    kept = _WORD.findall(text.casefold())
    if len(kept) < WINDOW:
        return []
    bare, marks = _LINE_MARK.subn(" ", text)
    if marks:
        other = _WORD.findall(bare.casefold())
        if other and len(other) != len(kept):
            return [kept, other]
    return [kept]


class _Hasher(dict):
    """Word to 64-bit term id; emptied when it has grown too large to be worth its memory."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word) - (1 << 63)
        self[word] = value
        return value


INDEX = pa.schema([(c, pa.binary()) for c in ("doc_ids", "readings", "starts", "terms", "codes", "offsets", "places")])
INDEX_TYPES = {"doc_ids": "<i8", "readings": "<i4", "starts": "<i8", "terms": "<i8", "codes": "<i4", "offsets": "<i8", "places": "<i4"}
INDEX_SQL = ", ".join(f"{c} binary" for c in INDEX.names)


def _shard(ids: list[int], numbers: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    """Postings of some documents: places[offsets[k]:offsets[k + 1]] are the places of terms[k], ascending."""
    terms, codes = np.unique(np.concatenate(lists), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(terms)))))
    columns = (ids, numbers, starts, terms, codes, offsets, np.argsort(codes, kind="stable"))
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(x, dtype=t).tobytes()], pa.binary()) for x, t in zip(columns, INDEX_TYPES.values(), strict=True)], schema=INDEX)


def positional_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard. Null, empty and short texts hold no window and are left out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = _Hasher()
        ids, numbers, lists, size = [], [], [], 0
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, reading in enumerate(readings(value) if value else []):
                    ids.append(row)
                    numbers.append(number)
                    lists.append(np.array([term[w] for w in reading], dtype=np.int64))
                    size += len(reading)
                if size >= SHARD_TOKENS:
                    yield _shard(ids, numbers, lists)
                    ids, numbers, lists, size = [], [], [], 0
        if ids:
            yield _shard(ids, numbers, lists)

    return spread(documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), text)).mapInArrow(build, INDEX_SQL)


def _columns(batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(batch.column(name)[row].as_py(), dtype=INDEX_TYPES[name]) for name in batch.schema.names}


def sketch_of(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for every key, in a fixed number of bits; rows that reach the driver: at most one per 64 bits."""
    slot = F.pmod(F.col(key), F.lit(SKETCH_BITS))
    words = keys.select(F.floor(slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    sketch = np.zeros(SKETCH_BITS // 64, dtype=np.uint64)
    sketch[words.word.to_numpy(dtype=np.int64)] = words.bits.to_numpy(dtype=np.int64).view(np.uint64)
    return sketch


def _in_sketch(sketch: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) & np.uint64(SKETCH_BITS - 1)
    return (sketch[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _pair_key(one: np.ndarray, other: np.ndarray, offset: np.ndarray | int) -> np.ndarray:
    """Key of two terms, the second `offset` words behind the first."""
    with np.errstate(over="ignore"):
        x = one.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (other.view(np.uint64) ^ (np.asarray(offset + 64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, pos, term): the words of every test item that has a window. Rows that repeat count once; of an id with several texts the smallest counts."""
    schema = pa.schema([("item_id", pa.int64()), ("pos", pa.int32()), ("term", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = _Hasher()
        for batch in batches:
            rows = [(i, (readings(t) or [[]])[0]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            n = [len(w) for _, w in rows]
            columns = (np.repeat([i for i, _ in rows], n), np.concatenate([np.empty(0), *map(np.arange, n)]), np.array([term[w] for _, x in rows for w in x], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema, strict=True)], schema=schema)

    once = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(item_id).cast("long").alias("item_id")).agg(F.min(text).alias("text"))
    return once.mapInArrow(read, "item_id long, pos int, term long")


def term_counts(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, n): occurrences in the whole corpus of the terms in a sketch."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard = _columns(batch, row)
                some = _in_sketch(shared.value, shard["terms"])
                yield pa.RecordBatch.from_arrays([pa.array(shard["terms"][some]), pa.array(np.diff(shard["offsets"])[some])], names=["term", "n"])

    return index.select("terms", "offsets").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


ANCHORS = pa.schema([("term", pa.int64()), ("item_id", pa.int64()), ("pos", pa.int32()), ("begin", pa.int32()), ("second", pa.int32()), ("third", pa.int32()), ("around", pa.binary()), ("keys", pa.list_(pa.int64()))])
ANCHORS_SQL = "term long, item_id long, pos int, begin int, second int, third int, around binary, keys array<long>"


def window_anchors(words: DataFrame, counts: DataFrame, slop: int) -> DataFrame:
    """A row per window of an item: its rarest term and where that stands (pos), the window's begin and the next rarest terms' places, all three from
    pos, the item's words around it, and the keys of the term with its second at every offset allowed. Windows of one anchor are one row if slop is 0.

    Counts are those of the corpus. A term that the corpus lacks rules its window out at slop 0, and is passed over otherwise.
    """
    rows = words.join(counts, "term", "left").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("words"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in ANCHORS]
            for item, listed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = listed.values
                term, n = (np.asarray(flat.field(c)).astype(np.int64) for c in ("term", "n"))
                order = np.argsort(np.where(np.lib.stride_tricks.sliding_window_view(n, WINDOW) > 0, np.lib.stride_tricks.sliding_window_view(n, WINDOW), np.iinfo(np.int64).max), axis=1, kind="stable")[:, :RARE]
                rare = order + np.arange(len(order))[:, None]
                present = (np.lib.stride_tricks.sliding_window_view(n, WINDOW) > 0).sum(axis=1)
                begin = np.flatnonzero(present == WINDOW if not slop else present >= RARE)
                rare = rare[begin]
                padded = np.concatenate((np.zeros(WINDOW - 1, np.int64), term, np.zeros(WINDOW - 1, np.int64)))
                around = np.lib.stride_tricks.sliding_window_view(padded, 2 * WINDOW - 1)
                keys = [{int(_pair_key(term[i : i + 1], term[j : j + 1], int(j - i) + s)[0]) for s in range(-slop, slop + 1)} for i, j in rare[:, :2]]
                if not slop:
                    joined: dict[int, set[int]] = {}
                    for i, k in zip(rare[:, 0].tolist(), keys, strict=True):
                        joined.setdefault(i, set()).update(k)
                    rare = np.repeat(np.array(sorted(joined), dtype=np.int64)[:, None], RARE, axis=1)
                    begin, keys = rare[:, 0], [joined[i] for i in rare[:, 0].tolist()]
                pos = rare[:, 0]
                found = (term[pos].tolist(), [item] * len(pos), pos.tolist(), (begin - pos).tolist(), (rare[:, 1] - pos).tolist(), (rare[:, 2] - pos).tolist(), [x.tobytes() for x in around[pos]], [sorted(k) for k in keys])
                for part, value in zip(parts, found, strict=True):
                    part.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, ANCHORS, strict=True)], schema=ANCHORS)

    return rows.mapInArrow(choose, ANCHORS_SQL)


PLACES = pa.schema([("term", pa.int64()), ("doc_id", pa.int64()), ("reading", pa.int32()), ("place", pa.int32()), ("words", pa.binary())])
PLACES_SQL = "term long, doc_id long, reading int, place int, words binary"


def anchor_places(index: DataFrame, anchors: np.ndarray, pairs: np.ndarray, slop: int) -> DataFrame:
    """Places of anchor terms beside which a second rarest term stands at a wanted offset, with the words around them."""
    shared = index.sparkSession.sparkContext.broadcast((anchors, pairs))
    reach = WINDOW - 1 + slop

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_wanted, pairs_wanted = shared.value
        for batch in batches:
            for row in range(len(batch)):
                x = _columns(batch, row)
                some = np.flatnonzero(_in_sketch(terms_wanted, x["terms"]))
                lists = [x["places"][x["offsets"][k] : x["offsets"][k + 1]] for k in some]
                at = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
                doc = np.searchsorted(x["starts"], at, side="right") - 1
                low, high = x["starts"][doc], x["starts"][doc + 1]
                own, alive = x["terms"][x["codes"][at]], np.zeros(len(at), dtype=bool)
                for offset in range(-reach, reach + 1):
                    inside = np.flatnonzero((at + offset >= low) & (at + offset < high) & ~alive) if offset else []
                    if len(inside):
                        key = _pair_key(own[inside], x["terms"][x["codes"][at[inside] + offset]], offset)
                        alive[inside[_in_sketch(pairs_wanted, key)]] = True
                at, doc, low, high, own = at[alive], doc[alive], low[alive], high[alive], own[alive]
                near = at[:, None] + np.arange(-reach, reach + 1)
                inside = (near >= low[:, None]) & (near < high[:, None])
                words = np.where(inside, x["terms"][x["codes"][np.where(inside, near, 0)]], 0)
                columns = [pa.array(own), pa.array(x["doc_ids"][doc]), pa.array(x["readings"][doc]), pa.array((at - low).astype(np.int32)), pa.array([w.tobytes() for w in words], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=PLACES)

    return index.mapInArrow(look, PLACES_SQL)


MATCHES = pa.schema([("doc_id", pa.int64()), ("reading", pa.int32()), ("item_id", pa.int64()), ("begin", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("n_words", pa.int32())])
MATCHES_SQL = "doc_id long, reading int, item_id long, begin int, first int, last int, n_words int"


def compared(met: DataFrame, slop: int) -> DataFrame:
    """Word by word: at slop 0 the equal words on both sides of the anchor; else the words of the window that stand within slop of their place, if its three rarest do."""
    width, reach = 2 * WINDOW - 1, WINDOW - 1 + slop

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            doc = np.frombuffer(b"".join(get["words"].to_pylist()), dtype="<i8").reshape(-1, 2 * reach + 1)
            item = np.frombuffer(b"".join(get["around"].to_pylist()), dtype="<i8").reshape(-1, width)
            pos, place = (np.asarray(get[c]).astype(np.int64) for c in ("pos", "place"))
            same = np.zeros(item.shape, dtype=bool)
            for shift in range(2 * slop + 1):
                same |= (doc[:, shift : shift + width] == item) & (item != 0)
            centre = WINDOW - 1
            if not slop:
                left = np.cumprod(same[:, centre - 1 :: -1], axis=1).sum(axis=1) if len(same) else pos
                right = np.cumprod(same[:, centre + 1 :], axis=1).sum(axis=1) if len(same) else pos
                n = left + right + 1
                keep = same[:, centre] & (n >= WINDOW)
                first, last = place - left, place + right
            else:
                row, begin = np.arange(len(same)), np.asarray(get["begin"]).astype(np.int64)
                upto = np.concatenate((np.zeros((len(same), 1), np.int64), np.cumsum(same, axis=1)), axis=1)
                n = upto[row, centre + begin + WINDOW] - upto[row, centre + begin]
                keep = same[:, centre] & same[row, centre + np.asarray(get["second"])] & same[row, centre + np.asarray(get["third"])]
                first, last = place + begin, place + begin + WINDOW - 1
            columns = (np.asarray(get["doc_id"]), np.asarray(get["reading"]), np.asarray(get["item_id"]), place - pos, first, last, n)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(f.type.to_pandas_dtype())) for c, f in zip(columns, MATCHES, strict=True)], schema=MATCHES)

    return met.select("doc_id", "reading", "place", "words", "item_id", "pos", "begin", "second", "third", "around").mapInArrow(compare, MATCHES_SQL)


def leaks(documents: DataFrame, items: DataFrame, slop: int = 0, least: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_words) of documents that hold a window of an item.

    At slop 0 windows match exactly and n_words is the longest run of the item's words, at least a
    window. With slop > 0 the three rarest terms of a window and, of its 15 words, at least `least`
    must stand within slop words of their places; n_words is the largest such number. Null, empty
    and shorter texts hold no window and match nothing; rows that repeat count once.
    """
    index = stored(positional_index(documents), "leak-index")
    words = stored(item_words(items), "leak-items")
    counts = term_counts(index, sketch_of(words.select("term").distinct(), "term"))
    anchors = stored(window_anchors(words, counts, slop), "leak-anchors")
    pairs = sketch_of(anchors.select(F.explode("keys").alias("key")), "key")
    places = anchor_places(index, sketch_of(anchors, "term"), pairs, slop)
    found = compared(places.join(anchors.drop("keys"), "term"), slop)
    if not slop:  # matches of one alignment that touch are one run
        alignment = Window.partitionBy("doc_id", "reading", "item_id", "begin").orderBy("first", "last")
        ended = found.withColumn("gap", F.coalesce(F.col("first") > F.max("last").over(alignment.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int"))
        run = ended.withColumn("run", F.sum("gap").over(alignment.rowsBetween(Window.unboundedPreceding, 0)))
        found = run.groupBy("doc_id", "reading", "item_id", "begin", "run").agg((F.max("last") - F.min("first") + 1).alias("n_words"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words")).where(F.col("n_words") >= least)
