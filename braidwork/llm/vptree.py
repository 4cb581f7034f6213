"""Most similar vectors for every vector (problem 4).

Every shard belongs to a vantage point, fitted on a bounded sample, and holds the vectors nearest to
it in a vantage-point tree. Shards and subtrees are pruned by the triangle inequality on chord
distances, with the search radius multiplied by a factor: at factor 1 the search is exact, below it
some neighbours behind a boundary may be lost. A vector of the shard of point v, where h is the
point nearest to the query, is no nearer than half of what v is farther away than h. Work is
batched: a node tests all its queries at once and a leaf is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import spread, stored

DIMENSION = 64
SHARD_ROWS = 4_096  # vectors in a shard, about; no task holds more than SHARD_ROWS * 2
MOST_SHARDS = 8_192  # vantage points of shards, at most (2 MB); over SHARD_ROWS times as many vectors, shards grow and are searched in blocks
SAMPLE_ROWS = 16  # vectors a shard, in the sample that fits its vantage point
QUERY_ROWS = 32_768  # queries that one task answers, at most
LEAF_ROWS = 128
RANGE_FACTOR = 0.3  # chords in d dimensions show a difference of about 1/sqrt(d) of their length to a vantage point
NEAREST_FACTOR = 0.2
ROUTING_FACTOR = 0.1  # between shards of the 10 nearest: boundaries run where vectors are few


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _vectors(column: pa.Array | list[bytes]) -> np.ndarray:
    joined = b"".join(column if isinstance(column, list) else column.to_pylist())
    return np.frombuffer(joined, dtype="<f4").reshape(-1, DIMENSION)


def chord(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ point)))


class Tree:
    """Vantage-point tree over unit vectors, split by rank, so that ties and copies still halve."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.x, self.nodes = x, []
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)), leaf_rows, rng)

    def _build(self, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        number = len(self.nodes)
        if len(rows) <= leaf_rows:
            self.nodes.append((rows, np.ascontiguousarray(self.x[rows].T)))
            return number
        self.nodes.append(None)
        probes = self.x[rng.choice(rows, 8)]
        some = self.x[rng.choice(rows, min(len(rows), 256))]
        vantage = probes[np.argmax([chord(some, p).var() for p in probes])]
        far = chord(self.x[rows], vantage)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        near_rows, far_rows = order[:half], order[half:]
        bounds = (far[near_rows[0]], far[near_rows[-1]], far[far_rows[0]], far[far_rows[-1]])
        near = self._build(rows[near_rows], leaf_rows, rng)
        self.nodes[number] = (vantage, bounds, near, self._build(rows[far_rows], leaf_rows, rng))
        return number

    def within(self, q: np.ndarray, cosine: float, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query rows, tree rows) whose cosine is at least the given one."""
        reach = factor * float(np.sqrt(2 - 2 * cosine))
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            number, qs = todo.pop()
            if not len(qs):
                continue
            node = self.nodes[number]
            if len(node) == 2:
                i, j = np.nonzero(q[qs] @ node[1] >= cosine - 1e-5)
                if len(i):
                    yield qs[i], node[0][j]
                continue
            vantage, (a, b, c, d), near, far = node
            away = chord(q[qs], vantage)
            todo.append((near, qs[(away >= a - reach) & (away <= b + reach)]))
            todo.append((far, qs[(away >= c - reach) & (away <= d + reach)]))

    def nearest(self, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, tree rows), k per query, best first; row -1 where there is none better than floor."""
        best = np.full((len(q), k), -2.0, dtype=np.float32)
        rows = np.full((len(q), k), -1, dtype=np.int64)
        if floor is not None:
            best[:] = floor[:, None]
        self._nearest(self.root, np.arange(len(q)), q, k, factor, best, rows)
        return best, rows

    def _nearest(self, number: int, qs: np.ndarray, q: np.ndarray, k: int, factor: float, best: np.ndarray, rows: np.ndarray) -> None:
        if not len(qs):
            return
        node = self.nodes[number]
        if len(node) == 2:
            members, columns = node
            score = q[qs] @ columns
            hit = score.max(axis=1) > best[qs, -1]
            qs, score = qs[hit], score[hit]
            if len(qs):
                score = np.concatenate([best[qs], score], axis=1)
                where = np.concatenate([rows[qs], np.broadcast_to(members, (len(qs), len(members)))], axis=1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
                best[qs], rows[qs] = np.take_along_axis(score, top, 1), np.take_along_axis(where, top, 1)
            return
        vantage, (a, b, c, d), near, far = node
        away = chord(q[qs], vantage)
        inner = away <= (b + c) / 2
        self._nearest(near, qs[inner], q, k, factor, best, rows)
        self._nearest(far, qs[~inner], q, k, factor, best, rows)
        reach = factor * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best[qs, -1]))
        self._nearest(far, qs[inner & (away >= c - reach) & (away <= d + reach)], q, k, factor, best, rows)
        self._nearest(near, qs[~inner & (away >= a - reach) & (away <= b + reach)], q, k, factor, best, rows)


class Router:
    """The shards' vantage points: sends vectors to the nearest one, and queries to every one in reach."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 11, turns: int = 5):
        rng = np.random.default_rng(seed)
        self.points = sample[rng.choice(len(sample), max(1, min(shards, MOST_SHARDS, len(sample))), replace=False)]
        self.shards = len(self.points)
        for _ in range(turns):  # points move to the middle of their shard, so that boundaries run where vectors are few
            home = self.home(sample)
            total = np.zeros_like(self.points)
            np.add.at(total, home, sample)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            self.points = np.where(length > 1e-6, total / np.maximum(length, 1e-6), self.points).astype(np.float32)

    def _parts(self, n: int) -> Iterator[slice]:
        step = max(1, (1 << 22) // self.shards)
        return (slice(i, i + step) for i in range(0, n, step))

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int32), *((x[p] @ self.points.T).argmax(axis=1).astype(np.int32) for p in self._parts(len(x)))])

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shards): every shard that may hold a vector within a row's reach."""
        rows, shards = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p in self._parts(len(x)):
            away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[p] @ self.points.T)))
            i, j = np.nonzero(away - away.min(axis=1, keepdims=True) <= 2 * reach[p, None] + 1e-6)
            rows.append(i + p.start), shards.append(j)
        return np.concatenate(rows), np.concatenate(shards)


def usable_vectors(df: DataFrame, field: str, row_id: str = "commit_sha") -> DataFrame:
    """(row_id, cls, vec) of vectors that are whole: not null, of the right length, finite, not zero. Copies share cls."""
    schema = pa.schema([("row_id", pa.string()), ("cls", pa.int64()), ("vec", pa.binary())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == DIMENSION)
            x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, DIMENSION)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            whole = np.isfinite(norm) & (norm > 0)
            packed = [v.tobytes() for v in x[whole]]
            cls = pa.array([xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[whole])), cls, pa.array(packed, pa.binary())], schema=schema)

    return df.where(F.col(row_id).isNotNull() & F.col(field).isNotNull()).select(row_id, field).transform(spread).mapInArrow(keep, "row_id string, cls long, vec binary")


def fit_router(classes: DataFrame, n: int) -> Router:
    """As many shards as n asks for. The sample's size is bounded by MOST_SHARDS * SAMPLE_ROWS; every vector is routed."""
    shards = min(MOST_SHARDS, -(-n // SHARD_ROWS))
    every = max(1, n // max(1024, shards * SAMPLE_ROWS))
    rows = classes.where(F.pmod(F.xxhash64("cls"), F.lit(every)) == 0).select("vec").limit(4 * max(1024, shards * SAMPLE_ROWS)).collect()
    return Router(_unit(_vectors([bytes(r.vec) for r in rows])) if rows else np.zeros((1, DIMENSION), np.float32), shards)


ROUTED = pa.schema([("shard", pa.int32()), ("role", pa.int32()), ("cls", pa.int64()), ("vec", pa.binary()), ("floor", pa.float32())])
ROUTED_SQL = "shard int, role int, cls long, vec binary, floor float"


def _routed(router: Router, factor: float, cosine: float | None, elsewhere: bool):
    """Index rows go home (role 0); queries go to every shard in reach, or, if elsewhere, to all of those but their own."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, packed = batch.column(0), batch.column(1)
            x = _unit(_vectors(packed)) if len(packed) else np.zeros((0, DIMENSION), np.float32)
            home = router.home(x)
            floor = np.asarray(batch.column(2)) if elsewhere else np.full(len(x), -2.0 if cosine is None else cosine, np.float32)
            if cosine is None and not elsewhere:
                rows, shards = np.arange(len(x)), home
            else:
                rows, shards = router.reached(x, factor * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * floor)))
                if elsewhere:
                    other = shards != home[rows]
                    rows, shards = rows[other], shards[other]
            for role, at, shard in ((0, np.arange(len(x)), home), (1, rows, shards)):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.full(len(at), role, np.int32)), cls.take(take), packed.take(take), pa.array(floor[at].astype(np.float32))], schema=ROUTED)

    return send


def _blocked(routed: DataFrame, router: Router) -> DataFrame:
    """Cut shards and query sets that are too large for a task into blocks; each meets each exactly once."""
    sizes = {(r.shard, r.role): r.n for r in routed.groupBy("shard", "role").agg(F.count("*").alias("n")).collect()}
    parts = [(s, -(-sizes.get((s, 0), 0) // (SHARD_ROWS * 2)) or 1, -(-sizes.get((s, 1), 0) // QUERY_ROWS) or 1) for s in range(router.shards)]
    table = routed.sparkSession.createDataFrame(parts, "shard int, n_index int, n_query int")
    salted = routed.join(F.broadcast(table), "shard")
    mine = F.when(F.col("role") == 0, F.pmod(F.xxhash64("cls", F.lit(1)), "n_index")).otherwise(F.pmod(F.xxhash64("cls", F.lit(2)), "n_query")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("n_query")).otherwise(F.col("n_index")) - 1))
    spread = salted.withColumn("mine", mine).withColumn("other", others)
    at = F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("other"))
    by = F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("mine"))
    return spread.select("shard", at.alias("index_block"), by.alias("query_block"), "role", "cls", "vec", "floor")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    role = np.asarray(table["role"])
    cls, floor = np.asarray(table["cls"]), np.asarray(table["floor"])
    raw = _vectors(table["vec"].to_pylist())
    index, query = role == 0, role == 1
    return cls[index], raw[index], cls[query], raw[query], floor[query], index


def similar_classes(classes: DataFrame, n: int, cosine: float, factor: float) -> DataFrame:
    """(cls_a, cls_b), a < b, of different vectors with at least the given cosine."""
    router = fit_router(classes, n)
    routed = stored(classes.select("cls", "vec").mapInArrow(_routed(router, factor, cosine, False), ROUTED_SQL), "vp-routed")
    schema = pa.schema([("cls_a", pa.int64()), ("cls_b", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        ids, x, query_ids, q, _, _ = _sides(table)
        if not len(ids) or not len(query_ids):
            return schema.empty_table()
        tree, unit = Tree(_unit(x)), _unit(q)
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for qi, xi in tree.within(unit, cosine, factor):
            other = query_ids[qi] != ids[xi]
            qi, xi = qi[other], xi[other]
            a, b = q[qi].astype(np.float64), x[xi].astype(np.float64)
            exact = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            qi, xi = qi[exact >= cosine], xi[exact >= cosine]
            found_a.append(np.minimum(query_ids[qi], ids[xi])), found_b.append(np.maximum(query_ids[qi], ids[xi]))
        return pa.Table.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], schema=schema)

    return _blocked(routed, router).groupBy("shard", "index_block", "query_block").applyInArrow(search, "cls_a long, cls_b long").distinct()


def similar_links(df: DataFrame, field: str = "diff_embedding", cosine: float = 0.95, factor: float = RANGE_FACTOR) -> tuple[DataFrame, DataFrame]:
    """(members, links): (row_id, cls) of all usable rows, copies of a vector being one class; (cls_a, cls_b) of classes that reach the cosine."""
    vectors = stored(usable_vectors(df, field), "vp-vectors")
    classes = stored(vectors.groupBy("cls").agg(F.first("vec").alias("vec")), "vp-classes")
    return vectors.select("row_id", "cls").distinct(), similar_classes(classes, classes.count(), cosine, factor)


def similar_pairs(df: DataFrame, field: str = "diff_embedding", cosine: float = 0.95, factor: float = RANGE_FACTOR) -> DataFrame:
    """(commit_sha_a, commit_sha_b), smaller first, of rows whose vectors reach the cosine.

    Copies of a vector are searched once and expanded at the end. Unusable vectors take no part;
    rows delivered again count once.
    """
    members, links = similar_links(df, field, cosine, factor)
    a, b = (members.select(F.col("row_id").alias(f"row_{x}"), F.col("cls").alias(f"cls_{x}")) for x in "ab")
    near = a.join(links, "cls_a").join(b, "cls_b").select("row_a", "row_b")
    same = a.join(b, F.col("cls_a") == F.col("cls_b")).where("row_a < row_b").select("row_a", "row_b")
    pairs = near.unionByName(same)
    return pairs.select(F.least("row_a", "row_b").alias("commit_sha_a"), F.greatest("row_a", "row_b").alias("commit_sha_b")).distinct()


def similar_members(df: DataFrame, field: str = "diff_embedding", cosine: float = 0.95, factor: float = RANGE_FACTOR) -> DataFrame:
    """(commit_sha, vector_class, n_copies, n_links): every usable row once, with the rows that share its vector and the other classes it reaches. No pairs are expanded."""
    members, links = similar_links(df, field, cosine, factor)
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("cls").agg(F.count("*").alias("n_copies"))
    per_class = copies.join(ends, "cls", "left").select("cls", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(per_class, "cls").select(F.col("row_id").alias("commit_sha"), F.col("cls").alias("vector_class"), "n_copies", "n_links")


def nearest_classes(classes: DataFrame, n: int, k: int, factor: float, routing: float) -> DataFrame:
    """(cls, other, cosine): up to k most similar other vectors of each vector."""
    router = fit_router(classes, n)
    schema = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("cosine", pa.float32())])

    def search(table: pa.Table) -> pa.Table:
        ids, x, query_ids, q, floor, _ = _sides(table)
        if not len(ids) or not len(query_ids):
            return schema.empty_table()
        tree = Tree(_unit(x))
        score, rows = tree.nearest(_unit(q), min(k + 1, len(ids)), factor, floor)
        flat = rows.ravel()
        cls = np.repeat(query_ids, rows.shape[1])
        other = ids[np.maximum(flat, 0)]
        good = (flat >= 0) & (cls != other)
        return pa.Table.from_arrays([pa.array(cls[good]), pa.array(other[good]), pa.array(score.ravel()[good])], schema=schema)

    def run(sent: DataFrame) -> DataFrame:
        return _blocked(sent, router).groupBy("shard", "index_block", "query_block").applyInArrow(search, "cls long, other long, cosine float")

    best = Window.partitionBy("cls").orderBy(F.desc("cosine"), "other")
    home = stored(run(stored(classes.select("cls", "vec").mapInArrow(_routed(router, routing, None, False), ROUTED_SQL), "vp-home")), "vp-near")
    floors = home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("cls").agg(F.min("cosine").alias("low"), F.count("*").alias("n"))
    known = classes.join(floors, "cls", "left").select("cls", "vec", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-1.0)).cast("float").alias("floor"))
    away = run(stored(known.mapInArrow(_routed(router, routing, None, True), ROUTED_SQL), "vp-away"))
    return home.unionByName(away).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def nearest_rows(df: DataFrame, field: str, k: int = 10, factor: float = NEAREST_FACTOR, routing: float = ROUTING_FACTOR) -> DataFrame:
    """(field, commit_sha, neighbour_sha, cosine, rank): the k most similar other rows of every usable row.

    factor relaxes the pruning inside shards, routing that between them; both 1 is exact. Equal
    cosines are ranked by the neighbour's id. Rows that hold the same vector are neighbours
    at cosine 1; no more than k + 1 of them are ever needed.
    """
    vectors = stored(usable_vectors(df, field), "vp-vectors")
    classes = stored(vectors.groupBy("cls").agg(F.first("vec").alias("vec")), "vp-classes")
    links = nearest_classes(classes, classes.count(), k, factor, routing)
    members = stored(vectors.select("row_id", "cls").distinct(), "vp-members")
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("row_id"))).where(F.col("place") <= k + 1)
    own = classes.select("cls", F.col("cls").alias("other"), F.lit(1.0).cast("float").alias("cosine"))
    reach = links.select("cls", "other", "cosine").unionByName(own)
    options = reach.join(few.select(F.col("cls").alias("other"), F.col("row_id").alias("neighbour_sha")), "other").select("cls", "neighbour_sha", "cosine")
    short = options.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("cosine"), "neighbour_sha"))).where(F.col("place") <= k + 1).drop("place")
    rows = members.join(short, "cls").where(F.col("row_id") != F.col("neighbour_sha"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("cosine"), "neighbour_sha"))).where(F.col("rank") <= k)
    return ranked.select(F.lit(field).alias("field"), F.col("row_id").alias("commit_sha"), "neighbour_sha", F.round(F.col("cosine").cast("double"), 5).alias("cosine"), "rank")
