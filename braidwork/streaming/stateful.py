"""Ordered state per repository: new assertions per file version, and recurrent steps."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

NEW = "repo_id string, seq int, path string, n_new int"


class FileKeys:
    """What each file of a repository asserted last: renames move it along, deletions forget it.

    Keys are 64-bit hashes, so the state of a repository is a few bytes per live assertion.
    """

    def __init__(self, state: dict[str, list[int]] | None = None):
        self.state = state or {}

    def apply(self, status: str | None, path: str, old_path: str | None, keys: Sequence[int] | None) -> int | None:
        """Number of keys new in this version; None for a deletion or a file without text."""
        if old_path and old_path != path and old_path in self.state:
            self.state[path] = self.state.pop(old_path)
        if (status or "").startswith("D") or keys is None:
            self.state.pop(path, None)
            return None
        fresh = set(keys) - set(self.state.get(path, ()))
        self.state[path] = sorted(set(keys))
        return len(fresh)


def new_assertions(changes: DataFrame) -> DataFrame:
    """W4 in batch: (repo_id, seq, path, n_new) for versions that bring new keys.

    changes: repo_id, seq, status, path, old_path, keys array<long>. A repository is an ordered
    sequence, so it is one group; its rows hold hashes, not text. Rows are sorted by the shuffle and
    streamed in Arrow batches, never gathered.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, files = None, FileKeys()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.repo_id != repo:
                    repo, files = r.repo_id, FileKeys()
                n = files.apply(r.status, r.path, r.old_path, None if r.keys is None else list(r.keys))
                if n:
                    out.append((r.repo_id, r.seq, r.path, n))
            yield pd.DataFrame(out, columns=["repo_id", "seq", "path", "n_new"])

    rows = changes.where("repo_id is not null and path is not null").select("repo_id", "seq", "status", "path", "old_path", "keys")
    return rows.repartition("repo_id").sortWithinPartitions("repo_id", "seq", "path").mapInPandas(walk, NEW)


class NewAssertionProcessor(StatefulProcessor):
    """The same walk as a streaming operator, its state kept per repository."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getValueState("files", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.files.get() if self.files.exists() else None
        files = FileKeys(json.loads(held[0]) if held else {})
        out = []
        for r in pd.concat(list(rows)).sort_values(["seq", "path"]).itertuples(index=False):
            n = files.apply(r.status, r.path, r.old_path, None if r.keys is None else list(r.keys))
            if n:
                out.append((key[0], r.seq, r.path, n))
        self.files.update((json.dumps({k: list(map(int, v)) for k, v in files.state.items()}),))
        yield pd.DataFrame(out, columns=["repo_id", "seq", "path", "n_new"])

    def close(self) -> None:
        pass


def stream_new_assertions(changes: DataFrame) -> DataFrame:
    """On a stream of file changes that arrive in order per repository; needs the RocksDB state store."""
    return changes.groupBy("repo_id").transformWithStateInPandas(NewAssertionProcessor(), outputStructType=NEW, outputMode="append", timeMode="none")


def recurrent_walk(rows: DataFrame, group: str, order: str, vector: str, step: Callable | None = None) -> DataFrame:
    """Z3: h_t = f(h_{t-1}, x_t) along each group, (group, order, state); f is the mean of both unless given.

    Null vectors leave the state as it is. Rows stream through in order; only the present state is held.
    """
    f = step or (lambda h, x: [(a + b) / 2 for a, b in zip(h, x, strict=True)])
    kinds = dict(rows.dtypes)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for g, o, x in frame.itertuples(index=False):
                if g != now:
                    now, state = g, None
                if x is not None:
                    state = list(map(float, x)) if state is None or len(state) != len(x) else f(state, x)
                out.append((g, o, state))
            yield pd.DataFrame(out, columns=[group, order, "state"])

    flat = rows.select(group, order, vector).repartition(group).sortWithinPartitions(group, order)
    return flat.mapInPandas(walk, f"{group} {kinds[group]}, {order} {kinds[order]}, state array<double>")


def evaluated_walk(rows: DataFrame, group: str, order: str, vector: str, step: Callable | None = None, score: Callable | None = None) -> DataFrame:
    """(group, order, score) at every step of a recurrent walk: the step's vector against the state before it.

    score is the cosine unless given; the first vector of a group, and null ones, have no score.
    """
    import numpy as np

    f = step or (lambda h, x: (h + x) / 2)
    cosine = score or (lambda h, x: float(h @ x / max(np.linalg.norm(h) * np.linalg.norm(x), 1e-300)))
    kinds = dict(rows.dtypes)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for g, o, x in frame.itertuples(index=False):
                if g != now:
                    now, state = g, None
                if x is None:
                    continue
                x = np.asarray(x, dtype=np.float64)
                if state is not None and len(state) == len(x):
                    out.append((g, o, cosine(state, x)))
                    state = f(state, x)
                else:
                    state = x
            yield pd.DataFrame(out, columns=[group, order, "score"])

    flat = rows.select(group, order, vector).repartition(group).sortWithinPartitions(group, order)
    return flat.mapInPandas(walk, f"{group} {kinds[group]}, {order} {kinds[order]}, score double")


def only_new(incoming: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been worked on, each key once."""
    return incoming.dropDuplicates([key]).join(done.select(key), key, "left_anti")
