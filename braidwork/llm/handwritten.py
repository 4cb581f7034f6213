"""Generated, minified, vendored source files and data saved as code (problem 7).

Each text gets a Re-Pair grammar over its tokens, inferred until no pair repeats. A grammar that
reuses its rules for most of the text marks a generated file. The characters of its literals get a
grammar too: literals that compress no better than their own characters in random order are data.
The start rule is cut into long rules at places that depend on the tokens near them only, so that
copies with local changes share most of them; a file made up of rules that occur in several
repositories is vendored code. Every rule, the whole file included, is named by a hash of what it
stands for, so equal rules have equal names wherever they come from. Paths and head comments are
two more signals; `file_signals` tells which signals speak for each file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut_lineage, spread, stored

LONG_RULE = 16  # tokens a rule, or a whole file, must stand for before its repositories are counted: fewer are alike by chance
SHARED_BY = 3  # repositories that make a long rule shared; two are enough for a whole file
SHARED_PART = 0.5  # part of a file's tokens, head comments aside, that shared rules must exceed
LONG_LINE = 120  # characters that make a line of code a long one
INCOMPRESSIBLE = 0.9  # size of a literal's grammar against that of its shuffled characters: data 0.94 and more, words 0.6 to 0.95

# Endings of source files (prose and configuration are not source).
SOURCE = "py pyi pyx js mjs cjs jsx ts tsx vue c h cc cpp cxx hpp hh hxx m mm cs java kt kts scala go rs rb php pl pm swift lua r jl sh bash zsh ps1 sql css scss less dart ex exs erl hs clj ml fs groovy asm s vb pas f90 proto coffee"
# Folders of other people's code, and names of files that tools write.
VENDOR_DIRS = "vendor _vendor vendored third_party third-party thirdparty 3rdparty extern external node_modules bower_components site-packages dist-packages Godeps Pods jspm_packages"
GENERATED_DIRS = "_generated __generated__ generated autogen gen-py gen-js"
GENERATED_NAMES = r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h)|\.pb2\.py|_generated\.\w+|\.generated\.\w+|\.g\.(cs|dart)|\.designer\.cs|_rc\.py|\.freezed\.dart|lextab\.py|yacctab\.py|parsetab\.py)$"
MINIFIED_NAMES = r"([.-]min\.(js|css|mjs|cjs)|\.bundle\.js|\.chunk\.js)$"

_TOKEN = re.compile(r"""[A-Za-z_]\w*|\d[\w.]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\s\w]""")
_COMMENT = re.compile(r"^\s*(?:#(?!include|define|if|pragma)|//|/\*+|\*|;|--|<!--|%)\s*!?(.*)")
_SAYS_GENERATED = re.compile(
    r"(?i)@generated\b|\bauto-?\s?generated\b|\bdo not (?:edit|modify|change)\b|\b(?:is|was|been) (?:automatically |auto-?)?generated\b|^\s*(?:code |file )?(?:automatically )?generated (?:by|from|with|using)\b|\b(?:file|code|module|source) was (?:produced|created|built|written) by\b|\b(?:automatically|auto-?) ?(?:created|produced|built|written)\b|\b(?:manual|hand|local) (?:changes|edits) will be (?:lost|overwritten)\b|\bproduced by \S+ from\b"
)
_SAYS_VENDORED = re.compile(
    r"(?i)\bcopied (?:verbatim )?from\b|\bbundled copy\b|\bvendored (?:from|copy)\b|\bupstream (?:sources?|at|version)\b|\bin sync with\b|\bdo not patch\b|\bredistribution (?:permitted|and use)\b|\(c\)\s+(?:\d{4}|the \S+ (?:developers|authors|contributors|team))|\bcopyright\b.*\b(?:developers|authors|contributors)\b|\ball rights reserved\b|^\s*\S+ v?\d+\.\d+(?:\.\d+)?\s+(?:\(c\)|\|)|\bv?\d+\.\d+\.\d+ - bundled\b|\b(?:imported|taken|derived|forked|pulled|synced|mirrored|copied) from \S+ (?:\(|v?\d|at |release|tag|version)|\blocal changes go to\b"
)
_NOT_SO = re.compile(r"(?i)\bby hand\b|\bhand-?written\b|\bregenerate\b|\bnot generated\b|\bmanual(?:ly)?\b")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0x[0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)(?![\w.])")
# The alphabets that bytes are written in: base 16 to 64, escapes, and digits with the marks between them.
_PAYLOAD = re.compile(r"[A-Za-z0-9+/=_-]+|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{1,3})+|[-+0-9.,;:eE]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LITERAL = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'")


def head_says(text: str) -> tuple[bool, bool]:
    """What comments before the first line of code say: (generated, vendored)."""
    generated = vendored = False
    for line in text[: head_end(text)].split("\n"):
        comment = _COMMENT.match(line)
        if not comment:
            continue
        said = comment.group(1)
        if not _NOT_SO.search(said):
            generated = generated or _SAYS_GENERATED.search(said) is not None
            vendored = vendored or _SAYS_VENDORED.search(said) is not None
    return generated, vendored


def head_end(text: str) -> int:
    """Where the first line of code begins."""
    start = 0
    while start < len(text):
        stop = text.find("\n", start)
        line = text[start : stop if stop >= 0 else len(text)]
        if line.strip() and not _COMMENT.match(line):
            return start
        start = stop + 1 if stop >= 0 else len(text)
    return start


def minified(text: str) -> bool:
    """Long lines of dense code with hardly a blank and short names."""
    code = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    if max(map(len, code.split("\n"))) < LONG_LINE:
        return False
    bare = _LITERAL.sub("", code)
    names = re.findall(r"[A-Za-z_$]\w*", bare)
    marks = sum(bare.count(c) for c in ";{}(),=")
    blanks = sum(c.isspace() for c in bare) / max(1, len(bare))
    short = sum(len(n) <= 2 for n in names) / max(1, len(names))
    return blanks <= 0.16 and marks >= 0.08 * len(bare) and short >= 0.4


def literal_payload(text: str) -> tuple[str, float]:
    """What may be data in a text: digits of numbers and strings in an encoding's alphabet; and the share of the visible characters they take, marks between them included."""
    visible = sum(map(len, text.split()))
    if not visible:
        return "", 0.0
    strings = [s for s in (a or b for a, b in _LITERAL.findall(text)) if s and _PAYLOAD.fullmatch(s)]
    numbers = _NUMBER.findall(_LITERAL.sub('""', text))
    taken = sum(len(s) + 2 for s in strings) + sum(len(n) + 1 for n in numbers)
    return "".join(strings) + "".join(re.sub(r"^[-+]?(?:0[xX])?|[_.]", "", n) for n in numbers), min(1.0, taken / visible)


def data_shares(texts: list[str]) -> list[float]:
    """Share of each text's visible characters in near-incompressible literals.

    The literals' characters get a Re-Pair grammar, and so do the same characters in random order:
    where order saves less than a tenth there is no structure to it. The comparison says nothing, and
    the literals are not counted, where they are so few that no pair repeats by chance either. Both
    grammars are inferred for every text whose literals take enough room to matter at all.
    """
    found = [literal_payload(t) for t in texts]
    rows = [i for i, (_, share) in enumerate(found) if share >= DATA]
    if not rows:
        return [0.0] * len(texts)
    order = np.random.default_rng(5)
    plain = [np.frombuffer(found[i][0].encode("utf-32-le"), dtype="<u4").astype(np.uint64) * _ODD for i in rows]
    mixed = [order.permutation(x) for x in plain]
    size, at_random = grammars(plain), grammars(mixed)
    chance = [len(np.unique(_mix(y[:-1], y[1:]))) < len(y) - 1 for y in mixed]
    dense = {i for i, a, b, some in zip(rows, size.tolist(), at_random.tolist(), chance, strict=True) if some and a >= INCOMPRESSIBLE * b}
    return [share if i in dense else 0.0 for i, (_, share) in enumerate(found)]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


def grammars(sequences: list[np.ndarray]) -> np.ndarray:
    """Sizes of the Re-Pair grammars of many sequences, inferred side by side until no pair repeats.

    Every round replaces, in each sequence, the repeated pairs that are more frequent than the pairs
    next to them; the most frequent pair of each is always among them, so the rounds come to an end.
    Overlapping uses of a pair of equal symbols count once. A symbol is the polynomial hash of what
    it stands for. Symbols in no repeated pair can never enter one later and leave the work.
    """
    n_docs = len(sequences)
    size = np.zeros(n_docs, dtype=np.int64)
    symbol = np.concatenate([np.empty(0, np.uint64), *sequences])
    doc = np.repeat(np.arange(n_docs), np.array([len(s) for s in sequences], dtype=np.int64))
    place = np.arange(len(symbol))
    span = np.ones(len(symbol), dtype=np.int64)
    power = np.full(len(symbol), _ODD)
    while len(symbol) > 1:
        joined = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + span[:-1])
        key = _mix(symbol[:-1], symbol[1:]) ^ (doc[:-1].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        number = np.arange(len(key))
        overlaps = np.concatenate(([False], (key[1:] == key[:-1]) & joined[1:] & joined[:-1]))
        usable = joined & ((number - np.maximum.accumulate(np.where(overlaps, 0, number))) % 2 == 0)
        _, inverse, counts = np.unique(np.where(usable, key, number.astype(np.uint64)), return_inverse=True, return_counts=True)
        count = np.where(usable, counts[inverse], 0)
        repeated = count >= 2
        if not repeated.any():
            break
        # Equal counts are settled by the pair's name, so that all its uses are decided alike.
        name = _mix(symbol[1:], symbol[:-1])
        above = (count[1:] > count[:-1]) | ((count[1:] == count[:-1]) & (name[1:] > name[:-1]))
        chosen = repeated.copy()
        chosen[1:] &= above
        chosen[:-1] &= ~above
        chosen &= np.bincount(inverse[chosen], minlength=len(counts))[inverse] >= 2  # a rule needs two uses left
        at = np.flatnonzero(chosen)
        first = np.unique(inverse[at], return_index=True)[1]
        size += 2 * np.bincount(doc[at[first]], minlength=n_docs)
        with np.errstate(over="ignore"):
            symbol[at] += power[at] * symbol[at + 1]
            power[at] *= power[at + 1]
        span[at] += span[at + 1]
        gone = np.zeros(len(symbol), dtype=bool)
        gone[at + 1] = True
        live = np.concatenate((repeated, [False])) | np.concatenate(([False], repeated))
        size += np.bincount(doc[~live & ~gone], minlength=n_docs)
        keep = live & ~gone
        symbol, power, doc, place, span = symbol[keep], power[keep], doc[keep], place[keep], span[keep]
    return size + np.bincount(doc, minlength=n_docs)


def rule_names(symbols: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The names of the rules that stand for symbols[edges[i]:edges[i + 1]]: polynomial hashes, as `grammars` names its rules."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(symbols), _ODD))))
        inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(symbols), np.uint64(pow(int(_ODD), -1, 1 << 64))))))
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * powers[: len(symbols)])))
        return (upto[edges[1:]] - upto[edges[:-1]]) * inverse[edges[:-1]]


def start_rules(symbols: np.ndarray, least: int = LONG_RULE) -> tuple[list[int], list[int]]:
    """Rules of at least `least` tokens that make up a sequence, by name, and the tokens each stands for.

    A cut falls where the hash of three tokens is below all others within `least` places: equal
    stretches of different files are cut alike, whatever stands before and after them.
    """
    n = len(symbols)
    if n < least:
        return [], []
    cuts = np.empty(0, np.int64)
    if n > 2 * least + 3:
        mark = _mix(_mix(symbols[:-2], symbols[1:-1]), symbols[2:])
        view = np.lib.stride_tricks.sliding_window_view(mark, 2 * least + 1)
        middle = view[:, least]
        low = view.min(axis=1)
        at = np.flatnonzero(middle == low)
        cuts = at[(view[at] == low[at, None]).sum(axis=1) == 1] + least
    edges = np.concatenate(([0], cuts, [n]))
    names, spans = rule_names(symbols, edges).view(np.int64), np.diff(edges)
    return names[spans >= least].tolist(), spans[spans >= least].tolist()


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        if token[0] in "\"'":
            shape = "S"
        elif token[0].isdigit():
            shape = "0"
        else:
            shape = re.sub(r"\d+", "0", token)
        value = xxhash.xxh64_intdigest(shape)
        self[token] = value
        return value


def _slices(batch: pa.RecordBatch, rows: int = 2000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and, single long texts aside, characters."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
        if i > start and (i - start >= rows or size + n > chars):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(batch) > start:
        yield batch.slice(start)


FEATURES = "blob_sha string, generated boolean, vendored boolean, minified boolean, data_share float, n_tokens int, reuse float, whole long, n_body int, rules array<long>, spans array<int>"


def blob_features(blobs: DataFrame) -> DataFrame:
    """One row per blob with what its text and its grammar say. Null and empty texts give a row without signs."""
    schema = pa.schema([("blob_sha", pa.string()), ("generated", pa.bool_()), ("vendored", pa.bool_()), ("minified", pa.bool_()), ("data_share", pa.float32()), ("n_tokens", pa.int32()), ("reuse", pa.float32()), ("whole", pa.int64()), ("n_body", pa.int32()), ("rules", pa.list_(pa.int64())), ("spans", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for batch in batches:
            for part in _slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                sequences = [np.array([known[t] for t in _TOKEN.findall(x)], dtype=np.uint64) for x in texts]
                n = np.array([len(s) for s in sequences])
                whole = [int(rule_names(s, np.array([0, len(s)])).view(np.int64)[0]) for s in sequences]
                size = grammars(sequences)
                bodies = [s[len(_TOKEN.findall(x[: head_end(x)])) :] for s, x in zip(sequences, texts, strict=True)]
                rules, spans = zip(*map(start_rules, bodies), strict=True)
                said = [head_says(x) for x in texts]
                columns = [part.column(0), [s[0] for s in said], [s[1] for s in said], [minified(x) for x in texts], data_shares(texts), n.astype(np.int32), np.where(n > 0, 1 - size / np.maximum(n, 1), 0.0), whole, [len(b) for b in bodies], rules, spans]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(blobs.where("blob_sha is not null").select("blob_sha", "text")).mapInArrow(read, FEATURES)


def _dirs(names: str) -> str:
    return "(^|/)(" + "|".join(re.escape(n) for n in names.split()) + ")/"


def is_source(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*SOURCE.split()) & path.contains(".")


def path_kind(path: Column) -> Column:
    """vendored, minified or generated by what the path says; null otherwise."""
    return F.when(path.rlike(_dirs(VENDOR_DIRS)), "vendored").when(path.rlike(MINIFIED_NAMES), "minified").when(path.rlike(_dirs(GENERATED_DIRS)) | path.rlike(GENERATED_NAMES), "generated")


REUSE = 0.42  # written code seldom repeats more than a third of itself, templates hardly less than half
DATA = 0.5
SIGNALS = ("head_vendored", "minified", "incompressible", "head_generated", "reuse", "shared_rules")


def blob_signals(rows: DataFrame, features: DataFrame, reuse: float, data: float) -> DataFrame:
    """(blob_sha, one boolean per signal) of blobs with any. rows: (repo_id, blob_sha).

    Rules of LONG_RULE tokens or more are counted in one name space: a file's own name, shared by two
    repositories, makes it vendored, and so do long rules of three or more that make up over SHARED_PART of its tokens.
    """
    long = features.select("blob_sha", "whole", "n_tokens", "n_body", "rules", "spans").dropDuplicates(["blob_sha"])
    placed = rows.select("repo_id", "blob_sha").distinct().join(long.where(F.col("n_tokens") >= LONG_RULE), "blob_sha")
    both = placed.groupBy("whole").agg(F.count_distinct("repo_id").alias("repos")).where("repos >= 2").select("whole")
    shared = placed.select("repo_id", F.explode("rules").alias("rule")).distinct().groupBy("rule").agg(F.count("*").alias("repos")).where(F.col("repos") >= SHARED_BY).select("rule")
    uses = long.select("blob_sha", "n_body", F.explode(F.arrays_zip("rules", "spans")).alias("r")).select("blob_sha", "n_body", F.col("r.rules").alias("rule"), F.col("r.spans").alias("span"))
    made_up = uses.join(shared, "rule", "left_semi").groupBy("blob_sha", "n_body").agg(F.sum("span").alias("common")).where(F.col("common") > SHARED_PART * F.col("n_body")).select("blob_sha")
    copied = long.join(both, "whole", "left_semi").select("blob_sha").union(made_up).distinct().withColumn("copied", F.lit(True))
    said = (F.col("vendored"), F.col("minified"), F.col("data_share") >= data, F.col("generated"), F.col("reuse") >= reuse, F.coalesce("copied", F.lit(False)))
    all_of = features.join(copied, "blob_sha", "left").select("blob_sha", *(c.alias(n) for c, n in zip(said, SIGNALS, strict=True))).distinct()
    return all_of.where(" or ".join(SIGNALS))


def text_kind() -> Column:
    return (
        F.when(F.col("head_vendored"), "vendored").when(F.col("minified"), "minified").when(F.col("incompressible"), "data")
        .when(F.col("head_generated") | F.col("reuse"), "generated").when(F.col("shared_rules"), "vendored")
    )


def _change_rows(changes: DataFrame) -> DataFrame:
    return changes.where("repo_id is not null and path is not null").select("repo_id", "path", "old_path", F.col("new_blob").alias("blob_sha")).distinct()


def file_kinds(changes: DataFrame, blobs: DataFrame, reuse: float = REUSE, data: float = DATA) -> DataFrame:
    """(repo_id, path, kind) of every source path that is not hand-written, paths before a rename included.

    A path has the first kind that any of its versions shows, in the order vendored, minified,
    data, generated. Rows without repository or path say nothing; a blob that is missing leaves the path to speak.
    """
    rows = _change_rows(changes)
    features = stored(blob_features(blobs), "file-features")
    by_text = cut_lineage(blob_signals(rows, features, reuse, data).select("blob_sha", text_kind().alias("text_kind")))
    judged = rows.join(by_text, "blob_sha", "left")
    said = judged.withColumn("kind", F.coalesce(path_kind(F.col("path")), path_kind(F.col("old_path")), "text_kind"))
    marked = cut_lineage(said.where("kind is not null").select("repo_id", F.explode(F.array("path", "old_path")).alias("path"), "kind").where("path is not null").distinct())
    moves = rows.where("old_path is not null and old_path <> path")
    steps = cut_lineage(moves.select("repo_id", "path", F.col("old_path").alias("other")).unionByName(moves.select("repo_id", F.col("old_path").alias("path"), F.col("path").alias("other"))).distinct())
    fresh = marked
    while True:  # a file keeps its kind through renames, in both directions; a turn goes on from new rows only
        reached = steps.join(fresh, ["repo_id", "path"]).select("repo_id", F.col("other").alias("path"), "kind").distinct()
        fresh = cut_lineage(reached.join(marked, ["repo_id", "path", "kind"], "left_anti"))
        if fresh.isEmpty():
            break
        marked = marked.unionByName(fresh)
    order = F.when(F.col("kind") == "vendored", 0).when(F.col("kind") == "minified", 1).when(F.col("kind") == "data", 2).otherwise(3)
    best = marked.where(is_source(F.col("path"))).groupBy("repo_id", "path").agg(F.min_by("kind", order).alias("kind"))
    return best


def signal_counts(changes: DataFrame, blobs: DataFrame, reuse: float = REUSE, data: float = DATA) -> DataFrame:
    """(signals, n_paths): how many source paths each set of signals speaks for; a set of one decides alone.

    Signals of all versions of a path are taken together; renames are not followed here.
    """
    rows = _change_rows(changes).where(is_source(F.col("path")))
    features = stored(blob_features(blobs), "file-features")
    names = F.filter(F.array(*(F.when(F.col(n), n) for n in ("path", *SIGNALS))), lambda x: x.isNotNull())
    spoken = rows.join(blob_signals(rows, features, reuse, data), "blob_sha", "left").withColumn("path_says", path_kind(F.col("path")).isNotNull())
    paths = spoken.groupBy("repo_id", "path").agg(F.max("path_says").alias("says"), *(F.max(F.coalesce(n, F.lit(False))).alias(n) for n in SIGNALS)).drop("path").withColumnRenamed("says", "path")
    return paths.select(F.array_join(names, "+").alias("signals")).where("signals <> ''").groupBy("signals").agg(F.count("*").alias("n_paths"))


def hand_written(changes: DataFrame, blobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, path): source paths that remain, for the repositories of the snapshots in any spelling."""
    from braidwork.llm.grouping import project_of

    kept = snapshots.select(project_of(F.col("repo_id")).alias("project")).where("project is not null").distinct()
    paths = changes.where("repo_id is not null and path is not null").select("repo_id", "path").distinct().where(is_source(F.col("path")))
    mine = paths.withColumn("project", project_of(F.col("repo_id"))).join(kept, "project", "left_semi").drop("project")
    return mine.join(file_kinds(changes, blobs).select("repo_id", "path"), ["repo_id", "path"], "left_anti")
