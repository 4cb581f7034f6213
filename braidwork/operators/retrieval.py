"""Lexical and dense retrieval, rank fusion, packing of context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.text import search_tokens
from braidwork.session import stored

K1, B = 1.5, 0.75
FUSION = 60
# How examples are set before a question.
SHOT_HEAD, SHOT_BREAK, SHOT_ASK = "# Examples of assertion completions:\n\n", "\n\n# ---\n\n", "\n\n# ---\n\n# Now complete the following assertion:\n"


def _query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(query_id, F.explode(search_tokens(F.col(text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qf"))


DOCUMENT = "\0"  # stands among the terms of every document once, so that one pass tells their number and length too


def _postings(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(term, doc_id, dl, tf) of the wanted terms, and of DOCUMENT."""
    tokens = docs.select(doc_id, search_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
    words = tokens.select(doc_id, F.size("tokens").alias("dl"), F.explode(F.array_append("tokens", F.lit(DOCUMENT))).alias("term"))
    kept = wanted.unionByName(wanted.sparkSession.createDataFrame([(DOCUMENT,)], "term string"))
    return words.join(kept, "term", "left_semi").groupBy("term", doc_id, "dl").agg(F.count("*").alias("tf"))


def _share(tf: str, dl: str, avgdl: str) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col(avgdl)))


def _known_terms(postings: DataFrame) -> DataFrame:
    """(term, avgdl, idf, top): idf = ln((N - df + .5) / (df + .5) + 1), and the most that the term adds to any document per query use."""
    totals = postings.where(F.col("term") == DOCUMENT).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    rows = postings.where(F.col("term") != DOCUMENT).join(F.broadcast(totals))  # one row beside each
    per_term = rows.groupBy("term").agg(F.count("*").alias("df"), F.max(_share("tf", "dl", "avgdl")).alias("share"), F.max("n_docs").alias("n_docs"), F.max("avgdl").alias("avgdl"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return per_term.select("term", "avgdl", idf.alias("idf"), (idf * F.col("share")).alias("top"))


def _part() -> Column:
    return F.col("qf") * F.col("idf") * _share("tf", "dl", "avgdl")


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of every pair with a common term; all others score 0.

    A term that a query repeats counts as often. The postings are restricted to the query terms
    before they are shuffled. For the best few use `bm25_top_k`.
    """
    terms = _query_terms(queries, query_id, text)
    postings = _postings(docs, doc_id, text, terms.select("term").distinct())
    return postings.join(terms.join(_known_terms(postings), "term"), "term").groupBy(query_id, doc_id).agg(F.sum(_part()).alias("score"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int, text: str = "text", digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank from 0), exact, ties by doc_id after rounding.

    What a term adds at most to any document is known from its list. A query's terms are ordered by
    that bound. Scores by the upper half of them give a floor for its k-th best score; terms whose
    bounds together stay under the floor, the stop words above all, cannot bring a new document among
    the best. So only documents with another term are candidates, and long lists are joined with
    candidates instead of paired with queries.
    """
    terms = stored(_query_terms(queries, query_id, text), "bm25-terms")
    postings = stored(_postings(docs, doc_id, text, terms.select("term").distinct()), "bm25-postings")
    weighed = terms.join(_known_terms(postings), "term").withColumn("bound", F.col("qf") * F.col("top"))
    below = F.sum("bound").over(Window.partitionBy(query_id).orderBy("bound", F.desc("term")))
    place = F.percent_rank().over(Window.partitionBy(query_id).orderBy(F.desc("bound"), "term"))
    weighed = stored(weighed.withColumn("below", below).withColumn("place", place), "bm25-bounds")
    high = postings.join(weighed.where("place <= 0.5"), "term").groupBy(query_id, doc_id).agg(F.sum(_part()).alias("s"))
    kth = high.withColumn("_r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("s"), doc_id))).where(F.col("_r") <= k).groupBy(query_id).agg(F.when(F.count("*") == k, F.min("s")).alias("floor"))
    judged = weighed.join(kth, query_id, "left").withColumn("essential", F.col("below") + 10.0**-digits >= F.coalesce("floor", F.lit(0.0)))
    judged = judged.select(query_id, "term", "qf", "idf", "avgdl", "essential")
    core = stored(postings.join(judged.where("essential"), "term").groupBy(query_id, doc_id).agg(F.sum(_part()).alias("s")), "bm25-candidates")
    rest = judged.where("not essential").drop("essential")
    more = postings.join(rest, "term").join(core.select(query_id, doc_id), [query_id, doc_id], "left_semi").select(query_id, doc_id, _part().alias("s"))
    total = core.unionByName(more).groupBy(query_id, doc_id).agg(F.sum("s").alias("score"))
    best = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", digits)), doc_id)
    return total.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)


def dense_top_k(base: DataFrame, queries: DataFrame, base_id: str, query_id: str, vector: str, k: int) -> DataFrame:
    """Exact cosine top-k of a stated query set against all rows, (query_id, base_id, cosine, rank).

    The query set is spread over the base in blocks of matrix products; each block of base rows keeps
    k + 1 per query and all that tie with the last, so about k rows per block and query are shuffled.
    Base rows of another width than the queries, whose width is that of one of them, have no cosine. Queries are broadcast, and their number
    is checked first: beyond a million numbers they are searched in several passes.
    """
    from braidwork.functions.vectors import is_finite

    rows = queries.where(is_finite(F.col(vector))).select(query_id, vector)
    width = max((len(r[vector]) for r in rows.limit(1).collect()), default=1)
    per_pass = max(1, 1_000_000 // width)
    n = rows.count()
    passes = -(-n // per_pass) or 1
    found = None
    types = dict(base.dtypes)[base_id], dict(queries.dtypes)[query_id]
    for i in range(passes):
        block = rows.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == i).toPandas()
        q = np.array(block[vector].tolist(), dtype=np.float64).reshape(len(block), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(block) else q
        shared = base.sparkSession.sparkContext.broadcast((block[query_id].to_numpy(), q))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for frame in frames:
                frame = frame[[len(v) == q.shape[1] for v in frame.v]] if len(q) else frame[:0]
                if not len(frame):
                    continue
                x = np.array(frame.v.tolist(), dtype=np.float64)
                score = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                score = np.round(score, 9)
                kth = np.partition(score, -min(k + 1, score.shape[1]), axis=1)[:, -min(k + 1, score.shape[1])]
                i, j = np.nonzero(score >= kth[:, None])  # ties with the last place kept, itself among the first
                yield pd.DataFrame({"q": names[i], "b": frame.b.to_numpy()[j], "cosine": score[i, j]})

        part = base.where(is_finite(F.col(vector))).select(F.col(base_id).alias("b"), F.col(vector).alias("v")).mapInPandas(search, f"q {types[1]}, b {types[0]}, cosine double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "b")
    ranked = found.where(F.col("q").cast("string") != F.col("b").cast("string")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("b").alias(base_id), F.round("cosine", 6).alias("cosine"), "rank")


def fused(rankings: list[DataFrame], query_id: str, doc_id: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, rank from 0), best k per query, ties by doc_id."""
    parts = [r.select(query_id, doc_id, (F.lit(1.0) / (FUSION + F.col("rank") + 1)).alias("s")) for r in rankings]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    scores = union.groupBy(query_id, doc_id).agg(F.sum("s").alias("score"))
    best = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), doc_id)
    return scores.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)


def few_shot_prompts(queries: DataFrame, examples: DataFrame, query_id: str, prefix: str, example: str, rank: str) -> DataFrame:
    """(query_id, prompt): a query's examples, best first, set before it; a query without examples is its prefix alone.

    Examples are few per query: choose them by a top-k before.
    """
    lists = examples.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(example).alias("e")))), lambda x: x.e), SHOT_BREAK).alias("_shots"))
    shown = F.concat(F.lit(SHOT_HEAD), F.col("_shots"), F.lit(SHOT_ASK), F.col(prefix))
    return queries.join(lists, query_id, "left").select(query_id, F.coalesce(shown, F.col(prefix)).alias("prompt"))


def window_index(docs: DataFrame, doc_id: str, text: str, size: int, overlap: int, least: int) -> DataFrame:
    """(doc_id, window, tokens): overlapping windows of search tokens; empty texts and windows under `least` tokens give none."""
    from braidwork.functions.vectors import token_windows

    tokens = docs.where(F.col(text).isNotNull()).select(doc_id, token_windows(search_tokens(F.col(text)), size, overlap, least).alias("w"))
    return tokens.select(doc_id, F.posexplode("w").alias("window", "tokens"))


def packed_context(blocks: DataFrame, group: str, budget: int) -> DataFrame:
    """Per group the blocks in order of score, each in full if it fits what is left, else short, else skipped.

    Blocks are (group, block_id, score, full_size, short_size); rows are (group, position, block_id,
    form). The choice depends on the blocks before, so rows are sorted by the shuffle and stream
    through, sizes only; just the room left and the position are held.
    """
    kinds = dict(blocks.dtypes)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, position = object(), 0, 0
        for frame in frames:
            out = []
            for g, block, full, short in frame.itertuples(index=False):
                if g != now:
                    now, left, position = g, budget, 0
                size, form = (full, "full") if full <= left else (short, "short")
                if size <= left:
                    out.append((g, position, block, form))
                    left, position = left - size, position + 1
            yield pd.DataFrame(out, columns=[group, "position", "block_id", "form"])

    rows = blocks.where(F.col(group).isNotNull()).select(group, "block_id", "full_size", "short_size", (-F.col("score")).alias("_s"))
    ordered = rows.repartition(group).sortWithinPartitions(group, "_s", "block_id").select(group, "block_id", "full_size", "short_size")
    return ordered.mapInPandas(choose, f"{group} {kinds[group]}, position int, block_id {kinds['block_id']}, form string")
