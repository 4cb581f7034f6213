from __future__ import annotations

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.llm import chunks, defects, grouping, handwritten, leaks, lookalike, overlap, packing, vptree
from braidwork.session import table

DATA = "/root/testdata/sf0.001"


# Problem 1

QNA = "qna_id long, cross_repo_split string, in_repo_split string, prefix string, target string, repo_id string, cls string, side string"


def qna(spark, rows):
    return spark.createDataFrame([(i, *r, "r", "clash", "clash") for i, r in enumerate(rows)], QNA)


def brute_overlap(rows):
    norm = lambda t: re.sub(r"\s+", "", t).replace('"', "'")
    out = set()
    for i, (c, s, p, t) in enumerate(rows):
        for j, (c2, s2, p2, t2) in enumerate(rows):
            if None in (p, t, p2, t2) or not (c == s == "train") or (c2 == s2 == "train") or norm(t) != norm(t2):
                continue
            a, b = re.findall(r"\w+", p), re.findall(r"\w+", p2)
            line = [0] * (len(b) + 1)
            for x in a:
                line = [0, *line[1:]]
                new = [0]
                for k, y in enumerate(b):
                    new.append(line[k] + 1 if x == y else max(line[k + 1], new[-1]))
                line = new
            if 2 * line[-1] >= 0.75 * (len(a) + len(b)):
                out.add((min(i, j), max(i, j)))
    return out


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(8, 30))]
        kind = rng.choice([["'a b'", '"a  b"', "'ab'"], ["x", " x"]])
        for _ in range(4):
            mine = [w for w in base if rng.random() > 0.12]
            for _ in range(rng.randint(0, 3)):
                mine.insert(rng.randrange(len(mine) + 1), rng.choice(words))
            target = rng.choice(kind)
            rows.append((rng.choice(["train", "train", "cr_val", None]), rng.choice(["train", "val"]), " ".join(mine), target))
    rows += [("train", "train", None, "x"), ("train", "train", "p q", None), ("cr_val", "val", "", "x"), ("train", "train", " ( ", "x")] + [rows[0]] * 3
    df = qna(spark, rows)
    want = brute_overlap(rows)
    assert len(want) > 30
    got = [tuple(r) for r in overlap.overlapping_pairs(df.unionByName(df.where("qna_id < 9"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from("abc")), min_size=1, max_size=30), st.dictionaries(st.integers(0, 9), st.integers(1, 500), max_size=10), st.floats(0.5, 0.95))
def test_weighted_cosine_is_never_below_its_bound(steps, freq, threshold):
    """Two word lists cut from one: where enough words are common, the weighted cosine reaches the bound, and the indexed terms meet."""
    one, two = [w for w, k in steps if k in "ab"], [w for w, k in steps if k in "ac"]
    common = sum((Counter(one) & Counter(two)).values())
    if not one or not two or 2 * common < threshold * (len(one) + len(two)):
        return
    sketch = np.zeros(overlap.SKETCH, dtype=np.int64)
    for w, n in freq.items():
        sketch[w] = n
    bound = overlap.cosine_bound(threshold)
    weight = lambda words: Counter({w: n for w, n in Counter(words).items()})
    square = lambda w: float(overlap.term_weights(sketch[w : w + 1], 500)[0] ** 2)
    dot = sum(square(w) * n for w, n in (weight(one) & weight(two)).items())
    norms = [sum(square(w) * n for w, n in weight(x).items()) ** 0.5 for x in (one, two)]
    assert dot / norms[0] / norms[1] >= bound - 1e-9 and min(norms) >= (bound - 1e-9) * max(norms)
    terms = [overlap.indexed_terms(np.array(x, dtype="<u4"), 7, sketch, bound, 500) for x in (one, two)]
    shared = set(terms[0][0].tolist()) & set(terms[1][0].tolist())
    assert shared
    at = [{t: (w, r) for t, w, r in zip(*x[:3], strict=True)} for x in terms]
    assert any(at[0][t][0] * at[1][t][0] + at[0][t][1] * at[1][t][1] >= bound - 1e-5 for t in shared)


def test_the_threshold_is_honoured(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [("train", "train", " ".join(words), "x"), ("cr_val", "val", " ".join(words[:17] + ["q1", "q2", "q3"]), "x"), ("cr_val", "val", " ".join(words[:19] + ["q4"]), "x")]
    for threshold, want in ((0.75, 2), (0.9, 1), (0.96, 0)):
        assert overlap.overlap_classes(qna(spark, rows), threshold)[1].count() == want
    got = {r.qna_id: (r.n_train, r.n_eval, r.n_links) for r in overlap.overlap_members(qna(spark, rows + rows[:1])).collect()}
    assert got == {0: (2, 0, 2), 3: (2, 0, 2), 1: (0, 1, 1), 2: (0, 1, 1)}


def test_overlap_of_a_hot_group_of_copies(spark):
    rows = [("train", "train", "a b c d e f", "hot")] * 60 + [("cr_val", "val", "a b c d e f", "hot")] * 5 + [("cr_val", "val", f"q{i} r s t", "cold") for i in range(20)]
    members, links = overlap.overlap_classes(qna(spark, rows))
    assert members.select("cls").distinct().count() == 1 and links.count() == 0
    assert overlap.overlapping_pairs(qna(spark, rows)).count() == 300
    report = {r.suite: (r.n_records, r.n_overlapping) for r in overlap.overlap_report(qna(spark, rows)).collect()}
    assert report == {"cr_val": (25, 5)}
    assert overlap.overlapping_pairs(qna(spark, rows).where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_common_in_order(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(line[k] + 1 if x == y else max(line[k + 1], new[-1]))
        line = new
    assert overlap.common_in_order(np.array(a, dtype="<u4"), np.array(b, dtype="<u4")) == line[-1]


# Problem 2


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "diff --git ", "@@ ", "é", ""]), st.integers(0, 90), st.sampled_from(["\n", "\r\n", "\r"])), max_size=60), st.integers(30, 80), st.integers(0, 12))
def test_pieces_keep_every_promise(lines, limit, overlap_):
    text = "".join(start + "y" * n + end for start, n, end in lines)
    parts = chunks.pieces(text, limit, overlap_)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in pairwise(parts))
    longest = max(map(len, re.split("\r\n|\n|\r", text)))
    for start, stop, begin, kind in parts:
        assert stop - begin <= limit and start - begin <= overlap_ and (stop > start or not text)
        if longest <= limit:
            assert kind != chunks.FORCED
    if longest > limit:
        assert any(kind == chunks.FORCED for *_, kind in parts)
    for start, stop, _, kind in parts[1:]:
        if kind == chunks.FORCED:
            line = [m.span() for m in re.finditer(r"[^\r\n]+", text) if m.start() < start < m.end()]
            assert line and line[0][1] - line[0][0] > limit


def test_runs_beside_a_wide_line_are_cut_at_hunks():
    hunk = "@@ -1 +1 @@\n" + "+ line of code\n" * 60
    for width in (3900, 9000):
        text = hunk * 12 + "x" * width + "\n" + hunk * 12
        parts = chunks.pieces(text)
        where = text.index("x" * width)
        line_end = where + width + 1
        assert all(text.startswith("@@ ", start) for start, *_ in parts[1:] if not where <= start < line_end)
        assert {where, line_end} <= {start for start, *_ in parts}
        assert all(stop - start > 1500 for start, stop, *_ in parts if not where <= start < line_end)


def test_uneven_lines_stay_with_the_balanced_method():
    """Lines of nearly the whole room leave no even cuts near the targets; pieces are added, none is superfluous, and every piece repeats something."""
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choice(["", "@@ ", "diff --git "]) + "z" * rng.choice([3, 40, 3000, 3600, 3790]) + "\n" for _ in range(rng.randint(3, 60)))
        parts = chunks.pieces(text)
        assert all(stop - begin <= 4000 for _, stop, begin, _ in parts) and all(kind != chunks.FORCED for *_, kind in parts)
        assert all(start - begin > 0 or stop - start > 3800 for start, stop, begin, _ in parts[1:])
        wide = [m.end() - m.start() for m in re.finditer(r".*\n", text) if m.end() - m.start() > 3800]
        assert wide or all(c[1] - a[0] > 3800 for a, c in pairwise(parts))


def test_cut_kinds(spark):
    long_line, lines = "x" * 4001, ("y" * 99 + "\n") * 45
    rows = [("a", long_line), ("b", lines), ("b", lines), ("c", "z" * 4000), ("d", None), ("e", ""), ("f", "z" * 4000 + "\n"), ("g", "é" * 4001), ("h", lines + "q" * 30_000)]
    df = spark.createDataFrame(rows, "commit_sha string, production_code_diff string").withColumn("piece", F.lit(1))
    assert {tuple(r) for r in chunks.cut_kinds(df).collect()} == {("a", "forced"), ("b", "boundary"), ("f", "boundary"), ("g", "forced"), ("h", "forced")}
    got = chunks.long_diff_pieces(df).toPandas().sort_values(["commit_sha", "piece_no"])
    for sha, part in got.groupby("commit_sha"):
        assert "".join(p[n:] for p, n in zip(part.piece, part.n_overlap, strict=True)) == dict(rows)[sha]
    assert chunks.cut_kinds(df.where("false")).count() == 0


# Problem 3

CASES = [
    ("def t():\n    assert x == ", "", "assert", "empty"),
    ("def t():\n    assert x == ", None, "assert", "empty"),
    ("def t():\n    assert x == ", " ​ ,)", "assert", "empty"),
    ("def t():\n    self.assertEqual(x, ", "27.5", "self.assertEqual", "truncated"),
    ("def t():\n    self.assertEqual(x, ", "[a, 'b", "self.assertEqual", "truncated"),
    ("def t():\n    assert x == ", "a + b -", "assert", "truncated"),
    ("def t():\n    assert x == ", "I'm sorry, but I can't tell what x should be.", "assert", "refusal"),
    ("def t():\n    self.assertIn(x, ", "# There is not enough context to work out x)", "self.assertIn", "refusal"),
    ("def t():\n    assert foo.bar(1) == ", "foo.bar( 1) ", "assert", "copy"),
    ("def t():\n    self.assertIs(foo[1], ", "self.assertIs(foo[1],", "self.assertIs", "copy"),
    ("def t():\n    assert x == ", "const a = b;", "assert", "language"),
    ("def t():\n    assert x == ", "Der Wert ist nicht bekannt und wird später geprüft.", "assert", "language"),
    ("def t():\n    assert x == ", "очередь растёт после проверки", "assert", "language"),
    ("def t():\n    assert x == ", "結果を確認してください。", "assert", "language"),
    ("def t():\n    assert x == ", "'sorry, I cannot help'", "assert", None),
    ("def t():\n    assert x == ", '"очередь растёт"', "assert", None),
    ("def t():\n    self.assertEqual(x, ", "(43, ...))", "self.assertEqual", None),
    ("def t():\n    y = 4\n    self.assertEqual(x, ", "y)", "self.assertEqual", None),
    ("def t():\n    assert x in ", "{'a': [1, 2]}", "assert", None),
]


def test_defects_by_label_model(spark):
    rows = [(i, *case[:3]) for i, case in enumerate(CASES * 12)] + [(10_000 + i, "def t():\n    assert x == ", f"value_{i}", "assert") for i in range(600)]
    df = spark.createDataFrame(rows, "qna_id long, prefix string, target string, assertion_type string").withColumn("pattern", F.lit("clash"))
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents").withColumn("slot", F.lit(1))
    got = {r.qna_id: r.defect for r in defects.defective_pairs(df.unionByName(df), docs).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: case[3] for i, case in enumerate(CASES)}
    assert not any(i >= 10_000 for i in got)
    assert defects.defective_pairs(df.where("false"), docs).count() == 0
    assert {r.defect for r in defects.validation_report(df, docs).collect() if r.precision > 0.9 and r.recall > 0.9} >= {"empty", "copy", "truncated", "refusal"}


def test_languages_by_trigrams(spark):
    """No word of these is listed anywhere; Swedish, Indonesian, Turkish and Czech are not among the documents either."""
    model = defects.fit_languages(table(spark, DATA.replace("0.001", "0.01"), "documents"))
    english = ["Not sure", "No reply given", "Ask the author", "I cannot tell", "This cannot be worked out from what is shown", "Unknown without the fixture file"]
    foreign = ["Nilai ini tidak boleh kosong karena dipakai lagi nanti", "Detta värde är okänt och måste kontrolleras senare", "Bu değer daha sonra kontrol edilecek", "Hodnota není známa a bude ověřena", "Der Wert wird später geprüft", "el valor no está en la caché"]
    assert [model.english(t.split()) for t in english] == [1] * len(english)
    assert [model.english(t.split()) for t in foreign] == [-1] * len(foreign)


def test_defects_judge_all_rows(spark):
    """Every pair is planted and every labelled document counted, at sizes where a sample used to be taken; redelivered pairs count once."""
    pairs = spark.range(9_000).selectExpr("id as qna_id", "'def t():\\n    assert x == ' as prefix", "concat('value_', id) as target", "'assert' as assertion_type")
    docs = spark.range(12_000).selectExpr("id as doc_id", "if(id % 20 = 0, 'de', 'en') as lang", "if(id % 20 = 0, concat('der Wert wird im Speicher geprüft und bleibt unbekannt ', repeat(char(97 + int(id / 20) % 26), 3)), concat('the value of the cache is written again ', repeat(char(97 + id % 26), 4))) as text")
    model, brute = defects.fit_languages(docs), {lang: np.zeros(defects.SLOTS) for lang in ("en", "de")}
    for r in docs.collect():
        np.add.at(brute[r.lang], defects.trigram_slots(defects._PROSE_WORD.findall(r.text)), 1)
    assert np.array_equal(model.by_slot, defects.Languages(brute).by_slot)
    assert {r.call: r.n for r in defects.passage_votes(docs, model).groupBy("call").agg(F.sum("n").alias("n")).collect()} == {"0": 600, "1": 600}
    assert {r.defect: r.n_planted for r in defects.validation_report(pairs.unionByName(pairs.where("qna_id < 500")), docs).collect()} == {"empty": 9_000, "refusal": 9_000, "language": 9_000, "copy": 9_000, "truncated": 0}


def test_languages_beyond_the_modelled_share_a_model_and_long_texts_count_whole(spark):
    rows = [(f"l{i % 80:02d}", f"zq{i % 80} vowel text") for i in range(240)] + [("en", "the value is " * 40_000)]
    model, brute = defects.fit_languages(spark.createDataFrame(rows, "lang string, text string")), {}
    for lang, text in sorted(rows):
        slots = defects.trigram_slots(defects._PROSE_WORD.findall(text))
        np.add.at(brute.setdefault(lang if lang <= "l62" else "other", np.zeros(defects.SLOTS)), slots, 1)
    assert len(brute) == defects.MOST_LANGUAGES + 1
    assert np.array_equal(model.by_slot, defects.Languages(brute).by_slot)


def test_repeated_documents_give_the_same_languages():
    rng = np.random.default_rng(4)
    counts = {lang: rng.poisson(rng.gamma(0.05, 4_000, defects.SLOTS)).astype(float) for lang in ("en", "de")}
    assert np.allclose(defects.Languages(counts).by_slot, defects.Languages({k: 1_000 * n for k, n in counts.items()}).by_slot)


@given(st.text("'\"\\()[]{}ab# ", max_size=24))
def test_open_prefixes_equal_scans_of_every_prefix(line):
    assert defects.open_prefixes(line) == [k for k in range(1, len(line)) if defects.scan(line[:k]) not in (("", ""), ("!", ""))]


def test_label_model_recovers_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.05
    says = np.stack([np.where(rng.random(len(truth)) < hit, np.where(truth, 1, -1), np.where(truth, -1, 1) * (rng.random(len(truth)) < 0.5)) for hit in (0.97, 0.93, 0.9, 0.95)], axis=1).astype(int)
    patterns, inverse, counts = np.unique(says, axis=0, return_inverse=True, return_counts=True)
    posterior = defects.label_model(patterns, counts.astype(float))[inverse]
    assert ((posterior > 0.5) == truth).mean() > 0.99


# Problem 4


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 64))).astype(np.float32)


def test_tree_is_exact_at_factor_one():
    x = vptree._unit(clustered(1500))
    tree = vptree.Tree(x, 32)
    s = x @ x.T
    pairs = {(a, b) for q, r in tree.within(x, 0.8, 1.0) for a, b in zip(q.tolist(), r.tolist(), strict=True)}
    assert pairs == {tuple(p) for p in np.argwhere(s >= 0.8 - 1e-5).tolist()}
    score, _ = tree.nearest(x, 6, 1.0)
    assert np.allclose(score, -np.sort(-s, axis=1)[:, :6], atol=1e-5)


def vector_rows(spark, x, extra=()):
    rows = [(f"{i:040x}", v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "commit_sha string, diff_embedding array<float>").withColumn("cls", F.lit(1))


def test_search_through_shards_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    x = clustered(1600, 3)
    x[1400:] = x[:200] * 2 + np.random.default_rng(2).normal(size=(200, 64)) * 0.3
    df = vector_rows(spark, x)
    unit = vptree._unit(x)
    s = unit @ unit.T
    want = {(f"{a:040x}", f"{b:040x}") for a, b in np.argwhere(np.triu(s >= 0.95, 1))}
    got = {tuple(r) for r in vptree.similar_pairs(df).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) >= 200
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -10]
    near = vptree.nearest_rows(df, "diff_embedding", 10).toPandas()
    assert near.groupby("commit_sha").size().eq(10).all()
    assert (near.cosine.to_numpy() >= kth[[int(c, 16) for c in near.commit_sha]] - 2e-5).mean() >= 0.9
    exact = {tuple(r) for r in vptree.similar_pairs(df, factor=1.0).collect()}
    assert exact == want


def test_router_loses_nothing_at_factor_one():
    x = vptree._unit(clustered(900, 5))
    router = vptree.Router(x[:400], 24)
    home = router.home(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    chord = np.sqrt(2 - 2 * np.sort(s, axis=1)[:, -10])
    rows, shards = router.reached(x, chord)
    reached = set(zip(rows.tolist(), shards.tolist(), strict=True))
    near = np.argsort(-s, axis=1)[:, :10]
    assert router.shards == 24 and all((i, int(home[j])) in reached for i in range(len(x)) for j in near[i])
    few, _ = router.reached(x, 0.1 * chord)
    assert len(few) < 0.5 * len(rows)


def test_unusable_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 8)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 16)
    same = [1.0] + [0.0] * 63
    bad = [("n", None), ("z", [0.0] * 64), ("s", [1.0] * 48), ("nan", [float("nan")] + [1.0] * 63), ("inf", [float("inf")] + [1.0] * 63), ("h", [None] + [1.0] * 63)]
    rng = np.random.default_rng(4)
    near = [(f"c{i:02d}", (np.array(same) + rng.normal(size=64) * 1e-3).tolist()) for i in range(60)]
    hot = [(f"e{i:02d}", same) for i in range(10)]
    df = vector_rows(spark, np.zeros((0, 64)), bad + near + hot + hot)
    assert vptree.similar_pairs(df).count() == 70 * 69 // 2
    members = vptree.similar_members(df).toPandas()
    assert len(members) == 70 and members.n_links.eq(60).all() and members[members.n_copies == 10].vector_class.nunique() == 1
    assert vptree.similar_links(df)[1].count() == 61 * 60 // 2
    got = vptree.nearest_rows(df, "diff_embedding", 10).toPandas()
    assert set(got.commit_sha) == {r[0] for r in near + hot} and got.groupby("commit_sha").size().eq(10).all()
    assert vptree.similar_pairs(df.where("false")).count() == 0 and vptree.nearest_rows(df.where("false"), "diff_embedding").count() == 0


# Problem 6


def test_projects_from_spellings(spark):
    forms = ["a/b-c", " A/B-C", "https://git.example/a/b-c", "https://git.example/a/b-c.git", "git@git.example:a/b-c.git", "ssh://git.example/a/B-c/", "a/b-c/"]
    got = spark.createDataFrame([(f,) for f in [*forms, None, " "]], "r string").select(grouping.project_of(F.col("r")).alias("p")).collect()
    assert [r.p for r in got] == ["a/b-c"] * len(forms) + [None, None]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(80)}", f"v{rng.randrange(80)}") for _ in range(70)] + [("hub", f"x{i}") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("a", "a"), (None, "b")]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    got = grouping.components(spark.createDataFrame(edges + edges[:20], "a string, b string")).collect()
    assert len({r.vertex for r in got}) == len(got)
    ours = {}
    for r in got:
        ours.setdefault(r.label, set()).add(r.vertex)
    theirs = {}
    for v in parent:
        theirs.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    assert grouping.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_grouped_split_keeps_projects_whole(spark):
    rng = random.Random(1)
    snaps = [(rng.choice([f"o/p{k}", f"O/P{k}", f"https://git.example/o/p{k}.git"]), rng.choice(["train", "cr_val", None]), i, f"s{i}") for i in range(3000) for k in [0 if rng.random() < 0.33 else rng.randrange(1, 400)]]
    df = spark.createDataFrame([*snaps, *snaps[:50], (None, "train", 1, "q")], "repo_id string, cross_repo_split string, commit_index int, commit_sha string")
    links = spark.createDataFrame([(f"o/p{i}", f"o/p{i + 1}", "fork_of") for i in range(10, 40)] + [("o/p1", "o/p2", "mentions"), (None, "o/p3", "fork_of")], "repo_id string, linked_repo_id string, link_kind string")
    got = grouping.grouped_split(df, links).toPandas()
    assert got.groupby("component").split.nunique().eq(1).all() and set(got.repo_id) == {s[0] for s in snaps}
    share = got.groupby("split").n_records.sum() / got.n_records.sum()
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    assert got[got.project.isin(["o/p10", "o/p40"])].component.nunique() == 1 and got[got.project.isin(["o/p1", "o/p2"])].component.nunique() == 2
    assert grouping.straddling(df.where("false"), links).count() == 0 and grouping.grouped_split(df.where("false"), links).count() == 0


# Problem 7


def test_grammar_sizes():
    known = handwritten._Tokens()
    ids = lambda t: np.array([known[x] for x in handwritten._TOKEN.findall(t)], dtype=np.uint64)
    template = "".join(f"def f{i}(a, b): return call({i}, a, b)\n" for i in range(30))
    varied = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    size = handwritten.grammars([ids(template), ids(varied), ids(""), ids("a")])
    n = len(ids(template))
    assert size[0] < 0.4 * n and size[1] == 300 and size[2] == 0 and size[3] == 1


def plain_repair(sequence: list) -> int:
    """Re-Pair one pair at a time: the size of the grammar when no pair repeats."""
    rules, fresh = 0, iter(range(10_000, 20_000))
    while True:
        counts, last = Counter(), {}
        for i, pair in enumerate(pairwise(sequence)):
            if last.get(pair) != i - 1:
                counts[pair] += 1
                last[pair] = i
        if not counts or max(counts.values()) < 2:
            return rules + len(sequence)
        best, name, out, i = max(counts, key=lambda p: counts[p]), next(fresh), [], 0
        while i < len(sequence):
            if tuple(sequence[i : i + 2]) == best:
                out.append(name)
                i += 2
            else:
                out.append(sequence[i])
                i += 1
        sequence, rules = out, rules + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=3))
def test_grammars_run_until_no_pair_repeats(sequences):
    size = handwritten.grammars([np.array(s, dtype=np.uint64) * handwritten._ODD for s in sequences])
    for ours, s in zip(size.tolist(), sequences, strict=True):
        theirs = plain_repair(s)
        assert ours <= len(s) and abs(ours - theirs) <= 2 + 0.2 * theirs
    assert handwritten.grammars([np.full(1 << 10, 7, dtype=np.uint64)])[0] == 2 * 9 + 2  # a power of two halves to the end


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.lists(st.integers(1, 9), max_size=30))
def test_equal_rules_have_equal_names(before, rule):
    sequence = np.array(before + rule + rule, dtype=np.uint64) * handwritten._ODD
    a, k = len(before), len(rule)
    names = handwritten.rule_names(sequence, np.array([0, a, a + k, a + 2 * k])).tolist()
    assert names[1] == names[2] == handwritten.rule_names(sequence[a : a + k], np.array([0, k]))[0]


def test_literals_of_any_length_are_judged_by_their_grammar():
    rng = random.Random(3)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(60))
    words = '", "'.join(written(5, 30).replace("\n", " ").split()[:60])
    texts = [f'K = "{secret}"\n', f'W = ["{words}"]\n', "T = [" + ", ".join(str(rng.randrange(10**6)) for _ in range(12)) + "]\n", 'S = "' + "ab" * 300 + '"\n', "", "x = 1\n"]
    dense = [s > 0.5 for s in handwritten.data_shares(texts)]
    assert dense == [True, False, True, False, False, False]


def test_two_of_ten_lines_changed(spark):
    """Three repositories that share four fifths of a file, but none all of it, hold vendored copies; two do not."""
    lines = written(31, 100).split("\n")

    def changed(k: int) -> str:
        own = written(60 + k, 60).split("\n")[6:]
        return "\n".join([*lines[:30], *own[: len(lines) // 5], *lines[30 + len(lines) // 5 :]])

    schema = "repo_id string, seq int, status string, path string, old_path string, new_blob string"
    for n, want in ((2, 0), (3, 3)):
        changes = spark.createDataFrame([(f"r{i}", 1, "A", "m.py", None, f"b{i}") for i in range(n)], schema)
        blobs = spark.createDataFrame([(f"b{i}", changed(i)) for i in range(n)], "blob_sha string, text string")
        assert handwritten.file_kinds(changes, blobs).count() == want
    alone = {r.signals: r.n_paths for r in handwritten.signal_counts(changes, blobs).collect()}
    assert alone == {"shared_rules": 3}


def written(seed: int, lines: int = 14) -> str:
    """Code as a person writes it: few lines of one shape."""
    rng = random.Random(seed)
    name = lambda: "_".join("".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) for _ in range(rng.randint(1, 2)))
    shapes = [
        lambda: f"{name()} = {name()}.{name()}({rng.randint(1, 99)}, {name()})", lambda: f"if {name()} is not None:\n        return {name()}[{name()}]", lambda: f"for {name()} in {name()}: {name()} += {rng.random():.3f}",
        lambda: f"{name()}({name()}={name()})", lambda: f'raise ValueError("{name()} {name()}")', lambda: f"{name()}[{rng.randint(0, 9)}] = -{name()}", lambda: f"assert {name()} <= {name()}, {name()}",
    ]
    return f"import {name()}\n\n\ndef {name()}({name()}, {name()}=None):\n    # Regenerate the table by hand.\n" + "".join(f"    {rng.choice(shapes)()}\n" for _ in range(lines))


def test_file_kinds(spark):
    code = written(1)
    template = "".join(f"def m_{i:03d}(a, b): return _call({i}, a, b)\n" for i in range(40))
    dense = "".join(f"for(;a<b;)a++;c[{i}]=!0;function f{i}(g){{return g?g+{i}:null}};" for i in range(20))
    rng = random.Random(0)
    blob = 'DATA = "' + "".join(rng.choice("0123456789abcdef") for _ in range(900)) + '"\n'
    numbers = "T = [" + ", ".join(str(rng.random()) for _ in range(80)) + "]\n"
    head = "# Generated by toolc from a.proto. DO NOT EDIT!\n\n" + written(7)
    copied = "# Copied verbatim from somelib release 1.2.3; keep in sync with somelib upstream.\n" + written(8)
    files = [
        ("src/plain.py", code, None), ("src/vendor_portal/x.py", written(4), None), ("src/gen.py", template, "generated"), ("web/a.js", dense, "minified"), ("src/t.py", blob, "data"), ("src/n.py", numbers, "data"),
        ("src/h.py", head, "generated"), ("src/c.py", copied, "vendored"), ("third_party/l/x.py", written(5), "vendored"), ("a/b.min.js", written(6), "minified"), ("docs/gen.md", template + "\n", None),
        ("src/codegen.py", '"""Makes headers."""\nBANNER = "# Generated by {tool}. DO NOT EDIT!"\n' + written(9), None), ("src/empty.py", "", None), ("src/none.py", None, None), ("src/huge.py", "".join(written(k, 40) for k in range(50, 120)), None),
    ]
    changes = [("r", i, "A", p, None, f"b{i}") for i, (p, _, _) in enumerate(files)] + [("r", 90, "R100", "src/moved.py", "src/gen.py", "b2"), ("r", 91, "D", "node_modules/z.js", None, "0" * 40), (None, 1, "A", "vendor/q.py", None, "b1"), ("r", 92, "A", None, None, "b1")]
    df = spark.createDataFrame(changes + changes[:3], "repo_id string, seq int, status string, path string, old_path string, new_blob string").withColumn("kind", F.lit("clash"))
    blobs = spark.createDataFrame([(f"b{i}", t) for i, (_, t, _) in enumerate(files)], "blob_sha string, text string")
    got = {(r.repo_id, r.path): r.kind for r in handwritten.file_kinds(df, blobs).collect()}
    want = {("r", p): k for p, _, k in files if k} | {("r", "src/moved.py"): "generated", ("r", "node_modules/z.js"): "vendored"}
    assert got == want
    snaps = spark.createDataFrame([("R",)], "repo_id string")
    assert ("r", "src/plain.py") in {tuple(r) for r in handwritten.hand_written(df, blobs, snaps).collect()}
    assert handwritten.file_kinds(df.where("false"), blobs).count() == 0


def test_copies_across_repositories_are_vendored(spark):
    code = written(2, 20)
    changes = spark.createDataFrame([("r1", 1, "A", "a.py", None, "b0"), ("r2", 1, "A", "z/b.py", None, "b1"), ("r3", 1, "A", "c.py", None, "b2")], "repo_id string, seq int, status string, path string, old_path string, new_blob string")
    blobs = spark.createDataFrame([("b0", code), ("b1", code + "\n\n"), ("b2", written(3, 20))], "blob_sha string, text string")
    assert {tuple(r) for r in handwritten.file_kinds(changes, blobs).collect()} == {("r1", "a.py", "vendored"), ("r2", "z/b.py", "vendored")}


def test_changed_copies_across_repositories_are_vendored(spark):
    code = written(2, 40)
    licence = "".join(f"# {w}\n" for w in written(20, 60).split("\n"))
    lines = code.split("\n")
    texts = [code, code.replace(lines[20], "    patched = 1"), code.replace(lines[0], "import other_module"), code + "    return locally_added\n"]
    own = [licence + written(k, 30) for k in (21, 22, 23, 24)]  # only the licence is shared
    twice = [written(25, 40), written(25, 40) + "    return 1\n"]  # two repositories are not enough for a part
    files = [(f"r{i}", f"lib/{g}{i}.py", f"{g}{i}", t) for g, some in (("c", texts), ("o", own), ("t", twice)) for i, t in enumerate(some)]
    changes = spark.createDataFrame([(r, 1, "A", p, None, b) for r, p, b, _ in files], "repo_id string, seq int, status string, path string, old_path string, new_blob string")
    blobs = spark.createDataFrame([(b, t) for _, _, b, t in files], "blob_sha string, text string")
    assert {tuple(r) for r in handwritten.file_kinds(changes, blobs).collect()} == {(f"r{i}", f"lib/c{i}.py", "vendored") for i in range(4)}


def test_kinds_go_through_any_number_of_renames(spark):
    moved = [("r", i, "R100", f"lib/n{i}.py", f"lib/n{i - 1}.py" if i else "vendor/n.py", "b0") for i in range(9)] + [("r", 20, "R100", "lib/n2.py", "lib/n8.py", "b0")]
    back = [("r", 30 + i, "R100", f"old/m{i + 1}.py" if i < 6 else "m_pb2.py", f"old/m{i}.py", "b0") for i in range(7)]
    changes = spark.createDataFrame([*moved, *back, ("s", 1, "R100", "lib/n1.py", "lib/n0.py", "b0")], "repo_id string, seq int, status string, path string, old_path string, new_blob string")
    blobs = spark.createDataFrame([("b0", "x = 1\n")], "blob_sha string, text string")
    got = {tuple(r) for r in handwritten.file_kinds(changes, blobs).collect()}
    vendored, generated = ["vendor/n.py", *(f"lib/n{i}.py" for i in range(9))], ["m_pb2.py", *(f"old/m{i}.py" for i in range(7))]
    assert got == {("r", p, "vendored") for p in vendored} | {("r", p, "generated") for p in generated}


def test_head_comments_are_read_to_their_end():
    licence = "".join(f"# Line {i} of a licence.\n\n" for i in range(40))
    assert handwritten.head_says(licence + "# Code generated by toolc. DO NOT EDIT.\nx = 1\n") == (True, False)
    assert handwritten.head_says(licence + "# Copied verbatim from somelib.") == (False, True)
    assert handwritten.head_says(licence + "x = 1\n# Code generated by toolc. DO NOT EDIT.\n") == (False, False)


# Problem 8


def check_packing(got: pd.DataFrame, sizes: dict[int, int], capacity: int) -> int:
    used = got.groupby("window").n_tokens.sum()
    assert used.max() <= capacity
    held = got.groupby("doc_id").n_tokens.sum().to_dict()
    assert held == {k: v for k, v in sizes.items() if v}
    for doc, part in got.groupby("doc_id"):
        if sizes[doc] <= capacity:
            assert len(part) == 1
        else:
            part = part.sort_values("piece_no")
            assert (part.start.to_numpy() == np.concatenate(([0], part.n_tokens.cumsum().to_numpy()[:-1]))).all()
    return len(used)


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    sizes = {i: int(n) for i, n in enumerate(np.concatenate([rng.integers(1, 400, 3000), rng.integers(300, 3000, 300), np.full(1500, 257), [0, 0, 1024, 1025, 2048]]))}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").withColumn("window", F.lit(1))
    windows = check_packing(packing.pack(df).toPandas(), sizes, 1024)
    assert windows <= 1.01 * sum(sizes.values()) / 1024 + 2
    assert packing.pack(df.where("false")).count() == 0


def test_plan_holds_its_demand_when_items_are_large():
    lengths, demand = np.array([300, 520, 700, 1024]), np.array([5, 7, 3, 2])
    plan = packing.window_plan(lengths, demand, 1024)
    held = Counter()
    for filling, times in plan:
        assert sum(lengths[k] * n for k, n in filling.items()) <= 1024
        held.update({k: n * times for k, n in filling.items()})
    assert [held[k] for k in range(4)] == demand.tolist() and sum(t for _, t in plan) <= 13


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=12))
def test_linear_program_and_its_bound(histogram):
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in sorted(histogram)])
    uses, value, bound = packing.configuration_lp(lengths, demand, 60)
    size = float((lengths * demand).sum())
    assert all(sum(lengths[k] * n for k, n in f) <= 60 for f in uses)
    assert size / 60 - 1e-6 <= bound <= value + 1e-6
    plan = packing.rounded(lengths, demand, 60, uses)
    held = Counter()
    for filling, times in plan:
        assert sum(lengths[k] * n for k, n in filling.items()) <= 60
        held.update({k: n * times for k, n in filling.items()})
    windows = sum(t for _, t in plan)
    assert [held[k] for k in range(len(lengths))] == demand.tolist() and bound - 1e-6 <= windows <= 1.3 * bound + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 3), min_size=1, max_size=6), st.integers(0, 60))
def test_fullest_is_the_best_subset(items, room):
    lengths = np.array(sorted(items))
    left = np.array([items[n] for n in sorted(items)])
    sums = {0}
    for n, times in items.items():
        for _ in range(times):
            sums |= {s + n for s in sums if s + n <= room}
    filling = packing.fullest(lengths, left, room)
    assert sum(int(lengths[k]) * n for k, n in filling.items()) == max(sums) and all(n <= left[k] for k, n in filling.items())


def test_a_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    sizes = dict.fromkeys(range(1200), 300) | {k: 1024 for k in range(2000, 2100)} | {k: 124 for k in range(3000, 3400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    assert check_packing(packing.pack(df).toPandas(), sizes, 1024) == 500


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1000
    check_packing(packing.document_windows(df).toPandas(), got, 1024)


# Problem 9


def test_leaks_through_disguises(spark):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("lo", "ma", "ri", "te") for b in ("ka", "su", "no", "vi", "pe")]
    item = [rng.choice(vocabulary) for _ in range(40)]
    other = [rng.choice(vocabulary) for _ in range(40)]
    text = " ".join(item)
    numbered = "\n".join(f" {i} | {' '.join(item[k : k + 5])}" for i, k in enumerate(range(0, 20, 5), 1))
    docs = [
        (1, f"before {text} after"), (2, " ".join(item[10:25])), (3, " ".join(item[10:24])), (4, " ".join(item[:15]).upper().replace(" ", ", ")), (5, numbered), (6, "<p>" + "</p> <b>".join(item[5:25])),
        (7, "​".join(text)), (8, text.replace("a", "а").replace("o", "о")), (9, " ".join(reversed(item))), (10, None), (11, ""), (12, "\n> ".join(item)), (13, " ".join(rng.choice(vocabulary) for _ in range(3000))),
        (14, " ".join(item[:12] + ["zzz"] + item[12:24])), (15, "　".join(other)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pos", F.lit(0))
    h = spark.createDataFrame([(100, text), (200, " ".join(other)), (300, "too short"), (400, None), (100, text)], "item_id long, text string").withColumn("term", F.lit(0))
    got = {(r.doc_id, r.item_id): r.n_words for r in leaks.leaks(d, h).collect()}
    want = {(k, 100) for k in (1, 2, 4, 5, 6, 7, 8, 12)} | {(15, 200)}
    assert set(got) == want and got[(2, 100)] == 15 and got[(1, 100)] == 40
    near = {(r.doc_id, r.item_id) for r in leaks.leaks(d, h, slop=2, least=10).collect()}
    assert want | {(14, 100)} <= near
    assert leaks.leaks(d.where("false"), h).count() == 0 and leaks.leaks(d, h.where("false")).count() == 0


def brute_proximity(docs, items, slop, least):
    """Windows of items in documents, by counts over all readings, place by place."""
    read = [(i, r) for i, t in docs for r in (leaks.readings(t) if t else [])]
    counts = Counter(w for _, r in read for w in r)
    found = {}
    for item, text in items:
        words = leaks.readings(text)[0]
        for begin in range(len(words) - 14):
            window = words[begin : begin + 15]
            rare = [k for k in sorted(range(15), key=lambda k: (counts[window[k]], k)) if counts[window[k]]][:3]
            if len(rare) < 3:
                continue
            for doc, r in read:
                near = lambda k, at: any(0 <= at + k + s < len(r) and r[at + k + s] == window[k] for s in range(-slop, slop + 1))
                for place, word in enumerate(r):
                    at = place - rare[0]
                    if word == window[rare[0]] and all(near(k, at) for k in rare[1:]):
                        n = sum(near(k, at) for k in range(15))
                        if n >= least:
                            found[doc, item] = max(found.get((doc, item), 0), n)
    return found


def test_proximity_equals_brute_force_however_sharded(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 30)))) for k in range(6)]
    docs = []
    for k in range(60):
        words = items[k % 6][1].split()
        words = [rng.choice(["zz", rng.choice(vocabulary)]) if rng.random() < 0.12 else w for w in words]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), "extra")
        docs.append((k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20))) + " " + " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[0][1])]
    want = brute_proximity(docs, items, 2, 9)
    assert len(want) > 20
    d, h = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 7):
        got = {(r.doc_id, r.item_id): r.n_words for r in leaks.leaks(d.repartition(parts), h, slop=2, least=9).collect()}
        assert got == want


# Problem 10


@pytest.mark.parametrize(
    ("a", "b"),
    [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("a​b­c", "abc"), ("one two three", "one two three"), ("рауlоаd", "payload"), ("ﬁne", "fine"), ("й", "й"), ("ΑΒ", "AB"), ("но‍вый", "нoвый"), ("x︎", "x"), ("non‑break", "non-break")],
)
def test_same_look(a, b):
    reader = lookalike.Reader({})
    assert reader.read(a) == reader.read(b)


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("й", "и"), ("a", "A"), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("ä", "a"), ("т", "m")])
def test_other_look(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("𝐩𝖺𝚢 ℓoad", "pay load"), ("Ⅻ", "XII"), ("ĳs", "ijs"), ("ﬂow", "flow"), ("ꓑꓮꓬ", "PAY"), ("ᎬᎪᏚᎢ", "EAST"), ("Ⲣⲟⲣ", "Pop"), ("ﻫ", "ه")])
def test_compatibility_forms_and_other_scripts(a, b):
    assert lookalike.Reader({}).read(a) == lookalike.Reader({}).read(b)


@pytest.mark.parametrize(("a", "b"), [("①", "1"), ("x₂", "x2"), ("½", "1/2"), ("™", "TM"), ("㎏", "kg")])
def test_raised_and_enclosed_forms_stay(a, b):
    assert lookalike.Reader({}).read(a) != lookalike.Reader({}).read(b)


def test_every_word_is_searched():
    """A word of look-alikes only takes the script that its letters or its neighbours speak for."""
    counts = Counter()
    for text, n in (("очередь растёт после проверки сорока серверов", 50), ("the queue grows after a check of each server", 50)):
        for word in text.split():
            counts.update({k: v * n for k, v in lookalike.bigrams_of(lookalike.apart(word)).items()})
    reader = lookalike.Reader(counts)
    assert reader.read("растёт a проверки") == reader.read("растёт а проверки") == "растёт а проверки"
    assert reader.read("after а check") == "after a check"
    assert {"check", "after"} <= reader.plain and len(reader.readings(lookalike.apart("сорока"))) >= 1


def test_readings_keep_to_one_script(spark):
    docs = [(1, "проверка после запуска очередь растёт"), (2, "the queue grows after the check"), (3, "пpoвepкa после зaпycкa"), (4, "тhе quеuе grоwѕ"), (5, "проверка payload после"), (6, None), (7, "")] + [(k, "loading the layout, paint on a toad, plain text of any kind") for k in range(50, 70)] + [(k, "очередь растёт после проверки а потом снова") for k in range(20, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.canonical for r in lookalike.canonical_texts(df).collect()}
    assert got[3] == "проверка после запуска" and got[5] == "проверка payload после" and got[2] == docs[1][1]
    assert got[6] is None and got[7] == "" and got[39] == docs[-1][1] and got[50] == docs[7][1]


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_canonical_form_is_stable(text):
    reader = lookalike.Reader({})
    once = reader.read(text)
    assert reader.read(once) == once and lookalike.skeleton(once) == lookalike.skeleton(text)


def test_pairs_of_a_look(spark):
    docs = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ABC"), (5, " "), (6, ""), (7, " "), (8, None), (9, "hot")] + [(k, "hot") for k in range(100, 160)] + [(200, "x" * 30_000), (201, "x" * 29_999 + "​x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("look_class", F.lit("clash"))
    assert {tuple(r) for r in lookalike.look_alike_pairs(df).collect()} == {(1, 2), (2, 3), (200, 201)}
    assert lookalike.look_alike_pairs(df.where("false")).count() == 0


# All queries


def test_named_queries_have_their_columns(spark):
    from braidwork.llm.queries import QUERIES

    columns = {"p1_found": ["qna_id_a", "qna_id_b"], "p2_found": ["commit_sha", "cut_kind"], "p3_found": ["qna_id", "defect"], "p4_found": ["commit_sha_a", "commit_sha_b"], "p6_found": ["repo_id"], "p7_found": ["repo_id", "path"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id_a", "doc_id_b"]}
    for name, want in columns.items():
        df = QUERIES[name](spark, DATA)
        assert df.columns == want, name
        assert df.count() > 0, name
        assert df.count() == df.distinct().count()
    assert table(spark, DATA, "documents").count() > 0
