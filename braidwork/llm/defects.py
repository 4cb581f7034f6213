"""Broken prompt and response pairs (problem 3).

Each defect has a few noisy labelling functions that vote for (1), against (-1) or not at all (0).
What language prose is in is told by character trigrams counted on labelled documents. The distinct
vote patterns, with their counts over all rows, are few; an expectation-maximization label model
turns them into posteriors. A cutoff per defect is validated on rows whose defects are known because
they were planted in the well-formed pairs, in every one of them. A row keeps every label whose
posterior reaches its cutoff. Nothing is sampled: all labelled documents and all pairs count.
"""

from __future__ import annotations

import ast
import random
import re
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import spread, stored

DEFECTS = ("empty", "refusal", "language", "copy", "truncated")  # where one label is wanted, the first one holds

SLOTS = 1 << 15  # hashed trigrams
WEIGHT = 1 << 22  # trigrams of a language from which on more of them no longer make an unseen one less likely
PIECE = 1 << 16  # characters whose trigrams are counted at a time
MOST_LANGUAGES = 64  # languages with a model of their own, English and the most frequent labels; the others share one
# Refusals that are planted for the validation of cutoffs; no labelling function knows them.
PLANTED_REFUSALS = (
    "I am unable to say what {0} should be.", "Sorry, there is no way to know the value of {0} from here.", "Please show me the source of {0} first.", "This depends on {0}, which was not given.",
    "As an assistant I would rather not guess {0}.", "No idea.", "That cannot be worked out without more of the code.", "Ask the author of {0}.",
)
_LITERAL = re.compile(r"""[rbfuRBFU]{0,2}(?:'{3}.*?'{3}|"{3}.*?"{3}|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")""", re.S)
_PLAIN_LITERAL = re.compile(r"(?<![^\W\d_])" + _LITERAL.pattern, re.S)  # an apostrophe inside a word opens nothing
_UNSEEN = re.compile(r"[\s\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]+")
_NOTHING = re.compile(r"[,)\]}]*")
_FOREIGN_CODE = re.compile(
    r"""=>|===|!==|&&|\|\||\+\+|--(?=\s*$)|:=|::|->|\?\.|\?;|;\s*$|^\s*!(?!=)|\$[A-Za-z_]|&mut\b|&self\b|\)\?\s*$|\bnew\s+[A-Z]\w*\s*[(<{]|\b(?:const|let|var|val|auto|final|int|String|fn|func|public|static)\s+[\w<>\[\]]+\s*(?:=|\(|:)|"""
    r"""\bstatic_cast<|\bstd::|\?\s*[^:?]+\s:\s|(?:^|[\s(,&|])@\w+|\b(?:undefined|nullptr|NULL)\b|\.(?:empty|nil)\?|<\w+>\s*[({]|\bfunction\s*\(|\becho\s|\bputs\s|\[\]\w+\{|\blambda\s*\{|\bend\s*$"""
)
_OTHER_SCRIPT = re.compile("[\u0370-\u1eff\u2e80-\ud7ff\uf900-\ufaff\uff66-\uffdc]")
_PROSE_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HEAD = re.compile(r"^\s*(assert\b|(?:self\.)?assert\w*\s*\(|with\s+pytest\.\w+\(|pytest\.\w+\()")
_OPERATOR_END = re.compile(r"(?:[-+*/%@&|^=<>.,(\[{:]|\b(?:and|or|not|in|is|if|else|for|lambda))$")
_DOTS_END = re.compile(r"(?:…|\.\.\.)$")
_COMPARED = re.compile(r"\s*(?:==|!=|<=|>=|<|>|\bnot\s+in|\bin|\bis\s+not|\bis)\s*$")

_STATEMENT = re.compile(r"(?m)^\s*[\w.\[\]'\"]+\s*=[^=]|\w\([^)\s]|^\s*(?:assert|with|return|raise)\b")
_MARKS_AROUND = "()[]{},.;:!?\"'…-–—"

VOTERS = {
    "empty": ("nothing_left", "no_content", "no_parse_nothing"),
    "refusal": ("english_prose", "whole_prose", "sentence", "is_python"),
    "language": ("script", "prose", "code", "is_python"),
    "copy": ("compared", "assertion_head", "verbatim", "novel"),
    "truncated": ("open_end", "dangling", "completable", "is_python"),
}


def _spelled(words: list[str]) -> str:
    return f" {' '.join(words)} ".lower().replace("'", " ").replace("’", " ")


def _slots(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1] * np.uint64(0x85EBCA77) + x[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) % SLOTS


def trigram_slots(words: list[str]) -> np.ndarray:
    return _slots(_spelled(words))


class Languages:
    """Log chances of character trigrams per language, with what is usual for English.

    Counts over WEIGHT are scaled down to it before smoothing: a table repeated any number of times
    gives the same model, and a single unseen trigram does not outweigh the rest of a text.
    """

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.02):
        counts = {lang: n * min(1.0, WEIGHT / max(1.0, n.sum())) for lang, n in ({"en": np.zeros(SLOTS)} | counts).items()}
        log = {lang: np.log((n + smoothing) / (n.sum() + smoothing * SLOTS)) for lang, n in counts.items()}
        self.usual = float((np.exp(log["en"]) * log["en"]).sum())
        self.by_slot = np.stack([log.pop("en"), *log.values()], axis=1)  # English first; a row per slot, read once for all languages

    def english(self, words: list[str]) -> int:
        """1 for English, -1 for another language, known or not; 0 if it can't be told.

        Another language is one that explains the words better, or nearly as well where English
        explains them much worse than its own texts; the shorter the text, the larger a shortfall is
        put down to chance.
        """
        at = trigram_slots(words)
        if len(at) < 4:
            return 0
        own, *others = (self.by_slot[at].sum(axis=0) / len(at)).tolist()
        lead = own - max(others, default=-np.inf)
        short, chance = own - self.usual, 6.0 / np.sqrt(len(at))
        if lead < 0 or (lead < 0.3 and short < -1.2 - chance) or short < -2.2 - chance or (short < -0.6 - chance / 2 and any(not w.isascii() for w in words)):
            return -1
        return 1


def fit_languages(documents: DataFrame) -> Languages:
    """Trigram counts on all labelled documents; at most SLOTS numbers a language reach the driver."""
    labelled = documents.where("lang is not null and text is not null").select("lang", "text")
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("lang") != "en", F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    lang = F.when(F.col("lang").isin([r.lang for r in counted]), F.col("lang")).otherwise("other")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spelled = _spelled(_PROSE_WORD.findall(text))
                if len(spelled) >= 6:
                    n = total.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
                    for at in range(0, len(spelled) - 2, PIECE):
                        np.add.at(n, _slots(spelled[at : at + PIECE + 2]), 1)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])

    rows = spread(labelled.select(lang.alias("lang"), "text")).mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in rows.groupby("lang"):
        counts[lang] = np.zeros(SLOTS)
        counts[lang][part.slot.to_numpy()] = part.n.to_numpy()
    return Languages(counts)


def scan(text: str) -> tuple[str, str]:
    """(closers still owed, quote still open) at the end of Python text; '!' if brackets do not match."""
    owed: list[str] = []
    quote, i = "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif text.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
            elif c == "\n" and len(quote) == 1:
                return "".join(reversed(owed)), quote
        elif c in "'\"":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                break
        elif c in "([{":
            owed.append(")]}"["([{".index(c)])
        elif c in ")]}":
            if not owed or owed.pop() != c:
                return "!", ""
        i += 1
    return "".join(reversed(owed)), quote


def open_prefixes(line: str) -> list[int]:
    """The lengths k, from 1 to one less than that of a line, at which scan(line[:k]) finds matching brackets and something still open."""
    out: list[int] = []
    owed: list[str] = []
    quote, run, escaped = "", 0, False  # run: quotes of the kind that opened the literal, since it opened or, in a long one, in a row
    for k, c in enumerate(line[:-1], 1):
        if len(quote) == 1:
            if escaped:
                escaped = False
            elif c == quote:
                quote, run = "", run + 1 if run == 1 else 0
                if run == 2:  # nothing between: closed, unless a third one makes it a long literal
                    out += [k] if owed else []
                    last = c
                    continue
            else:
                escaped = c == "\\"
            run = 0
        elif quote:
            if escaped:
                escaped, run = False, 0
            elif c == quote[0]:
                run += 1
                if run == 3:
                    quote, run = "", 0
            else:
                escaped, run = c == "\\", 0
        elif run == 2 and c == last:
            quote, run = c * 3, 0
        else:
            run = 0
            if c in "'\"":
                quote, run = c, 1
            elif c == "#":
                return out + (list(range(k, len(line))) if owed else [])
            elif c in "([{":
                owed.append(")]}"["([{".index(c)])
            elif c in ")]}" and (not owed or owed.pop() != c):
                return out
        if owed or quote:
            out.append(k)
    return out


@contextmanager
def quiet() -> Iterator[None]:
    """Without the parser's warnings; entered once a batch, as it costs half as much as a parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def parses(text: str) -> bool:
    try:
        compile(text, "<answer>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
        return True
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False


def compared_expression(prefix: str) -> str:
    """The expression that the unfinished last line of a prefix compares its answer with; empty if there is none."""
    line = prefix.rstrip().rsplit("\n", 1)[-1].strip()
    if line.startswith("assert ") or line == "assert":
        body = line[6:].strip()
        if body.endswith("("):
            body = re.sub(r"[\w.]+\($", "", body).strip()
        return _COMPARED.sub("", body).strip()
    depth = 0
    for i, c in enumerate(line):
        if c == "(":
            if depth == 0:
                start = i + 1
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                start = None
    if depth > 0 and start is not None:
        return line[start:].strip().rstrip(",").strip()
    return ""


def _squeeze(text: str) -> str:
    return "".join(text.split())


def votes(prefix: str | None, target: str | None, kind: str | None, languages: Languages) -> list[int]:
    """The votes of all labelling functions, in the order of VOTERS."""
    prefix, target, kind = prefix or "", target or "", kind or ""
    seen = _UNSEEN.sub(" ", target).strip()
    call = kind != "assert"

    nothing = _NOTHING.fullmatch(seen.replace(" ", "")) is not None
    if nothing:
        return [1, 1, 1, *[-1] * 4, *[-1] * 4, -1, -1, -1, -1, 0, 0, 0, -1]

    whole = "f(" + seen if call else "(" + seen + "\n)"
    foreign_letters = len(_OTHER_SCRIPT.findall(_LITERAL.sub("", seen)))
    is_python = not seen.startswith("#") and (parses(whole) or (not call and parses(seen)))
    quoted = seen[0] in "\"'" or re.match(r"[rbfuRBFU]{1,2}[\"']", seen) is not None
    remark = seen.lstrip("#/ ").strip() if seen.startswith(("#", "//")) else seen
    bare = _PLAIN_LITERAL.sub(" ", remark)

    owed, quote = scan(whole) if call else scan(seen)
    core = seen[:-1].rstrip() if call and seen.endswith(")") and owed == "" else seen
    trimmed = _DOTS_END.sub("", seen).rstrip()
    completable = False
    if not is_python and owed != "!":
        for stem in dict.fromkeys((seen, trimmed)):
            start = "f(" + stem if call else "(" + stem
            need, open_quote = (owed, quote) if start == whole else scan(start)
            if need == "!":
                continue
            end = open_quote + need + ("" if call or need.endswith(")") else ")")
            if any(start + filler + end != whole and parses(start + filler + end) for filler in (("",) if open_quote else ("", " x", ": x", "=x", "x"))):
                completable = True
                break

    tokens = [t.strip(_MARKS_AROUND) for t in bare.split()] if not is_python and not quoted and not completable else []
    tokens = [t for t in tokens if t]
    words = [t for t in tokens if _PROSE_WORD.fullmatch(t)]
    prose = len(words) >= 2 and len(words) > 0.5 * len(tokens) and _HEAD.match(seen) is None and not ("\n" in target.strip() and _STATEMENT.search(target))
    english = languages.english(words) if prose else 0
    code = not is_python and not quoted and not (english > 0 and len(words) > 0.85 * len(tokens)) and _FOREIGN_CODE.search(bare) is not None
    prose, english = prose and not code, 0 if code else english
    ended = re.search(r"\w[.!?]\W*$", bare) is not None

    out = [-1, -1, -1]
    # refusal
    out += [1 if english > 0 else -1 if not prose or english < 0 else 0, 1 if english >= 0 and prose and len(words) >= 0.6 * len(tokens) else 0 if english >= 0 and prose else -1, 1 if english >= 0 and prose and (len(words) >= 5 or ended) else 0, -1 if is_python or quoted or completable else 0]
    # language
    out += [1 if foreign_letters >= 3 and not quoted else 0, 1 if english < 0 else 0, 1 if code else 0, -1 if (is_python or quoted) and foreign_letters < 3 else 0]
    # copy
    lean, expression = _squeeze(core), _squeeze(compared_expression(prefix))
    echoed = bool(expression) and (lean == expression or _squeeze(seen) == expression)
    head = _HEAD.match(seen) is not None
    lines = prefix.rstrip().rsplit("\n", 1)
    several = "\n" in target.strip()
    within = (several or head) and lean in _squeeze(prefix)
    verbatim = len(lean) >= 12 and within
    novel = not echoed and not head and not (several and within)
    own = head and _squeeze(lines[-1]).startswith(_squeeze(_HEAD.match(seen).group(0)))
    out += [1 if echoed else 0, 1 if own else 0, 1 if verbatim else 0, -1 if novel else 0]
    # truncated
    dotted = trimmed != seen and not is_python
    dangling = not is_python and (dotted or _OPERATOR_END.search(seen) is not None)
    open_end = bool(quote) or (owed not in ("", "!"))
    out += [1 if open_end or dotted else -1, 1 if dangling else 0, 1 if completable else 0, -1 if is_python else 0]
    return out


N_VOTERS = sum(map(len, VOTERS.values()))


def _written(said: list[int]) -> str:
    return "".join("-0+"[v + 1] for v in said)


def vote_table(qna: DataFrame, languages: Languages) -> DataFrame:
    """(qna_id, pattern, planted): each row's votes as a string of -, 0 and +, and the same for each defect planted in it, as defect:call:pattern between commas; null where the row is not well-formed."""
    shared = qna.sparkSession.sparkContext.broadcast(languages)  # SLOTS numbers a language
    schema = pa.schema([("qna_id", pa.int64()), ("pattern", pa.string()), ("planted", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        refused = lru_cache(1 << 14)(lambda text, call: _written(votes("", text, "" if call else "assert", known)))  # only votes on copies depend on the prefix; no cutoff of theirs looks at refusals
        for batch in batches:
            said, trials = [], []
            with quiet():
                for row, prefix, target, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    own, call, bad = _written(votes(prefix, target, kind, known)), int((kind or "") != "assert"), []
                    for defect, text in planted(prefix or "", target or "", kind or "", row):
                        on_trial = own if not defect else refused(text, call) if defect == "refusal" else _written(votes(prefix, text, kind, known))
                        bad.append(f"{defect}:{call}:{on_trial}")
                    said.append(own)
                    trials.append(",".join(bad) or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(trials, pa.string())], schema=schema)

    return spread(qna.where("qna_id is not null").select("qna_id", "prefix", "target", "assertion_type")).mapInArrow(label, "qna_id long, pattern string, planted string")


def planted(prefix: str, target: str, kind: str, seed: int) -> Iterator[tuple[str, str]]:
    """(defect, target): a well-formed answer as it is, under the name "", and with each defect that can be planted in its place; for other languages see passage_votes."""
    call = kind != "assert"
    end = ")" if call else ""
    seen = _UNSEEN.sub(" ", target).strip()
    core = seen[:-1].rstrip() if call and seen.endswith(")") else seen
    if not core or not parses("f(" + core + ")") or (call and not seen.endswith(")")):
        return
    expression = compared_expression(prefix)
    if _squeeze(core) == _squeeze(expression) or _HEAD.match(seen) or "\n" in core:
        return
    rng = random.Random(seed)
    yield "", target
    yield "empty", rng.choice(["", "  ", ",", ")", " , )"])
    open_at = open_prefixes(core)
    if open_at:
        yield "truncated", core[: rng.choice(open_at)] + rng.choice(["", "", "..."])
    if expression:
        yield "copy", expression + end
    yield "refusal", rng.choice(PLANTED_REFUSALS).format((re.findall(r"[A-Za-z]\w+", prefix) or ["it"])[-1]) + end


def planted_votes(said: DataFrame) -> DataFrame:
    """(defect, call, pattern, n): votes on every well-formed pair as it is and with each planted defect. Rows: vote patterns, bounded by the voters."""
    rows = said.select(F.explode("planted").alias("row")).select(F.explode(F.split("row", ",")).alias("planted")).select(F.split("planted", ":").alias("part"))
    return rows.groupBy(*(F.col("part")[i].alias(name) for i, name in enumerate(("defect", "call", "pattern")))).agg(F.count("*").alias("n"))


def passage_votes(documents: DataFrame, languages: Languages) -> DataFrame:
    """(call, pattern, n): votes on a passage of eight words of every document labelled as not English, given as an answer in a call and outside one.

    Only the votes on copies depend on the prefix, and no cutoff of theirs looks at other languages;
    so these counts stand for every pair with every passage.
    """
    shared = documents.sparkSession.sparkContext.broadcast(languages)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            with quiet():
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = text.split()
                    if words:
                        at = (row or 0) % max(1, len(words) - 8)
                        passage = " ".join(words[at : at + 8])[:200]
                        out += [("1", _written(votes("", passage + ")", "", known))), ("0", _written(votes("", passage, "assert", known)))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], names=["call", "pattern"])

    other = documents.where("lang <> 'en' and text is not null").select("doc_id", "text")
    return spread(other).mapInArrow(cut, "call string, pattern string").groupBy("call", "pattern").agg(F.count("*").alias("n"))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(prior, chances): chances[truth, voter, vote + 1], by expectation-maximization over vote patterns (rows of -1, 0, 1).

    Voters are taken to be independent given the truth; each has its own chance of every vote under
    either truth. Votes in favour start out as three times likelier under the defect.
    """
    score = patterns.sum(axis=1)
    posterior = np.where((patterns == 1).any(axis=1) & (score > 0), 0.9, np.where((patterns == 1).any(axis=1), 0.4, 0.01))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        votes_cast = np.stack([mass @ (patterns == v) for v in (-1, 0, 1)], axis=2)
        chances = (votes_cast + 0.1) / (mass.sum(axis=1)[:, None, None] + 0.3)
        fresh = posteriors(patterns, prior, chances, False)
        if np.abs(fresh - posterior).max() < 1e-9:
            break
        posterior = fresh
    return prior, chances


def posteriors(patterns: np.ndarray, prior: np.ndarray, chances: np.ndarray, grounded: bool = True) -> np.ndarray:
    """Posterior of the defect for each pattern; where grounded, 0 without a single vote in favour."""
    log = np.log(prior)[:, None] + sum(np.log(chances[:, j, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
    posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return np.where((patterns == 1).any(axis=1), posterior, 0.0) if grounded else posterior


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    return posteriors(patterns, *fit_label_model(patterns, counts, rounds))


def validated_cutoff(posterior: np.ndarray, true: np.ndarray, counts: np.ndarray) -> float:
    """The cutoff of the best F1 on labelled rows, in the middle between the posteriors on its two sides; 0.5 without a true row."""
    if not (counts * true).sum():
        return 0.5
    levels = np.unique(posterior)
    f1 = [2 * (counts * true * (posterior >= x)).sum() / ((counts * (posterior >= x)).sum() + (counts * true).sum()) for x in levels]
    best = int(np.argmax(f1))
    return float(np.clip((levels[best] + (levels[best - 1] if best else 0.0)) / 2, 0.02, 0.98))


def _matrix(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns], dtype=int).reshape(len(patterns), N_VOTERS)


def _judged(qna: DataFrame, documents: DataFrame) -> tuple[DataFrame, list[tuple[str, str, float]], list[tuple[str, float, int, float, float]]]:
    """(votes, labels, validation): labels (pattern, defect, posterior) at or over their cutoffs; per defect its cutoff, planted rows, precision and recall on them."""
    languages = fit_languages(documents)
    said = stored(vote_table(qna, languages).groupBy("qna_id", "pattern").agg(F.collect_set("planted").alias("planted")), "defect-votes")
    table = said.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()  # a row per vote pattern: bounded by the voters
    known = planted_votes(said).toPandas()
    passages = passage_votes(documents, languages).toPandas()
    well_formed = known[known.defect == ""].groupby("call").n.sum()
    passages["n"] = passages.n * passages.call.map(well_formed).fillna(0.0) / passages.groupby("call").n.transform("sum")  # all passages together are one planted row a pair
    known = pd.concat([known, passages[passages.n > 0].assign(defect="language")], ignore_index=True)
    matrix, trial = _matrix(table.pattern.tolist()), _matrix(known.pattern.tolist())
    labels, validation, at = [], [], 0
    for defect, voters in VOTERS.items() if len(table) else ():
        part = slice(at, at + len(voters))
        at += len(voters)
        fitted = fit_label_model(matrix[:, part], table.n.to_numpy().astype(float))
        on_trial, true = posteriors(trial[:, part], *fitted), (known.defect == defect).to_numpy()
        n = known.n.to_numpy() * ~known.defect.isin(DEFECTS[: DEFECTS.index(defect)]).to_numpy()  # a label before this one would hold instead
        cutoff = validated_cutoff(on_trial, true, n)
        hit = on_trial >= cutoff
        validation.append((defect, cutoff, round((n * true).sum()), float((n * true * hit).sum() / max(1.0, (n * hit).sum())), float((n * true * hit).sum() / max(1.0, (n * true).sum()))))
        labels += [(p, defect, float(q)) for p, q in zip(table.pattern, posteriors(matrix[:, part], *fitted), strict=True) if q >= cutoff]
    return said, labels, validation


def defect_labels(qna: DataFrame, documents: DataFrame) -> DataFrame:
    """(qna_id, defect, posterior): every label whose posterior reaches its cutoff; a row may have several.

    A null target counts as empty, a null prefix as an empty one. Redelivered rows count once.
    Without documents, or without a language among them, prose is taken for English.
    """
    said, labels, _ = _judged(qna, documents)
    rows = qna.sparkSession.createDataFrame(labels, "pattern string, defect string, posterior double")
    return said.join(F.broadcast(rows), "pattern").select("qna_id", "defect", "posterior")


def validation_report(qna: DataFrame, documents: DataFrame) -> DataFrame:
    """(defect, cutoff, n_planted, precision, recall): how the label model does on planted defects."""
    return qna.sparkSession.createDataFrame(_judged(qna, documents)[2], "defect string, cutoff double, n_planted long, precision double, recall double")


def defective_pairs(qna: DataFrame, documents: DataFrame) -> DataFrame:
    """(qna_id, defect): the label that holds first, in the order of DEFECTS, for each defective row."""
    place = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    ranked = defect_labels(qna, documents).withColumn("place", F.row_number().over(Window.partitionBy("qna_id").orderBy(place)))
    return ranked.where("place = 1").select("qna_id", "defect")
