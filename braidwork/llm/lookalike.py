"""Visually identical text with different characters (problem 10).

A text is first brought to compatibility forms where these look the same, and stripped of what
cannot be seen; every character that has a look-alike in another script then stands for the whole
look-alike class. The classes of a word form a lattice of possible readings. Each distinct word is
searched by Viterbi under character bigrams that keep to one script, readings that no neighbour could
make the best are dropped, and a second Viterbi search over the words of the text picks among the
rest. The searches see classes only, so texts that look the same come out the same.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut_lineage, spread, stored

# Letters that look like the Latin letter in front.
CYRILLIC = "aа eе oо pр cс yу xх sѕ iі jј hһ dԁ qԛ wԝ lӏ AА BВ EЕ KК MМ HН OО PР CС TТ XХ YУ SЅ IІ JЈ GԌ WԜ"
GREEK = "oο vν AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ"
ARMENIAN = "oօ"
CHEROKEE = "DᎠ RᎡ TᎢ iᎥ AᎪ JᎫ EᎬ WᎳ MᎷ HᎻ GᏀ ZᏃ VᏙ SᏚ LᏞ CᏟ PᏢ KᏦ"
COPTIC = "OⲞ oⲟ PⲢ pⲣ CⲤ cⲥ MⲘ NⲚ HⲎ KⲔ TⲦ XⲬ BⲂ"
LISU = "Bꓐ Pꓑ Dꓓ Tꓔ Gꓖ Kꓗ Jꓙ Cꓚ Zꓜ Fꓝ Mꓟ Nꓠ Lꓡ Sꓢ Rꓣ Vꓦ Hꓧ Wꓪ Xꓫ Yꓬ Aꓮ Eꓰ Iꓲ Oꓳ Uꓴ"
PHONETIC = "gɡ"
# Hyphens drawn like the plain one, and letters that are drawn as nothing.
HYPHENS = "‐‑"
FILLERS = "ᅟᅠㅤﾠ͏឴឵"

LATIN, CYRL, GREK = 0, 1, 2
SWITCH_INSIDE, SWITCH_BETWEEN, UNSEEN = 9.0, 4.0, 7.0


def _pairs(spec: str) -> dict[str, str]:
    return {pair[1]: pair[0] for pair in spec.split()}


TO_LATIN = {look: latin for spec in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU, PHONETIC) for look, latin in _pairs(spec).items()}
READINGS: dict[str, dict[int, str]] = {}
for _script, _spec in ((CYRL, CYRILLIC), (GREK, GREEK)):
    for _look, _latin in _pairs(_spec).items():
        READINGS.setdefault(_latin, {LATIN: _latin})[_script] = _look


# Kinds of compatibility forms that show the same letters, and names of those <compat> forms that do.
SAME_FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
SAME_NAMES = re.compile(r"LIGATURE|ROMAN NUMERAL|^LATIN (?:SMALL|CAPITAL) LETTER (?:DZ|LJ|NJ)\b|^LATIN CAPITAL LETTER [DLN] WITH SMALL LETTER [ZJ]\b")


def _compatibility_table() -> dict[int, str | None]:
    """Built by rule from the character database: forms of the same look, blanks, ignorable characters. Raised, lowered, circled and squared forms look different and stay."""
    out: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F:
            out[code] = None
        elif kind == "Zs" and char != " ":
            out[code] = " "
        elif kind[0] in "LNPSM":
            form = unicodedata.decomposition(char).split(" ", 1)[0]
            if form in SAME_FORMS or (form == "<compat>" and SAME_NAMES.search(unicodedata.name(char, ""))):
                out[code] = unicodedata.normalize("NFKC", char)
    out.update({ord(c): None for c in FILLERS})
    out.update({ord(c): "-" for c in HYPHENS})
    return out


_TABLES: dict[str, dict] = {}


def _tables() -> dict[str, dict]:
    if not _TABLES:
        compat = _compatibility_table()
        _TABLES["compat"] = compat
        _TABLES["skeleton"] = compat | {ord(c): s for c, s in TO_LATIN.items()}
    return _TABLES


def apart(text: str) -> str:
    """The look-alike classes of a text, each written as its Latin member, marks apart from their letters."""
    if text.isascii():
        return text
    t = _tables()
    # Width variants may hide letters that decompose, so they go first.
    return unicodedata.normalize("NFD", text.translate(t["compat"])).translate(t["skeleton"])


def skeleton(text: str) -> str:
    """The look-alike classes of a text in composed form; equal for texts that look the same."""
    return text if text.isascii() else unicodedata.normalize("NFC", apart(text))


_MARKS = re.compile("[\u0300-\u036f]")
_WORD = re.compile(r"[^\W\d_]+")


def script_of(char: str) -> int:
    if "Ѐ" <= char <= "ԯ":
        return CYRL
    return GREK if "Ͱ" <= char <= "Ͽ" else LATIN


def bigrams_of(word: str) -> Counter:
    """Bigrams of a word of classes, without marks, if its letters stand for one script beyond doubt."""
    scripts = {script_of(c) for c in word if c not in READINGS}
    if len(scripts) != 1:
        return Counter()
    script = scripts.pop()
    read = [READINGS.get(c, {}).get(script, c) for c in word]
    return Counter(zip(["^", *read], read, strict=False))


_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII_LETTERS = re.compile("[A-Za-z]+")
MOST_WORDS = 300_000  # words whose readings a Python worker keeps; more empty its store


class Reader:
    """Prints skeletons in the likeliest script-consistent reading."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        before: Counter = Counter()
        for (a, _), n in counts.items():
            before[a] += n
        self.cost = {(a, b): math.log((before[a] + 50) / (n + 0.5)) for (a, b), n in counts.items()}
        self.known: dict[str, list[tuple[int, int, float, str]]] = {}
        self.plain: set[str] = set()

    def search(self, word: str) -> list[tuple[int, int, float, str]]:
        """(first script, last script, cost, reading): the best reading of a word for each script at its ends, without those that no context makes the best."""
        # (first script, script, letter) -> (cost, trail); a trail is a linked list, so a word of any length stays linear.
        layer: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for char in word:
            if unicodedata.category(char)[0] == "M":
                layer = {state: (cost, (char, trail)) for state, (cost, trail) in layer.items()}
                continue
            options = READINGS.get(char) or {script_of(char): char}
            nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for script, shown in options.items():
                if not layer:
                    nxt[(script, script, shown)] = (self.cost.get(("^", shown), UNSEEN), (shown, None))
                for (first, was, last), (cost, trail) in layer.items():
                    cost += (SWITCH_INSIDE if was != script else 0.0) + self.cost.get((last, shown), UNSEEN)
                    if cost < nxt.get((first, script, shown), (math.inf,))[0]:
                        nxt[(first, script, shown)] = (cost, (shown, trail))
            layer = nxt
        low = min(cost for cost, _ in layer.values())
        best: dict[tuple[int, int], tuple[float, str]] = {}
        for (first, script, _), (cost, node) in layer.items():
            if cost > low + 2 * SWITCH_BETWEEN or cost >= best.get((first, script), (math.inf,))[0]:
                continue
            out = []
            while node:
                out.append(node[0])
                node = node[1]
            best[(first, script)] = (cost, "".join(reversed(out)))
        return [(first, last, cost, shown) for (first, last), (cost, shown) in sorted(best.items())]

    def readings(self, word: str) -> list[tuple[int, int, float, str]]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MOST_WORDS:
                self.known.clear(), self.plain.clear()
            found = self.known[word] = self.search(word)
            best = min(found, key=lambda x: (x[2], x[:2]))
            if best[:2] == (LATIN, LATIN) and best[3] == word:
                self.plain.add(word)
        return found

    def read(self, text: str) -> str:
        return self.read_flat(apart(text))

    def read_flat(self, flat: str) -> str:
        """The reading of a text whose look-alike classes are given, as `apart` gives them."""
        letters = _ASCII_LETTERS if flat.isascii() else _LETTERS
        words = letters.findall(flat)
        for word in set(words).difference(self.plain):
            self.readings(word)
        if self.plain.issuperset(words):  # the cheapest readings of all words, without a switch between them: nothing can cost less
            return unicodedata.normalize("NFC", flat)
        layer: dict[int, tuple[float, tuple | None]] = {LATIN: (0.0, None)}
        for word in words:
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for first, last, cost, shown in self.readings(word):
                for script, (so_far, trail) in layer.items():
                    total = so_far + cost + (SWITCH_BETWEEN if script != first else 0.0)
                    if total < nxt.get(last, (math.inf,))[0]:
                        nxt[last] = (total, (shown, trail))
            layer = nxt
        node, out = min(layer.values(), key=lambda x: x[0])[1], []
        while node:
            out.append(node[0])
            node = node[1]
        shown = iter(reversed(out))
        return unicodedata.normalize("NFC", letters.sub(lambda _: next(shown), flat))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    words: Counter = Counter()

    def flush() -> None:
        for word, n in words.items():
            for pair, k in bigrams_of(word).items():
                total[pair] += n * k
        words.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update(_WORD.findall(_MARKS.sub("", text)))
        if len(words) > 200_000:
            flush()
    flush()
    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in total], "b": [b for _, b in total], "n": list(total.values())}, pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))


def folded_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_md5, flat): the look-alike classes of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("flat", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [None if t is None else apart(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.string())], schema=schema)

    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(text).alias("text_md5"), F.col(text).alias("text"))
    return spread(narrow).mapInArrow(fold, "doc_id long, text_md5 string, flat string")


def bigram_model(folded: DataFrame) -> dict[tuple[str, str], int]:
    """Bigram counts of Latin, Cyrillic and Greek letters over all texts.

    The model is bounded by its alphabet, not by the corpus: pairs that involve other scripts have
    one reading only and are left out before they reach the driver.
    """
    letters = "^[\\^A-Za-zÀ-ɏͰ-ϿЀ-ԯ]$"
    counts = folded.select("flat").mapInArrow(_count_batches, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("a").rlike(letters) & F.col("b").rlike(letters))
    return {(r.a, r.b): r.n for r in counts.collect()}


def canonical_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_md5, canonical, canonical_md5): each text in its one form.

    Null text gives a null form, an empty text an empty one. Line ends, letter case, accents and
    runs of blanks are visible and stay.
    """
    folded = stored(folded_texts(documents, doc_id, text), "look-folded")
    model = bigram_model(folded)
    schema = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("canonical", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            shown = [None if t is None else reader.read_flat(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string())], schema=schema)

    return folded.mapInArrow(rewrite, "doc_id long, text_md5 string, canonical string").withColumn("canonical_md5", F.md5("canonical"))


def look_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, look_class, text_md5). Texts without any visible character have no class."""
    shown = canonical_texts(documents, doc_id, text)
    return shown.where(F.col("canonical").rlike(r"\S")).select("doc_id", F.col("canonical_md5").alias("look_class"), "text_md5")


def look_alike_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): documents of one look whose strings differ, smaller id first.

    Classes with a single string, copies under any number of ids included, are dropped by an
    aggregate first. Strings, not documents, are then paired, and each pair of strings is expanded
    to its documents: copies of one string never meet each other, and only results are emitted.
    """
    member = cut_lineage(look_classes(documents, doc_id, text))
    strings = member.select("look_class", "text_md5").distinct()
    mixed = strings.groupBy("look_class").agg(F.count("*").alias("n_strings")).where("n_strings > 1").select("look_class")
    some = strings.join(mixed, "look_class", "left_semi")
    other = some.select("look_class", F.col("text_md5").alias("md5_b"))
    looks = some.withColumnRenamed("text_md5", "md5_a").join(other, "look_class").where("md5_a < md5_b").select("md5_a", "md5_b")
    a, b = (member.select(F.col("text_md5").alias(f"md5_{x}"), F.col("doc_id").alias(f"id_{x}")) for x in "ab")
    pairs = looks.join(a, "md5_a").join(b, "md5_b")
    return pairs.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()
