"""One consistent form for texts that look the same (problem 1).

The form of a text: ignorable characters deleted, compatibility and canonical
variants composed alike, hyphens that look like ``-`` made ``-``, every run of
white space one space, none at the ends; and each token whose letters could be
read in several scripts spelled by the best path through its look-alike
lattice. The lattice of a token holds, at each place, every letter that looks
like the one there, so it depends on how the token looks and not on how it is
stored: two texts that look the same always get the same form, whatever the
scores are. The scores (character bigrams within one script, counted over the
whole corpus) only decide which spelling that is; with ties and without
evidence of another script it is the Latin one.

Defined results: null -> null; empty or blank -> "" (and never a found case);
texts of any length are treated whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.shared import kept

# --- fixed values: letters of other scripts that look like Latin ones -------
CYRILLIC = {
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
}
GREEK = {
    "α": "a", "ι": "i", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
ARMENIAN = {"օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C",
    "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Look-alikes of the ASCII hyphen.
HYPHENS = r"‐‑‒–⁃˗−﹘﹣－"
#: Invisible characters (ranges): controls that aren't white space, soft hyphen, joiners, marks of direction,
#: fillers, variation selectors, tags.
IGNORABLE = (
    r"\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f"
    r"\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U0001bca0-\U0001bca3"
    r"\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
# -----------------------------------------------------------------------------

#: Numbered from 0.
SCRIPTS = ("latin", "cyrillic", "greek", "armenian", "cherokee")
_TABLES = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE)
LATIN_OF = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE}
_READINGS: dict[str, tuple[tuple[int, str], ...]] = {}
for _script, _table in enumerate(_TABLES, 1):
    for _own, _latin in _table.items():
        _READINGS[_latin] = (*_READINGS.get(_latin, ((0, _latin),)), (_script, _own))
_LATTICE = {**_READINGS, **{own: _READINGS[latin] for own, latin in LATIN_OF.items()}}

_IGNORED = re.compile(f"[{IGNORABLE}]+")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1c80-\u1c8f]")
_MIXED_TOKEN = re.compile("[A-Za-z\u00aa-\u024f\u0300-\u058f\u13a0-\u13ff]+")
_AMBIGUOUS_TOKEN = re.compile(f"(?<![^\\W\\d_])[{''.join(_READINGS)}]+(?![^\\W\\d_])")
_NOT_ALNUM = re.compile(r"[\W_]+")


def without_ignorable(text: str) -> str:
    return _IGNORED.sub("", text)


def has_foreign_letters(text: str) -> bool:
    """Whether a letter of another script with Latin look-alikes is in the text."""
    return _FOREIGN.search(text) is not None


def script_of(letter: str) -> int:
    """The script's place in SCRIPTS, -1 for anything else."""
    o = ord(letter)
    if o < 0x250:
        return 0 if letter.isalpha() else -1
    if 0x370 <= o < 0x400:
        return 2
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90:
        return 1
    if 0x530 <= o < 0x590:
        return 3
    return 4 if 0x13A0 <= o < 0x1400 else -1


class Speller:
    """Viterbi search of look-alike lattices under script-consistent bigram scores.

    ``counts`` maps (script, first, second) to how often the bigram stands in
    the corpus; "" is the edge of a token. The number of entries is bounded by
    the letters of three scripts squared. A script without evidence is no
    choice for a letter that has a Latin reading.
    """

    SWITCH = -12.0  # log score of changing the script within a token

    def __init__(self, counts: dict[tuple[int, str, str], int] | None = None) -> None:
        self.counts = counts or {}
        self.totals: Counter = Counter()
        self.alive = {0}
        letters: dict[int, set[str]] = {s: set() for s in range(len(SCRIPTS))}
        for (script, a, b), n in self.counts.items():
            self.totals[script, a] += n
            letters[script].update((a, b))
            self.alive.add(script)
        self.size = {s: len(x) + 60 for s, x in letters.items()}
        self.weight = {s: math.log((sum(n for (k, _), n in self.totals.items() if k == s) + 1)) for s in range(len(SCRIPTS))}
        self.seen: dict[str, str] = {}

    def score(self, script: int, a: str, b: str) -> float:
        n = self.counts.get((script, a, b), 0)
        return math.log((n + 0.5) / (self.totals.get((script, a), 0) + 0.5 * self.size[script]))

    def spell(self, token: str) -> str:
        """The best spelling of a token; equal for all tokens that look like it."""
        base = unicodedata.normalize("NFD", token)
        places = [c for c in base if not unicodedata.combining(c)]
        look = "".join(LATIN_OF.get(c, c) for c in places)
        if look in self.seen:
            best = self.seen[look]
        else:
            best = self._search(look)
            if len(self.seen) < 200_000:
                self.seen[look] = best
        if len(places) == len(base):
            return best
        kept = iter(best)
        return unicodedata.normalize("NFC", "".join(c if unicodedata.combining(c) else next(kept) for c in base))

    def _search(self, look: str) -> str:
        paths: dict[int, tuple[float, str]] = {}
        for i, c in enumerate(look):
            readings = [(s, x) for s, x in _LATTICE.get(c, ((script_of(c), c),)) if s in self.alive or len(_LATTICE.get(c, ())) < 2]
            step: dict[int, tuple[float, str]] = {}
            for script, x in readings:
                known = max(script, 0)
                if not i:
                    step[script] = (self.weight[known] + self.score(known, "", x), x)
                    continue
                options = []
                for before, (total, text) in paths.items():
                    same = before == script
                    options.append((total + self.score(known, text[-1] if same else "", x) + (0.0 if same else self.SWITCH), -before, text + x))
                total, _, text = max(options, key=lambda o: (o[0], o[1]))
                step[script] = (total, text)
            paths = step
        if not paths:
            return look
        ends = [(total + self.score(max(s, 0), text[-1], ""), -s, text) for s, (total, text) in paths.items()]
        return max(ends)[2]


#: The speller without evidence of other scripts: every look-alike is Latin.
LATIN_SPELLER = Speller()


def one_form(text: str | None, speller: Speller = LATIN_SPELLER) -> str | None:
    """The form in which equal-looking texts are equal; None for None."""
    if text is None:
        return None
    if not text.isascii():
        text = _IGNORED.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = _IGNORED.sub("", unicodedata.normalize("NFKC", text))
        text = _HYPHEN.sub("-", text)
        if _FOREIGN.search(text):
            text = _MIXED_TOKEN.sub(lambda m: speller.spell(m[0]) if _FOREIGN.search(m[0]) else m[0], text)
            text = unicodedata.normalize("NFC", text)
    else:
        text = _IGNORED.sub("", text)
    if len(speller.alive) > 1:
        text = _AMBIGUOUS_TOKEN.sub(lambda m: speller.spell(m[0]), text)
    return " ".join(text.split())


def letters_and_digits(text: str | None, speller: Speller = LATIN_SPELLER) -> str:
    """One form, lower case, all but letters and digits removed; "" for None."""
    return _NOT_ALNUM.sub("", one_form(text, speller).lower()) if text else ""


_TABLE = np.zeros(0, dtype=np.int32)


def _table() -> np.ndarray:
    """For each code point below 0x10000 the letter or digit it becomes, 0 if it vanishes, -1 if its neighbours matter."""
    global _TABLE
    if not len(_TABLE):
        table = np.full(0x10001, -1, dtype=np.int32)  # the last entry is for all code points above
        for code in range(0x10000):
            c = chr(code)
            depends = 0xD800 <= code < 0xE000 or 0x1100 <= code < 0x1200 or "Σ" in unicodedata.normalize("NFKC", c) or unicodedata.category(c)[0] == "M"
            if not depends and len(own := letters_and_digits(c)) <= 1:
                table[code] = ord(own) if own else 0
        _TABLE = table
    return _TABLE


def all_letters_and_digits(texts: list[str]) -> list[str]:
    """``letters_and_digits`` of each text, by table where no character's neighbours matter."""
    if not texts:
        return []
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mapped = _table()[np.minimum(codes, 0x10000)]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    hard = np.concatenate(([0], np.cumsum(mapped < 0)))
    kept = np.concatenate(([0], np.cumsum(mapped > 0)))
    whole = mapped[mapped > 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    begins = np.concatenate(([0], ends[:-1]))
    out, difficult = [], (hard[ends] > hard[begins]).tolist()
    for text, a, b, slow in zip(texts, kept[begins].tolist(), kept[ends].tolist(), difficult):
        out.append(letters_and_digits(text) if slow else whole[a:b])
    return out


def digest(text: str) -> bytes:
    """128 bits; texts are taken as equal if these are."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


# --- the corpus's bigrams ------------------------------------------------------

_LETTER_CLASS = np.zeros(0x250, dtype=np.int16)
_LATIN_LETTERS = [c for c in map(chr, range(0x250)) if c.isalpha()]
for _i, _c in enumerate(_LATIN_LETTERS):
    _LETTER_CLASS[ord(_c)] = _i + 1
_WIDTH = len(_LATIN_LETTERS) + 1


def _latin_bigrams(joined: str) -> np.ndarray:
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.zeros(len(codes) + 2, dtype=np.int32)
    kind[1:-1] = np.where(codes < 0x250, _LETTER_CLASS[np.minimum(codes, 0x24F)], 0)
    return np.bincount(kind[:-1] * _WIDTH + kind[1:], minlength=_WIDTH * _WIDTH)


def _foreign_bigrams(text: str, into: Counter) -> None:
    """Counts tokens that one non-Latin script alone can spell."""
    for m in _MIXED_TOKEN.finditer(text):
        token = m[0]
        if len(token) < 2 or not _FOREIGN.search(token):
            continue
        sure = {script_of(c) for c in token if c not in LATIN_OF and c not in _READINGS and script_of(c) >= 0}
        if len(sure) == 1 and 0 not in sure:
            script = sure.pop()
            if all(script_of(c) in (script, -1) for c in token):
                for a, b in zip(("", *token), (*token, "")):
                    into[script, a, b] += 1


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    latin, foreign = np.zeros(_WIDTH * _WIDTH, dtype=np.int64), Counter()
    for batch in batches:
        for column in batch.columns:
            texts = [t for t in column.to_pylist() if t]
            if texts:
                latin += _latin_bigrams("\n".join(texts))
                for t in texts:
                    if not t.isascii() and _FOREIGN.search(t):
                        _foreign_bigrams(unicodedata.normalize("NFKC", _IGNORED.sub("", t)), foreign)
    rows = [(s, a, b, n) for (s, a, b), n in foreign.items()]
    edge = ["", *_LATIN_LETTERS]
    for i in np.flatnonzero(latin):
        a, b = edge[i // _WIDTH], edge[i % _WIDTH]
        if a or b:
            rows.append((0, a, b, int(latin[i])))
    cols = list(zip(*rows)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
        names=["script", "first", "second", "n"],
    )


def learn_speller(texts: DataFrame) -> Speller:
    """Bigram counts over every text in the (string) columns of ``texts``.

    The result is bounded by the alphabets: at most (letters below U+0250)^2
    Latin pairs and the pairs of the Greek and Cyrillic blocks.
    """
    counted = texts.mapInArrow(_count_batches, "script int, first string, second string, n bigint")
    rows = counted.groupBy("script", "first", "second").agg(F.sum("n").alias("n")).collect()
    return Speller({(r["script"], r["first"], r["second"]): r["n"] for r in rows})


def with_one_form(df: DataFrame, column: str | Column, to: str, speller: Speller = LATIN_SPELLER) -> DataFrame:
    """``df`` with the one form of ``column`` in the new (or replaced) column ``to``.

    Every other column, whatever its name, is kept; null stays null.
    """

    @F.pandas_udf("string")
    def form(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: one_form(t, speller), na_action="ignore")

    return df.withColumn(to, form(F.col(column) if isinstance(column, str) else column))


def form_keys(df: DataFrame, key: str, column: str, speller: Speller) -> DataFrame:
    """key, form (128 bits), stored (128 bits) of each text that isn't blank."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short: dict[str, bytes | None] = {}

        def of(text: str) -> bytes | None:
            if len(text) < 80 and text in short:
                return short[text]
            form = one_form(text, speller)
            found = digest(form) if form else None
            if len(text) < 80 and len(short) < 50_000:
                short[text] = found
            return found

        for batch in batches:
            ids, forms, stored = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k is not None and t and (f := of(t)):
                    ids.append(k)
                    forms.append(f)
                    stored.append(digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(forms, pa.binary()), pa.array(stored, pa.binary())], names=["key", "form", "stored"])

    picked = df.select(F.col(key).cast("string").alias("key"), F.col(column).alias("text")).where("text is not null and text <> ''")
    return picked.mapInArrow(keys, "key string, form binary, stored binary")


def equal_looking(keys: DataFrame) -> DataFrame:
    """left_key, right_key (smaller first) of texts that differ as stored and are equal in one form.

    A form of which only one stored text exists (any number of exact copies)
    ends in the first aggregation; only texts of forms with several go on.
    """
    several = keys.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("form")
    rows = kept(keys.join(several, "form", "left_semi").distinct())
    # spellings of a form meet first, then their members: copies of one spelling are never held against each other
    spelled = rows.select("form", F.col("stored").alias("a")).distinct()
    met = spelled.join(spelled.select("form", F.col("a").alias("b")), "form").where("a < b")
    left, right = rows.select("form", F.col("stored").alias("a"), F.col("key").alias("x")), rows.select("form", F.col("stored").alias("b"), F.col("key").alias("y"))
    pairs = met.join(left, ["form", "a"]).join(right, ["form", "b"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("left_key"), F.greatest("x", "y").alias("right_key")).distinct()


def matching_headings(keys: DataFrame, agreed: DataFrame) -> DataFrame:
    """left_key (of ``keys``), right_key (of ``agreed``): equal in one form, different as stored."""
    right = agreed.select("form", F.col("key").alias("right_key"), F.col("stored").alias("right_stored"))
    return keys.join(right, "form").where("stored <> right_stored").select(F.col("key").alias("left_key"), "right_key").distinct()
