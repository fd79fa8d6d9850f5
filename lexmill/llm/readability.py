"""Reading level of each document (problem 9).

A Rasch-style model puts documents and words on one scale of difficulty. Every
word of a sentence is a trial for every word w of the corpus, and w comes with

    logit P(w | level) = slope_w * (level - difficulty_w)

so a word has a difficulty (the level at which its odds are even, far beyond the
scale for rare words) and a slope that says how much it tells; words used at
every level have none. Occurrence and non-occurrence count: the likelihood of a
sentence at a level is the product of its words' odds, divided by what all words
together lose by not occurring, once for each of its words. A document's level
is the one most likely for all its sentences, each of which is, with a small
probability, of any level; so single sentences of another level don't change it.

The parameters are estimated by alternating optimisation:

- levels of documents, given the words (on a grid of levels, in the tasks). A
  labelled document has the level of its labels, and the others the one their
  place on the grid stands for, by borders fitted to the labelled documents
  after every round; that anchors the scale. Sentences that are more likely
  strays don't count for their document's level;
- slope and difficulty of each word, given the levels: Newton steps of the
  logistic model, for which how often a word occurs, the sum of the levels it
  occurs at, and the histogram of the levels of all words are sufficient. These
  are partial sums of one pass over the corpus.

Words (letter runs; pairs of neighbouring letters where no white space divides
words) are hashed to a fixed number of buckets, which bounds what is collected
and broadcast in each pass. Every pass reads every document's whole text, as
bucket numbers that are made once; every sentence counts by what its words say.

Defined results: documents with fewer than ``least`` characters that aren't
white space, and null texts, have no row; documents without any known word get
the level nearest to the labelled documents' mean. Without labels there is no
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.forms import LATIN_OF, one_form

BUCKETS = 1 << 18
_STEPS = 8  # grid points a level
_ENDS = "。！？；!?;\n\r"

_KIND = np.zeros(0x110000, dtype=np.uint8)  # 1 a letter of a spaced script, 2 of an unspaced one, 3 ends a sentence


def _kinds() -> np.ndarray:
    if not _KIND.any():
        letters = np.array([chr(i).isalpha() for i in range(0x30000)])
        _KIND[: len(letters)][letters] = 1
        for a, b in ((0x0E00, 0x0EFF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)):
            _KIND[a : b + 1] *= 2
        for c in _ENDS:
            _KIND[ord(c)] = 3
    return _KIND


_ODD = re.compile("[Ａ-Ｚａ-ｚ" + "".join(LATIN_OF) + r"\xad\u200b-\u200f\u2060\ufeff\ufb00-\ufb06]")


def _read_alike(text: str) -> str:
    """The text with words stored in other characters brought to one form, line by line."""
    return "\n".join(map(one_form, text.splitlines())) if not text.isascii() and _ODD.search(text) else text


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, the sentence of each, and the text of each sentence that has words."""
    texts = [_read_alike(t) for t in texts]
    codes = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), dtype=np.int64, count=len(texts))
    kind = _kinds()[np.minimum(codes, 0x10FFFF)]
    space = (codes == 32) | (codes == 0x3000) | (codes == 9)
    ends = kind == 3
    ends[:-1] |= (codes[:-1] == 46) & (space[1:] | (codes[1:] == 10))
    sentence = np.concatenate(([0], np.cumsum(ends)[:-1]))
    spaced = kind == 1
    edge = np.diff(np.concatenate(([0], spaced.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # hashes of runs by differences of one running polynomial
    base = np.full(len(codes) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    base[0] = 1
    power = np.cumprod(base)
    running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes.astype(np.uint64) * power[:-1])))
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    base[1:] = inverse
    back = np.cumprod(base)
    runs = (running[last] - running[first]) * back[first]
    pair = np.flatnonzero((kind[:-1] == 2) & (kind[1:] == 2))
    pairs = codes[pair].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + codes[pair + 1]
    at = np.concatenate((first, pair))
    hashed = np.concatenate((runs, pairs))
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    buckets = (hashed >> np.uint64(40)).astype(np.uint32) & np.uint32(BUCKETS - 1)
    order = np.argsort(sentence[at], kind="stable")
    of, buckets = sentence[at][order], buckets[order]
    count = np.bincount(of, minlength=sentence[-1] + 1 if len(sentence) else 0)
    kept = count > 0
    text_of = np.searchsorted(np.cumsum(lengths), np.flatnonzero(ends), "right")
    text_of = np.append(text_of, len(texts) - 1)[: len(count)]
    keep = kept[of]
    number = np.cumsum(kept) - 1
    return buckets[keep], number[of[keep]], text_of[kept]


def counted_words(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, words (buckets, 4 bytes each) and sizes (words per sentence, 4 bytes each) of documents long enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size = first = 0
            for i, t in enumerate([*texts, ""]):
                size += len(t)
                if i == len(texts) or size > 1_000_000:
                    last = min(i + 1, len(texts))
                    if last > first:
                        yield rows(keys[first:last], texts[first:last])
                    first, size = last, 0

    def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
        buckets, sentence, text_of = words_of(texts)
        sizes = np.bincount(sentence, minlength=len(text_of)).astype(np.int32)
        per_text = np.bincount(text_of, minlength=len(texts))
        sentence_edge = np.concatenate(([0], np.cumsum(per_text)))
        word_edge = np.concatenate(([0], np.cumsum(sizes)))[sentence_edge]
        word_bytes, size_bytes = memoryview(buckets.tobytes()), memoryview(sizes.tobytes())
        words = [bytes(word_bytes[4 * a : 4 * b]) for a, b in zip(word_edge, word_edge[1:])]
        counts = [bytes(size_bytes[4 * a : 4 * b]) for a, b in zip(sentence_edge, sentence_edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["key", "words", "sizes"])

    long = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).where(F.char_length(F.regexp_replace(text, r"(?U)\s+", "")) >= least)
    return long.select(F.col(key).cast("bigint"), text).mapInArrow(count, "key bigint, words binary, sizes binary")


class Words:
    """What the driver knows of the words after a pass: slope and intercept by bucket, and what all lose by not occurring."""

    def __init__(self, grid: np.ndarray, spread: float) -> None:
        self.grid, self.spread = grid, spread
        self.middle = grid.mean()
        self.slope, self.intercept, self.known = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS, dtype=bool)
        self.absent = np.zeros(len(grid))

    def fit(self, counts: np.ndarray, levels: np.ndarray, histogram: np.ndarray, steps: int = 10) -> None:
        """Newton steps from how often words occur, the sums of their levels, and the words at each level of the grid."""
        self.known = counts > 0
        at = np.flatnonzero(self.known)
        g = self.grid - self.middle
        self.absent = np.zeros(len(g))
        for first in range(0, len(at), 1 << 14):
            own = at[first : first + (1 << 14)]
            n, t = counts[own], levels[own] - self.middle * counts[own]
            a, c = np.zeros(len(own)), np.log(n / histogram.sum())
            for _ in range(steps):
                p = 1 / (1 + np.exp(-(a[:, None] * g + c[:, None])))
                expected = p * histogram
                w = expected * (1 - p)
                dc, da = n - expected.sum(1), t - expected @ g - a / self.spread**2
                cc, ca, aa = w.sum(1) + 1e-9, w @ g, w @ (g * g) + 1 / self.spread**2
                det = cc * aa - ca * ca
                # a step changes no odds on the scale more than about tenfold
                c, a = c + np.clip((aa * dc - ca * da) / det, -1.5, 1.5), a + np.clip((cc * da - ca * dc) / det, -0.75, 0.75)
            self.slope[own], self.intercept[own] = a, c
            self.absent += np.log1p(np.exp(a[:, None] * g + c[:, None])).sum(0)

    def difficulty(self) -> np.ndarray:
        """The level at which a word's odds are even; NaN for words that say nothing."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.known & (self.slope != 0), self.middle - self.intercept / self.slope, np.nan)

    def sentences(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The share of each level of the grid in the likelihood of each sentence."""
        edge = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        tells = np.add.reduceat(self.slope[words], edge)
        known = np.add.reduceat(self.known[words].astype(float), edge)
        out = tells[:, None] * (self.grid - self.middle) - known[:, None] * self.absent
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out


class ReadingLevels:
    """The model fitted to ``df`` and the labels of some of its documents.

    ``labels`` has the key and ``level``, 1 to ``top``; several labels of a
    document are averaged (exact repeats once). ``max_labels`` bounds the
    labelled documents that anchor the scale (taken by hash of their key).
    ``stray`` is the probability of a sentence of another level, ``spread`` the
    prior deviation of a word's slope, ``weight`` what a document without label
    counts for against a labelled one.
    """

    def __init__(
        self, df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: int = 60, top: int = 4, rounds: int = 2, max_labels: int = 200_000,
        stray: float = 0.1, spread: float = 0.7, weight: float = 0.5,
    ) -> None:
        self.key, self.top, self.stray, self.weight = key, top, stray, weight
        self.words = Words(0.5 + np.arange(top * _STEPS + 1) / _STEPS, spread)
        self.documents = counted_words(df, key, text, least).persist()
        given = labels.groupBy("key").agg(F.avg("level").alias("level"), F.xxhash64("key").alias("h")).orderBy("h", "key").limit(max_labels)
        rows = sorted((r["key"], r["level"]) for r in given.select("key", "level").collect())
        self.anchors = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)
        self.borders = np.arange(1.5, top)
        self.usual = int(np.clip(np.round(self.anchors[1].mean()), 1, top)) if len(rows) else 0
        if self.usual:
            for n in range(rounds + 1):
                counts, levels, histogram, _ = self._pass(labelled=n == 0)
                self.words.fit(counts, levels, histogram)
                self._draw_borders(self._pass(labelled=True)[3])

    @staticmethod
    def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        size_list = batch.column(2).to_pylist()
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32)
        sizes = np.frombuffer(b"".join(size_list), dtype=np.int32).astype(np.int64)
        per_text = np.fromiter((len(x) // 4 for x in size_list), dtype=np.int64, count=len(size_list))
        return keys, words, sizes, np.repeat(np.arange(len(keys)), per_text)

    @staticmethod
    def _anchored(keys: np.ndarray, anchors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        known, level = anchors
        if not len(known):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, level[at], np.nan)

    @staticmethod
    def _documents(shares: np.ndarray, text: np.ndarray, n: int, stray: float, usual: int, grid: np.ndarray) -> np.ndarray:
        """The place on the grid of each document's most likely level; ties (no known word) near the usual one."""
        each = np.log((1 - stray) * shares + stray / len(grid))
        whole = np.zeros((n, len(grid)))
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, dtype=np.int64)
        if len(first):
            whole[text[first]] = np.add.reduceat(each, first, axis=0)
        return np.argmax(whole - 1e-6 * (grid - usual) ** 2, axis=1)

    def _pass(self, labelled: bool = False) -> tuple[np.ndarray, ...]:
        """One pass: by word its occurrences and the sum of their levels; words by level; labelled documents by label and level found.

        Levels found are read on the labels' scale, by the borders.
        """
        read, anchored, place = ReadingLevels._read, ReadingLevels._anchored, ReadingLevels._documents
        top, stray, weight, usual, width = self.top, self.stray, self.weight, self.usual, len(self.words.grid)
        on_scale = ((np.searchsorted(self.borders, self.words.grid) + 0.5) * _STEPS).astype(np.int64)
        shared = self.documents.sparkSession.sparkContext.broadcast((self.anchors, self.words))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors, now = shared.value
            sums, extra = np.zeros((2, BUCKETS)), np.zeros((top + 1, width))
            for batch in batches:
                if labelled:
                    own = anchored(batch.column(0).to_numpy(zero_copy_only=False), anchors)
                    batch = batch.filter(pa.array(~np.isnan(own)))
                keys, words, sizes, text = read(batch)
                if not len(sizes):
                    continue
                given = anchored(keys, anchors)
                mine = ~np.isnan(given)
                nearest = np.clip(np.round((np.where(mine, given, 1) - now.grid[0]) * _STEPS), 0, width - 1).astype(np.int64)
                if now.known.any():
                    shares = now.sentences(words, sizes)
                    found = place(shares, text, len(keys), stray, usual, now.grid)
                    sure = mine & (given == np.round(given))
                    np.add.at(extra, (given[sure].astype(np.int64), found[sure]), 1)
                    # a sentence more likely a stray says nothing of its document's level
                    fits = (1 - stray) * shares[np.arange(len(text)), found[text]] >= stray / width
                    level, counted = np.where(mine, nearest, on_scale[found])[text], np.where(mine, 1.0, weight)[text] * fits
                else:
                    level, counted = nearest[text], np.where(mine, 1.0, 0.0)[text]
                each, at = np.repeat(counted, sizes), np.repeat(now.grid[level], sizes)
                sums[0] += np.bincount(words, each, BUCKETS)
                sums[1] += np.bincount(words, each * at, BUCKETS)
                extra[0] += np.bincount(level, counted * sizes, width)
            at = np.flatnonzero(sums[0])
            row, column = np.nonzero(extra)
            number = np.concatenate((at, -1 - (row * width + column))).astype(np.int32)
            first = np.concatenate((sums[0, at], extra[row, column]))
            second = np.concatenate((sums[1, at], np.zeros(len(row))))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(first), pa.array(second)], names=["bucket", "s0", "s1"])

        rows = self.documents.mapInArrow(add, "bucket int, s0 double, s1 double")
        got = rows.groupBy("bucket").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1")).toArrow()  # bounded by BUCKETS
        shared.unpersist()
        bucket, s0, s1 = (got[name].to_numpy() for name in ("bucket", "s0", "s1"))
        sums, extra = np.zeros((2, BUCKETS)), np.zeros((top + 1) * width)
        word = bucket >= 0
        sums[0, bucket[word]], sums[1, bucket[word]] = s0[word], s1[word]
        extra[-1 - bucket[~word]] = s0[~word]
        extra = extra.reshape(top + 1, width)
        return sums[0], sums[1], extra[0], extra[1:]

    def _draw_borders(self, found: np.ndarray) -> None:
        """Between neighbouring levels, where the smallest shares of labelled documents are on the wrong side."""
        grid = self.words.grid
        edges = (grid[1:] + grid[:-1]) / 2
        for i in range(self.top - 1):
            below, above = found[i] / max(found[i].sum(), 1), found[i + 1] / max(found[i + 1].sum(), 1)
            wrong = np.cumsum(above)[:-1] + below.sum() - np.cumsum(below)[:-1]
            inside = np.flatnonzero((edges > i + 1) & (edges < i + 2))
            best = inside[wrong[inside] <= wrong[inside].min() + 1e-12]
            self.borders[i] = edges[best].mean()

    def levels(self) -> DataFrame:
        """key and reading_level of every document long enough."""
        read, place, usual, stray = ReadingLevels._read, ReadingLevels._documents, self.usual, self.stray
        shared = self.documents.sparkSession.sparkContext.broadcast((self.words, self.borders))

        def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words_, borders = shared.value
            for batch in batches:
                keys, words, sizes, text = read(batch)
                shares = words_.sentences(words, sizes) if len(sizes) else np.zeros((0, len(words_.grid)))
                found = words_.grid[place(shares, text, len(keys), stray, usual, words_.grid)]
                level = np.searchsorted(borders, found) + 1
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(level.astype(np.int32))], names=["key", "reading_level"])

        graded = self.documents.mapInArrow(grade, "key bigint, reading_level int")
        return graded.select(F.col("key").alias(self.key), "reading_level").where(F.lit(usual > 0))

    def word_difficulty(self) -> tuple[np.ndarray, np.ndarray]:
        """Difficulty and slope by bucket."""
        return self.words.difficulty(), self.words.slope
