"""Evaluation passages inside a corpus (problem 8).

Each shard of the corpus becomes an FM-index: the shard's normal texts (one
form, lower case, letters and digits only) are joined with separators, their
suffixes sorted by prefix doubling, and the Burrows-Wheeler transform kept as a
wavelet matrix whose rank answers backward-search steps. Every phrase of the
wanted length of every test item is searched backward, all phrases in step, and
those without an occurrence drop out as they narrow to nothing. Occurrences are
located by walking to the next sampled suffix position; hits of the same item
in the same document are merged to spans.

An item and a document share a run of at least w letters or digits exactly if
some phrase of w of the item stands in the document, so the result is exact.

The items are a table of any size: they are sent to the tasks in blocks of a
measured size, one block after the other against the whole corpus.

Defined results: null, empty and short texts and items have no hits; an item of
another or of no language has the default window; texts of any length are
treated whole (a text longer than a shard is cut into shards of its own that
overlap by the longest window, and its spans are merged again).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.forms import all_letters_and_digits, letters_and_digits

#: Symbols of a shard: rank, second rank and place of a suffix fit in 63 bits.
SHARD = 1 << 21
_BITS = 21
_STRIDE = 32
_PHRASES = 1 << 18  # phrases searched in step


def suffix_array(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``codes`` (below ``symbols``, the last one 0 and unique as an end).

    Prefix doubling; in each round only the suffixes that are still tied are
    sorted, as single integers of rank, rank further on, and place.
    """
    n = len(codes)
    width = max(1, int(42 / np.log2(max(2, symbols))))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        key *= np.uint64(symbols)
        key[: max(0, n - i)] += codes[i:].astype(np.uint64)
    place = np.uint64((1 << _BITS) - 1)
    ordered = np.sort(key << np.uint64(_BITS) | np.arange(n, dtype=np.uint64))
    order = (ordered & place).astype(np.int64)
    key = ordered >> np.uint64(_BITS)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order
    depth = width
    while len(tied):
        suffix = order[tied]
        further = np.minimum(suffix + depth, n)
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        keys = (rank[suffix].astype(np.uint64) << np.uint64(2 * _BITS + 1)) | (second.astype(np.uint64) << np.uint64(_BITS)) | suffix.astype(np.uint64)
        keys.sort()
        order[tied] = (keys & place).astype(np.int64)
        keys >>= np.uint64(_BITS)
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        rank[order[tied]] = tied[np.repeat(first, np.diff(np.append(first, len(tied))))]
        tied = tied[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in a sequence: a bit plane and its running count per level."""

    def __init__(self, sequence: np.ndarray, levels: int) -> None:
        self.levels, self.counts, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            count = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.counts.append(count)
            self.zeros.append(len(bit) - int(count[-1]))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros(len(at), dtype=np.int64)
        at = at.astype(np.int64)
        for level, count, zeros in zip(range(self.levels - 1, -1, -1), self.counts, self.zeros):
            one = (symbols >> level & 1).astype(bool)
            b, a = count[begin], count[at]
            begin = np.where(one, zeros + b, begin - b)
            at = np.where(one, zeros + a, at - a)
        return at - begin

    def access_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        begin, symbols = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        at = at.astype(np.int64)
        for count, zeros in zip(self.counts, self.zeros):
            one = count[at + 1] != count[at]
            symbols = symbols << 1 | one
            b, a = count[begin], count[at]
            begin = np.where(one, zeros + b, begin - b)
            at = np.where(one, zeros + a, at - a)
        return symbols, at - begin


class FMIndex:
    """The index of one shard of normal texts."""

    def __init__(self, texts: list[str]) -> None:
        joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        present = np.zeros(0x110000, dtype=bool)
        present[joined] = True
        alphabet = np.flatnonzero(present)
        self.code = np.full(0x110000, -1, dtype=np.int32)
        self.code[alphabet] = np.arange(len(alphabet))
        codes = self.code[joined].astype(np.int64)
        self.size = len(codes)
        order = suffix_array(codes, len(alphabet) + 1)
        transform = codes[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(alphabet)))))
        self.matrix = WaveletMatrix(transform.astype(np.int32), max(1, int(len(alphabet) - 1).bit_length()))
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        # every 32nd place and the beginnings of texts, so that no walk leaves its text
        chosen = np.arange(self.size) % _STRIDE == 0
        chosen[self.starts[:-1]] = True
        sampled = chosen[order]
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = order[sampled]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of occurring ``phrases`` (one a row, as code points) and their intervals."""
        codes = self.code[phrases]
        rows = np.flatnonzero((codes >= 0).all(1))
        low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), self.size, dtype=np.int64)
        for step in range(codes.shape[1] - 1, -1, -1):
            symbol = codes[rows, step].astype(np.int64)
            both = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            low, high = self.below[symbol] + both[: len(rows)], self.below[symbol] + both[len(rows) :]
            some = low < high
            rows, low, high = rows[some], low[some], high[some]
            if not len(rows):
                break
        return rows, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the shard of the suffixes at these places of the order."""
        out, steps = np.full(len(at), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(len(at))
        at = at.copy()
        while len(open_):
            here = self.sampled[at + 1] != self.sampled[at]
            out[open_[here]] = self.samples[self.sampled[at[here]]] + steps[open_[here]]
            open_, at = open_[~here], at[~here]
            if len(open_):
                symbol, before = self.matrix.access_and_rank(at)
                at = self.below[symbol] + before
                steps[open_] += 1
        return out


def phrases_of(items: list[tuple[int, str, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By window: all phrases (code points), and the item and place of each."""
    by: dict[int, tuple[list, list, list]] = {}
    for item, text, window in items:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(codes) >= window:
            of = by.setdefault(window, ([], [], []))
            rows = np.lib.stride_tricks.sliding_window_view(codes, window)
            of[0].append(rows)
            of[1].append(np.full(len(rows), item))
            of[2].append(np.arange(len(rows)))
    return {w: tuple(np.concatenate(x) for x in of) for w, of in by.items()}


#: Bytes of normal texts of items that are sent to the tasks at once.
ITEM_BYTES = 8 << 20


def item_blocks(items: DataFrame, key: str, text: str, window: Column, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str, int]]]:
    """The items (id, text, window) in blocks of about ``most`` bytes, by hash of their id."""
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("i"), F.col(text).alias("t"), window.cast("int").alias("w"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // most))
    for n in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n)
        yield [tuple(r) for r in block.collect()]  # about ``most`` bytes


def leaked_from(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: Column) -> DataFrame:
    """``leaked_spans`` for a table of items of any size."""
    spans = None
    for block in item_blocks(items, item_key, item_text, window):
        own = leaked_spans(df, key, text, block)
        spans = own if spans is None else spans.unionByName(own)
    return spans


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """item, start, length: spans of an item that overlap or touch as one."""
    out: list[tuple[int, int, int]] = []
    for item, start, length in sorted(spans):
        if out and out[-1][0] == item and start <= out[-1][1] + out[-1][2]:
            last = out[-1]
            out[-1] = (item, last[1], max(last[2], start + length - last[1]))
        else:
            out.append((item, start, length))
    return out


def leaked_spans(df: DataFrame, key: str, text: str, items: list[tuple[int, str, int]]) -> DataFrame:
    """key, item_id, start, length of every merged run a row's text shares with an item.

    ``items`` are (id, text, window), a block that can be sent with the tasks.
    start and length are in letters and digits.
    """
    normal = [(i, letters_and_digits(t), w) for i, t, w in items]
    shared = df.sparkSession.sparkContext.broadcast(normal)
    longest = max((w for _, _, w in items), default=1)
    key_type = df.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of(shared.value)
        shard: list[tuple[object, str]] = []
        size, step = 0, SHARD - 2 - longest
        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), all_letters_and_digits(batch.column(1).to_pylist())):
                if len(own) > step:
                    parts = [(at, own[at : at + step + longest - 1]) for at in range(0, len(own), step)]
                    found = [(item, start + at, length) for at, part in parts for _, item, start, length in hits([part], phrases)]
                    yield rows_of([(k, *s) for s in _merged(found)])
                    continue
                if size + len(own) + 1 > SHARD - 1:
                    yield rows_of([(shard[n][0], *s) for n, *s in hits([t for _, t in shard], phrases)])
                    shard, size = [], 0
                if own:
                    shard.append((k, own))
                    size += len(own) + 1
        if shard:
            yield rows_of([(shard[n][0], *s) for n, *s in hits([t for _, t in shard], phrases)])

    def hits(texts: list[str], phrases: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """Text number, item, start and length of the spans of a shard."""
        index = FMIndex(texts)
        found = []
        for window, (wanted, item, _) in phrases.items():
            for first in range(0, len(wanted), _PHRASES):
                rows, low, high = index.find(wanted[first : first + _PHRASES])
                counts = high - low
                if len(rows):
                    ends = np.cumsum(counts)
                    place = index.locate(np.repeat(low - (ends - counts), counts) + np.arange(ends[-1]))
                    text_no = np.searchsorted(index.starts, place, "right") - 1
                    found.append(np.stack((text_no, np.repeat(item[first + rows], counts), place - index.starts[text_no], np.full(len(place), window))))
        if not found:
            return []
        of = np.unique(np.concatenate(found, axis=1), axis=1)
        new = np.concatenate(([True], (np.diff(of[0]) != 0) | (np.diff(of[1]) != 0) | (of[2, 1:] > of[2, :-1] + of[3, :-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        return list(zip(of[0, first].tolist(), of[1, first].tolist(), of[2, first].tolist(), (of[2, last] + of[3, last] - of[2, first]).tolist()))

    def rows_of(spans: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*spans)) or [(), (), (), ()]
        kinds = (pa.int32() if key_type == "int" else pa.int64() if key_type == "bigint" else pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "item_id", "start", "length"])

    rows = df.select(F.col(key), F.col(text)).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    spans = rows.mapInArrow(search, f"key {key_type}, item_id bigint, start bigint, length bigint")
    return spans.select(F.col("key").alias(key), "item_id", "start", "length")
