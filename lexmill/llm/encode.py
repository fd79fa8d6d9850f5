"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

The corpus is encoded word by word, each distinct word once. A first pass splits
the texts into words; shards of them send their distinct words to the words'
partitions, where the words of all shards meet. There the merges are replayed: an
inverted index leads from each token pair to the places it stands at in all the
words, and the merges are applied in rank order. A merge visits only the places
of its own pair and enters only the two new pairs at each into the index, so the
work is in proportion to the merges done. A merge can only create pairs of later
ranks (a pair of a token has a rank after the one that makes the token), so one
pass in ascending order is the whole encoding. The ids go back to the shards,
which put their documents together.

A words' partition is as large as Spark's shuffle partitions are made; what it
replays at once is bounded by ``_REPLAYED`` bytes, which keeps memory level and
changes no id, as words don't touch each other.

Defined results: null and empty texts have an empty list of ids; strings that
spell special tokens are ordinary text; no special tokens are added; texts of
any length are treated whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.shared import kept

# --- fixed values: how byte-level tokenizers split a text into words ----------
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# -----------------------------------------------------------------------------

#: Characters of a shard's texts, bytes of words replayed at once, buckets of words for each shuffle partition.
_SHARD, _REPLAYED, _BUCKETS = 2_000_000, 2_000_000, 4


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else one above U+00FF."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _pattern(pre_tokenizer: dict) -> str:
    """The pattern of a tokenizer file's words."""
    for step in pre_tokenizer.get("pretokenizers", [pre_tokenizer]):
        if step["type"] == "Split":
            return step["pattern"]["Regex"]
        if step["type"] == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space"):
            return BYTE_LEVEL
    raise ValueError("the tokenizer splits words in a way that isn't known")


class Merges:
    """The pattern of words, ids of the single bytes, and for each mergeable pair (as one integer) its rank and the id made."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        self.pattern = _pattern(stored["pre_tokenizer"])
        vocab = model["vocab"]
        self.single = [0] * 256
        for letter, byte in byte_letters().items():
            self.single[byte] = vocab[letter]
        self.pairs: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = vocab[a], vocab[b]
            self.pairs[left << 20 | right] = rank
            self.made.append((left, right, vocab[a + b]))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
        single = np.array(self.single, dtype=np.int64)
        start = single[joined]
        ends = np.cumsum(lengths)
        n = len(start)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[(ends - lengths)[lengths > 0]] = -1
        after[(ends - 1)[lengths > 0]] = -1
        # the inverted index of the pairs of single bytes
        places: dict[int, list[int]] = {}
        left = np.flatnonzero(after >= 0)
        codes = start[left] << 20 | start[left + 1]
        distinct, inverse = np.unique(codes, return_inverse=True)
        rank_of = np.array([self.pairs.get(c, -1) for c in distinct.tolist()], dtype=np.int64)
        ranks = rank_of[inverse] if len(distinct) else np.zeros(0, dtype=np.int64)
        known = ranks >= 0
        left, ranks = left[known], ranks[known]
        order = np.argsort(ranks, kind="stable")
        left, ranks = left[order], ranks[order]
        edges = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else []
        for s, e in zip(edges, [*edges[1:], len(ranks)]):
            places[int(ranks[s])] = left[s:e].tolist()
        token, prev, nxt = start.tolist(), before.tolist(), after.tolist()
        waiting = list(places)
        heapq.heapify(waiting)
        rank_in, made = self.pairs.get, self.made
        while waiting:
            rank = heapq.heappop(waiting)
            a, b, c = made[rank]
            here = places.pop(rank)
            here.sort()
            for p in here:
                if token[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or token[q] != b:
                    continue
                token[p], token[q] = c, -1
                r = nxt[p] = nxt[q]
                if r >= 0:
                    prev[r] = p
                    new = rank_in(c << 20 | token[r])
                    if new is not None:
                        if new in places:
                            places[new].append(p)
                        else:
                            places[new] = [p]
                            heapq.heappush(waiting, new)
                r = prev[p]
                if r >= 0:
                    new = rank_in(token[r] << 20 | c)
                    if new is not None:
                        if new in places:
                            places[new].append(r)
                        else:
                            places[new] = [r]
                            heapq.heappush(waiting, new)
        out = np.array(token, dtype=np.int32)
        alive = out >= 0
        total = np.concatenate(([0], np.cumsum(alive)))
        return out[alive], total[ends] - total[ends - lengths]


def _bucket(word: str, buckets: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % buckets


_ROW = {"kind": pa.int32(), "shard": pa.int64(), "bucket": pa.int32(), "key": pa.string(), "places": pa.binary(), "words": pa.list_(pa.string()), "ids": pa.binary(), "counts": pa.binary()}
_ROW_DDL = "kind int, shard bigint, bucket int, key string, places binary, words array<string>, ids binary, counts binary"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _ROW.items()], names=list(_ROW))


def _ints(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.int32)


def split_texts(df: DataFrame, key: str, text: str, pattern: str, buckets: int) -> DataFrame:
    """Rows of documents (kind 1: shard, key, numbers of their words) and of shards' distinct words (kind 0, by bucket)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = regex.compile(pattern).findall
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        number: dict[str, int] = {}
        rows: list[dict] = []
        size = 0

        def ended() -> pa.RecordBatch:
            groups: dict[int, tuple[list[int], list[str]]] = {}
            for word, n in number.items():
                of = groups.setdefault(_bucket(word, buckets), ([], []))
                of[0].append(n)
                of[1].append(word)
            rows.extend({"kind": 0, "shard": shard, "bucket": b, "places": np.array(n, dtype=np.int32).tobytes(), "words": w} for b, (n, w) in groups.items())
            return _batch(rows)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places = [number.setdefault(w, len(number)) for w in words_of(t)] if t else []
                rows.append({"kind": 1, "shard": shard, "key": k, "places": np.array(places, dtype=np.int32).tobytes()})
                size += len(t) if t else 0
                if size > _SHARD:
                    yield ended()
                    shard, size, number, rows = shard + 1, 0, {}, []
        if rows:
            yield ended()

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(split, _ROW_DDL)


def encoded_words(words: DataFrame, merges: Broadcast, buckets: int) -> DataFrame:
    """Rows of kind 0 with ids and counts: every distinct word of the corpus replayed once, in its bucket's partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        waiting: list[tuple[int, int, bytes, np.ndarray]] = []
        new: list[str] = []
        size, bucket = 0, None
        ids, counts = [], []

        def replay() -> None:
            nonlocal new, size
            if new:
                of = merges.value.encode(new)
                ids.append(of[0])
                counts.append(of[1])
            new, size = [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            replay()
            all_ids, all_counts = np.concatenate(ids), np.concatenate(counts)
            ends = np.cumsum(all_counts)
            for shard, own_bucket, places, at in waiting:
                n = all_counts[at]
                begin = np.repeat(ends[at] - n - (np.cumsum(n) - n), n)
                own = all_ids[begin + np.arange(int(n.sum()))]
                yield _batch([{"kind": 0, "shard": shard, "bucket": own_bucket, "places": places, "ids": own.astype(np.int32).tobytes(), "counts": n.astype(np.int32).tobytes()}])

        for batch in batches:  # sorted by bucket
            for shard, b, places, words_ in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5))):
                if b != bucket and waiting:
                    yield from answers()
                    number, waiting, ids, counts = {}, [], [], []
                bucket = b
                at = np.empty(len(words_), dtype=np.int64)
                for i, w in enumerate(words_):
                    n = number.get(w)
                    if n is None:
                        n = number[w] = len(number)
                        new.append(w)
                        size += len(w) * 3
                        if size > _REPLAYED:
                            replay()
                    at[i] = n
                waiting.append((shard, b, places, at))
        if waiting:
            yield from answers()

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, _ROW_DDL)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' ids; of each shard its words come first."""
    shard, parts, table = None, [], None
    for batch in batches:
        kinds, shards = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys, out, counted = [], [], []
        for i, (kind, own) in enumerate(zip(kinds, shards)):
            if own != shard:
                shard, parts, table = own, [], None
            if kind == 0:
                parts.append(tuple(_ints(batch.column(c)[i].as_py()) for c in (4, 6, 7)))
                continue
            if table is None:
                table = _by_number(parts)
            at = _ints(batch.column(4)[i].as_py())
            ids, first, count = table
            n = count[at]
            begin = np.repeat(first[at] - (np.cumsum(n) - n), n)
            own_ids = ids[begin + np.arange(int(n.sum()))]
            keys.append(batch.column(3)[i].as_py())
            out.append(own_ids)
            counted.append(len(own_ids))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counted))), pa.int32())
        values = pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, values)], names=["key", "ids"])


def _by_number(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and by word number where its ids begin and how many they are."""
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    number, ids, counts = (np.concatenate(x) for x in zip(*parts))
    count, first = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    count[number], first[number] = counts, np.cumsum(counts, dtype=np.int64) - counts
    return ids, first, count


def encode_texts(df: DataFrame, key: str, text: str, merges_path: str) -> DataFrame:
    """key and ids (array<int>) of every row of ``df``, by the byte-level BPE stored at ``merges_path``.

    The merges are read on the driver and broadcast (the file has a fixed size
    of a few MB).
    """
    spark = df.sparkSession
    merges = Merges(merges_path)
    shared = spark.sparkContext.broadcast(merges)
    buckets = _BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept, as shards are numbered by the task that makes them
    split = kept(split_texts(df, key, text, merges.pattern, buckets))
    words = encoded_words(split.where("kind = 0"), shared, buckets)
    both = split.where("kind = 1").unionByName(words)
    rows = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_assembled, "key string, ids array<int>")
    return rows.select(F.col("key").cast(df.schema[key].dataType).alias(key), "ids")
