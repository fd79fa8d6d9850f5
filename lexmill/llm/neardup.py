"""Near-duplicate records with small edits (problem 6).

Candidates come from tensored banding of minhashes: instead of k independent
minhashes for each of L tables, ``groups`` collections of ``per_group``
minhashes are computed once, and every pair of collections forms the key of one
table. groups * per_group minhashes thus serve groups * (groups - 1) / 2 tables
of 2 * per_group rows each; two records are candidates as soon as two of their
collections agree. Every candidate pair is then verified by the exact
similarity of its shingle sets.

Exact copies (equal after normalisation) are one class: only classes are paired
and verified, and a class's members meet pairs at the end.

Tables' keys are never shuffled: a text goes to one bucket for each collection,
with a byte of each of its minhashes. Within a bucket, texts are alike in one
collection; those of them whose bytes agree in a later one, too, share a table's
key. Texts that are not alike meet there by chance, the more so the more texts
there are (their pairs grow as the square), so a pair leaves its bucket only if
as many of its bytes agree as do of nearly all pairs with the similarity wanted.

Buckets are read run by run; a bucket of more than ``BUCKET`` rows and a key of
more than ``RUN`` go through a join instead, which Spark splits where it is
skewed. No run is cut short or dropped.

Defined results: null contents, and those with fewer letters and digits than a
shingle has, are like nothing; a row repeated exactly counts once; texts of any
length are treated whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.forms import all_letters_and_digits, digest
from lexmill.sources.shared import kept, sized

#: Longest run of equal table keys whose pairs one task forms.
RUN = 1500
#: Rows of one bucket that a task holds.
BUCKET = 1 << 18
#: Share of the pairs at the least similarity that agree in too few bytes.
LOSS = 1e-4
_CHECKED = 100_000  # pairs whose bytes are held at once
_BLOCK = 1 << 16
_PAIRS = 2000  # pairs whose shingles are held at once
_MET = 1 << 20  # digests a task remembers
_GROUPS = 64  # collections at most


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``width`` characters, and where each text's begin.

    Every text must have ``width`` characters or more.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    rolled = codes[: len(codes) - width + 1].copy()
    for i in range(1, width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += codes[i : len(codes) - width + 1 + i]
    ends = np.cumsum(lengths)
    whole = np.ones(len(rolled), dtype=bool)
    for back in range(1, width):
        whole[ends[:-1] - back] = False
    rolled = rolled[whole]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    starts = np.concatenate(([0], np.cumsum(lengths - width + 1)[:-1]))
    return rolled, starts


class TensorSketch:
    """The collections of minhashes and the tables formed of their pairs."""

    def __init__(self, width: int, groups: int, per_group: int, seed: int = 11) -> None:
        self.width, self.groups, self.per_group = width, groups, per_group
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, groups * per_group, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each text and collection (its number in the last bits), and a byte of each minhash of each text."""
        buckets, marks = np.empty((len(texts), self.groups), dtype=np.uint64), np.empty((len(texts), len(self.factors)), dtype=np.uint8)
        first, size = 0, 0
        for i, t in enumerate([*texts, ""]):
            if i == len(texts) or size > _BLOCK:
                if i > first:
                    buckets[first:i], marks[first:i] = self._block(texts[first:i])
                first, size = i, 0
            size += len(t)
        return buckets, marks

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, starts = shingle_hashes(texts, self.width)
        out, marks = np.zeros((len(texts), self.groups), dtype=np.uint64), np.empty((len(texts), len(self.factors)), dtype=np.uint8)
        for i, factor in enumerate(self.factors):
            least = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), starts)
            g = i // self.per_group
            marks[:, i] = least & np.uint32(255)
            out[:, g] = (out[:, g] ^ least) * np.uint64(0x9FB21C651E98DF25)
            out[:, g] ^= out[:, g] >> np.uint64(31)
        return out & ~np.uint64(_GROUPS - 1) | np.arange(self.groups, dtype=np.uint64), marks

    def fewest(self, least: float) -> int:
        """Bytes that agree in all but LOSS of the pairs whose similarity is ``least``; what is more alike has more."""
        n, below = len(self.factors), 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * least**k * (1 - least) ** (n - k)
            if below > LOSS:
                return k
        return n


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def normalised(df: DataFrame, key: str, source: str, text: str, width: int) -> DataFrame:
    """item_id, source, d1, d2 (128 bits of the normal text), normal; only items with a shingle."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sources, normals = [], [], []
            normal = all_letters_and_digits(batch.column(2).to_pylist())
            for item, origin, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), normal):
                if len(own) >= width:
                    items.append(item)
                    sources.append(origin)
                    normals.append(own)
            d1, d2 = _halves([digest(t) for t in normals])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(sources, pa.string()), pa.array(d1), pa.array(d2), pa.array(normals, pa.string())],
                names=["item_id", "source", "d1", "d2", "normal"],
            )

    picked = df.select(F.col(key).cast("string").alias("i"), F.col(source).cast("string").alias("s"), F.col(text).alias("t"))
    picked = picked.where("i is not null and t is not null and t <> ''")
    return picked.mapInArrow(norm, "item_id string, source string, d1 bigint, d2 bigint, normal string")


def bucket_rows(items: DataFrame, sketch: TensorSketch) -> DataFrame:
    """bucket, d1, marks of the other collections: a row for each collection but the last (none comes later) and text (copies met by one task once).

    Half of the text's digest is enough here: texts that share it only make
    candidates more, which are told apart when they are verified.
    """

    times, per_group = sketch.groups - 1, sketch.per_group
    others = np.array([[i for i in range(sketch.groups * per_group) if i // per_group != g] for g in range(times)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, dtype=np.int64)
        for batch in batches:
            d1, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            new = ~np.isin(d1, met)
            d1, first = d1[new], first[new]
            if not len(d1):
                continue
            met = np.union1d(met, d1) if len(met) < _MET else d1
            buckets, marks = sketch.marked(batch.column(1).take(pa.array(first)).to_pylist())
            width = others.shape[1]
            whole = marks[:, others].tobytes()
            own = pa.array([whole[i : i + width] for i in range(0, len(whole), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(buckets[:, :times].view(np.int64).ravel()), pa.array(np.repeat(d1, times)), own], names=["bucket", "d1", "marks"])

    return items.select("d1", "normal").mapInArrow(rows, "bucket bigint, d1 bigint, marks binary")


_PAIR = "a1 bigint, b1 bigint, table_key bigint"


def _pairs_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each run of equal keys; a run beyond RUN leaves as rows without a b."""

    def out(a1, b1=None, table_key=None):  # type: ignore[no-untyped-def]
        columns = [pa.array(c) if c is not None else pa.nulls(len(a1), pa.int64()) for c in (a1, b1, table_key)]
        return pa.RecordBatch.from_arrays(columns, names=["a1", "b1", "table_key"])

    def pairs(keys: np.ndarray, d1: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes, starts = np.diff(edges), edges[:-1]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= RUN)]):
            i, j = np.triu_indices(size, 1)
            at = starts[sizes == size]
            step = max(1, 200_000 // len(i))
            for k in range(0, len(at), step):
                yield out(d1[(at[k : k + step, None] + i).ravel()], d1[(at[k : k + step, None] + j).ravel()])
        for s, size in zip(starts[sizes > RUN], sizes[sizes > RUN]):
            yield out(d1[s : s + size], table_key=keys[s : s + size])

    held: list[tuple[np.ndarray, ...]] = []
    hot = None  # the key of a run that is already leaving row by row
    for batch in batches:
        rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if len(rows[0]) and hot is not None:
            end = int(np.searchsorted(rows[0], hot, "right")) if rows[0][0] == hot else 0
            if end:
                yield out(rows[1][:end], table_key=rows[0][:end])
                rows = tuple(c[end:] for c in rows)
        once = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))) if len(rows[0]) else []
        rows = tuple(c[once] for c in rows) if len(rows[0]) else rows  # copies
        if not len(rows[0]):
            continue
        hot, last = None, int(np.searchsorted(rows[0], rows[0][-1]))
        whole = [np.concatenate([h[i] for h in held] + [rows[i]]) for i in range(2)]
        if held and not last and held[0][0][0] == rows[0][0]:
            held = [tuple(whole)]
        else:
            cut = len(whole[0]) - (len(rows[0]) - last)  # before the batch's last run
            if cut:
                yield from pairs(*(c[:cut] for c in whole))
            held = [tuple(c[cut:] for c in whole)]
        if len(held[0][0]) > RUN:
            hot = held[0][0][0]
            yield out(held[0][1], table_key=held[0][0])
            held = []
    if held:
        yield from pairs(*held[0])


def _mixed(bucket: np.ndarray, g: int, own: np.ndarray) -> np.ndarray:
    """The table key of rows of a bucket and their bytes of the later collection ``g``."""
    x = (bucket.astype(np.uint64) ^ (own * np.uint64(_GROUPS) + np.uint64(g)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _pairs_of_buckets(groups: int, per_group: int, fewest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of the texts of each bucket that share a table's key and agree in ``fewest`` bytes; rows come sorted.

    What is too long for a task leaves as rows of table keys without a b.
    """

    def out(a1: np.ndarray, b1: np.ndarray | None = None, table_key: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.array(c) if c is not None else pa.nulls(len(a1), pa.int64()) for c in (a1, b1, table_key)]
        return pa.RecordBatch.from_arrays(columns, names=["a1", "b1", "table_key"])

    def triple(marks: np.ndarray, g: int) -> np.ndarray:
        own = np.zeros(len(marks), dtype=np.uint64)
        for i in range((g - 1) * per_group, g * per_group):  # the bucket's own collection, an earlier one, is left out
            own = own * np.uint64(256) + marks[:, i]
        return own

    def leaving(bucket: np.ndarray, d1: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for g in range(int(bucket[0]) & (_GROUPS - 1), groups - 1):
            yield out(d1, table_key=_mixed(bucket, g + 1, triple(marks, g + 1)))

    def pairs(bucket: np.ndarray, d1: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        several = np.repeat(np.diff(edges) > 1, np.diff(edges))
        bucket, d1, marks = bucket[several], d1[several], marks[several]
        first, found = bucket & (_GROUPS - 1), []
        for g in range(1, groups):
            rows = np.flatnonzero(first < g)
            keys = _mixed(bucket[rows], g, triple(marks[rows], g))
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            sizes, starts = np.diff(edges), edges[:-1]
            for size in np.unique(sizes[(sizes > 1) & (sizes <= RUN)]):
                i, j = np.triu_indices(size, 1)
                at = starts[sizes == size]
                step = max(1, _CHECKED // len(i))
                for k in range(0, len(at), step):
                    x, y = (rows[(at[k : k + step, None] + z).ravel()] for z in (i, j))
                    for n in range(0, len(x), _CHECKED):
                        own, other = x[n : n + _CHECKED], y[n : n + _CHECKED]
                        alike = np.count_nonzero(marks[own] == marks[other], axis=1) >= fewest - per_group
                        own, other = d1[own[alike]], d1[other[alike]]
                        found.append(np.stack((np.minimum(own, other), np.maximum(own, other)), axis=1))
            for s, size in zip(starts[sizes > RUN], sizes[sizes > RUN]):
                yield out(d1[rows[s : s + size]], table_key=keys[s : s + size])
        both = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        both = both[np.concatenate(([True], (both[1:] != both[:-1]).any(1)))] if len(both) else both
        yield out(np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows_held, hot = 0, None  # hot: a bucket that is already leaving row by row
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, d1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(bucket), -1)
            once = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (d1[1:] != d1[:-1])))  # copies
            if held:
                once[0] = bucket[0] != held[-1][0][-1] or d1[0] != held[-1][1][-1]
            rows = tuple(c[once] for c in (bucket, d1, marks))
            if hot is not None and len(rows[0]):
                end = int(np.searchsorted(rows[0], hot, "right"))
                if end:
                    yield from leaving(*(c[:end] for c in rows))
                rows = tuple(c[end:] for c in rows)
                hot = hot if not len(rows[0]) else None
            if not len(rows[0]):
                continue
            held.append(rows)
            rows_held += len(rows[0])
            if rows_held < BUCKET // 4:
                continue
            whole = tuple(np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # before the last bucket
            if cut:
                yield from pairs(*(c[:cut] for c in whole))
            held, rows_held = [tuple(c[cut:] for c in whole)], len(whole[0]) - cut
            if rows_held > BUCKET:
                hot = whole[0][-1]
                yield from leaving(*held[0])
                held, rows_held = [], 0
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held)))

    return run


def _crossed(hot: DataFrame) -> DataFrame:
    return hot.join(hot.select("table_key", F.col("a1").alias("b1")), "table_key").where("a1 <= b1").select("a1", "b1")


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """a1, b1: half digests of classes that share a key in some table, each pair once, smaller first."""
    runs = kept(keys.repartition("table_key").sortWithinPartitions("table_key", "d1").mapInArrow(_pairs_of_runs, _PAIR))
    close = runs.where("b1 is not null").select("a1", "b1")
    hot = runs.where("b1 is null").select("table_key", "a1")
    return (close if hot.isEmpty() else close.unionByName(_crossed(hot))).distinct()


def sketched_pairs(rows: DataFrame, sketch: TensorSketch, least: float) -> DataFrame:
    """a1, b1: half digests of classes that share a key in some table and could be as similar as ``least``, each pair once, smaller first."""
    meet = _pairs_of_buckets(sketch.groups, sketch.per_group, sketch.fewest(least))
    found = kept(rows.repartition("bucket").sortWithinPartitions("bucket", "d1").mapInArrow(meet, _PAIR))
    close = found.where("b1 is not null").select("a1", "b1")
    hot = found.where("b1 is null").select("table_key", F.col("a1").alias("d1"))
    return (close if hot.isEmpty() else close.unionByName(candidate_pairs(hot))).distinct()


def jaccard(a: str, b: str, width: int) -> float:
    """Shared part of the distinct runs of ``width`` characters of two texts."""
    x, y = ({t[i : i + width] for i in range(len(t) - width + 1)} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's distinct runs of ``width`` characters, as sorted 64-bit hashes."""
    if not texts:
        return []
    hashes, starts = shingle_hashes(texts, width)
    return [np.unique(h) for h in np.split(hashes, starts[1:])]


def similarities(a: list[np.ndarray], b: list[np.ndarray], least: float) -> list[float]:
    """The shared part of each pair of sets; 0 where their sizes alone keep it below ``least``."""
    out = []
    for x, y in zip(a, b):
        if min(len(x), len(y)) < least * max(len(x), len(y)):
            out.append(0.0)
            continue
        whole = np.concatenate((x, y))
        whole.sort()
        both = int(np.count_nonzero(whole[1:] == whole[:-1]))
        out.append(both / (len(whole) - both))
    return out


def verified(pairs: DataFrame, items: DataFrame, width: int, least: float) -> DataFrame:
    """``pairs`` whose exact similarity is ``least`` or more, with it.

    Only the texts of candidates are moved, each text once.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAIRS):
                batch = whole.slice(at, _PAIRS)
                number: dict[tuple[int, int], int] = {}
                texts: list[str] = []
                ends = []
                for high, low, text in ((0, 1, 4), (2, 3, 5)):
                    own = []
                    for k, t in zip(zip(batch.column(high).to_pylist(), batch.column(low).to_pylist()), batch.column(text).to_pylist()):
                        if k not in number:
                            number[k] = len(texts)
                            texts.append(t)
                        own.append(number[k])
                    ends.append(own)
                sets = shingle_sets(texts, width)
                alike = pa.array(similarities([sets[i] for i in ends[0]], [sets[i] for i in ends[1]], least - 1e-12), pa.float64())
                rows = pa.RecordBatch.from_arrays([*batch.columns[:4], alike], names=["a1", "a2", "b1", "b2", "similarity"])
                yield rows.filter(compute.greater_equal(alike, least - 1e-12))

    needed = sized(pairs.select(F.col("a1").alias("d1")).union(pairs.select("b1")).distinct())
    classes = items.select("d1", "d2", "normal").join(needed, "d1", "left_semi").dropDuplicates(["d1", "d2"])
    classes = kept(classes)
    left = classes.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("normal").alias("a_text"))
    right = classes.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("normal").alias("b_text"))
    texts = pairs.join(left, "a1").join(right, "b1").where("a1 < b1 or a2 < b2")
    return texts.select("a1", "a2", "b1", "b2", "a_text", "b_text").mapInArrow(check, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")


def _class_id(d1: Column, d2: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(d1), 16, "0")), F.lower(F.lpad(F.hex(d2), 16, "0")))


class NearDuplicates:
    """The stages over one table: members of classes, and links between classes."""

    def __init__(self, df: DataFrame, key: str, source: str, text: str, width: int = 5, least: float = 0.7, groups: int = 17, per_group: int = 3) -> None:
        items = normalised(df, key, source, text, width).persist(StorageLevel.MEMORY_ONLY)  # what doesn't fit is made again, not written
        self.members = items.select("item_id", "source", "d1", "d2").distinct()
        sketch = TensorSketch(width, groups, per_group)
        pairs = kept(sketched_pairs(bucket_rows(items, sketch), sketch, least))
        self.links = kept(verified(pairs, items, width, least))
        self.members = kept(self.members)
        items.unpersist()

    def membership(self, keep: tuple[str, ...] = ()) -> DataFrame:
        """item_id, source, class_id: copies share a class."""
        return self.members.select(*keep, "item_id", "source", _class_id(F.col("d1"), F.col("d2")).alias("class_id"))

    def linked(self) -> DataFrame:
        """item_id, source, class_id, links: copies share a class; links are the other classes that are alike."""
        ends = self.links.select("a1", "a2").unionByName(self.links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2")))
        counts = ends.groupBy(F.col("a1").alias("d1"), F.col("a2").alias("d2")).agg(F.count("*").alias("links"))
        members = self.membership(keep=("d1", "d2")).join(counts, ["d1", "d2"], "left")
        return members.select("item_id", "source", "class_id", F.coalesce("links", F.lit(0)).alias("links"))

    def grouped(self) -> DataFrame:
        """item_id, source, class_id, group_id: classes that links lead to from one another are a group, named by its smallest class.

        Each round a class takes the smallest name among its own and its
        neighbours', and then the name that one goes by itself, so the rounds are
        few even for long chains; they end when no name changes.
        """
        name = lambda x, y: _class_id(F.col(x), F.col(y))
        one_way = self.links.select(name("a1", "a2").alias("a"), name("b1", "b2").alias("b"))
        edges = kept(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        names = kept(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("name")))
        while True:
            near = edges.join(names.select(F.col("a").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("near"))
            taken = kept(names.join(near, "a").select("a", F.least("name", "near").alias("name")))
            after = kept(taken.join(taken.select(F.col("a").alias("name"), F.col("name").alias("further")), "name").select("a", F.col("further").alias("name")))
            changed = after.join(names.select("a", F.col("name").alias("before")), "a").where("name <> before")
            if changed.isEmpty():
                break
            names = after
        return self.membership().join(names.select(F.col("a").alias("class_id"), "name"), "class_id", "left").select("item_id", "source", "class_id", F.coalesce("name", "class_id").alias("group_id"))

    def pairs_across_sources(self) -> DataFrame:
        """chunk_a, chunk_b (smaller first) of different, non-null sources, copies included.

        Classes none of whose members could make such a pair (copies within one
        source) are left before members meet.
        """
        known = self.members.where("source is not null")
        a = known.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("item_id").alias("i"), F.col("source").alias("s"))
        b = known.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("item_id").alias("j"), F.col("source").alias("t"))
        across = self.links.select("a1", "a2", "b1", "b2").join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where("s <> t and i <> j").select("i", "j")
        mixed = known.groupBy("d1", "d2").agg(F.min("source").alias("x"), F.max("source").alias("y")).where("x <> y").select(F.col("d1").alias("a1"), F.col("d2").alias("a2"))
        copies = a.join(mixed, ["a1", "a2"], "left_semi")
        copies_b = copies.select("a1", "a2", F.col("i").alias("j"), F.col("s").alias("t"))
        within = copies.join(copies_b, ["a1", "a2"]).where("s <> t and i < j").select("i", "j")
        both = across.unionByName(within)
        return both.select(F.least("i", "j").alias("chunk_a"), F.greatest("i", "j").alias("chunk_b")).distinct()
