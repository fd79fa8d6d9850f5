"""Most similar vectors for every vector (problem 5).

Vectors are scaled to length one and projected to a few dimensions by a 2-stable
(Gaussian) projection, in which a squared distance d^2 becomes d^2 times a
chi-square variable. A kd-tree over the projections is grown as a table: a node
that holds more than a cell's worth of vectors is split at medians of a sample
of its own vectors, again and again, so cells hold about ``cell`` vectors
whatever their number. A cell is one task's; within it leaves of ``leaf``
vectors have tight boxes.

A cell's vectors are written once, as a file in the folder all executors share,
and moved no more: a task holds the vectors of a few cells that lie together,
searches these first, then reads the files of the cells its vectors can't rule
out, the closest first; in a cell they are compared with the leaves they can't
rule out. A box is ruled out, and the search ends, when the chi-square test
holds: were a closer neighbour in it, its projection would be as far as the box
with a probability below ``1 - confidence``. Comparisons that count are exact
cosines in double precision.

Equal vectors of a model are one class; the index holds the ``k + 1`` smallest
keys of each class, which is exact: no other key of it can be among the k best
of any vector, as ties go to the smaller key. A class is searched once, with
``k + 1`` results, of which each of its keys leaves itself out.

Defined results: for each key its latest row counts (ties of created_at: the
greatest vector); a key whose latest vector is null, of a wrong length, not
finite or all zero has no neighbours and is nobody's; a model with fewer than
k + 1 vectors gives as many pairs as there are.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import kept, sized


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, by bisection of the series."""

    def below(x: float) -> float:
        a, half = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 1e-9, 20.0 * m + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(dimension: int, m: int, seed: int) -> np.ndarray:
    """The Gaussian matrix all tasks use for vectors of ``dimension`` elements."""
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, m))


class MedianTree:
    """A complete kd-tree of ``depth`` levels, split at medians of the points given."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.at = np.zeros((1 << depth) - 1)
        parts = {0: points}
        for node in range(len(self.axis)):
            own = parts.pop(node)
            if len(own):
                axis = int(np.argmax(own.max(0) - own.min(0)))
                self.axis[node], self.at[node] = axis, np.median(own[:, axis])
            right = own[:, self.axis[node]] > self.at[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        return leaf_of(points, self.axis, self.at)


def leaf_of(points: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf of each point in the complete tree of these axes and cuts."""
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range(int(len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > at[node])
    return node - len(axis)


def _descend(root: np.ndarray, low: np.ndarray, trees: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """The node each point ends in, from the roots' node 1."""
    node = np.ones(len(root), dtype=np.int64)
    moved = np.arange(len(root))
    while len(moved):
        both = np.stack((root[moved], node[moved]), axis=1)
        kinds, of = np.unique(both, axis=0, return_inverse=True)
        of, further = of.ravel(), []
        for n, kind in enumerate(kinds.tolist()):
            if tuple(kind) in trees:
                rows = moved[of == n]
                node[rows] = (kind[1] << bits) + leaf_of(low[rows], *trees[tuple(kind)])
                further.append(rows)
        moved = np.concatenate(further) if further else moved[:0]
    return node


def latest_vectors(df: DataFrame) -> DataFrame:
    """cache_key, model_fingerprint, vector of each key's latest row, if it is usable.

    Only rows of keys that have several rows are brought together.
    """
    rows = df.where("cache_key is not null").select("cache_key", F.struct("created_at", "vector", "dimension", "model_fingerprint").alias("r"), F.xxhash64("cache_key").alias("hash"))
    several = sized(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    chosen = kept(rows.join(several, "hash", "left_semi").groupBy("cache_key").agg(F.max("r").alias("r")))
    last = rows.join(several, "hash", "left_anti").select("cache_key", "r").unionByName(chosen).select("cache_key", "r.*")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vector").isNotNull() & (F.size("vector") == F.col("dimension")) & ~bad & F.exists("vector", lambda x: x != 0)
    return last.where(F.col("model_fingerprint").isNotNull() & F.coalesce(usable, F.lit(False))).select("cache_key", "model_fingerprint", "vector")


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _boxes_within(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)), dtype=np.float32)
    for a in range(points.shape[1]):
        gap = np.maximum(low[None, :, a] - points[:, a, None], points[:, a, None] - high[None, :, a])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


def _lows(packed: Sequence[bytes], m: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(-1, m)


class Leaves:
    """A cell's vectors in leaves: ``order`` puts them leaf by leaf, ``edge`` is where leaves begin."""

    def __init__(self, low: np.ndarray, leaf: int) -> None:
        depth = max(0, math.ceil(math.log2(max(1, len(low) / leaf))))
        of = MedianTree(low, depth).leaf_of(low)
        self.order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(of[self.order]) > 0)))
        self.edge = [*first.tolist(), len(low)]
        sorted_ = low[self.order]
        self.low, self.high = np.minimum.reduceat(sorted_, first, axis=0), np.maximum.reduceat(sorted_, first, axis=0)


def _shared(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def _removed(folder: str) -> None:
    with contextlib.suppress(OSError):
        system, path = _shared(folder)
        system.delete_dir(path)


def _file(root: int, node: int) -> str:
    return f"{root & (1 << 64) - 1:016x}-{node:x}"


class Cell:
    """A cell's vectors, leaf by leaf, as they are in its file."""

    def __init__(self, raw: np.ndarray, low: np.ndarray, classes: np.ndarray, keys: list[str], leaf: int) -> None:
        leaves = Leaves(low, leaf)
        self.edge, self.leaf_low, self.leaf_high = leaves.edge, leaves.low, leaves.high
        self.raw, self.low, self.classes = raw[leaves.order], low[leaves.order], classes[leaves.order]
        texts = [keys[i].encode("utf-8", "surrogatepass") for i in leaves.order]
        self.ends, self.names = np.concatenate(([0], np.cumsum([len(t) for t in texts]))), b"".join(texts)

    def key(self, at: int) -> str:
        return self.names[self.ends[at] : self.ends[at + 1]].decode("utf-8", "surrogatepass")

    def write(self, folder: str, name: str) -> None:
        """All at once: a task that is run twice leaves one whole file."""
        system, path = _shared(folder)
        partial = f"{path}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(partial) as f:
            f.write(pickle.dumps(self, protocol=5))
        system.move(partial, f"{path}/{name}")

    @staticmethod
    def read(folder: str, name: str) -> Cell:
        system, path = _shared(folder)
        with system.open_input_stream(f"{path}/{name}") as f:
            return pickle.loads(f.read())


class Search:
    """The ``keep`` best keys for each query among the cells it meets, one after the other."""

    def __init__(self, raw: np.ndarray, low: np.ndarray, keep: int, reach: float) -> None:
        self.low, self.keep, self.reach = low, keep, reach
        self.units = _units(raw)
        self.coarse = self.units.astype(np.float32)
        self.top = np.full((len(raw), keep), -2.0)
        self.floor = np.full(len(raw), -2.0)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, key, cosine
        self.held = 0

    def within(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The squared distance from which on a box is ruled out."""
        floor = self.floor if rows is None else self.floor[rows]
        return (self.reach * (2 - 2 * np.minimum(floor, 1) + 2e-6)).astype(np.float32)

    def meet(self, cell: Cell, rows: np.ndarray) -> None:
        """Compares the queries ``rows`` with the leaves of a cell that they can't rule out, each query's closest leaf first."""
        far = _boxes_within(self.low[rows], cell.leaf_low, cell.leaf_high)
        some = (far <= self.within(rows)[:, None]).any(1)
        rows, far = rows[some], far[some]
        if not len(rows):
            return
        points = _units(cell.raw).astype(np.float32)
        home = np.argmin(far, axis=1)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(home):
            self._compare(cell, points, int(n), rows[home == n], hits)
        open_ = far <= self.within(rows)[:, None]
        open_[np.arange(len(rows)), home] = False
        for n in np.flatnonzero(open_.any(0)):
            mine = np.flatnonzero(open_[:, n])
            mine = mine[far[mine, n] <= self.within(rows[mine])]
            if len(mine):
                self._compare(cell, points, int(n), rows[mine], hits)
        if hits:
            q, at, c = (np.concatenate(x) for x in zip(*hits))
            near = c >= self.floor[q]
            q, at, c = q[near], at[near], c[near]
            names, back = np.unique(at, return_inverse=True)
            self.found.append((q, np.array([cell.key(i) for i in names.tolist()], dtype=object)[back], c))
            self.held += len(q)
            if self.held > 1 << 21:
                self._settle()

    def _compare(self, cell: Cell, points: np.ndarray, leaf: int, rows: np.ndarray, hits: list) -> None:
        a, b = cell.edge[leaf : leaf + 2]
        about = self.coarse[rows] @ points[a:b].T
        i, j = np.nonzero(about >= (self.floor[rows, None] - 1e-5).astype(np.float32))  # single precision only leaves out what surely is below
        if not len(i):
            return
        exact = np.round(np.einsum("ij,ij->i", self.units[rows[i]], _units(cell.raw[a:b])[j]), 6)
        hits.append((rows[i], a + j, exact))
        some, back = np.unique(i, return_inverse=True)
        block = np.full((len(some), b - a), -2.0)
        block[back, j] = exact
        best = np.partition(np.concatenate((self.top[rows[some]], block), axis=1), b - a, axis=1)[:, b - a :]
        self.top[rows[some]] = best
        self.floor[rows[some]] = np.maximum(self.floor[rows[some]], best.min(1))

    def _settle(self) -> None:
        """Leaves of what is found the ``keep`` best of each query; ties by the key."""
        q, keys, c = (np.concatenate(x) for x in zip(*self.found))
        near = c >= self.floor[q]
        q, keys, c = q[near], keys[near], c[near]
        _, rank = np.unique(keys, return_inverse=True)
        order = np.lexsort((rank, -c, q))
        q, keys, c = q[order], keys[order], c[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < self.keep
        self.found, self.held = [(q[best], keys[best], c[best])], int(best.sum())

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, key and cosine, query by query, the best first."""
        if not self.found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object), np.zeros(0)
        self._settle()
        return self.found[0]


class SimilarVectors:
    """The k most similar vectors of the same model, for every key.

    ``cell`` and ``leaf`` are the vectors wanted in a cell and in a leaf, ``bits``
    says into how many (2 ** bits) a node is split at most at once, ``sample``
    bounds the vectors of a node that shape its split (every vector is indexed),
    ``share`` the vectors that one task searches for (one cell's at least).
    """

    def __init__(self, df: DataFrame, k: int = 5, m: int = 8, confidence: float = 0.998, cell: int = 3000, leaf: int = 32, bits: int = 6, sample: int = 8192, share: int = 20_000, seed: int = 5) -> None:
        self.k, self.m, self.seed, self.cell, self.leaf, self.bits, self.share = k, m, seed, cell, leaf, bits, share
        self.reach = chi_square_quantile(confidence, m)
        keyed = latest_vectors(df).withColumn("c1", F.xxhash64("model_fingerprint", "vector")).withColumn("c2", F.xxhash64(F.lit(7), "vector", "model_fingerprint"))
        # only classes of more than k + 1 keys are brought together
        crowded = sized(keyed.groupBy("c1").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("c1"))
        place = Window.partitionBy("c1", "c2").orderBy("cache_key")
        together = keyed.join(crowded, "c1", "left_semi")
        few = kept(together.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).drop("place"))
        first = few.groupBy("c1", "c2").agg(F.min("cache_key").alias("first"))
        self.more = kept(together.select("cache_key", "c1", "c2").join(few.select("cache_key"), "cache_key", "left_anti").join(first, ["c1", "c2"]).select("cache_key", "first"))
        rows = keyed.join(crowded, "c1", "left_anti").unionByName(few)
        trees, self.levels = self._grown(rows, sample)
        self.points = self._placed(rows, trees)

    def _projector(self):  # type: ignore[no-untyped-def]
        """A function of a batch's column of vectors: their bytes and their projections."""
        m, seed = self.m, self.seed

        def project(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
            flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False), np.diff(vectors.offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            packed, low = np.empty(len(sizes), dtype=object), np.zeros((len(sizes), m), dtype=np.float32)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                raw = flat[starts[mine, None] + np.arange(size)]
                low[mine] = np.einsum("ij,jk->ik", _units(raw), projection(int(size), m, seed))
                packed[mine] = [r.tobytes() for r in raw]
            return packed, low

        return project

    @staticmethod
    def _root() -> Column:
        return F.xxhash64("model_fingerprint", F.size("vector"))

    def _placed(self, rows: DataFrame, trees: Broadcast) -> DataFrame:
        """root, node, cache_key, packed, low, c1, c2: every vector with the cell it is in."""
        project, bits = self._projector(), self.bits

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed, low = project(batch.column(1))
                node = _descend(batch.column(0).to_numpy(), low, trees.value, bits)
                columns = [batch.column(0), pa.array(node), batch.column(2), pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), batch.column(3), batch.column(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["root", "node", "cache_key", "packed", "low", "c1", "c2"])

        schema = "root bigint, node bigint, cache_key string, packed binary, low binary, c1 bigint, c2 bigint"
        return rows.select(self._root(), "vector", "cache_key", "c1", "c2").mapInArrow(place, schema)

    def _grown(self, rows: DataFrame, sample: int) -> tuple[Broadcast, int]:
        """The splits of all nodes that were divided (axes and cuts by root and node), and how many times nodes were."""
        m, cell, bits, project = self.m, self.cell, self.bits, self._projector()
        context = rows.sparkSession.sparkContext

        def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low = [x.tobytes() for x in project(batch.column(1))[1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(low, pa.binary())], names=["root", "c1", "low"])

        def descended(trees: Broadcast) -> DataFrame:
            def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    node = _descend(batch.column(0).to_numpy(), _lows(batch.column(2).to_pylist(), m), trees.value, bits)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=["root", "c1", "low", "node"])

            return thin.mapInArrow(step, "root bigint, c1 bigint, low binary, node bigint")

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            depth = min(bits, max(1, math.ceil(math.log2(pdf["n"].iloc[0] / cell))))
            tree = MedianTree(_lows(pdf["low"].tolist(), m), depth)
            return pd.DataFrame({"root": pdf["root"][:1], "node": pdf["node"][:1], "axis": [tree.axis.tolist()], "at": [tree.at.tolist()]})

        thin = kept(rows.select(self._root(), "vector", "c1").mapInArrow(lows, "root bigint, c1 bigint, low binary"))
        splits: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        trees, most = context.broadcast(splits), 62 // bits - 1
        for level in range(most):  # each level divides nodes by 2 ** bits; what is equal in projection can't be divided
            placed = descended(trees)
            large = sized(placed.groupBy("root", "node").agg(F.count("*").alias("n")).where(F.col("n") > 1.5 * cell))
            if large.isEmpty():
                return trees, level
            some = placed.join(large, ["root", "node"])
            drawn = some.where(F.pmod(F.xxhash64("c1", F.lit(level)), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("n"))
            for r in drawn.groupBy("root", "node").applyInPandas(split, "root bigint, node bigint, axis array<int>, at array<double>").collect():
                splits[r["root"], r["node"]] = np.array(r["axis"]), np.array(r["at"])
            trees = context.broadcast(dict(splits))
        return trees, most

    def pairs(self) -> DataFrame:
        """key_a, key_b (smaller first): either is among the k most similar of the other."""
        nearest = self.nearest()
        return nearest.select(F.least("cache_key", "neighbour").alias("key_a"), F.greatest("cache_key", "neighbour").alias("key_b")).distinct()

    def nearest(self) -> DataFrame:
        """cache_key, neighbour, cosine, rank (1 to k) for every usable key."""
        found = self._searched()
        if self.more.isEmpty():
            return found
        found = kept(found)
        # a key beyond the k + 1 of its class has the neighbours of the class's first key, and that one
        best = found.join(self.more.select(F.col("first").alias("cache_key")).distinct(), "cache_key", "left_semi")
        lists = best.groupBy(F.col("cache_key").alias("first")).agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour")).alias("found"))
        own = F.array(F.struct(F.lit(-1.0).alias("far"), F.col("first").alias("neighbour")))
        theirs = self.more.join(lists, "first").select("cache_key", F.posexplode(F.slice(F.array_sort(F.concat("found", own)), 1, self.k)).alias("rank", "x"))
        return found.unionByName(theirs.select("cache_key", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("rank") + 1).alias("rank")))

    def _stored(self) -> tuple[str, list[tuple[int, int, int, bytes]]]:
        """The folder of the cells' files, and of each cell root, node, size and hull, by root and node."""
        m, leaf, context = self.m, self.leaf, self.points.sparkSession.sparkContext
        folder = f"{context._jsc.sc().getCheckpointDir().get()}/cells-{uuid.uuid4().hex}"
        system, path = _shared(folder)
        system.create_dir(path)
        atexit.register(_removed, folder)

        def store(pdf: pd.DataFrame) -> pd.DataFrame:
            root, node = int(pdf["root"].iloc[0]), int(pdf["node"].iloc[0])
            raw = np.frombuffer(b"".join(pdf["packed"]), dtype=np.float32).reshape(len(pdf), -1)
            low = _lows(pdf["low"].tolist(), m)
            Cell(raw, low, pdf[["c1", "c2"]].to_numpy(), pdf["cache_key"].tolist(), leaf).write(folder, _file(root, node))
            return pd.DataFrame({"root": [root], "node": [node], "size": [len(pdf)], "hull": [np.concatenate((low.min(0), low.max(0))).tobytes()]})

        cells = self.points.groupBy("root", "node").applyInPandas(store, "root bigint, node bigint, size int, hull binary")
        return folder, sorted(tuple(r) for r in cells.collect())

    def _searched(self) -> DataFrame:
        """cache_key, neighbour, cosine, rank of every key that is in a cell."""
        m, reach, k, share = self.m, self.reach, self.k, self.share
        folder, cells = self._stored()
        spark = self.points.sparkSession
        blocks: list[list[int]] = []  # cells that lie together, whose vectors one task searches for
        wanted = min(share, max(self.cell, sum(c[2] for c in cells) // 128))
        for n, (root, _, size, _) in enumerate(cells):
            if blocks and cells[blocks[-1][0]][0] == root and sum(cells[i][2] for i in blocks[-1]) + size <= wanted:
                blocks[-1].append(n)
            else:
                blocks.append([n])
        known = spark.sparkContext.broadcast((cells, blocks))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block in batch["id"].tolist():
                    yield one(*known.value, block)

        def one(cells: list, blocks: list, block: int) -> pd.DataFrame:
            own = [(n, Cell.read(folder, _file(*cells[n][:2]))) for n in blocks[block]]
            raw, low, classes = (np.concatenate([getattr(c, x) for _, c in own]) for x in ("raw", "low", "classes"))
            _, first, of = np.unique(classes, axis=0, return_index=True, return_inverse=True)
            of = of.ravel()
            run = Search(raw[first], low[first], k + 1, reach)
            at = 0
            for _, cell in own:  # each query's own cell first
                run.meet(cell, np.flatnonzero((first >= at) & (first < at + len(cell.raw))))
                at += len(cell.raw)
            hulls = np.frombuffer(b"".join(c[3] for c in cells), dtype=np.float32).reshape(-1, 2 * m)
            same = np.array([n for n, c in enumerate(cells) if c[0] == cells[blocks[block][0]][0]])
            gap = np.maximum(np.maximum(hulls[same, :m] - run.low.max(0), run.low.min(0) - hulls[same, m:]), 0)
            middle = (hulls[same, :m] + hulls[same, m:]) / 2 - run.low.mean(0)
            starts = np.cumsum([0] + [len(c.raw) for _, c in own])
            for n in same[np.lexsort(((middle**2).sum(1), (gap**2).sum(1)))].tolist():
                open_ = _boxes_within(run.low, hulls[n : n + 1, :m], hulls[n : n + 1, m:])[:, 0] <= run.within()
                held = next((i for i, (own_n, _) in enumerate(own) if own_n == n), None)
                if held is not None:
                    open_ &= (first < starts[held]) | (first >= starts[held + 1])
                rows = np.flatnonzero(open_)
                if len(rows):
                    run.meet(own[held][1] if held is not None else Cell.read(folder, _file(*cells[n][:2])), rows)
            q, names, cosine = run.results()
            begin, end = np.searchsorted(q, np.arange(len(first))), np.searchsorted(q, np.arange(len(first)), "right")
            keys = [c.key(i) for _, c in own for i in range(len(c.raw))]
            out: list[tuple] = []
            for key, i in zip(keys, of.tolist()):
                rank = 0
                for x in range(begin[i], end[i]):
                    if names[x] != key and rank < k:
                        rank += 1
                        out.append((key, names[x], cosine[x], rank))
            return pd.DataFrame(out, columns=["cache_key", "neighbour", "cosine", "rank"])

        schema = "cache_key string, neighbour string, cosine double, rank int"
        return spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInPandas(search, schema)
