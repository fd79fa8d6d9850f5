import datetime as dt
from pathlib import Path

import numpy as np

from lexmill.llm import neighbours as N


def test_chi_square():
    assert abs(N.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(N.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_tree_places_every_point():
    x = np.random.default_rng(1).standard_normal((500, 4))
    leaf = N.MedianTree(x, 4).leaf_of(x)
    assert leaf.min() >= 0 and leaf.max() < 16 and np.bincount(leaf).max() < 60


def brute(rows, k):
    latest = {}
    for key, model, dim, v, at in rows:
        if key not in latest or at > latest[key][3]:
            latest[key] = (model, dim, v, at)
    by = {}
    for key, (model, dim, v, _) in sorted(latest.items()):
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float32).astype(np.float64)
            by.setdefault(model, []).append((key, a / np.linalg.norm(a)))
    out = set()
    for of in by.values():
        for key, a in of:
            best = sorted(((-round(float(a @ b), 6), other) for other, b in of if other != key))[:k]
            out |= {tuple(sorted((key, other))) for _, other in best}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    at = dt.datetime(2025, 1, 1)
    rows = []
    centres = rng.standard_normal((40, 16))
    for i in range(700):
        v = centres[i % 40] + 0.1 * rng.standard_normal(16)
        rows.append((f"k{i:04}", "m1", 16, [float(np.float32(x)) for x in v * rng.uniform(0.2, 3)], at))
    rows += [(f"copy{i}", "m1", 16, rows[0][3], at) for i in range(30)]
    rows += [(f"z{i}", "m2", 8, [float(np.float32(x)) for x in rng.standard_normal(8)], at) for i in range(4)]
    rows += [("k0001", "m1", 16, None, at + dt.timedelta(1)), ("bad1", "m1", 16, [float("nan")] * 16, at), ("bad2", "m1", 16, [0.0] * 16, at), ("bad3", "m1", 16, [1.0], at), ("bad4", "m1", 16, [None] * 16, at), rows[5]]
    schema = "cache_key string, model_fingerprint string, dimension int, vector array<float>, created_at timestamp, low string"
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    want = brute(rows, 5)
    for sizes in ({"cell": 120, "leaf": 16}, {"cell": 40, "leaf": 8, "bits": 2, "sample": 100, "share": 60}):  # one split, several in a row
        similar = N.SimilarVectors(df, **sizes)
        assert similar.levels == (1 if sizes["cell"] == 120 else similar.levels) and similar.points.groupBy("root", "node").count().selectExpr("max(count)").first()[0] <= 2 * sizes["cell"]
        got = {tuple(r) for r in similar.pairs().collect()}
        assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_empty_and_small(spark):
    schema = "cache_key string, model_fingerprint string, dimension int, vector array<float>, created_at timestamp"
    assert N.SimilarVectors(spark.createDataFrame([], schema)).pairs().count() == 0
    two = [("a", "m", 2, [1.0, 0.0], dt.datetime(2025, 1, 1)), ("b", "m", 2, [0.0, 1.0], dt.datetime(2025, 1, 1))]
    assert [tuple(r) for r in N.SimilarVectors(spark.createDataFrame(two, schema)).pairs().collect()] == [("a", "b")]


def test_vectors_are_written_few_times(spark):
    """What is kept follows the vectors, not the visits to cells that they can't rule out."""
    rng, at = np.random.default_rng(8), dt.datetime(2025, 1, 1)
    rows = [(f"k{i:05}", "m", 64, [float(np.float32(x)) for x in rng.standard_normal(64)], at) for i in range(3000)]
    df = spark.createDataFrame(rows, "cache_key string, model_fingerprint string, dimension int, vector array<float>, created_at timestamp")
    context = spark.sparkContext

    def held():
        folder = context._jsc.sc().getCheckpointDir()
        return sum(p.stat().st_size for p in Path(folder.get().removeprefix("file:")).rglob("*") if p.is_file()) if folder.isDefined() else 0

    before = held()
    assert N.SimilarVectors(df, cell=100, leaf=16).pairs().count() >= 3000 * 5 // 2
    assert held() - before <= 4 * 3000 * 64 * 4


def test_a_crowd_of_copies(spark):
    """Keys beyond the k + 1 that stand for their class have their neighbours all the same."""
    rng, at = np.random.default_rng(9), dt.datetime(2025, 1, 1)
    x = rng.standard_normal(12)
    near = [(f"a{i}", "m", 12, [float(np.float32(v)) for v in x + 1e-6 * rng.standard_normal(12)], at) for i in range(3)]
    far = [(f"z{i:03}", "m", 12, [float(np.float32(v)) for v in rng.standard_normal(12)], at) for i in range(300)]
    rows = near + far + [(f"c{i:02}", "m", 12, [float(np.float32(v)) for v in x], at) for i in range(20)]
    rows += [("c05", "m", 12, far[0][3], at + dt.timedelta(1)), ("z007", "m", 12, far[1][3], at)]  # rewritten; a tie goes to the greatest vector
    want = brute([r for r in rows if r != rows[-1]] if rows[-1][3] < far[7][3] else [r for r in rows if r != far[7]], 5)
    df = spark.createDataFrame(rows, "cache_key string, model_fingerprint string, dimension int, vector array<float>, created_at timestamp")
    assert {tuple(r) for r in N.SimilarVectors(df, cell=60, leaf=8).pairs().collect()} == want
