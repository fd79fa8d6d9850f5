import random

import pyarrow as pa

from lexmill.llm import neardup as D
from lexmill.llm.forms import letters_and_digits


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for g in range(40):
        base = rng.choices(words, k=60)
        for i in range(rng.randint(1, 4)):
            own = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            rows.append((f"g{g:02}-{i}", f"s{rng.randint(0, 2)}", " ".join(own)))
    return rows + [("x1", "s0", rows[0][2].upper()), ("x2", "s1", rows[0][2]), ("x3", None, rows[0][2]), ("n", "s0", None), ("e", "s0", ""), ("t", "s1", "ab"), rows[3]]


def test_against_brute_force(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, src string, text string, d1 int").repartition(3)
    got = {tuple(r) for r in D.NearDuplicates(df, "id", "src", "text").pairs_across_sources().collect()}
    known = sorted({r for r in rows if r[1] is not None and r[2]})
    want, sure = set(), set()
    for a in known:
        for b in known:
            if a[0] < b[0] and a[1] != b[1]:
                j = D.jaccard(letters_and_digits(a[2]), letters_and_digits(b[2]), 5)
                want |= {(a[0], b[0])} if j >= 0.7 else set()
                sure |= {(a[0], b[0])} if j >= 0.8 else set()
    assert got <= want and sure <= got and sure


def test_members(spark):
    df = spark.createDataFrame([("a", "s", "same text here"), ("b", "t", "Same text, here!"), ("c", "t", "other words")], "id string, src string, text string")
    near = D.NearDuplicates(df, "id", "src", "text")
    of = {r["item_id"]: r["class_id"] for r in near.membership().collect()}
    assert of["a"] == of["b"] != of["c"]
    more = df.unionByName(spark.createDataFrame([("d", "u", "some test here"), ("e", "u", "one two three four five six seven eight nine ten"), ("f", "v", "one two three four five six seven eight nine tem")], df.schema))
    links = {r["item_id"]: r["links"] for r in D.NearDuplicates(more, "id", "src", "text").linked().collect()}
    assert links == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1, "f": 1}
    assert D.NearDuplicates(df.limit(0), "id", "src", "text").pairs_across_sources().count() == 0


def test_long_runs_leave_row_by_row():
    n = D.RUN + 300
    keys = [1] * 3 + [2] * n + [3] * 2
    ids = [*range(3), *range(n), 7, 8]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 500]), pa.array(ids[i : i + 500])], names=["table_key", "d1"]) for i in range(0, len(keys), 500)]
    rows = [r for b in D._pairs_of_runs(iter(batches)) for r in b.to_pylist()]
    assert {(r["a1"], r["b1"]) for r in rows if r["b1"] is not None} == {(0, 1), (0, 2), (1, 2), (7, 8)}
    assert sorted(r["a1"] for r in rows if r["b1"] is None) == list(range(n))


def test_hot_run(spark, monkeypatch):
    rows = [(5, i) for i in range(D.RUN + 5)]
    got = D.candidate_pairs(spark.createDataFrame(rows, "table_key bigint, d1 bigint"))
    assert got.where("a1 < b1").count() == (D.RUN + 5) * (D.RUN + 4) // 2


def test_similarities_by_hashes():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc", k=rng.randint(5, 60))) for _ in range(60)]
    sets = D.shingle_sets(texts, 5)
    for i, j in zip(range(0, 60, 2), range(1, 60, 2)):
        want = D.jaccard(texts[i], texts[j], 5)
        assert D.similarities([sets[i]], [sets[j]], 0.0) == [want]
        assert D.similarities([sets[i]], [sets[j]], 0.7)[0] in ((want,) if want >= 0.7 else (want, 0.0))


def test_groups_of_chains(spark):
    """Texts in which each is like the next: one group, whatever the ends have in common."""
    words = [f"word{i}xyz" for i in range(90)]
    chain = [(f"c{k:02}", "s", " ".join(words[k * 2 : k * 2 + 40])) for k in range(20)]
    lone = [("x", "t", "something else entirely stands here"), ("y", "t", "Something else, entirely, stands here!"), ("z", None, "nothing like it at all 123")]
    df = spark.createDataFrame(chain + lone, "id string, src string, text string")
    near = D.NearDuplicates(df, "id", "src", "text")
    of = {r["item_id"]: r["group_id"] for r in near.grouped().collect()}
    parent = {r["item_id"]: r["class_id"] for r in near.membership().collect()}
    links = [(r["a1"], r["b1"]) for r in near.links.collect()]
    assert len(links) >= 19 and len({of[k] for k, *_ in chain}) == 1 and of["c00"] == min(parent[k] for k, *_ in chain)
    assert of["x"] == of["y"] != of["z"] and len(of) == 23


def test_pairs_alike_by_chance_stay_in_their_buckets(spark):
    """Texts of common phrases share tables' keys, the more the more there are; few of their pairs are verified."""
    rng = random.Random(3)
    phrases = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(30)]
    texts = ["".join(rng.sample(phrases, 10)) for _ in range(400)]
    texts += [t[:60] + "xyz" + t[63:] for t in texts[:20]]
    df = spark.createDataFrame([(f"t{i:03}", f"s{i}", t) for i, t in enumerate(texts)], "id string, src string, text string")
    items = D.normalised(df, "id", "src", "text", 5)
    sketch = D.TensorSketch(5, 17, 3)
    pairs = {tuple(r) for r in D.sketched_pairs(D.bucket_rows(items, sketch), sketch, 0.7).collect()}
    of = {r["item_id"]: r["d1"] for r in items.collect()}
    assert {tuple(sorted((of[f"t{i:03}"], of[f"t{400 + i}"]))) for i in range(20)} <= pairs
    assert len(pairs) < 200


def test_long_buckets_leave_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET", 40)
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefghij", k=400))
    texts = [base[:i] + "#" + base[i + 1 :] for i in range(100)]
    sketch = D.TensorSketch(5, 17, 3)
    df = spark.createDataFrame([(f"t{i}", "s", t.replace("#", "z")) for i, t in enumerate(texts)], "id string, src string, text string")
    rows = sorted(((r["bucket"], r["d1"], bytes(r["marks"])) for r in D.bucket_rows(D.normalised(df, "id", "src", "text", 5), sketch).collect()))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 30]), (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "d1", "marks"]) for i in range(0, len(rows), 30)]
    got = [r for b in D._pairs_of_buckets(17, 3, sketch.fewest(0.7))(iter(batches)) for r in b.to_pylist()]
    keys = {}
    for r in got:
        if r["b1"] is None:
            keys.setdefault(r["table_key"], set()).add(r["a1"])
    pairs = {(r["a1"], r["b1"]) for r in got if r["b1"] is not None} | {(a, b) for own in keys.values() for a in own for b in own if a < b}
    assert keys and len(pairs) == len(texts) * (len(texts) - 1) // 2
