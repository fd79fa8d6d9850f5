import random

import numpy as np

from lexmill.llm import leakage as L
from lexmill.llm.forms import letters_and_digits


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(60):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 80))] + [0]
        assert L.suffix_array(np.array(text, dtype=np.int64), 5).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_find_and_locate():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc", k=rng.randint(1, 200))) for _ in range(30)]
    index = L.FMIndex(texts)
    joined = "\0".join([*texts, ""])
    wanted = ["".join(rng.choices("abc", k=5)) for _ in range(60)] + ["zzzzz"]
    codes = np.array([[ord(c) for c in w] for w in wanted], dtype=np.uint32)
    rows, low, high = index.find(codes)
    found = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows, low, high)}
    for i, w in enumerate(wanted):
        assert found.get(i, []) == [j for j in range(len(joined)) if joined.startswith(w, j)]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, "".join(rng.choices("abcdefgh 1", k=60)), 12) for i in range(12)] + [(90, "", 12), (91, "short", 12), (92, None, 12)]
    rows = []
    for d in range(80):
        text = "".join(rng.choices("abcdefgh, ", k=150))
        if d % 4 == 0:
            part = items[d % 12][1]
            text = text[:50] + part[10 : 10 + rng.randint(8, 40)].upper() + text[50:]
        rows.append((d, text, 1))
    rows += [(100, None, 1), (101, "", 1), (102, rows[0][1], 1), (103, rows[0][1], 1)]
    monkeypatch.setattr(L, "SHARD", 2000)
    got = L.leaked_spans(spark.createDataFrame(rows, "doc_id bigint, text string, item_id int"), "doc_id", "text", items).collect()
    want = set()
    for d, text, _ in rows:
        own = letters_and_digits(text)
        for i, t, w in items:
            q = letters_and_digits(t)
            if any(q[j : j + w] in own for j in range(len(q) - w + 1)):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    texts = {d: letters_and_digits(t) for d, t, _ in rows}
    asked = {i: letters_and_digits(t) for i, t, _ in items}
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + 12] in asked[r["item_id"]] for r in got)


def test_text_longer_than_a_shard(spark, monkeypatch):
    text = "x" * 995 + "needleneedle99" + "y" * 2000
    monkeypatch.setattr(L, "SHARD", 1024)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert L.leaked_spans(df, "doc_id", "text", [(5, "a needle needle 99 b", 12)]).select("doc_id", "item_id").distinct().count() == 1
    assert L.leaked_spans(df.limit(0), "doc_id", "text", [(5, "a needle needle 99 b", 12)]).count() == 0


def test_spans_across_the_parts_of_a_long_text(spark, monkeypatch):
    """A passage that a cut runs through is one span, as it is in a text of one shard."""
    item = "abcdefghij" * 60
    text = "x" * 700 + item[:500] + "y" * 1500
    df = spark.createDataFrame([("k", text)], "doc_id string, text string")
    whole = L.leaked_spans(df, "doc_id", "text", [(1, item, 12)]).collect()
    monkeypatch.setattr(L, "SHARD", 1024)
    parts = L.leaked_spans(df, "doc_id", "text", [(1, item, 12)]).collect()
    assert whole == parts and [(r["start"], r["length"]) for r in parts] == [(700, 500)]


def test_items_in_blocks_and_of_any_language(spark):
    from pyspark.sql import functions as F

    texts = [f"passage {i} of the held out set number {i * 17}" for i in range(40)]
    items = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(None, "no id", "en"), (99, None, "en")], "item_id int, text string, lang string")
    window = F.when(F.col("lang") == "en", 12).otherwise(14)
    assert sum(len(b) for b in L.item_blocks(items, "item_id", "text", window)) == 40
    blocks = list(L.item_blocks(items, "item_id", "text", window, most=300))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, *_ in b) == list(range(40))
    docs = spark.createDataFrame([(1, "so " + texts[3].upper() + "!"), (2, texts[6])], "doc_id bigint, text string")
    whole = {tuple(r) for r in L.leaked_from(docs, "doc_id", "text", items, "item_id", "text", window).collect()}
    assert {(1, 3), (2, 6)} <= {r[:2] for r in whole}
    assert L.leaked_from(docs, "doc_id", "text", items.limit(0), "item_id", "text", window).count() == 0
