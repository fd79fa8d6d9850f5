import os
import random

import pytest

from lexmill.llm import encode as E
from lexmill.llm.queries import TOKENIZERS

PATH = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
TEXTS = ["Hello  world's 123\n\n don't", "", None, "aaaaaaaaaa banana", "電磁閥 M6 螺絲", "<|endoftext|>", "🙂 é ​\x00", " \t ", "x" * 50_000, "ab" * 3000, "Hello  world's 123\n\n don't"]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_against_the_tokenizer(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in E.encode_texts(df, "doc_id", "text", PATH).collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)
    assert E.encode_texts(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_many_shards_and_replays(spark, monkeypatch):
    """Small shards and blocks: words of several shards meet and give the same ids."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé電磁閥 12'", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    merges = E.Merges(PATH)
    parts = E.Merges.encode(merges, sorted(set(words)))
    assert parts[1].sum() == len(parts[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    monkeypatch.setattr(E, "_SHARD", 500)
    monkeypatch.setattr(E, "_REPLAYED", 100)
    rows = E.encode_texts(df, "doc_id", "text", PATH)
    assert rows.dtypes == [("doc_id", "int"), ("ids", "array<int>")]
    got = {r["doc_id"]: list(r["ids"]) for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)


def test_pattern_of_the_file():
    assert E.Merges(PATH).pattern == E.BYTE_LEVEL
    with pytest.raises(ValueError):
        E._pattern({"type": "Whitespace"})
