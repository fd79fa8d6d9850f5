import random
from difflib import SequenceMatcher

import pytest

from lexmill.operators import toc
from lexmill.plans import catalogue


def test_segments_open_at_own_headings(spark, tmp_path):
    chunk = "vector_chunk_id string, document_id string, page int, page_chunk_index int, sub_chunk_index int, heading string, content string"
    rows = [("c1", "d", 1, 0, 0, "Oven door and seal check", "intro"), ("c2", "d", 2, 0, 0, None, "more\nOven door and seaI check\nseal"), ("c3", "e", 1, 0, 0, "Other", "Oven door and seal check")]
    spark.createDataFrame(rows, chunk).write.parquet(f"{tmp_path}/chunk_metadata.parquet")
    spark.createDataFrame([(1, "General")], "heading_id int, heading string").write.parquet(f"{tmp_path}/heading_ref.parquet")
    got = catalogue.title_segments(spark, str(tmp_path)).orderBy("document_id", "page_start", "segment").collect()
    own = ["Oven door and seal check"]
    assert [(r["document_id"], r["path"], r["body"]) for r in got] == [("d", own, "intro\nmore"), ("d", own, "seal"), ("e", ["Other"], own[0])]


@pytest.mark.parametrize("least", [0.92, 0.8])
def test_documents_of_many_titles_lose_no_similar_one(spark, least):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdef閥油") for _ in range(n))
    titles = {word(rng.randint(4, 50)) for _ in range(150)}

    def misread(t):
        for _ in range(rng.randint(1, 7)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", word(1)]) + t[at + rng.randint(0, 1) :]
        return t

    lines = sorted({misread(t) for t in titles for _ in range(4)} - {""})

    def best(line):
        if line in titles or len(line) > 42:
            return [line] if line in titles else None
        like = [(SequenceMatcher(None, line, t).ratio(), t) for t in titles if abs(len(t) - len(line)) <= max(3, int(len(t) * 0.25))]
        return [max(like)[1]] if like and max(like)[0] >= least else None

    known = spark.createDataFrame([("d", t, [t]) for t in titles], "document_id string, title string, path array<string>")
    df = spark.createDataFrame([("d", 1, n, x) for n, x in enumerate(lines)], "document_id string, page int, line_no int, line string")
    got = {r["line"]: r["path"] for r in toc.titled_lines(df, known, least).collect()}
    assert got == {x: best(x) for x in lines}
    assert sum(v is not None and v != [k] for k, v in got.items()) > 50
