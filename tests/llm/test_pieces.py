import random
import re

from hypothesis import given
from hypothesis import strategies as st

from lexmill.llm import pieces as P


def stretch(text):
    return max(map(len, re.split("(?<=[\n\r\x0b\x0c\x85  。！？；!?;])|(?<=\\.)(?=\\s)", text)))


@given(st.text(alphabet="ab。. \n!?，", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_pieces_are_the_text(text, limit, overlap):
    got = P.cut_item(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end, _ in got) == text
    assert all(0 < end - a <= limit and own - a <= overlap for a, own, end, _ in got)
    assert any(f for *_, f in got) == (len(text) > limit and stretch(text) > limit)


def test_overlap_is_as_wanted_where_it_fits():
    text = "aaaa. " * 60
    got = P.cut_item(text, 60, 12)
    assert [own - a for a, own, *_ in got][1:] == [12] * (len(got) - 1)


def test_natural_cuts_come_first():
    got = P.cut_item("x" * 30 + "\n\n" + "y" * 30, 40, 5)
    assert got[0][2] == 32 and not got[0][3]


def test_long_item():
    assert len(P.cut_item("z" * 400_000, 1200, 180)) == 334


def test_frames(spark):
    rows = [("a", "x" * 30), ("a", "x" * 30), ("b", None), ("c", ""), ("d", "short"), ("e", "a。" * 20)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id string, text string, piece int")
    got = P.split_oversized(df, "id", "text", 20, 4)
    assert {(r["item_id"], r["cut"]) for r in P.cuts_found(got).collect()} == {("a", "forced"), ("e", "natural")}
    assert got.where("item_id = 'a'").count() == 2
    assert P.split_oversized(df.limit(0), "id", "text", 20, 4).count() == 0
    blocks = spark.createDataFrame([("h", "t"), (None, "t"), ("", "t"), ("h", None), (None, None)], "heading string, text string")
    assert [r["item_text"] for r in P.procedure_text(blocks).collect()] == ["h\nt", "t", "t", "h", ""]


def test_combining_marks_stay_with_their_letter():
    text = "e\u0301" * 100
    for start, own, end, forced in P.cut_item(text, 31, 6, full=True):
        assert text[own] == "e" and end - start <= 31
    assert len(P.cut_item("\u0301" * 100, 31, 6, full=True)) > 3  # nothing but marks is cut all the same
