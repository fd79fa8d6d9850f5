import re

from hypothesis import given
from hypothesis import strategies as st

from lexmill.llm import pieces as P


@given(st.text(alphabet="ab。. \n!?，", max_size=200) | st.text(alphabet="ab ", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_every_joint_has_the_wanted_overlap(text, limit, overlap):
    got = P.cut_item(text, limit, overlap, full=True)
    assert "".join(text[own:end] for _, own, end, _ in got) == text
    assert all(0 < end - a <= limit and own - a == min(overlap, own) for a, own, end, _ in got)
    assert all(a >= before for (before, *_), (a, *_) in zip(got, got[1:]))
    stretch = max(map(len, re.split("(?<=[\n。！？；!?;])|(?<=\\.)(?=\\s)", text)))
    assert any(f for *_, f in got) == (stretch > limit)


def test_pieces_of_frames(spark):
    rows = [("a", "x" * 3000), ("b", ("y" * 1099 + "。") * 3)]
    got = P.split_oversized(spark.createDataFrame(rows, "id string, text string"), "id", "text", 1200, 180).orderBy("item_id", "piece_no").collect()
    assert all(r["shared"] == (180 if r["piece_no"] else 0) and len(r["piece"]) <= 1200 for r in got)
    assert {(r["item_id"], r["stretch_cut"]) for r in got} == {("a", True), ("b", False)}
