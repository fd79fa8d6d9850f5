from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as X

AWKWARD = st.text(alphabet=st.sampled_from("ab \t\n\r\x0b\x0c\x1c\x85  　　﻿。漢A1-*#_`|"), max_size=30)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("v")).first()["v"]


def many(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expression.alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


@settings(max_examples=5, deadline=None)
@given(st.lists(AWKWARD, min_size=40, max_size=60))
def test_white_space_and_lines_are_pythons(spark, texts):
    t = F.col("t")
    assert many(spark, texts, X.strip(t)) == [x.strip() for x in texts]
    assert many(spark, texts, X.strip_end(t)) == [x.rstrip() for x in texts]
    assert many(spark, texts, X.lines(t)) == [x.splitlines() for x in texts]
    assert many(spark, texts, X.one_space(t)) == [" ".join(x.split()) for x in texts]


def test_clean_markdown(spark):
    assert one(spark, "﻿a \r\nb\x00<PAGE>\r\n\r\n\r\n\r\nc<|User|>  \n", X.clean_markdown(F.col("t"))) == "a\nb\n\nc"
    assert one(spark, None, X.clean_markdown(F.col("t"))) is None


def test_rag_markdown(spark):
    assert one(spark, "![ x ](images/a.png) ![](b) <b>t</b>", X.rag_markdown(F.col("t"))) == "[圖片：x] [圖片] t"
    assert one(spark, "<h2 class=a>T</h2>\n<p>x</p>", X.rag_markdown(F.col("t"), True)) == "## T\nx"


def test_plain_text(spark):
    md = "# T\n- a\n1. b\n**c** _d_ `e`\n|---|---|\nend"
    assert one(spark, md, X.plain_text(F.col("t"))) == "T\na\nb\nc d e\n\nend"


def test_title_key_and_stem(spark):
    assert one(spark, "## 目 錄（一）：x....", X.title_key(F.col("t"))) == "目錄(一):x"
    assert many(spark, ["a.b.pdf", ".pdf", "x"], X.stem(F.col("t"))) == ["a.b", ".pdf", "x"]


def test_leaks(spark):
    text = "keep\n  Do not use special characters here\nalso"
    assert one(spark, text, X.without_leaks(F.col("t"))) == "keep\nalso"
    assert one(spark, text, X.leaked_lines(F.col("t"))) == ["  Do not use special characters here"]


def test_word_score(spark):
    key = X.search_key(F.lit("M6 螺絲庫存量是多少？"))
    scores = many(spark, ["M6 螺絲 100", "m6x 螺絲", "nothing"], X.word_score(key, F.col("t")))
    assert scores == [1.0, 0.95, 0.0]


def test_toc_and_steps(spark):
    assert tuple(one(spark, "重要故障查修 ...... 4", X.toc_entry(F.col("t")))) == ("重要故障查修", 4)
    assert many(spark, ["1 檢查保險絲", "10 檢查", "1. 將電源開關OFF。", "1 .foo"], X.step_number(F.col("t"))) == [1, 10, None, None]


def test_heading_prefix(spark):
    assert spark.range(1).select(X.heading_prefix(F.array(F.lit("A"), F.lit("B"))).alias("v")).first()["v"] == "# A\n## B"


def test_json_salvage(spark):
    assert one(spark, '```json\n[{"a": 1}]\n```', X.json_array(F.col("t"), "array<struct<a:int>>"))[0]["a"] == 1
    assert one(spark, 'so: {"a": 2} ok', X.json_object(F.col("t"), "struct<a:int>"))["a"] == 2
    assert one(spark, "none", X.json_object(F.col("t"), "struct<a:int>")) is None


def test_reasoning(spark):
    assert tuple(one(spark, "<think> a </think> b", X.split_reasoning(F.col("t")))) == ("a", "b")
    assert tuple(one(spark, "Thinking process: x\nFinal Answer: y", X.split_reasoning(F.col("t")))) == ("", "y")
    assert one(spark, "<think>a</think>b", X.without_reasoning(F.col("t"))) == "b"


def test_summary_text(spark):
    schema = "title string, summary string, purpose string, intended_audience string, topics array<string>"
    rows = spark.createDataFrame([((None, "s", None, None, ["a", " ", "b"]),), ((None, " ", "", "x", []),)], f"s struct<{schema.replace(' string', ':string').replace(' array', ':array')}>")
    got = [r["v"] for r in rows.select(X.summary_text(F.lit("f.pdf"), F.lit("t"), F.col("s")).alias("v")).collect()]
    assert got == ["passage: 文件名稱：f.pdf\n文件標題：t\n文件摘要：s\n主要主題：a、b", None]


def test_page_image_links(spark):
    assert one(spark, "![a](images/b.png)", X.page_image_links(F.col("t"), F.lit(3))) == "![a](pages/page_0003/images/b.png)"
