import random
import unicodedata

from pyspark.sql import functions as F

from lexmill.llm import forms as O


def test_one_form():
    same = ["Müllex 與 °C A-1", "Müllex　與 ℃ Ａ‑1", "M­ül​lex\n與\t°С А-1 "]
    assert {O.one_form(t) for t in same} == {"Müllex 與 °C A-1"}
    assert O.one_form("é") != O.one_form("e") and O.one_form("A") != O.one_form("a")
    assert O.one_form("Pе́lado") == O.one_form("Pélado")


def test_edges():
    assert O.one_form(None) is None and O.one_form("") == "" and O.one_form(" ​\n") == ""
    long = "а" * 300_000
    assert O.one_form(long) == "a" * 300_000


def test_script_evidence_keeps_equal_looks_equal():
    words = ["сор", "cop", "сoр", "вор"]
    counts = {}
    for w in ["город", "гора", "вода", "сорок", "мороз"] * 50:
        for a, b in zip(("", *w), (*w, "")):
            counts[1, a, b] = counts.get((1, a, b), 0) + 1
    speller = O.Speller(counts)
    assert len({O.one_form(w, speller) for w in words[:3]}) == 1
    assert O.one_form("гoрод", speller) == "город"  # a Latin o among Cyrillic letters
    assert O.one_form("сор", O.Speller()) == "cop"


def test_table_of_letters_is_the_slow_way():
    rng = random.Random(7)
    pool = [chr(i) for i in (*range(0x20, 0x250), *range(0x300, 0x530), *range(0x1100, 0x1120), 0x200B, 0xFB01, 0x338F, 0x1F600, 0x2126, 0xFF21, 0x3F9, 0x4E00)]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 10))) for _ in range(5000)]
    assert O.all_letters_and_digits(texts) == [O.letters_and_digits(t) for t in texts]
    assert O.all_letters_and_digits([]) == []


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    base = ["pump A", "Müllex", "seal 12", "valve-x"]
    vary = [lambda t: t, lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace("a", "а"), lambda t: t.replace(" ", "　"), lambda t: t + "‍"]
    rows = [(f"k{i:03}", vary[rng.randrange(5)](base[rng.randrange(4)]), "clash") for i in range(120)] + [("n1", None, ""), ("n2", "", ""), ("n3", " ", ""), ("n4", "​", "")]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "vector_chunk_id string, content string, form string")
    speller = O.learn_speller(df.select("content"))
    got = {tuple(r) for r in O.equal_looking(O.form_keys(df, "vector_chunk_id", "content", speller)).collect()}
    uniq = sorted({r[:2] for r in rows if r[1] and O.one_form(r[1])})
    want = {(a, b) for a, x in uniq for b, y in uniq if a < b and x != y and O.one_form(x) == O.one_form(y)}
    assert got == want and want


def test_headings_and_columns(spark):
    heads = spark.createDataFrame([("c1", "Ａ１"), ("c2", "A1"), ("c3", None)], "k string, heading string")
    agreed = spark.createDataFrame([(7, "A1"), (8, "B")], "heading_id int, heading string")
    keys = lambda df, k: O.form_keys(df, k, "heading", O.LATIN_SPELLER)
    assert [tuple(r) for r in O.matching_headings(keys(heads, "k"), keys(agreed, "heading_id")).collect()] == [("c1", "7")]
    shown = O.with_one_form(heads, "heading", "form")
    assert shown.columns == ["k", "heading", "form"] and [r["form"] for r in shown.orderBy("k").collect()] == ["A1", "A1", None]
    assert O.equal_looking(keys(heads.where(F.lit(False)), "k")).count() == 0


def test_more_scripts_that_look_latin():
    for odd, plain in (("paypa\u04cf", "paypal"), ("\u03b1lpha", "alpha"), ("\u13aapple", "Apple"), ("g\u0585\u0585d", "good")):
        assert O.one_form(odd) == plain
    assert O.one_form("5 \u03bcm, 3 \u03a9, \u03c9t") == "5 \u03bcm, 3 \u03a9, \u03c9t"  # letters that look like no Latin one


def test_copies_of_one_spelling_are_not_paired(spark):
    rows = [(f"c{i}", "same text") for i in range(50)] + [("odd", "sam\u0435 text"), ("c1", "same text")]
    keys = O.form_keys(spark.createDataFrame(rows, "k string, t string"), "k", "t", O.LATIN_SPELLER)
    assert {tuple(r) for r in O.equal_looking(keys).collect()} == {tuple(sorted((f"c{i}", "odd"))) for i in range(50)}
