import collections
import random

from lexmill.llm import boilerplate as B


def brute(rows, least):
    docs = collections.defaultdict(lambda: collections.defaultdict(set))
    for key, source, text in set(rows):
        for i, line in enumerate((text or "").split("\n")):
            if source is not None and (k := B.line_key(line)):
                docs[source, k][key].add(i)
    return {(d, i) for of in docs.values() if len(of) >= least for d, at in of.items() for i in at}


def rows_of(seed):
    rng = random.Random(seed)
    notes = ["— Legal notice NT-1.", "Legal  Notice nt-1", "Share it! [A-9]", "Ｓhare it [a-9]"]
    rows = []
    for i in range(150):
        lines = [f"Tighten screw {rng.randint(1, 30)} of the {rng.choice(['pump', 'valve'])}" for _ in range(3)] + rng.sample(notes, 2) + ["", "--"]
        rng.shuffle(lines)
        rows.append((f"c{i}", rng.choice(["s1", "s1", "s2", None]), "\n".join(lines)))
    return rows + rows[:20] + [("n", "s1", None), ("e", "s1", ""), ("b", "s1", " \n "), ("long", "s1", "word " * 20_000 + "\nLegal notice NT-1")]


def test_against_brute_force(spark):
    for seed, least in ((1, 10), (2, 25)):
        rows = rows_of(seed)
        df = spark.createDataFrame([(*r, "x") for r in rows], "id string, src string, text string, leaf string").repartition(5)
        found = B.LineTemplates(df, "id", "src", "text", least).repeated_lines()
        assert {tuple(r) for r in found.collect()} == brute(rows, least)


NAMES = ("lena", "omar", "ida", "jun", "rosa", "tom", "mei", "paul", "ana", "kurt", "yuki", "bob")


def test_bylines_are_one_template_with_a_slot(spark):
    rows = [(f"c{i}", "s", f"own text number {w} of {w}\nShared by {w.title()} on the forum\n作者：{'甲乙丙丁戊己庚辛壬癸子丑'[i]}先生發表於論壇") for i, w in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "id string, src string, text string").repartition(4)
    lines = B.LineTemplates(df, "id", "src", "text")
    assert {(r["template"], r["docs"]) for r in lines.templates().collect()} == {("shared by <*> on the forum", 12), ("作 者 : <*> 先 生 發 表 於 論 壇", 12)}
    assert lines.repeated_lines().count() == 0  # no line stands in ten documents by itself
    clean = B.without_repeated_lines(df, "id", "src", "text", "clean")
    assert {r["clean"] for r in clean.collect()} == {f"own text number {w} of {w}" for w in NAMES}


def test_sentences_with_several_values_stay(spark):
    rows = [(f"c{i}", "s", f"the pressure of the main {w} in zone {i} must never exceed {i * 7} bar at any time of the day") for i, w in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "id string, src string, text string")
    assert B.LineTemplates(df, "id", "src", "text").templates().count() == 0


def test_spellings_that_differ_in_white_space(spark):
    rows = [(f"c{i}", "s", ("Service notice", "Servicenotice", "S e r v i c e notice", "Ser vice no tice")[i % 4]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, src string, text string").repartition(3)
    assert B.LineTemplates(df, "id", "src", "text").repeated_lines().count() == 12


def test_removal_and_templates(spark):
    rows = [(f"c{i}", "s", f"own text {'abcdefghijkl'[i]}\nCopyright notice 20{i:02}\nSame line", i) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, src string, text string, docs int")
    got = B.without_repeated_lines(df, "id", "src", "text", "clean", 10)
    assert got.columns == ["id", "src", "text", "docs", "clean"] and got.count() == 12
    assert got.where("id = 'c3'").first()["clean"] == "own text d\nCopyright notice 2003"  # only two of its three words are constant
    templates = B.LineTemplates(df, "id", "src", "text").templates().collect()
    assert {(r["docs"], r["template"]) for r in templates} == {(12, "same line")}
    assert B.LineTemplates(df, "id", "src", "text", share=0.6).templates().count() == 3
    assert B.LineTemplates(df.limit(0), "id", "src", "text").repeated_lines().count() == 0


def test_partitions_make_no_difference(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "id string, src string, text string")
    seen = {tuple(sorted(map(tuple, B.LineTemplates(df.repartition(n), "id", "src", "text").templates().collect()))) for n in (1, 7)}
    assert len(seen) == 1
