import random

from lexmill.llm import scans as S


def test_page_lines():
    for line in ("Page 3", "p. 12", "- 4 -", "— 7 —", "[ 9 ]", "3 / 22", "7 of 29", "第 5 頁", "頁 3，共 9 頁", "Pagc 1O"):
        assert S.is_page_line(line, None), line
    for line in ("Page three", "M6", "", "3 bolts", "E51"):
        assert not S.is_page_line(line, None), line
    assert S.is_page_line("7", 6) and not S.is_page_line("7", 60)


def test_skeletons():
    assert S.skeleton("temperafure") == S.skeleton("temperature")
    assert S.skeleton("inodern") == S.skeleton("1nodern") and S.skeleton("screvvs") == S.skeleton("screws")
    assert S.skeleton("厭力") == S.skeleton("壓力")


def corpus():
    rng = random.Random(4)
    body = ["the pressure of the valve must remain below the temperature of the machine", "tighten the screws of the hydraulic cylinder and inspect the bearing", "請先清潔電磁閥再檢查壓力表並記錄讀值"]
    rows = []
    for f in range(8):
        for p in range(1, 7):
            rows.append((f"n{f}-{p}", f"n{f}.pdf", f"NN-{f}00 manual", p, "\n".join(rng.sample(body, 3)) + f"\nCopyright notice {f}"))
    for f in range(3):
        for p in range(1, 9):
            text = f"XY-10{f} manual\nDoc no AB-10{f} rev A\nthe pressure of the valve must re-\nmain below the temperafure of the machine\ntighten the screws of the hydrau-\nPage {p}\nlic cylinder and inspect the bearing\n請先請潔電磁閥再檢查壓力表並記錄讀值\nCopyright notice {f}"
            if p > 1:  # misread on few pages only
                text = text.replace("temperafure", "temperature").replace("先請", "先清")
            rows.append((f"s{f}-{p}", f"s{f}.pdf", f"XY-10{f} manual", p, text))
    return rows + [("x1", None, None, None, "a"), ("x2", "n1.pdf", None, None, None), ("x3", "n1.pdf", None, 1, ""), rows[-1]]


def test_noise_is_found(spark):
    df = spark.createDataFrame([(*r, "clash") for r in corpus()], "id string, src string, title string, page int, text string, noise string")
    noise = S.ScanNoise(df, "id", "src", "title", "page", "text")
    got = {(r["item_id"], r["line_no"], r["noise"]) for r in noise.found().select("item_id", "line_no", "noise").collect()}
    want = set()
    for f in range(3):
        for p in range(1, 9):
            want |= {(f"s{f}-{p}", i, n) for i, n in ((0, "page_furniture"), (1, "page_furniture"), (2, "broken_word"), (3, "misread"), (4, "broken_word"), (5, "page_furniture"), (7, "misread")) if n != "misread" or p == 1}
    assert got == want


def test_repair(spark):
    df = spark.createDataFrame(corpus(), "id string, src string, title string, page int, text string")
    rows = {r["id"]: r["repaired"] for r in S.ScanNoise(df, "id", "src", "title", "page", "text").repaired("repaired").collect()}
    assert rows["s0-1"] == "the pressure of the valve must remain below the temperature of the machine tighten the screws of the hydraulic cylinder and inspect the bearing\n請先清潔電磁閥再檢查壓力表並記錄讀值 Copyright notice 0".replace("\n", " ")
    assert rows["n0-1"] == {r[0]: r[4] for r in corpus()}["n0-1"] and rows["x2"] is None and rows["x3"] == ""


def test_empty(spark):
    df = spark.createDataFrame([], "id string, src string, title string, page int, text string")
    assert S.ScanNoise(df, "id", "src", "title", "page", "text").found().count() == 0


def test_headers_without_digits_of_one_source_and_damaged_ones(spark):
    body = "the pressure of the valve must remain below the limit\ntighten the screws of the cylinder and inspect the bearing"
    rows = [(f"n{i}", f"n{i % 4}.pdf", None, i, f"{body}\nplain end {'abcdefghij'[i % 10]}") for i in range(20)]
    head = "Nightly Workshop Bulletin"
    for p in range(1, 11):
        own = {4: "Nightly Works.op Bulletin", 5: "Nightly Workshop Bulle tin"}.get(p, head)
        rows.append((f"s{p}", "scan.pdf", None, p, f"{own}\n{body}\n- {p} -"))
    df = spark.createDataFrame(rows, "id string, src string, title string, page int, text string")
    got = {(r["item_id"], r["line_no"]) for r in S.ScanNoise(df, "id", "src", "title", "page", "text").found().where("noise = 'page_furniture'").collect()}
    assert got == {(f"s{p}", n) for p in range(1, 11) for n in (0, 3)}


def test_titles_as_headers():
    shapes = S.title_shapes("Pump XY-12 manual", "Pump_XY-12_manual_D0007.pdf")
    for line in ("Pump XY-12 manual", "PUMP  XY·12 manual   7", "12 | Pump XY-12 manual"):
        assert S.line_shape(line)[0] in shapes
    assert any(v in {o for t in shapes for o in S.one_off(t, glyphs=True)} for v in S.one_off(S.line_shape("Pump XY-1. manual")[0]))
    assert S.line_shape("Tighten it, then check XY-12.") is None and S.line_shape("x" * 90 + " 7") is None


def test_the_supported_form_mends(spark):
    """Of several frequent words of one skeleton the one with the same neighbours is meant; of several characters the one that forms the pairs."""
    assert S.skeleton("heard") == S.skeleton("beard")
    clean = ["we heard voices in the hall"] * 12 + ["his beard grows long"] * 30
    rows = [(f"n{i}", f"n{i % 5}.pdf", None, None, t) for i, t in enumerate(clean)]
    rows += [(f"s{p}", "scan.pdf", None, p, f"{'we hcard voices in the hall' if p == 2 else 'his beard grows long'}\n- {p} -") for p in range(1, 7)]
    df = spark.createDataFrame(rows, "id string, src string, title string, page int, text string")
    noise = S.ScanNoise(df, "id", "src", "title", "page", "text")
    found = {(r["item_id"], r["line_no"], r["form"]) for r in noise.found().where("noise = 'misread'").collect()}
    assert found == {("s2", 0, "heard")}
    assert {r["id"]: r["out"] for r in noise.repaired("out").collect()}["s2"] == "we heard voices in the hall"
    counts = spark.createDataFrame([("han", "的已經", None, 2), ("han", "自己的", None, 90), ("han", "在巳時", None, 40), ("han", "自巳的", None, 1), ("han", "自已的", None, 1)], "kind string, a string, b string, n bigint")
    best = {}
    for r in S.han_forms(counts).collect():
        best[r["trigram"]] = max(best.get(r["trigram"], (0, "")), (r["support"], r["form"]))
    assert best["自巳的"][1] == best["自已的"][1] == "己"
