import math
import os
import time

import pytest
from pyspark.sql import functions as F

from lexmill import config, models, schemas
from lexmill.config import Settings
from lexmill.engine import Engine
from lexmill.functions import vectors as V
from lexmill.operators import cache, catalog, grounding, index, pages, search, toc
from lexmill.sources import files
from lexmill.streaming import watch as W


def test_settings():
    assert config.Settings().validated()
    with pytest.raises(ValueError):
        config.Settings(chunk_overlap=1200).validated()
    assert config.PROFILES["gui"].min_rerank_score == 0.25 and config.PROFILES["cli"].max_context_chars == 9000


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.norm(F.col("a")).alias("n"), V.unit(F.col("a")).alias("u"), V.blend(F.col("a"), F.col("b"), 0.5).alias("m")).first()
    assert r["d"] == 3.0 and r["n"] == 5.0 and r["u"] == [0.6, 0.8] and abs(math.hypot(*r["m"]) - 1) < 1e-12
    with pytest.raises(Exception, match="normalised"):
        spark.createDataFrame([([0.0, 0.0],)], "a array<float>").select(V.unit(F.col("a"))).collect()
    values = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("inf",)], "t string")
    assert [r[0] for r in values.select(V.safe_float(F.col("t"))).collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_centroid_weights(spark):
    rows = spark.createDataFrame([("d", "aaaa", [1.0, 0.0]), ("d", "a", [0.0, 1.0])], "document_id string, content string, embedding array<double>")
    assert [round(x, 6) for x in index.centroids(rows).first()["embedding"]] == [0.894427, 0.447214]


def test_representatives(spark):
    schema = "document_id string, page int, chunk_index int, sub_chunk_index int, vector_chunk_id string, embedding array<double>"
    scores = [("c1", 1, 0.1), ("c2", 1, 0.2), ("c3", 1, 0.9), ("c4", 1, 0.8), ("c5", 1, 0.7), ("c6", 2, 0.05)]
    rows = spark.createDataFrame([("d", p, i, 0, c, [s]) for i, (c, p, s) in enumerate(scores)], schema)
    middle = spark.createDataFrame([("d", [1.0])], "document_id string, embedding array<double>")
    pick = lambda df, n: [r["vector_chunk_id"] for r in index.representatives(df, middle, n).orderBy("rank").collect()]
    assert pick(rows.where("page = 1"), 3) == ["c1", "c2", "c3"]
    assert pick(rows, 4) == ["c1", "c2", "c6", "c3"]


def test_budget(spark):
    rows = spark.createDataFrame([([(1, "abcdef"), (2, "xy  zz"), (3, "hello")],)], "r array<struct<place:int,content:string>>")
    got = rows.select(search.budgeted(F.col("r"), 10).alias("b")).first()["b"]
    assert [(x["content"], x["content_truncated"]) for x in got["results"]] == [("abcdef", False), ("xy", True), ("he", True)]
    assert got["used"] == 10


def test_status_ladder(spark):
    schema = "rank int, dense_score double, lexical_score double, rerank_score double"
    of = lambda rows, reranker=True: search.detail_status(spark.createDataFrame(rows, schema), reranker, 0.95, 0.5).first()["status"]
    assert of([]) == "insufficient_context" and of([(1, 0.1, 0.0, 0.1)]) == "insufficient_context"
    assert of([(1, 0.1, 0.95, 0.1)]) == "ok" and of([(1, 0.1, 0.0, 0.6)]) == "ok" and of([(1, 0.1, 0.0, None)], False) == "ok"


def test_merge_and_rerank(spark):
    near = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.8)], "vector_chunk_id string, dense_rank int, dense_score double")
    words = spark.createDataFrame([("b", 1, 1.0), ("c", 2, 0.95)], "vector_chunk_id string, lexical_rank int, lexical_score double")
    got = [(r["vector_chunk_id"], r["position"], r["lexical_score"]) for r in search.merged(near, words).orderBy("position").collect()]
    assert got == [("a", 1, 0.0), ("b", 2, 1.0), ("c", 3, 0.95)]
    cand = search.merged(near, words).withColumn("parent_chunk_id", F.when(F.col("vector_chunk_id") == "a", "p").otherwise("q")).withColumn("rerank_score", F.lit(0.5))
    assert [r["vector_chunk_id"] for r in search.reranked(cand, 5).orderBy("rank").collect()] == ["b", "a"]


def test_routing(spark):
    rows = spark.createDataFrame([("哪份文件提到 M6", False), ("講解一下這份 PDF", False), ("幫我整理", False), ("幫我整理", True), ("M6 規格", True)], "question string, selected boolean")
    got = [r["m"] for r in rows.select(search.mode_by_rules(F.col("question"), F.col("selected")).alias("m")).collect()]
    assert got == ["documents", "overview", "detail", "overview", "detail"]
    assert {r["mode"] for r in search.mode_by_meaning(rows, models.HashEmbedder(), 0.035).collect()} <= {"documents", "overview", "detail"}


def test_cache(spark):
    fp = "m"
    recs = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h2")], "vector_chunk_id string, embedding_text_sha256 string")
    key = spark.range(1).select(cache.cache_key(F.lit(fp), F.lit("h1")).alias("k")).first()["k"]
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(key, 2, fp, "h1", 2, [1.0, 0.0], t), (key, 2, fp, "h1", 2, [0.0, 1.0], t + dt.timedelta(days=1)), ("x", 2, fp, "h9", 2, [float("nan"), 1.0], t), ("y", 2, fp, "h8", 3, [1.0], t), ("z", 2, fp, "h7", 2, None, t)]
    stored = spark.createDataFrame(rows, schemas.EMBEDDING_CACHE)
    planned = cache.plan(recs, stored, fp)
    assert sorted((r["vector_chunk_id"], r["cached"]) for r in planned.collect()) == [("a", True), ("b", False), ("c", False)]
    assert tuple(cache.statistics(planned).first()) == (3, 1, 1, 2)
    assert cache.usable(stored).count() == 1 and cache.usable(stored).first()["vector"] == [0.0, 1.0]
    made = cache.embed_missing(planned.withColumn("t", F.col("embedding_text_sha256")), "t", models.HashEmbedder(4), fp)
    assert made.count() == 1 and made.first()["dimension"] == 4


def test_catalog(spark):
    rows = [("b/X.pdf", "X.pdf", "d1", "c", "", 2, "complete", None), ("A/x.pdf", "x.pdf", "d1", "c", "", 2, "complete", None), ("z", "z.pdf", "d2", "c", "", None, "error", "e")]
    known = spark.createDataFrame(rows, schemas.CATALOG)
    assert [r["source_path"] for r in catalog.complete_documents(known).collect()] == ["A/x.pdf"]
    import datetime as dt

    at = lambda m: dt.datetime(2025, 1, 1, 0, m)
    states = spark.createDataFrame([("d1", "c", 1, "done", 1, None, at(5)), ("d1", "c", 1, "pending", 0, None, at(1))], schemas.PAGE_STATUS)
    assert [(r["page"], r["reason"]) for r in catalog.resume_plan(known, states).collect()] == [(2, "missing")]
    merged = W.merged_states(states, spark.createDataFrame([("d1", "c", 1, "error", 2, "x", at(3))], schemas.PAGE_STATUS)).first()
    assert merged["status"] == "done" and merged["attempts"] == 3
    asked = spark.createDataFrame([(1, "d1"), (2, "d"), (3, "x.PDF"), (4, "q"), (5, "Z")], "request_id int, wanted string")
    got = {r["request_id"]: r["outcome"] for r in catalog.resolve(known, asked).collect()}
    assert got == {1: "found", 2: "ambiguous", 3: "found", 4: "missing", 5: "found"}


def test_pages(spark):
    rows = spark.createDataFrame([("d", p, f"服務手冊\nbody {p}\n{p}-1\n\n\n\nend {p}") for p in (1, 2, 3)], "document_id string, page int, text string")
    edge = pages.edge_lines(rows)
    assert [(r["key"], r["pages"]) for r in edge.collect()] == [("服務手冊", 3)]
    assert pages.edge_lines(rows.where("page < 3")).count() == 0
    assert pages.without_noise(rows, edge).orderBy("page").first()["text"] == "body 1\n\nend 1"
    assert [r["line"] for r in pages.recurring_lines(rows).collect()] == ["服務手冊"]
    assert pages.whole_documents(rows).first()["markdown"].startswith("## 第 1 頁\n\n服務手冊")


def test_toc(spark):
    rows = [("d", 1, "目錄", 40.0, 10.0), ("d", 1, "A .... 3", 50.0, 30.0), ("d", 1, "T ..... 4", 70.0, 40.0), ("d", 1, "T2 ..... 5", 70.0, 50.0), ("d", 1, "B ..... 6", 50.0, 60.0)]
    layout = spark.createDataFrame([(*r, r[3] + 100, r[4] + 10, 600.0) for r in rows], schemas.LAYOUT_LINES)
    levels = toc.toc_levels(toc.toc_entries(layout)).orderBy("place").collect()
    assert [(r["title"], r["level"], r["path"]) for r in levels] == [("A", 1, ["A"]), ("T", 2, ["A", "T"]), ("T2", 2, ["A", "T2"]), ("B", 1, ["B"])]
    text = spark.createDataFrame([("d", 1, "目錄\nfirst half\n second .... 7\nA 9")], "document_id string, page int, text string")
    assert [(r["title"], r["target_page"]) for r in toc.toc_from_text(text).orderBy("place").collect()] == [("first halfsecond", 7), ("A", 9)]
    lines = spark.createDataFrame([("d", 1, 1, "intro"), ("d", 1, 2, "Brake system overview and checks"), ("d", 1, 3, "body"), ("d", 2, 1, "more")], "document_id string, page int, line_no int, line string")
    titles = spark.createDataFrame([("d", "Brake system overvicw and checks", ["B"])], "document_id string, title string, path array<string>")
    got = toc.segments(toc.titled_lines(lines, titles)).orderBy("segment").collect()
    assert [(r["path"], r["page_start"], r["page_end"], r["body"]) for r in got] == [(None, 1, 1, "intro"), (["B"], 1, 2, "body\nmore")]


def test_sections(spark):
    text = spark.createDataFrame([("d", 1, "A\na\nT\nb\nT2\nc"), ("d", 2, "go on\nU\nd")], "document_id string, page int, text string")
    found = spark.createDataFrame([("d", 1, 1, 1), ("d", 1, 3, 3), ("d", 1, 5, 3), ("d", 2, 2, 2), ("d", 2, 9, 1)], "document_id string, page int, start_line int, level int")
    got = toc.section_segments(text, toc.sound_headings(found, text)).orderBy("page", "place").collect()
    assert [(r["section_path"], r["body"]) for r in got] == [(["A"], "a"), (["A", "T"], "b"), (["A", "T", "T2"], "c"), (["A", "T", "T2"], "go on"), (["A", "U"], "d")]


def test_grounding(spark):
    results = spark.createDataFrame([(1, "f", 2, "a\n\n b "), (2, "f", 2, " "), (3, "g", None, "c")], "rank int, source_file string, page int, content string")
    assert [(r["citation_id"], r["line"]) for r in grounding.cited_lines(results).orderBy("rank", "line_no").collect()] == [("S1-1", "a"), ("S1-2", "b"), ("S3-1", "c")]
    assert [(r["source_number"], r["source_file"], r["page"]) for r in grounding.sources(results).orderBy("source_number").collect()] == [(1, "f", 2), (2, "g", 0)]
    foot = spark.createDataFrame([("x ", [("f", 2)])], "a string, s array<struct<source_file:string,page:int>>").select(grounding.with_footer(F.col("a"), F.col("s"))).first()[0]
    assert foot == "x\n\n參考來源：\n- [來源1] f，第 2 頁"
    good = spark.createDataFrame([(("run", "low", 0.5, "r", "SOP-1", []),), (("run", "low", 1.5, "r", "SOP-1", []),)], "d struct<decision:string,severity:string,confidence:double,reason:string,sop_reference:string,actions:array<string>>")
    assert [r[0] for r in good.select(grounding.sound_decision(F.col("d"), "SOP")).collect()] == [True, False]


def test_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "A.PDF").write_bytes(b"%PDF-1 a")
    (tmp_path / "b" / "c.pdf").write_bytes(b"%PDF-1 c")
    (tmp_path / "x.txt").write_text("x")
    found = files.pdf_files(spark, str(tmp_path), True)
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["A.PDF", "c.pdf"]
    assert found.select(files.sound_upload(F.col("path"), F.col("content"), 100).alias("e")).where("e is not null").count() == 0
    assert found.select(files.sound_upload(F.col("path"), F.col("content"), 3).alias("e")).first()["e"] == "file too large"
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": x}\n[1]\n')
    schema = "a int"
    assert [r["a"] for r in files.json_lines(spark, str(lines), schema, strict=False).collect()] == [1]
    with pytest.raises(Exception, match="no JSON object"):
        files.json_lines(spark, str(lines), schema).collect()
    clean = tmp_path / "cache" / "doc" / "conf" / "pages" / "page_0007"
    clean.mkdir(parents=True)
    (clean / "clean.md").write_text("hello")
    assert tuple(files.cached_pages(spark, str(tmp_path / "cache")).first()) == ("doc", "conf", 7, "hello")


def test_watch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "b.pdf").write_bytes(b"one")
    old = time.time() - 60
    os.utime(folder / "a.pdf", (old, old))
    os.utime(folder / "b.pdf", (old, old))
    (folder / "new.pdf").write_bytes(b"two")
    seen = []
    W.watch(spark, str(folder), str(tmp_path / "cp"), lambda df, n: seen.append({(os.path.basename(r["source_path"]), r["status"]) for r in df.collect()}), settle_s=30, once=True).awaitTermination(60)
    assert seen[-1] == {("a.pdf", "pending"), ("new.pdf", "waiting_for_stable_file")}
    (folder / "a.pdf").unlink()
    assert {os.path.basename(r["source_path"]) for r in W.snapshot(spark, str(folder), 0).where("status = 'pending'").collect()} == {"b.pdf", "new.pdf"}


def test_models():
    assert models.HashEmbedder(8)(["a"]) == models.HashEmbedder(8)(["a"])
    assert models.room_for_answer(1000, 100, 768) == 768
    with pytest.raises(ValueError):
        models.room_for_answer(200, 150, 768)
    with pytest.raises(ValueError):
        models.answered(lambda m: " ", [])


def test_engine(spark):
    rows = [(f"c{i}", f"d{i % 2}", f"f{i % 2}.pdf", None, i + 1, i + 1, i, f"text number {i} about pumps and M{i} screws") for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, source_file string, title string, page int, page_start int, chunk_index int, content string")
    engine = Engine(spark, models.HashEmbedder(16))
    stored = engine.ingest(chunks)
    assert stored.count() == 8 and [r["faiss_id"] for r in engine.chunks.orderBy("faiss_id").collect()] == list(range(8))
    mode, found = engine.search("M6 screws", mode="detail")
    assert mode == "detail" and found.count() == 6
    assert "參考來源" in engine.answer("M6 screws", models.echo_generator)
    assert engine.search("x", mode="documents")[1].count() == 2 and engine.search("x", "d1", "overview")[1].count() == 4
    assert engine.resolve("d1") == "d1"
    with pytest.raises(LookupError):
        engine.resolve("nothing")
    assert engine.ingest(chunks, stored).count() == 8


def test_ingest(spark, tmp_path):
    from lexmill.operators import ingest

    good = "Page text with many words so that it counts as usable native text for sure 123"
    (tmp_path / "a.pdf").write_bytes(f"1\x01{good}\x022\x01short".encode())
    (tmp_path / "bad.pdf").write_bytes(b"\x02")
    pdfs = files.pdf_files(spark, str(tmp_path), True)

    def decode(content):
        return [(int(p.split("\x01")[0]), p.split("\x01")[1]) for p in content.decode().split("\x02") if p]

    def recognise(content, page):
        if page == 1:
            raise RuntimeError("no model")
        return "seen  by\r\nmodel"

    seen = {r["source_path"].rsplit("/", 1)[1]: (r["page_count"], r["error"]) for r in ingest.inspected(pdfs, lambda c: len(decode(c))).collect()}
    assert seen == {"a.pdf": (2, None), "bad.pdf": (None, "no pages")}
    rows = {r["page"]: r for r in ingest.decoded(pdfs, decode, recognise).collect()}
    assert (rows[1]["text"], rows[1]["extraction_method"], rows[1]["status"]) == (good, "pdf_text_layer", "done")
    assert (rows[2]["text"], rows[2]["extraction_method"]) == ("seen  by\nmodel", "recognition")
    forced = {r["page"]: r["status"] for r in ingest.decoded(pdfs, decode, recognise, "recognised").collect()}
    assert forced == {1: "error", 2: "done"}
    done = spark.createDataFrame([(rows[1]["document_id"], 1)], "document_id string, page int")
    assert [r["page"] for r in ingest.decoded(pdfs, decode, recognise, done=done).collect()] == [2]
    assert ingest.config_hash({"a": 1, "b": 2}) == ingest.config_hash({"b": 2, "a": 1})


def test_section_cache(spark):
    import json

    from lexmill.operators import ingest

    text = spark.createDataFrame([("d", 1, "Title\nbody"), ("d", 2, "Title\nbody"), ("d", 3, "x")], "document_id string, page int, text string")
    none = spark.createDataFrame([], "text_sha256 string, version string, model string, start_line int, level int")
    planned = ingest.section_plan(text, none, "v1", "m")
    assert planned.where("hit").count() == 0
    stored = ingest.detected(planned, lambda lines: json.dumps([h for h in models.rule_headings(lines) if h["title"] == "Title"]), "v1", "m").persist()
    assert stored.count() == 2
    again = ingest.section_plan(text, stored, "v1", "m")
    assert again.where("not hit").count() == 0 and ingest.section_plan(text, stored, "v2", "m").where("hit").count() == 0
    assert sorted((r["page"], r["start_line"]) for r in ingest.headings_of(again, stored, "v1", "m").collect()) == [(1, 1), (2, 1)]


def test_document_files(spark):
    from lexmill.operators import ingest

    whole = pages.whole_documents(spark.createDataFrame([("d", 1, "a")], "document_id string, page int, text string"))
    known = spark.createDataFrame([("p/x.pdf", "x.pdf", "d", "c", "", 1, "complete", None)], schemas.CATALOG)
    row = ingest.document_markdown(whole, known, "2025-01-01T00:00:00+00:00").first()
    assert row["markdown"].startswith('---\ndocument_id: "d"\nsource_file: "x.pdf"\npage_count: 1\n') and "# x\n\n## 第 1 頁" in row["markdown"]
    assert row["plain"].startswith("x\n\n===== 第 1 頁 =====")


def test_conversations(spark):
    rows = [(f"c{i}", "d0", "f.pdf", None, i + 1, i + 1, i, f"pump {i} pressure limit") for i in range(3)]
    engine = Engine(spark, models.HashEmbedder(16))
    engine.ingest(spark.createDataFrame(rows, "chunk_id string, document_id string, source_file string, title string, page int, page_start int, chunk_index int, content string"))
    assert "參考來源" in engine.grounded("pump 1 pressure", models.echo_generator)
    assert engine.grounded("zzz", lambda m: "qqq") == grounding.REFUSAL
    assert engine.chat("hi", lambda m: f"{len(m)}", [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}]) == "3"
    good = '{"decision": "stop", "severity": "high", "confidence": 0.9, "reason": "r", "sop_reference": "SOP-2", "actions": []}'
    assert engine.decide("leak", lambda m: f"so: {good}", "SOP")["decision"] == "stop"
    assert engine.decide("leak", lambda m: "none", "SOP") is None


def test_summaries(spark):
    middle = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "document_id string, embedding array<double>")
    summary = spark.createDataFrame([("a", [0.0, 1.0])], "document_id string, embedding array<double>")
    got = {r["document_id"]: r for r in index.with_summaries(middle, summary, 0.65).collect()}
    n = math.hypot(0.35, 0.65)
    assert [round(x, 9) for x in got["a"]["embedding"]] == [round(0.35 / n, 9), round(0.65 / n, 9)] and got["a"]["vector_source"] == "summary_and_chunk_centroid"
    assert got["b"]["embedding"] == [0.0, 1.0] and got["b"]["vector_source"] == "chunk_centroid"


def test_finished_pages_and_jobs(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2025, 1, 1, 0, m)
    states = spark.createDataFrame([("d", "c", p, s, 1, None, at(m)) for p, s, m in ((1, "done", 1), (2, "done", 1), (2, "error", 2), (3, "done", 1))], schemas.PAGE_STATUS)
    have = spark.createDataFrame([("d", "c", 1), ("d", "c", 2)], "document_id string, ocr_config_hash string, page int")
    assert [r["page"] for r in catalog.finished_pages(states, have, have).collect()] == [1]
    jobs = spark.createDataFrame([(f"j{i:02}", "completed" if i % 5 else "ocr", at(i)) for i in range(14)], "job_id string, status string, started_at timestamp")
    kept = catalog.kept_jobs(jobs).collect()
    assert len(kept) == 10 and [r["job_id"] for r in kept if r["active"]] == ["j10"]


def test_answer_stream():
    def shown(pieces, thinking=False):
        stream = models.AnswerStream(thinking)
        out = [x for p in pieces for x in stream.feed(p)] + stream.close()
        return tuple("".join(t for k, t in out if k == kind) for kind in ("reasoning", "answer"))

    assert shown(list("<think>why</think>\nso")) == ("why", "so")
    assert shown(["plain ", "answer"]) == ("", "plain answer")
    assert shown(["think", "ing </th", "ink>done"], True) == ("thinking ", "done")
    assert shown(["<"]) == ("", "<")


def test_single_writer(spark, tmp_path):
    lock = (tmp_path / "lock").as_uri()
    with W.single_writer(spark, lock):
        with pytest.raises(RuntimeError):
            with W.single_writer(spark, lock):
                pass
        with W.single_writer(spark, lock, stale_s=-1):  # left by a driver that died
            pass
    with W.single_writer(spark, lock):
        pass


def test_only_changed_files_are_read(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-2")):
        (tmp_path / name).write_bytes(content)
    before = W.hashed(spark, str(tmp_path), 0)
    assert before.where("document_id is not null").count() == 2
    kept = spark.createDataFrame([(r["path"], r["modificationTime"], r["length"], "known " + r["path"][-5:]) for r in before.collect()], before.schema)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-22")
    after = {os.path.basename(r["path"]): r["document_id"] for r in W.hashed(spark, str(tmp_path), 0, known=kept).collect()}
    assert after["a.pdf"] == "known a.pdf" and len(after["b.pdf"]) == 64


def test_rerankers(spark):
    rows = [("a", "p1", 1, 1, 0.0, "pump"), ("b", "p1", 2, 2, 0.0, "pump valve"), ("c", "p2", 3, 3, 0.95, None), ("d", "p3", 4, 4, 0.0, "x")]
    df = spark.createDataFrame(rows, "vector_chunk_id string, parent_chunk_id string, dense_rank int, position int, lexical_score double, content string")
    best = search.reranked(search.scored(df, "pump valve", models.OverlapReranker()), 3).orderBy("rank").collect()
    assert [r["vector_chunk_id"] for r in best] == ["c", "b", "d"] and best[1]["rerank_score"] == 1.0
    off = search.unreranked(df, 2).orderBy("rank").collect()
    assert [(r["vector_chunk_id"], r["rerank_score"]) for r in off] == [("a", None), ("b", None)]
    assert models.activated(lambda pairs: [0.0, 800.0, -800.0])([("", "")] * 3) == [0.5, 1.0, 0.0]
    with pytest.raises(Exception, match="score for every candidate"):
        search.scored(df, "q", lambda pairs: []).collect()
    assert models.token_rate(10, 4) == 2.5 and models.token_rate(1, 0) is None


def test_engine_in_all_modes(spark):
    rows = [(f"c{i}", f"d{i % 2}", f"f{i % 2}.pdf", f"T{i % 2}", i, i, i, f"M6 screws {i} on page {i} of the manual") for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, source_file string, title string, page int, page_start int, chunk_index int, content string")
    summaries = spark.createDataFrame([("d1", "S", "about screws", None, None, ["screws", "torque"])], schemas.DOCUMENT_SUMMARY)
    engine = Engine(spark, models.HashEmbedder(16), Settings(max_context_chars=60, document_min_score=0.0))
    engine.ingest(chunks, summaries=summaries)
    table = {r["document_id"]: r for r in engine.documents.collect()}
    assert table["d1"]["vector_source"] == "summary_and_chunk_centroid" and table["d0"]["vector_source"] == "chunk_centroid" and table["d1"]["faiss_id"] == 1
    text, sources = engine.context(engine.find("M6 screws", mode="detail"))
    assert text.startswith("[來源1｜f") and sum(len(b.split("\n", 1)[1]) for b in text.split("\n\n")) <= 60 and 1 <= len(sources) <= 3
    text, _ = engine.context(engine.find("M6 screws", mode="documents"))
    assert text.startswith("[候選文件1]\n檔名：f")
    assert engine.select("f1.pdf") == "d1"
    text, _ = engine.context(engine.find("overview", mode="overview"))
    assert text.startswith("[文件摘要｜f1.pdf]\nabout screws\n\n[文件主題｜f1.pdf]\nscrews、torque\n\n[來源1｜f1.pdf")
    assert {r["document_id"] for r in engine.listing().collect()} == {"d0", "d1"}
    engine.refresh(engine.chunks, engine.documents.where("document_id = 'd0'"))
    assert engine.selected is None
    off = Engine(spark, models.HashEmbedder(16), rerank=None)
    off.ingest(chunks)
    assert off.find("M6 screws", mode="detail").rows.where("rerank_score is not null").count() == 0
    far = Engine(spark, models.HashEmbedder(16), Settings(document_min_score=1.0))
    far.ingest(chunks)
    assert far.find("zzz", mode="overview").status == "insufficient_context" and far.find("zzz", "d0", "overview").status == "ok"
    with pytest.raises(ValueError):
        off.answer("q", models.echo_generator, history=[{"role": "robot", "content": "x"}])
    heard = []
    off.answer("M6 screws", lambda m: heard.append(m) or "[S1-1]", history=[{"role": "user", "content": f"q{i}"} for i in range(20)])
    assert [m["content"] for m in heard[0][1:-1]] == [f"q{i}" for i in range(8, 20)]


def test_prompts_too_long_are_errors(spark):
    engine = Engine(spark, models.HashEmbedder(8), count_tokens=lambda messages: sum(len(m["content"]) for m in messages))
    assert engine.chat("hi", lambda m: "yes") == "yes"
    with pytest.raises(ValueError):
        engine.chat("x" * 9000, lambda m: "yes")


def test_models_are_loaded_once_a_worker(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return models.OverlapReranker()

    df = spark.createDataFrame([(i, f"pump {i}") for i in range(40)], "position int, content string").repartition(20)
    scored = search.scored(df, "pump", models.PerWorker("overlap for a test", load))
    assert scored.where("rerank_score = 1.0").count() == 40 and 1 <= loads.value <= 8


def test_messages_that_are_wrong_are_errors(spark):
    good = spark.createDataFrame([("c", 1, "user", " hi ")], schemas.MESSAGE)
    assert grounding.checked_messages(good).first()["content"] == "hi"
    for role, content in (("robot", "x"), ("user", " "), (None, "x"), ("user", None)):
        with pytest.raises(Exception, match="no such role|blank"):
            grounding.checked_messages(spark.createDataFrame([("c", 1, role, content)], schemas.MESSAGE)).collect()


def test_texts_are_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)
    embed = models.HashEmbedder(8)
    none = spark.createDataFrame([], schemas.EMBEDDING_CACHE)
    texts = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b")], "id int, t string")
    first, stored = cache.embed_texts(texts, "t", none, embed, "m")
    assert stored.count() == 2 and first.count() == 3 and first.columns == ["id", "t", "embedding"]

    def never(batch):
        calls.add(len(batch))
        return embed(batch)

    again, _ = cache.embed_texts(texts, "t", stored, never, "m")
    assert again.count() == 3 and calls.value == 0


def test_catalog_listings(spark):
    docs = spark.createDataFrame([("d1", "a.pdf", " "), ("d2", "b.pdf", "B")], "document_id string, source_file string, title string")
    assert {tuple(r) for r in catalog.listing(docs).collect()} == {("d1", "a.pdf", "a.pdf"), ("d2", "b.pdf", "B")}
    stored = spark.createDataFrame([("d1", "x"), ("d2", ""), (None, "y")], "document_id string, cache_dir string")
    assert [r["document_id"] for r in catalog.with_cache(stored).collect()] == ["d1"]


def test_contents_pages_are_left_out(spark):
    lines = spark.createDataFrame([("d", 1, 1, "A ... 2", None), ("d", 2, 1, "A", ["A"]), ("d", 2, 2, "x", None)], "document_id string, page int, line_no int, line string, path array<string>")
    left = toc.segments(lines, spark.createDataFrame([("d", 1)], "document_id string, page int")).collect()
    assert [(r["body"], r["path"]) for r in left] == [("x", ["A"])]


def test_index_is_replaced_as_a_whole(spark, tmp_path):
    root = (tmp_path / "index").as_uri()
    for version, n in (("v1", 3), ("v2", 5)):
        files.write_index({"chunks": spark.range(n), "documents": spark.range(1)}, root, version)
        now = files.read_index(spark, root, "chunks", "documents")
        assert now["chunks"].count() == n and now["documents"].count() == 1
    assert (tmp_path / "index" / "v1").is_dir() and not (tmp_path / "index" / "CURRENT.v2").exists()


def test_summaries_and_json_values(spark, tmp_path):
    for name, text in (("d1", '{"title": "T", "summary": "s", "topics": ["a"]}'), ("d2", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(text)
    assert [(r["document_id"], r["summary"], r["topics"]) for r in files.summaries(spark, str(tmp_path)).where("summary is not null").collect()] == [("d1", "s", ["a"])]
    (tmp_path / "values.jsonl").write_text('{"a": 1}\n\n[2]\n"x"\n')
    rows = files.json_values(spark, str(tmp_path / "values.jsonl"))
    assert sorted(r["j"] for r in rows.select(F.to_json("value").alias("j")).collect()) == ['"x"', "[2]", '{"a":1}']


def test_pruned_states_and_strict_pages(spark):
    states = spark.createDataFrame([("d1", "c", 1, "done"), ("d1", "c", 9, "done"), ("d1", "old", 1, "done"), ("d2", "c", 1, "done")], "document_id string, ocr_config_hash string, page int, status string")
    known = spark.createDataFrame([("d1", "c", 2)], "document_id string, ocr_config_hash string, page_count int")
    assert [tuple(r) for r in W.pruned_states(states, known).collect()] == [("d1", "c", 1, "done")]
    there = spark.createDataFrame([("d1", 1, "x"), ("d1", 2, None)], "document_id string, page int, text string")
    assert pages.catalogued_pages(known, there, strict=True).count() == 2
    with pytest.raises(Exception, match="page 2 of d1 is missing"):
        pages.catalogued_pages(known, there.where("page = 1"), strict=True).collect()
