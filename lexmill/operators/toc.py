"""Tables of contents: their entries and levels, and documents cut by them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.sources.shared import sized

_LABELS = ("目錄", "目录", "故障查修")


def toc_entries(layout: DataFrame) -> DataFrame:
    """document_id, page, column, x0, y0, title, target_page of layout lines on pages that show a table of contents.

    A page shows one if it is labelled so and has three entries. A short line
    without page number just before an entry in its column, about as far
    indented, is the first half of its title.
    """
    shown = layout.groupBy("document_id", "page").agg(F.max(F.rlike("text", F.lit("目錄|目录")).cast("int")).alias("labelled")).where("labelled = 1")
    rows = layout.join(shown.select("document_id", "page"), ["document_id", "page"], "left_semi").withColumn("text", X.strip(F.col("text")))
    rows = rows.where(~X.title_key(F.col("text")).isin(*_LABELS) & ~F.rlike("text", F.lit(r"^\d{1,3}$"))).withColumn("column", (F.col("x0") >= F.col("page_width") / 2).cast("int"))
    rows = rows.withColumn("entry", X.toc_entry(F.col("text"))).where(F.col("entry").isNotNull() | (F.char_length("text") <= 40))
    order = Window.partitionBy("document_id", "page", "column").orderBy("y0", "x0")
    before = lambda c: F.lag(c).over(order)
    wrapped = before(F.col("entry.title")).isNull() & before("text").isNotNull() & (F.abs(before("x0") - F.col("x0")) <= 4.0)
    titled = rows.withColumn("title", F.when(wrapped, F.concat(before("text"), F.col("entry.title"))).otherwise(F.col("entry.title"))).where("entry is not null")
    enough = titled.withColumn("__n", F.count("*").over(Window.partitionBy("document_id", "page"))).where("__n >= 3")
    return enough.select("document_id", "page", "column", "x0", "y0", X.strip(F.col("title")).alias("title"), F.col("entry.page").alias("target_page"))


def toc_levels(entries: DataFrame) -> DataFrame:
    """``entries`` in reading order (place) with level and path, by how far they are indented in their column.

    Indentations within 4 of the first of a cluster are one; three clusters on
    the left mean that the first is the document's root, of level 0. A page of
    a table of contents is small, so a page is one task's.
    """

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["column", "y0", "x0"], kind="stable").reset_index(drop=True)
        clusters: dict[int, list[float]] = {}
        for column, of in pdf.groupby("column"):
            anchors: list[float] = []
            for x in sorted({round(float(v), 1) for v in of["x0"]}):
                if not anchors or x - anchors[-1] > 4.0:
                    anchors.append(x)
            clusters[column] = anchors
        rooted = len(clusters.get(0, [])) >= 3
        levels, paths, open_ = [], [], {}
        for column, x, title in zip(pdf["column"], pdf["x0"], pdf["title"]):
            nearest = min(range(len(clusters[column])), key=lambda i: abs(clusters[column][i] - x))
            level = nearest + 1 - (rooted and column == 0)
            open_ = {k: v for k, v in open_.items() if k < level} | {level: title}
            levels.append(level)
            paths.append([title] if level == 0 else [v for k, v in sorted(open_.items()) if k >= 1])
        return pdf.assign(place=range(1, len(pdf) + 1), level=levels, path=paths)[["document_id", "page", "place", "title", "target_page", "level", "path"]]

    schema = "document_id string, page int, place int, title string, target_page int, level int, path array<string>"
    levelled = entries.groupBy("document_id", "page").applyInPandas(page, schema)
    once = Window.partitionBy("document_id", X.title_key(F.col("title"))).orderBy("page", "place")
    return levelled.where(X.title_key(F.col("title")) != "").withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")


def toc_from_text(pages: DataFrame) -> DataFrame:
    """document_id, page, place, title, target_page, level 1 and path, from pages whose first twelve lines are labelled as a table of contents."""
    rows = pages.select("document_id", "page", X.filled_lines(F.col("text")).alias("l"))
    rows = rows.where(F.exists(F.slice("l", 1, 12), lambda x: X.title_key(x).isin("目錄", "目录"))).select("document_id", "page", F.posexplode("l").alias("n", "line"))
    rows = rows.where(~X.title_key(F.col("line")).isin(*_LABELS)).withColumn("entry", X.toc_entry(F.col("line"))).where(F.col("entry").isNotNull() | (F.char_length("line") <= 40))
    back = Window.partitionBy("document_id", "page").orderBy(F.desc("n"))
    group = F.sum(F.col("entry").isNotNull().cast("int")).over(back)  # an entry and the lines that lead to it
    whole = rows.withColumn("g", group).where("g > 0").groupBy("document_id", "page", "g").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("n", F.coalesce("entry.title", "line").alias("t"))))["t"], "").alias("title"), F.max("entry.page").alias("target_page"), F.max("n").alias("place")
    )
    return whole.select("document_id", "page", (F.col("place") + 1).alias("place"), "title", "target_page", F.lit(1).alias("level"), F.array("title").alias("path"))


#: Longest key of a line that may be a misread title; titles up to which all of a document's are held against each of its lines.
_SHORT, _FEW = 42, 64


def _letters(line: int, least: float) -> tuple[int, int]:
    """Parts a key of so many letters is cut into, and letters of each part that are looked for.

    Keys with a ratio of ``least`` leave at most 1 - least of their letters over,
    and a letter left over spoils one part: of one part more, one stands whole in
    the other key.
    """
    longest = int(line * (2 - least) / least + 1e-9)
    parts = int((1 - least) * (line + longest) + 1e-9) + 1
    return parts, line // parts


def _pieces_of_lines(key: Column, least: float) -> Column:
    """Parts of a short line's key, of which a similar title's key holds one or more."""
    cuts = [[0]] + [[j * n // k + 1 for j in range(k)] for n in range(1, _SHORT + 1) for k, _ in [_letters(n, least)]]
    sizes = [0] + [_letters(n, least)[1] for n in range(1, _SHORT + 1)]
    size = F.element_at(F.lit(sizes), F.char_length(key) + 1)
    return F.array_distinct(F.transform(F.element_at(F.lit(cuts), F.char_length(key) + 1), lambda at: F.substring(key, at, size)))


def _pieces_of_titles(key: Column, least: float) -> Column:
    """All runs of a title's key as long as the parts of lines that can be similar to it."""
    widest = (2 - least) / least + 1e-9
    sizes = [sorted({_letters(n, least)[1] for n in range(1, _SHORT + 1) if n <= m * widest and m <= n * widest}) or [-1] for m in range(int(_SHORT * widest) + 1)]
    runs = F.transform(F.element_at(F.lit(sizes), F.char_length(key) + 1), lambda q: F.when(q >= 0, F.transform(F.sequence(F.lit(1), F.char_length(key) - q + 1), lambda at: F.substring(key, at, q))).otherwise(F.array().cast("array<string>")))
    return F.when(F.char_length(key) < len(sizes), F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def _nearly(keyed: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """document_id, line_key, path of short lines that are nearly one of their document's titles."""
    # distinct short lines that aren't titles themselves, held against the titles of their document
    short = keyed.where(f"__key <> '' and length(__key) <= {_SHORT}").select("document_id", F.col("__key").alias("line_key")).distinct()
    rest = short.join(known.select("document_id", F.col("key").alias("line_key")), ["document_id", "line_key"], "left_anti")
    gap = F.abs(F.char_length("key") - F.char_length("line_key")) <= F.greatest(F.lit(3), F.floor(F.char_length("key") * 0.25))

    def similar(x: str, y: str) -> float:
        shared = sum(c in y for c in x)  # no more than these can match
        return SequenceMatcher(None, x, y).ratio() if 2 * shared >= least * (len(x) + len(y)) else 0.0

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b)])

    # letters left over by both are at least their edit distance, which the JVM finds in a band
    longest = _SHORT + max(3, _SHORT // 3)
    left_over = (1 - least) * (F.char_length("key") + F.char_length("line_key"))
    edits = F.levenshtein("key", "line_key", int((1 - least) * (_SHORT + longest)) + 1)
    many = sized(known.groupBy("document_id").count().where(f"count > {_FEW}").select("document_id", F.lit(True).alias("__many")))
    by_piece = lambda df, pieces: df.join(many, "document_id", "left").withColumn("piece", F.explode_outer(F.when(F.col("__many"), pieces).otherwise(F.array(F.lit("")))))
    held = by_piece(rest, _pieces_of_lines(F.col("line_key"), least)).join(by_piece(known, _pieces_of_titles(F.col("key"), least)).drop("__many"), ["document_id", "piece"])
    near = held.where(gap & (edits >= 0) & (edits <= left_over + 1e-9)).withColumn("r", ratio("line_key", "key")).where(F.col("r") >= least)
    return near.groupBy("document_id", "line_key").agg(F.min_by("path", F.struct(-F.col("r"), F.col("place"), F.col("key"))).alias("path"))


def titled_lines(lines: DataFrame, titles: DataFrame, least: float = 0.92, nearly: bool = True) -> DataFrame:
    """``lines`` (document_id, page, line and more) with path where the line is a title of its document.

    A line whose key is a title's has its path; of the other short lines the
    most similar title of about the same length counts, if it is similar
    enough, of equally similar ones the first (by ``place``, if titles have it).
    Titles have document_id, title, path. Keys meet their document's
    titles by key and, in documents of many titles, by the parts of which similar
    keys must share one, so no pair is lost. A page gets only the titles found on
    it, so the lines are moved once, by page. Without ``nearly`` only equal keys count.
    """
    place = ["document_id", "page"]
    keyed = lines.withColumn("__key", X.title_key(F.col("line"))).persist()  # read by three branches
    # keys of longer texts are only compared for equality
    named = lambda key: F.when(F.char_length(key) > 64, F.sha2(key, 256)).otherwise(F.col(key))
    order = F.col("place") if "place" in titles.columns else F.lit(0)
    known = titles.select("document_id", X.title_key(F.col("title")).alias("key"), "path", order.alias("place")).where("key <> ''")
    known = known.groupBy("document_id", "key").agg(F.min(F.struct("place", "path")).alias("x")).select("document_id", "key", "x.path", "x.place")
    matched = known.select("document_id", named("key").alias("__named"), "path")
    if nearly:
        near = _nearly(keyed, known, least)
        matched = matched.unionByName(near.select("document_id", F.col("line_key").alias("__named"), "path"))
    met = keyed.where("__key <> ''").select(*place, named("__key").alias("__named")).join(matched, ["document_id", "__named"])
    of_page = met.groupBy(*place).agg(F.map_from_entries(F.collect_set(F.struct("__named", "path"))).alias("__titles"))
    found = keyed.join(of_page, place, "left").withColumn("path", F.try_element_at("__titles", named("__key")))
    return found.select(*lines.columns, "path")


def segments(lines: DataFrame, toc_pages: DataFrame | None = None) -> DataFrame:
    """document_id, segment, path, page_start, page_end, body of lines (document_id, page, line_no, line, path) cut at titles.

    Pages of a table of contents (``toc_pages``: document_id, page) are left out.
    """
    if toc_pages is not None:
        lines = lines.join(toc_pages.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")
    inside = Window.partitionBy("document_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    titles = F.col("path").isNotNull().cast("int")
    # what pages hand on is counted page by page, so a document's lines needn't meet in one task
    pages = lines.groupBy("document_id", "page").agg(F.sum(titles).alias("n"), F.max_by("path", F.when(F.col("path").isNotNull(), F.col("line_no"))).alias("last"))
    carried = pages.select("document_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"), F.last("last", ignorenulls=True).over(before).alias("open"))
    rows = lines.withColumn("n", F.sum(titles).over(inside)).withColumn("own", F.last("path", ignorenulls=True).over(inside)).where("path is null").join(carried, ["document_id", "page"])
    body = F.array_join(F.array_sort(F.collect_list(F.struct("page", "line_no", "line")))["line"], "\n")
    of = rows.withColumn("segment", F.col("from") + F.col("n")).withColumn("open", F.coalesce("own", "open")).groupBy("document_id", "segment")
    return of.agg(F.first("open").alias("path"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), body.alias("body"))


def sound_headings(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Detected headings (document_id, page, start_line, level) that are lines of their page: title is the line itself.

    The first of a line counts; levels are 1 to 3; numbers, numbered items, ok/ng
    answers and tables are no headings.
    """
    lines = pages.select("document_id", "page", F.posexplode_outer(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1)).alias("n", "line"))
    named = found.join(lines.select("document_id", "page", (F.col("n") + 1).alias("start_line"), X.strip(F.col("line")).alias("title")), ["document_id", "page", "start_line"])
    no = F.rlike("title", F.lit(r"^\d+$|^\s*\d+[.)、]\s+")) | F.lower("title").isin("ok", "ng", "ok或ng", "是或否", "是", "否") | F.startswith("title", F.lit("<table")) | (F.col("title") == "")
    first = Window.partitionBy("document_id", "page", "start_line").orderBy("level")
    kept = named.where(~no).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("level", F.greatest(F.lit(1), F.least(F.col("level"), F.lit(3))))


def section_segments(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """document_id, page, place, section_path, body: pages cut at headings, the path carried on from page to page.

    A heading cuts the path to its level; a level that was skipped isn't
    invented, so the depth of the i-th heading of a document is the least of i
    and of level + (i - j) over all headings j up to it. The path at a place is
    the last title of each depth up to the present one. Headings alone (and a
    mark for each page) are ordered by document; lines meet within their page.
    """
    page = ["document_id", "page"]
    marks = pages.select(*page, F.lit(0).alias("start_line"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"))
    so_far = Window.partitionBy("document_id").orderBy("page", "start_line").rowsBetween(Window.unboundedPreceding, 0)
    rows = headings.select(*page, "start_line", "level", "title").unionByName(marks).withColumn("i", F.count("level").over(so_far))
    rows = rows.withColumn("depth", F.col("i") + F.least(F.lit(0), F.coalesce(F.min(F.col("level") - F.col("i")).over(so_far), F.lit(0))))
    last = [F.last(F.when(F.col("level").isNotNull() & (F.col("depth") == k), F.col("title")), ignorenulls=True).over(so_far) for k in (1, 2, 3)]
    paths = rows.withColumn("path", F.slice(F.array(*last), F.lit(1), F.col("depth").cast("int")))
    of_page = paths.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("start_line", "path"))).alias("heads"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    lines = pages.join(of_page, page).select(*page, "heads", F.posexplode_outer(F.split(text, "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)
    under = lines.withColumn("head", F.element_at(F.filter("heads", lambda h: h["start_line"] <= F.col("n")), -1)).where("head.start_line <> n")
    bodies = under.groupBy(*page, F.col("head.start_line").alias("start"), F.col("head.path").alias("section_path")).agg(
        X.strip(F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n")).alias("body")
    )
    place = F.row_number().over(Window.partitionBy(*page).orderBy("start"))
    return bodies.where("body <> ''").select(*page, place.alias("place"), "section_path", "body")
