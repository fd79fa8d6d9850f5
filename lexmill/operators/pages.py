"""Pages: reading order, recurring lines, noise lines, whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their place (from 1) on the page: header, left column, right column, footer.

    A page is read by columns only if both have blocks, else from top to bottom.
    """
    middle, gutter = F.col("page_width") / 2, F.greatest(F.lit(12.0), F.col("page_width") * 0.035)
    spans = (F.col("x0") < middle - gutter) & (F.col("x1") > middle + gutter)
    part = (
        F.when((F.col("y1") <= F.col("page_height") * 0.10) | spans, 0)
        .when(F.col("y0") >= F.col("page_height") * 0.92, 3)
        .when((F.col("x0") + F.col("x1")) / 2 < middle, 1)
        .otherwise(2)
    )
    page = Window.partitionBy("document_id", "page")
    marked = blocks.withColumn("part", part)
    both = F.max(F.when(F.col("part") == 1, 1)).over(page).isNotNull() & F.max(F.when(F.col("part") == 2, 1)).over(page).isNotNull()
    placed = marked.withColumn("part", F.when(both, F.col("part")).otherwise(0))
    return placed.withColumn("place", F.row_number().over(page.orderBy("part", "y0", "x0", "text"))).drop("part")


def page_text(blocks: DataFrame) -> DataFrame:
    """document_id, page, text of pages in reading order."""
    ordered = reading_order(blocks).groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("b"))
    return ordered.select("document_id", "page", F.array_join("b.text", "\n\n").alias("text"))


def native_usable(text: Column) -> Column:
    """Whether a page's text layer is good enough to do without recognition."""
    own = X.strip(F.coalesce(text, F.lit("")))
    words = F.regexp_count(own, F.lit(r"(?U)\S+"))
    letters = F.regexp_count(own, F.lit("[A-Za-z0-9㐀-鿿]"))
    lost = F.char_length(own) - F.char_length(F.replace(own, F.lit("�"), F.lit("")))
    return (words >= 8) & (F.char_length(own) >= 45) & (letters >= 30) & (lost / F.greatest(F.char_length(own), F.lit(1)) <= 0.01)


def numbered_lines(df: DataFrame, text: str) -> DataFrame:
    """``df`` with line_no (from 1) and line for every line that isn't blank."""
    rows = df.select("*", F.posexplode_outer(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)).alias("__n", "line"))
    return rows.where(X.strip(F.col("line")) != "").withColumn("line_no", F.col("__n") + 1).drop("__n")


def edge_lines(pages: DataFrame, least_pages: int = 3, longest: int = 32, edge: int = 4) -> DataFrame:
    """document_id, key, pages: short lines among the first or last of many pages."""
    filled = X.filled_lines(F.col("text"))
    rows = pages.select("document_id", "page", filled.alias("l")).where(F.size("l") > 0)
    ends = F.array_union(F.slice("l", 1, edge), F.reverse(F.slice(F.reverse("l"), 1, edge)))
    short = F.filter(ends, lambda x: (F.char_length(x) <= longest) & ~F.startswith(F.lower(x), F.lit("<table")))
    keys = rows.select("document_id", "page", F.explode_outer(F.array_distinct(F.transform(short, X.title_key))).alias("key")).where("key <> ''")
    return keys.groupBy("document_id", "key").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)


def recurring_lines(pages: DataFrame, share: float = 0.5, longest: int = 80) -> DataFrame:
    """document_id, line, pages: lines on at least the given share of a document's pages (of two or more)."""
    counts = pages.groupBy("document_id").agg(F.countDistinct("page").alias("n"))
    rows = pages.select("document_id", "page", F.explode_outer(F.array_distinct(F.transform(X.lines(F.col("text")), X.one_space))).alias("line"))
    rows = rows.where((F.col("line") != "") & (F.char_length("line") <= longest) & ~F.rlike("line", F.lit(r"(?U)^\d+$")))
    often = rows.groupBy("document_id", "line").agg(F.countDistinct("page").alias("pages")).join(counts, "document_id")
    wanted = F.greatest(F.lit(2), F.floor(F.col("n") * share + 0.999))
    return often.where((F.col("n") >= 2) & (F.col("pages") >= wanted)).select("document_id", "line", "pages")


def without_noise(pages: DataFrame, recurring: DataFrame) -> DataFrame:
    """document_id, page, text without recurring keys and lines that are only page numbers.

    ``recurring`` has document_id and key; a document's keys are few.
    """
    keys = recurring.groupBy("document_id").agg(F.collect_set("key").alias("__keys"))
    joined = pages.join(keys, "document_id", "left")
    shown = F.transform(X.lines(F.col("text")), lambda x: F.when(X.strip(x) == "", "").otherwise(x))
    known = F.coalesce(F.col("__keys"), F.array().cast("array<string>"))
    number = lambda x: F.rlike(X.strip(x), F.lit(r"^\d{1,3}(-\d{1,3})?$"))
    kept = F.filter(shown, lambda x: (x == "") | ~(F.array_contains(known, X.title_key(x)) | number(x)))
    return joined.withColumn("text", X.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))).drop("__keys")


def catalogued_pages(catalog: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """document_id, page, text of every catalogued page that exists; ``strict``: a page that doesn't is an error."""
    wanted = catalog.where("page_count >= 1").select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    if not strict:
        return wanted.join(pages, ["document_id", "page"])
    joined = wanted.join(pages.withColumn("__there", F.lit(True)), ["document_id", "page"], "left")
    missing = F.raise_error(F.format_string("page %d of %s is missing", "page", "document_id")).cast("string")
    return joined.withColumn("text", F.when(F.col("__there"), F.col("text")).otherwise(missing)).drop("__there")


def whole_documents(pages: DataFrame) -> DataFrame:
    """document_id, markdown, plain: a document's pages in order, each under its number."""
    number = F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 頁"))
    parts = pages.select(
        "document_id", "page", F.concat(F.lit("## "), number, F.lit("\n\n"), X.page_image_links(F.col("text"), F.col("page")), F.lit("\n")).alias("m"),
        F.concat(F.lit("\n===== "), number, F.lit(" =====\n\n"), X.plain_text(F.col("text")), F.lit("\n")).alias("p"),
    )
    whole = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "m", "p"))).alias("x"))
    return whole.select("document_id", F.array_join("x.m", "\n").alias("markdown"), F.array_join("x.p", "\n").alias("plain"))
