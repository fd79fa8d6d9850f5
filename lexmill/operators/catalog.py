"""Catalog, page states and the global roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.sources.shared import kept, sized


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    place = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    place = Window.partitionBy(*keys).orderBy(*(c.asc_nulls_last() for c in order))
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def complete_documents(catalog: DataFrame) -> DataFrame:
    """Complete documents, each once, by the first of its paths (ignoring case)."""
    return first_by(catalog.where("status = 'complete' and document_id is not null"), ["document_id"], [F.lower("source_path"), F.col("source_path")])


def rollup(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of complete documents."""
    return chunks.join(complete_documents(catalog).select("document_id"), "document_id", "left_semi")


def current_pages(status: DataFrame) -> DataFrame:
    """The latest state of every page, by its own time and not by arrival."""
    return last_by(status, ["document_id", "ocr_config_hash", "page"], [F.col("updated_at"), F.col("status")])


def resume_plan(catalog: DataFrame, status: DataFrame) -> DataFrame:
    """document_id, ocr_config_hash, page, reason of pages still to do: never seen, or not done."""
    known = catalog.where("page_count >= 1").groupBy("document_id", "ocr_config_hash").agg(F.max("page_count").alias("pages"))
    wanted = known.select("document_id", "ocr_config_hash", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    state = current_pages(status).select("document_id", "ocr_config_hash", "page", "status")
    joined = wanted.join(state, ["document_id", "ocr_config_hash", "page"], "left")
    return joined.where("status is null or status <> 'done'").select("document_id", "ocr_config_hash", "page", F.coalesce("status", F.lit("missing")).alias("reason"))


def document_states(status: DataFrame) -> DataFrame:
    """pages, done, attempts and the state of each document and configuration."""
    pages = current_pages(status).groupBy("document_id", "ocr_config_hash")
    of = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "done").alias("done"), F.sum("attempts").cast("bigint").alias("attempts"), F.bool_and(F.col("status") == "done").alias("all_done"))
    state = F.when(F.col("all_done"), "complete").when(F.col("done") > 0, "partial").otherwise("pending")
    return of.withColumn("state", state).drop("all_done")


def resolve(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, document_id, outcome of each request.

    A request names a document by exact id, by the beginning of one id, by
    exact file name, or by a part of one file name; the first way that fits
    decides, and one that fits several documents is ambiguous.

    The first three are joins by equality, beginnings of ids at the lengths that
    are asked for; only what they leave is looked for within the file names.
    """
    known = documents.select("document_id", "source_file").where("document_id is not null").distinct()
    asked = requests.select("request_id", "wanted")
    lengths = sorted(r[0] for r in asked.where("wanted <> ''").select(F.char_length("wanted").alias("n")).distinct().collect())  # ids are short, so are these
    starts = known.select("document_id", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n"))
    starts = starts.where(F.char_length("document_id") >= F.col("n")).select(F.substring("document_id", F.lit(1), F.col("n")).alias("wanted"), "document_id").distinct()
    by_id = asked.join(starts, "wanted").withColumn("way", F.when(F.col("document_id") == F.col("wanted"), 1).otherwise(2))
    name = F.lower("source_file")
    by_name = asked.join(known, F.lower("wanted") == name).withColumn("way", F.lit(3))
    columns = ("request_id", "document_id", "way")
    sure = kept(by_id.select(*columns).unionByName(by_name.select(*columns)))
    left = sized(asked.join(sure.select("request_id"), "request_id", "left_anti"))
    by_part = known.join(left, F.contains(name, F.lower("wanted"))).withColumn("way", F.lit(4)).select(*columns)
    held = sure.unionByName(by_part)
    first = held.groupBy("request_id", "way").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("document_id"))
    best = first.groupBy("request_id").agg(F.min_by(F.struct("n", "document_id"), "way").alias("b")).select("request_id", "b.n", "b.document_id")
    out = requests.join(best, "request_id", "left")
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("request_id", F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"), outcome.alias("outcome"))


def listing(documents: DataFrame) -> DataFrame:
    """document_id, source_file, name (title, or file name) of documents, by name."""
    title = F.nullif(X.strip(F.coalesce("title", F.lit(""))), F.lit(""))
    return documents.select("document_id", "source_file", F.coalesce(title, "source_file").alias("name"))


def with_cache(catalog: DataFrame) -> DataFrame:
    """Catalogued documents whose pages are stored somewhere."""
    filled = lambda c: X.strip(F.coalesce(c, F.lit(""))) != ""
    return catalog.where(filled("cache_dir") & filled("document_id"))


def finished_pages(status: DataFrame, results: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages whose latest state is done and of which both files are there (document_id, ocr_config_hash, page)."""
    keys = ["document_id", "ocr_config_hash", "page"]
    done = current_pages(status).where("status = 'done'").select(*keys)
    return done.join(results.select(*keys), keys, "left_semi").join(texts.select(*keys), keys, "left_semi")


def kept_jobs(jobs: DataFrame, most: int = 10) -> DataFrame:
    """The newest ``most`` jobs (job_id, status, started_at), and whether a job is the newest that still runs."""
    newest = jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(most)
    running = ~F.col("status").isin("completed", "failed")
    latest = F.max(F.when(running, F.struct("started_at", "job_id"))).over(Window.partitionBy())  # ``most`` rows
    return newest.withColumn("active", F.coalesce(running & (F.struct("started_at", "job_id") == latest), F.lit(False)))
