"""Index records and document vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import vectors as V
from lexmill.operators.catalog import last_by
from lexmill.operators.chunkers import windowed
from lexmill.sources.shared import kept, sized

#: The order of the index.
INDEX_ORDER = ("document_id", "page", "chunk_index", "sub_chunk_index", "vector_chunk_id")


def index_records(chunks: DataFrame, most: int, overlap: int, tokens: Column | None = None, offsets: Column | None = None) -> DataFrame:
    """Index rows of ``chunks`` (chunk_id, document_id, source_file, title, page, page_start, chunk_index, content).

    Contents longer than ``most`` tokens are cut to windows; rows without
    content are left out, rows without ids are an error; of rows with the same
    vector_chunk_id the last (by content) stays. ``tokens`` gives a row's
    tokens, words by default; ``offsets`` a tokenizer's places instead (structs of
    begin and end in the stripped content), by which windows keep the text as it is.
    """
    sound = F.coalesce(X.strip(F.coalesce("chunk_id", F.lit(""))) != "", F.lit(False)) & F.coalesce(X.strip(F.coalesce("document_id", F.lit(""))) != "", F.lit(False))
    checked = chunks.withColumn("content", F.when(sound, X.strip(F.coalesce("content", F.lit("")))).otherwise(F.raise_error(F.lit("a chunk has no id")).cast("string")))
    words = X.words(F.col("content")) if tokens is None else tokens
    rows = windowed(checked.where("content <> ''"), words if offsets is None else offsets, most, overlap, None if offsets is None else F.col("content"))
    content = F.when(F.col("sub_chunk_count") == 1, F.col("content")).otherwise(F.col("sub_content"))
    page = F.coalesce(F.nullif("page", F.lit(0)), "page_start", F.lit(0))
    rows = rows.withColumn("content", content).withColumn("page", page).withColumn("page_start", F.coalesce("page_start", page))
    rows = rows.withColumn("vector_chunk_id", F.concat("chunk_id", F.format_string("-s%03d", "sub_chunk_index"))).withColumnRenamed("chunk_id", "parent_chunk_id").drop("sub_content")
    passage = X.passage_text(F.col("source_file"), F.col("title"), F.col("page"), F.col("content"))
    rows = rows.withColumn("content_sha256", F.sha2("content", 256)).withColumn("embedding_text_sha256", F.sha2(passage, 256))
    return last_by(rows, ["vector_chunk_id"], [F.col("content"), F.col("page")])


def ingest_counts(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """One row: source, skipped, indexed and split chunks."""
    blank = F.coalesce(X.strip(F.col("content")), F.lit("")) == ""
    of_source = chunks.agg(F.count("*").alias("source_chunks"), F.count_if(blank).alias("skipped_chunks"))
    of_index = records.agg(F.count("*").alias("indexed_chunks"), F.countDistinct(F.when(F.col("sub_chunk_count") > 1, F.col("parent_chunk_id"))).alias("split_chunks"))
    return of_source.crossJoin(of_index)  # one row each


def centroids(chunks: DataFrame) -> DataFrame:
    """document_id, embedding: mean of a document's vectors by the root of their contents' length (1 to 2000), of length one.

    Vectors are summed position by position with partial sums before the
    shuffle, so a document of any size is no single task's load.
    """
    weight = F.sqrt(F.greatest(F.lit(1), F.least(F.char_length(F.coalesce("content", F.lit(""))), F.lit(2000))).cast("double"))
    parts = chunks.select("document_id", weight.alias("w"), F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    sums = parts.groupBy("document_id", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    whole = sums.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return whole.select("document_id", V.unit_or_null(F.col("v.x")).alias("embedding")).where("embedding is not null")


def with_summaries(centroid: DataFrame, summaries: DataFrame, share: float) -> DataFrame:
    """``centroid`` blended with the documents' summary vectors where there are some, and vector_source."""
    joined = centroid.join(summaries.select("document_id", F.col("embedding").alias("__s")), "document_id", "left")
    both = F.when(F.col("__s").isNull(), F.col("embedding")).otherwise(V.blend(F.col("__s"), F.col("embedding"), share))
    source = F.when(F.col("__s").isNull(), "chunk_centroid").otherwise("summary_and_chunk_centroid")
    return joined.withColumn("vector_source", source).withColumn("embedding", both).drop("__s")


def representatives(chunks: DataFrame, centroid: DataFrame, count: int) -> DataFrame:
    """document_id, rank, vector_chunk_id, score of each document's representative chunks.

    The first two in reading order, then the most similar to the centroid with
    at most two of a page (the first two among them), then the most similar
    whatever their page.
    """
    score = F.round(V.dot(F.col("embedding"), F.col("__c")), 6)
    joined = chunks.join(centroid.select("document_id", F.col("embedding").alias("__c")), "document_id")
    scored = joined.select("document_id", "page", "chunk_index", "sub_chunk_index", "vector_chunk_id", score.alias("score")).persist()
    document, of_page = Window.partitionBy("document_id"), Window.partitionBy("document_id", "page")
    # both ranks below are limits, so tasks leave out what can't matter before rows are shuffled
    read = F.row_number().over(document.orderBy("page", "chunk_index", "sub_chunk_index", "vector_chunk_id"))
    first = scored.withColumn("read", read).where("read <= 2")
    near = F.row_number().over(of_page.orderBy(F.desc("score"), "vector_chunk_id"))
    best = scored.withColumn("near", near).where(F.col("near") <= count + 2).drop("near")
    rest = best.join(first.select("document_id", "vector_chunk_id"), ["document_id", "vector_chunk_id"], "left_anti").select(scored.columns).withColumn("read", F.lit(None).cast("int"))
    rows = first.select(*scored.columns, "read").unionByName(rest)
    taken = F.count("read").over(of_page)
    place = F.row_number().over(of_page.orderBy(F.col("read").isNotNull(), F.desc("score"), "vector_chunk_id"))
    tier = F.when(F.col("read").isNotNull(), 0).when(F.col("place") <= 2 - F.col("taken"), 1).otherwise(2)
    rows = rows.withColumn("taken", taken).withColumn("place", place).withColumn("tier", tier)
    order = document.orderBy("tier", "read", F.desc("score"), "vector_chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("document_id", "rank", "vector_chunk_id", "score")


def document_facts(chunks: DataFrame) -> DataFrame:
    """document_id, source_file, title, pages (ascending), page_count, chunk_count, characters."""
    of = chunks.groupBy("document_id").agg(
        F.min("source_file").alias("source_file"), F.min("title").alias("title"), F.sort_array(F.collect_set("page")).alias("pages"),
        F.max("page").alias("page_count"), F.count("*").alias("chunk_count"), F.sum(F.char_length("content")).alias("characters"),
    )
    return of.withColumn("title", F.coalesce("title", X.stem(F.col("source_file"))))


def numbered(records: DataFrame, order: tuple[str, ...] = INDEX_ORDER) -> DataFrame:
    """``records`` with faiss_id: places from 0 in the index order.

    Sorted by range and kept, then numbered within partitions from the counts of
    the partitions before (a row each), so that no single task sees all rows and
    a partition that is read again has the same numbers.
    """
    ordered = kept(records.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return ordered.join(sized(starts), "__p").withColumn("faiss_id", F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__start")


def document_table(chunks: DataFrame, count: int, summaries: DataFrame | None = None, share: float = 0.65) -> DataFrame:
    """The documents' table: facts, vector, its source, summary, topics, representative chunks, and faiss_id in order of document_id.

    ``summaries`` has document_id, embedding, summary, topics for documents that
    have a summary; their vectors are blended in by ``share``.
    """
    middle = centroids(chunks)
    none = middle.where("false").select("document_id", "embedding", F.lit("").alias("summary"), F.array().cast("array<string>").alias("topics"))
    own = none if summaries is None else summaries.select("document_id", "embedding", "summary", "topics")
    vectors = with_summaries(middle, own, share)
    shown = representatives(chunks, middle, count).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vector_chunk_id")))["vector_chunk_id"].alias("representative_chunk_ids"))
    facts = document_facts(chunks).select("document_id", "source_file", "title", "page_count", F.col("pages").alias("indexed_page_numbers"), F.col("chunk_count").alias("indexed_chunk_count"))
    rows = facts.join(vectors, "document_id").join(own.select("document_id", "summary", "topics"), "document_id", "left").join(shown, "document_id", "left")
    return numbered(rows.withColumn("summary_available", F.col("summary").isNotNull()), ("document_id",))


def manifest(chunks: DataFrame, fingerprint: str) -> DataFrame:
    """One row of counts and hashes of an index."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("content_sha256").alias("distinct_contents"),
        F.sum("token_count").cast("bigint").alias("tokens"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
        F.count_if(F.col("sub_chunk_count") > 1).alias("sub_chunks"), F.sha2(F.lit(fingerprint), 256).alias("model_sha256"),
    )
