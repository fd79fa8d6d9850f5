"""The pN_ queries over the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import boilerplate, encode, forms, leakage, neardup, neighbours, pieces, readability, scans
from lexmill.sources.tables import table


def _speller(chunks: DataFrame, agreed: DataFrame) -> forms.Speller:
    return forms.learn_speller(chunks.select("content", "heading").unionByName(agreed.select(F.lit(None).cast("string").alias("content"), "heading")))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's content and heading in one form."""
    chunks, agreed = table(spark, sf_dir, "chunk_metadata"), table(spark, sf_dir, "heading_ref")
    speller = _speller(chunks, agreed)
    rows = chunks.select("vector_chunk_id", "content", "heading")
    return forms.with_one_form(forms.with_one_form(rows, "content", "content", speller), "heading", "heading", speller).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and headings that look the same but are stored with different characters."""
    chunks, agreed = table(spark, sf_dir, "chunk_metadata"), table(spark, sf_dir, "heading_ref")
    speller = _speller(chunks, agreed)
    contents = forms.form_keys(chunks, "vector_chunk_id", "content", speller).persist()
    headings = forms.form_keys(chunks, "vector_chunk_id", "heading", speller)
    pairs = forms.equal_looking(contents)
    named = forms.matching_headings(headings, forms.form_keys(agreed, "heading_id", "heading", speller))
    return pairs.select(F.lit("content").alias("field_name"), "left_key", "right_key").unionByName(named.select(F.lit("heading").alias("field_name"), "left_key", "right_key"))


#: Limits and wanted overlaps, in characters.
CHUNK_PIECE, BLOCK_PIECE = (1200, 180), (520, 40)


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunk_metadata")
    blocks = pieces.procedure_text(table(spark, sf_dir, "procedure_block").select("block_id", "heading", "text"))
    return pieces.split_oversized(chunks, "vector_chunk_id", "content", *CHUNK_PIECE), pieces.split_oversized(blocks, "block_id", "item_text", *BLOCK_PIECE)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items longer than a piece may be, and whether all their cuts could be natural."""
    of_chunks, of_blocks = (pieces.cuts_found(x) for x in _pieces(spark, sf_dir))
    both = of_chunks.withColumn("item_table", F.lit("chunk_metadata")).unionByName(of_blocks.withColumn("item_table", F.lit("procedure_block")))
    return both.select("item_table", "item_id", "cut")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves."""
    of_chunks, of_blocks = _pieces(spark, sf_dir)
    return of_chunks.withColumn("item_table", F.lit("chunk_metadata")).unionByName(of_blocks.withColumn("item_table", F.lit("procedure_block")))


def _noise(spark: SparkSession, sf_dir: str) -> scans.ScanNoise:
    return scans.ScanNoise(table(spark, sf_dir, "chunk_metadata"), "vector_chunk_id", "source_file", "title", "page", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned pages with a broken or misread word, or with nothing but page furniture."""
    return _noise(spark, sf_dir).found().select(F.col("item_id").alias("vector_chunk_id"), "line_no", "noise").distinct()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's content with the noise of scanning repaired."""
    return _noise(spark, sf_dir).repaired("repaired").select("vector_chunk_id", "repaired")


#: Documents of one source from which on a line is repeated.
REPEATED_FROM = 10


def _templates(spark: SparkSession, sf_dir: str) -> boilerplate.LineTemplates:
    return boilerplate.LineTemplates(table(spark, sf_dir, "chunk_metadata"), "vector_chunk_id", "source_file", "content", REPEATED_FROM)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in many chunks of one source_file."""
    return _templates(spark, sf_dir).repeated_lines().select(F.col("item_id").alias("vector_chunk_id"), "line_no")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's content without the lines of covering templates."""
    chunks = table(spark, sf_dir, "chunk_metadata").select("vector_chunk_id", "source_file", "content")
    return boilerplate.without_repeated_lines(chunks, "vector_chunk_id", "source_file", "content", "cleaned", REPEATED_FROM).drop("content")


def p4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged tree's templates that cover as many chunks."""
    return _templates(spark, sf_dir).templates()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keys of which either is among the 5 most similar of the other."""
    return neighbours.SimilarVectors(table(spark, sf_dir, "embedding_cache")).pairs()


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, sf_dir, "chunk_metadata"), "vector_chunk_id", "source_file", "content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of different sources whose contents are the same passage slightly changed."""
    return _near(spark, sf_dir).pairs_across_sources()


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's class of equal contents, and how many other classes are like it."""
    return _near(spark, sf_dir).linked().withColumnRenamed("item_id", "vector_chunk_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's class of equal contents and its group of classes that are alike."""
    return _near(spark, sf_dir).grouped().withColumnRenamed("item_id", "vector_chunk_id")


#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of byte_bpe_50k."""
    return encode.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", os.path.join(TOKENIZERS, "byte_bpe_50k.json"))


#: Letters and digits in a row that a document must share with an item, by the item's language, and for any other.
SHARED_RUN, ANY_RUN = {"en": 50, "zh": 20}, 50


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.coalesce(F.create_map(*(F.lit(x) for pair in SHARED_RUN.items() for x in pair))[F.col("lang")], F.lit(ANY_RUN))
    items = table(spark, sf_dir, "eval_item")
    return leakage.leaked_from(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text", window).withColumn("item_id", F.col("item_id").cast("int"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items they share a passage with."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages: where they begin and how long they are, in letters and digits."""
    return _leaks(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document long enough to have one."""
    given = table(spark, sf_dir, "reading_label").select(F.col("doc_id").alias("key"), F.col("reading_level").alias("level"), "labeled_by")
    labels = given.where("key is not null and level is not null").distinct()
    return readability.ReadingLevels(table(spark, sf_dir, "documents"), labels).levels()


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_cleaned": p4_cleaned,
    "p4_templates": p4_templates,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_groups": p6_groups,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
}

def _cuts_sql(name: str, key: str, text: str, table_name: str, limit: int) -> str:
    """Longest stretch between natural boundaries of each item beyond the limit (a mark stands behind each boundary)."""
    marked = f"regexp_replace(regexp_replace({text}, '(\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}。！？；!?;])', '\\1' || chr(1), 'g'), '\\.([\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x{{85}}])', '.' || chr(1) || '\\1', 'g')"
    return f"""SELECT '{name}' AS item_table, {key} AS item_id, CASE WHEN list_max(list_transform(string_split({marked}, chr(1)), lambda x: length(x))) > {limit} THEN 'forced' ELSE 'natural' END AS cut
FROM (SELECT DISTINCT {key}, {text} FROM {table_name}) WHERE length({text}) > {limit}"""


#: The same in SQL for those that SQL can say; compatibility normalisation, tokenizers, fits and searches it can't.
SQL: dict[str, str] = {
    "p2_found": _cuts_sql("chunk_metadata", "vector_chunk_id", "content", "chunk_metadata", CHUNK_PIECE[0])
    + " UNION ALL "
    + _cuts_sql("procedure_block", "block_id", "body", "(SELECT block_id, concat_ws(chr(10), nullif(heading, ''), nullif(text, '')) AS body FROM procedure_block)", BLOCK_PIECE[0]),
    "p5_found": """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) AS n FROM (SELECT DISTINCT * FROM embedding_cache)) WHERE n = 1),
usable AS (SELECT cache_key, model_fingerprint, list_transform(vector::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(vector::DOUBLE[], lambda y: y * y)))) AS u FROM latest WHERE vector IS NOT NULL AND len(vector) = dimension
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
near AS (SELECT a.cache_key AS k, b.cache_key AS o FROM usable a JOIN usable b ON a.model_fingerprint = b.model_fingerprint AND a.cache_key <> b.cache_key
  QUALIFY row_number() OVER (PARTITION BY a.cache_key ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.cache_key) <= 5)
SELECT DISTINCT least(k, o) AS key_a, greatest(k, o) AS key_b FROM near""",
}
