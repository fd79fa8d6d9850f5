"""The pN_ queries on the smallest tables: all run, with the columns asked for; those with SQL equal it."""

import collections
import os

import duckdb
import pytest

from lexmill.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "p1_found": "field_name string left_key string right_key string",
    "p2_found": "item_table string item_id string cut string",
    "p3_found": "vector_chunk_id string line_no int noise string",
    "p4_found": "vector_chunk_id string line_no int",
    "p5_found": "key_a string key_b string",
    "p6_found": "chunk_a string chunk_b string",
    "p7_ids": "doc_id bigint ids array<int>",
    "p8_found": "doc_id bigint item_id int",
    "p9_found": "doc_id bigint reading_level int",
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, FOLDER)
    if name in COLUMNS:
        assert " ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows or name == "p4_templates"
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in Q.SQL:
        connection = duckdb.connect()
        for f in os.listdir(FOLDER):
            connection.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
        want = connection.sql(f"select {', '.join(df.columns)} from ({Q.SQL[name]})").fetchall()
        assert collections.Counter(map(tuple, rows)) == collections.Counter(want)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("chunk_metadata", "procedure_block", "heading_ref", "embedding_cache", "documents", "eval_item", "reading_label"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def hollow(spark, tmp_path_factory):
    """The tables with every nullable column null."""
    folder = tmp_path_factory.mktemp("hollow")
    keys = {"vector_chunk_id", "document_id", "block_id", "cache_key", "model_fingerprint", "doc_id", "item_id", "heading_id"}
    from pyspark.sql import functions as F

    for name in ("chunk_metadata", "procedure_block", "heading_ref", "embedding_cache", "documents", "eval_item", "reading_label"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        df.select(*(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in df.dtypes)).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_null_columns(spark, hollow, name):
    rows = Q.QUERIES[name](spark, hollow).collect()
    whole = {"p1_forms", "p7_ids", "p3_repaired", "p4_cleaned"}  # a row for every document or chunk
    assert bool(rows) == (name in whole)
