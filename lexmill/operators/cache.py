"""The embedding cache: which vectors are there, which are to be made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vectors as V
from lexmill.sources.shared import kept


def cache_key(fingerprint: Column, text_sha256: Column) -> Column:
    """The key of a text under a model."""
    return F.sha2(F.concat(fingerprint, F.lit(":"), text_sha256), 256)


def upserted(cache: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Each key's latest row. Partial aggregation runs before the shuffle, so a key with many rewrites is no hot spot."""
    rows = cache if new is None else cache.unionByName(new)
    names = [c for c in rows.columns if c not in ("cache_key", "created_at")]
    later = F.struct("created_at", F.xxhash64(*names))  # rewrites of one time: any, but always the same
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*names), later).alias("r"), F.max("created_at").alias("created_at")).select("cache_key", "r.*", "created_at")


def usable(cache: DataFrame) -> DataFrame:
    """Latest rows whose vector can be used."""
    return upserted(cache).where(V.is_usable(F.col("vector"), F.col("dimension")))


def plan(records: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """``records`` with cache_key and cached (whether a usable vector is there)."""
    keyed = records.withColumn("cache_key", cache_key(F.lit(fingerprint), F.col("embedding_text_sha256")))
    have = usable(cache).select("cache_key", F.lit(True).alias("cached"))
    return keyed.join(have, "cache_key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def statistics(planned: DataFrame) -> DataFrame:
    """One row: records, hit_records (whose vector wasn't newly made), new_keys, distinct_keys."""
    return planned.agg(
        F.count("*").alias("records"), F.count_if("cached").alias("hit_records"),
        F.countDistinct(F.when(~F.col("cached"), F.col("cache_key"))).alias("new_keys"), F.countDistinct("cache_key").alias("distinct_keys"),
    )


def embed_missing(planned: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], fingerprint: str, version: int = 2) -> DataFrame:
    """Cache rows of the keys that are missing, each encoded once."""
    missing = planned.where(~F.col("cached")).dropDuplicates(["cache_key"]).select("cache_key", "embedding_text_sha256", text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors = embed(pdf[text].tolist())
            if vectors and len({len(v) for v in vectors}) != 1:
                raise ValueError("the embedder's vectors differ in length")
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "text_sha256": pdf["embedding_text_sha256"], "vector": vectors})

    made = missing.mapInPandas(run, "cache_key string, text_sha256 string, vector array<float>")
    return made.select(
        "cache_key", F.lit(version).alias("cache_format_version"), F.lit(fingerprint).alias("model_fingerprint"), "text_sha256",
        F.size("vector").alias("dimension"), V.unit(F.col("vector")).cast("array<float>").alias("vector"), F.current_timestamp().alias("created_at"),
    )


def embed_texts(texts: DataFrame, text: str, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """``texts`` with the vector of each text, and the cache with the new ones: texts whose vector is stored aren't encoded."""
    planned = plan(texts.withColumn("embedding_text_sha256", F.sha2(text, 256)), cache, fingerprint)
    full = kept(upserted(cache, embed_missing(planned, text, embed, fingerprint).select(*cache.columns)))
    return with_vectors(planned, full).drop("embedding_text_sha256", "cached", "cache_key"), full


def with_vectors(planned: DataFrame, cache: DataFrame) -> DataFrame:
    """``planned`` with each record's vector, scaled to length one."""
    have = usable(cache).select("cache_key", V.unit_or_null(F.col("vector")).alias("embedding"))
    return planned.join(have, "cache_key")
