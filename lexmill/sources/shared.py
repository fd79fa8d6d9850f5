"""Intermediate tables in the folder all executors share, and joins by their size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, so its lineage ends here and a lost executor costs nothing.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (tests, a single machine) a temporary one is made.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-checkpoint-"))
    return df.checkpoint()


def _bytes(df: DataFrame) -> int:
    """Rows and texts of ``df`` in bytes, measured."""
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, kept, and marked for broadcast if it is measured to have no more than ``most`` bytes; else it is joined by shuffling."""
    df = kept(df)
    return F.broadcast(df) if _bytes(df) <= most else df
