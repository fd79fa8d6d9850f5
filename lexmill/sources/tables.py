"""Readers of the Parquet tables a query is given."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application.

    The archive is written to the shared folder if that is a plain path, else
    where the driver can serve it from.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    shared = named.removeprefix("file://") if named.startswith(("file:///", "/")) else None
    if shared:
        os.makedirs(shared, exist_ok=True)
    archive = os.path.join(tempfile.mkdtemp(prefix="lexmill-", dir=shared), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``: one Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
