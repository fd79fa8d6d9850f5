"""Files the engine reads and writes: PDFs, JSON lines, page caches, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.config import Settings
from lexmill.functions import text as X
from lexmill.schemas import DOCUMENT_SUMMARY


def pdf_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, modificationTime, length of all PDFs below a folder, by path ignoring case; or, in no order, with their content.

    Without content the files are only listed, not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return found if content else found.drop("content").orderBy(F.lower("path"), "path")


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """value (a variant) of every line of JSON lines that isn't blank, whatever it holds; a line that is no JSON is an error."""
    return spark.read.text(path).where(X.strip(F.col("value")) != "").select(F.parse_json("value").alias("value"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. Strict: a bad line is an error that shows it; else it is left out."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file")).where(X.strip(F.col("value")) != "")
    checked = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt", T.StringType())])
    rows = text.select("__file", "value", F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.startswith(X.strip(F.col("value")), F.lit("{"))
    if not strict:
        return rows.where(~bad).select("r.*").drop("_corrupt")
    message = F.concat(F.lit("no JSON object in "), "__file", F.lit(": "), F.substring("value", 1, 200))
    return rows.withColumn("r", F.when(bad, F.raise_error(message).cast(checked)).otherwise(F.col("r"))).select("r.*").drop("_corrupt")


def json_object(spark: SparkSession, path: str, schema: str, default: bool = False) -> DataFrame:
    """One row from a file that holds one JSON object; no row if it holds none and ``default`` is set."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    if default:
        return text.where("r is not null").select("r.*")
    return text.select(F.coalesce("r", F.raise_error(F.lit(f"no JSON object in {path}")).cast(T.StructType.fromDDL(schema))).alias("r")).select("r.*")


def cached_pages(spark: SparkSession, root: str) -> DataFrame:
    """document_id, ocr_config_hash, page, text of a page cache ``<document>/<config>/pages/page_NNNN/clean.md``."""
    files = spark.read.text(f"{root}/*/*/pages/page_*/clean.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    part = lambda n: F.regexp_extract("p", r"/([^/]+)/([^/]+)/pages/page_(\d+)/clean\.md$", n)
    return files.select(part(1).alias("document_id"), part(2).alias("ocr_config_hash"), part(3).cast("int").alias("page"), X.without_leaks(F.col("value")).alias("text"))


def sound_upload(name: Column, content: Column, limit: int = Settings.upload_limit) -> Column:
    """Null for a file that may be taken in, else what is wrong with it."""
    return (
        F.when(~F.endswith(F.lower(name), F.lit(".pdf")), "not a .pdf file")
        .when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty file")
        .when(F.length(content) > limit, "file too large")
        .when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "no PDF header")
    )


def safe_name(name: Column) -> Column:
    """A file name without folders and with nothing but letters, digits, dots, hyphens and underscores."""
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+", "")


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Writes ``df`` as ``root/version`` (by Spark's commit protocol, so whole or not at all) and returns that path."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_index(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes an index (chunks with their vectors, documents, manifest, ...) as one version of ``root``, and then makes it the current one.

    The name of the current version is a small file that is renamed into place,
    so readers see the whole old index or the whole new one.
    """
    for name, df in tables.items():
        write_snapshot(df, f"{root.rstrip('/')}/{version}", name)
    spark = next(iter(tables.values())).sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    pointer, draft = fs.Path(f"{root.rstrip('/')}/CURRENT"), fs.Path(f"{root.rstrip('/')}/CURRENT.{version}")
    context = fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(draft, pointer, rename)


def read_index(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The tables of the current version of an index; an error if there is none."""
    version = spark.read.text(f"{root.rstrip('/')}/CURRENT", wholetext=True).first()["value"].strip()
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{version}/{name}") for name in names}


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of documents (schemas.DOCUMENT_SUMMARY) stored as ``<document>/summary.json``; files without an object are left out."""
    text = spark.read.text(f"{root.rstrip('/')}/*/summary.json", wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"/([^/]+)/summary\.json$", 1).alias("folder"))
    rows = text.select("folder", F.from_json("value", DOCUMENT_SUMMARY).alias("r")).where("r is not null")
    return rows.select(F.coalesce("r.document_id", "folder").alias("document_id"), "r.title", "r.summary", "r.purpose", "r.intended_audience", "r.topics")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
