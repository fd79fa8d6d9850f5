"""Watching a folder of PDFs.

The stream only says that something came; each batch lists the folder again, as
files may be rewritten, still growing, or gone. So retractions and late files
are taken up without state in the stream.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.config import Settings
from lexmill.operators.catalog import first_by
from lexmill.sources.files import pdf_files
from lexmill.sources.shared import kept

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def snapshot(spark: SparkSession, folder: str, settle_s: float, now: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """source_path, document_id, status of the folder's PDFs as they are now.

    A file younger than ``settle_s`` waits (waiting_for_stable_file); equal
    files are one document, by the first of their paths. Only files that aren't
    in ``known`` (``hashed`` of before) as they are now are read.
    """
    rows = hashed(spark, folder, settle_s, now, known)
    first = first_by(rows.where("document_id is not null"), ["document_id"], [F.lower("path"), F.col("path")])
    done = first.select(F.col("path").alias("source_path"), "document_id", F.lit("pending").alias("status"))
    waiting = rows.where("document_id is null").select(F.col("path").alias("source_path"), "document_id", F.lit("waiting_for_stable_file").alias("status"))
    return done.unionByName(waiting)


def hashed(spark: SparkSession, folder: str, settle_s: float, now: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """path, modificationTime, length, document_id (the content's hash; null while a file may still grow) of the folder's PDFs."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    listed = pdf_files(spark, folder).withColumn("stable", F.col("modificationTime") <= at - F.expr(f"make_dt_interval(0, 0, 0, {settle_s})"))
    same = ["path", "modificationTime", "length"]
    before = known.where("document_id is not null").select(*same, "document_id") if known is not None else listed.where("false").select(*same, F.lit("").alias("document_id"))
    files = kept(listed.join(before, same, "left"))
    changed = [r["path"] for r in files.where("stable and document_id is null").select("path").collect()]  # what came since the last look
    columns = (*same, "document_id")
    rest = files.where(F.col("document_id").isNotNull() | ~F.col("stable")).select(*columns)
    if not changed:
        return rest
    new = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in changed]).select(*same, F.sha2("content", 256).alias("document_id"))
    return rest.unionByName(new)


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], interval_s: int = Settings.watch_interval_s, settle_s: float = Settings.settle_s, once: bool = False) -> StreamingQuery:
    """Calls ``handle(snapshot, batch)`` whenever files came; with ``once``, for what is there now.

    What was hashed is kept beside the checkpoint, two looks of it, so that files
    are read when they are new or have changed only.
    """
    arrivals = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path")
    seen = f"{checkpoint.rstrip('/')}/hashed"

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.parquet(f"{seen}/{(number + 1) % 2}") if number else None
        except AnalysisException:  # nothing kept
            known = None
        hashed(session, folder, settle_s, known=known).write.mode("overwrite").parquet(f"{seen}/{number % 2}")
        handle(snapshot(session, folder, settle_s, known=session.read.parquet(f"{seen}/{number % 2}")), number)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_s} seconds")).start()


def await_document(query: StreamingQuery, catalog: Callable[[], DataFrame], source_file: str, since: str, timeout_s: float = 1800, look_s: float = 1.0) -> str:
    """The state of a file's catalog entry that is no older than ``since`` (less half a second), once it is complete or failed; an error after ``timeout_s``."""
    end = time.monotonic() + timeout_s
    while time.monotonic() < end:
        fresh = catalog().where((F.col("source_file") == source_file) & (F.col("updated_at") >= F.lit(since).cast("timestamp") - F.expr("interval 500 milliseconds")))
        state = fresh.where(F.col("status").isin("complete", "failed")).orderBy(F.desc("updated_at")).select("status").first()
        if state:
            return state["status"]
        if query.exception() is not None:
            raise RuntimeError("the watch has ended") from query.exception()
        time.sleep(look_s)
    raise TimeoutError(source_file)


@contextmanager
def single_writer(spark: SparkSession, path: str, stale_s: float = 3600) -> Iterator[None]:
    """Holds a lock file in the store that ``path`` names, which all drivers of a cluster see; an error if another writer holds it.

    The file is made only if it isn't there, which the store decides. One that is
    older than ``stale_s`` was left by a driver that died and is taken over.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(place) and time.time() - store.getFileStatus(place).getModificationTime() / 1000 > stale_s:
        store.delete(place, False)
    try:
        store.create(place, False).close()
    except Py4JJavaError as e:
        raise RuntimeError(f"another writer holds {path}") from e
    try:
        yield
    finally:
        store.delete(place, False)


def merged_states(states: DataFrame, events: DataFrame) -> DataFrame:
    """Page states after new events: the latest by its own time, attempts added up.

    Both have document_id, ocr_config_hash, page, status, attempts, last_error,
    updated_at. Rows that come late change the sum of attempts but not the state.
    """
    both = states.unionByName(events).distinct()
    names = ("status", "last_error", "updated_at")
    of = both.groupBy("document_id", "ocr_config_hash", "page").agg(F.max_by(F.struct(*names), F.struct("updated_at", "status")).alias("s"), F.sum("attempts").cast("int").alias("attempts"))
    return of.select("document_id", "ocr_config_hash", "page", "s.status", "attempts", "s.last_error", "s.updated_at")


def pruned_states(states: DataFrame, catalog: DataFrame) -> DataFrame:
    """Page states without those of documents, settings or pages that the catalog doesn't have (any more)."""
    keys = ["document_id", "ocr_config_hash"]
    known = catalog.where("document_id is not null").groupBy(*keys).agg(F.max("page_count").alias("__most"))
    kept_ = states.join(known, keys).where(F.col("__most").isNull() | F.col("page").between(1, F.col("__most")))
    return kept_.select(*states.columns)


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Spark built-in, beyond what page states need: events per type in windows of their time, late rows within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
