"""From PDFs to page texts and sections, with the decoder, recogniser and detector passed in.

Each model runs once for what isn't there yet: pages are decoded only if no
finished page is stored, headings are detected only for page texts that the
detector's version hasn't seen.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.pages import native_usable

#: Which text of a page counts: ``native`` or ``recognised`` only, or ``auto`` (native where it is usable).
POLICIES = ("auto", "native", "recognised")

Decoder = Callable[[bytes], list[tuple[int, str]]]
Recogniser = Callable[[bytes, int], str]


def config_hash(settings: dict[str, object]) -> str:
    """The hash of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def inspected(pdfs: DataFrame, count_pages: Callable[[bytes], int]) -> DataFrame:
    """source_path, document_id, page_count, error of PDFs (path, content); a file that can't be read keeps its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                pages, error = None, None
                try:
                    pages = count_pages(bytes(content))
                    error = None if pages else "no pages"
                except Exception as e:  # noqa: BLE001 - whatever the decoder raises is the file's error
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, hashlib.sha256(bytes(content)).hexdigest(), pages if error is None else None, error))
            yield pd.DataFrame(rows, columns=["source_path", "document_id", "page_count", "error"]).astype({"page_count": "Int32"})

    return pdfs.select("path", "content").mapInPandas(run, "source_path string, document_id string, page_count int, error string")


def decoded(pdfs: DataFrame, decode: Decoder, recognise: Recogniser | None = None, policy: str = "auto", done: DataFrame | None = None) -> DataFrame:
    """document_id, page, text, extraction_method, status, last_error of the pages of PDFs (path, content).

    ``done`` (document_id, page) are pages that are stored already; they aren't
    recognised again. A page whose recognition fails has status ``error``.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    stored = pdfs.withColumn("document_id", F.sha2("content", 256))
    if done is not None:
        kept = done.groupBy("document_id").agg(F.collect_set("page").alias("have"))
        stored = stored.join(kept, "document_id", "left")
    else:
        stored = stored.withColumn("have", F.lit(None).cast("array<int>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for document, content, have in zip(pdf["document_id"], pdf["content"], pdf["have"]):
                have = set() if have is None else set(have)
                for page, text in decode(bytes(content)):
                    if page in have:
                        continue
                    recognised, error = None, None
                    if recognise is not None and policy != "native":
                        try:
                            recognised = recognise(bytes(content), page)
                        except Exception as e:  # noqa: BLE001
                            error = f"{type(e).__name__}: {e}"
                    rows.append((document, page, text, recognised, error))
            yield pd.DataFrame(rows, columns=["document_id", "page", "native", "recognised", "last_error"])

    pages = stored.select("document_id", "content", "have").mapInPandas(run, "document_id string, page int, native string, recognised string, last_error string")
    native = native_usable(X.clean_markdown(F.col("native"))) if policy == "auto" else F.lit(policy == "native")
    text = F.when(native, X.clean_markdown(F.col("native"))).otherwise(X.clean_markdown(F.col("recognised")))
    method = F.when(native, "pdf_text_layer").otherwise("recognition")
    out = pages.withColumn("text", text).withColumn("extraction_method", method)
    failed = ~native & F.col("last_error").isNotNull()
    return out.select("document_id", "page", "text", "extraction_method", F.when(failed, "error").otherwise("done").alias("status"), F.when(failed, F.col("last_error")).alias("last_error"))


def section_plan(pages: DataFrame, stored: DataFrame, version: str, model: str) -> DataFrame:
    """``pages`` with text_sha256 and hit: whether headings of this text, version and model are stored."""
    keyed = pages.withColumn("text_sha256", F.sha2("text", 256))
    known = stored.where((F.col("version") == version) & (F.col("model") == model)).select("text_sha256", F.lit(True).alias("hit")).distinct()
    return keyed.join(known, "text_sha256", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def detected(planned: DataFrame, detect: Callable[[str], str], version: str, model: str) -> DataFrame:
    """text_sha256, version, model, start_line, level of the pages that aren't stored, each text once.

    The detector gets the numbered lines and answers with a JSON array; an
    answer without one is asked for once more. A page without headings has one
    row with null start_line, so that it counts as seen.
    """
    missing = planned.where(~F.col("hit")).dropDuplicates(["text_sha256"])
    numbered = F.array_join(F.filter(F.transform(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1), lambda x, i: F.when(X.strip(x) != "", F.concat((i + 1).cast("string"), F.lit("| "), X.strip_end(x)))), lambda x: x.isNotNull()), "\n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers = []
            for lines in pdf["numbered"]:
                answer = detect(lines)
                answers.append(answer if "[" in answer else detect(lines))
            yield pd.DataFrame({"text_sha256": pdf["text_sha256"], "answer": answers})

    asked = missing.select("text_sha256", numbered.alias("numbered")).mapInPandas(run, "text_sha256 string, answer string")
    found = asked.select("text_sha256", F.explode_outer(X.json_array(F.col("answer"), "array<struct<start_line:int,level:int>>")).alias("h"))
    return found.select("text_sha256", F.lit(version).alias("version"), F.lit(model).alias("model"), "h.start_line", "h.level")


def headings_of(planned: DataFrame, stored: DataFrame, version: str, model: str) -> DataFrame:
    """document_id, page, start_line, level from stored headings."""
    own = stored.where((F.col("version") == version) & (F.col("model") == model) & F.col("start_line").isNotNull())
    return planned.select("document_id", "page", "text_sha256").join(own, "text_sha256").select("document_id", "page", "start_line", "level")


def document_markdown(whole: DataFrame, catalog: DataFrame, generated_at: str) -> DataFrame:
    """document_id, markdown with front matter, plain: files of whole documents (operators.pages.whole_documents)."""
    known = catalog.select("document_id", "source_file", "page_count", "ocr_config_hash").dropDuplicates(["document_id"])
    rows = whole.join(known, "document_id")
    title = X.stem(F.col("source_file"))
    front = F.concat_ws(
        "\n", F.lit("---"), F.format_string('document_id: "%s"', "document_id"), F.format_string('source_file: "%s"', "source_file"), F.format_string("page_count: %s", F.col("page_count").cast("string")),
        F.format_string('ocr_config_hash: "%s"', "ocr_config_hash"), F.lit(f'generated_at: "{generated_at}"'), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""),
    )
    return rows.select("document_id", F.concat(front, F.lit("\n"), "markdown").alias("markdown"), F.concat(title, F.lit("\n"), "plain").alias("plain"))
