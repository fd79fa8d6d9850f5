"""Routing, dense and lexical retrieval, reranking, context budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import vectors as V

# --- fixed values: what asks for a list of documents, or for an overview of one ---
DISCOVERY = (r"哪份(?:pdf|文件|文檔|檔案)", r"哪些(?:pdf|文件|文檔|檔案)", r"哪一份", r"which (?:pdf|document|file)", r"what (?:pdf|document|file)")
OVERVIEW = (
    r"(?:這份|此份|該份|目前這份|這個|此個)?(?:pdf|文件|文檔|檔案|文章).*(?:講什麼|說什麼|主要內容|主旨|重點|摘要|概要|概述|講解|解說|解讀|導讀|說明|介紹|分析|整理|總結)",
    r"(?:幫我|請|麻煩|可以)?(?:先)?(?:講解|解說|解讀|導讀|說明|介紹|分析|整理|摘要|概述|總結)(?:一下|一下子|給我|看看|下)?.*(?:這份|此份|該份|目前這份|這個|此個)?(?:pdf|文件|文檔|檔案|文章)",
    r"(?:全文|整份|整個文件|整篇).*(?:講解|解說|解讀|導讀|說明|介紹|分析|整理|摘要|概述|總結)",
    r"(?:這份|此份|該份).*(?:核心內容|文件目的|用途|適用對象)",
    r"(?:有哪些|列出|整理).*(?:章節|主題|重點)",
    r"(?:what is|what's).*(?:this|the).*(?:pdf|document).*(?:about|discuss)",
    r"(?:explain|summarize|summary|overview|introduce|analyze).*(?:this|the)?.*(?:pdf|document|file)",
    r"(?:main topic|main idea|purpose).*(?:pdf|document|file)",
)
SELECTED_OVERVIEW = (
    "內容是什麼", "內容為何", "主要內容", "文件目的", "這是什麼", "用途是什麼", "講什麼", "說什麼", "講解一下", "幫我講解", "解說一下", "幫我解說",
    "解讀一下", "幫我解讀", "導讀一下", "幫我導讀", "說明一下", "幫我說明", "介紹一下", "幫我介紹", "分析一下", "幫我分析", "整理一下", "幫我整理",
    "總結一下", "幫我總結", "全文摘要", "整份摘要", "全文重點", "整份重點",
)
OVERVIEW_EXAMPLES = (
    "請摘要並講解目前選取的整份文件", "這份 PDF 整體在說什麼", "幫我整理這份手冊的主要內容與重點", "請對整份文件做導讀與概述",
    "介紹這份資料的章節、目的和核心內容", "我想先了解整份文件的全貌", "請總結全文而不是查某一個細節", "帶我快速看懂目前選取的 PDF",
)
DETAIL_EXAMPLES = (
    "根據文件回答一個具體問題", "查詢文件中的特定數值、規格或庫存", "某一頁或某一條規定寫了什麼", "找出設備操作的特定步驟",
    "文件中某個零件的規格是多少", "請根據相關段落回答，而不是摘要整份文件", "查詢某個專有名詞、條文或項目", "比較文件中的兩個具體項目",
)
# ------------------------------------------------------------------------------------


def mode_by_rules(question: Column, selected: Column) -> Column:
    """``documents``, ``overview`` or ``detail``."""
    text = F.lower(question)
    generic = F.rlike(text, F.lit("|".join(SELECTED_OVERVIEW)))
    return (
        F.when(F.rlike(text, F.lit("(?is)" + "|".join(DISCOVERY))), "documents")
        .when(F.rlike(text, F.lit("(?i)" + "|".join(OVERVIEW))), "overview")
        .when(selected & generic, "overview")
        .otherwise("detail")
    )


def mode_by_meaning(questions: DataFrame, embed: Callable[[list[str]], list[list[float]]], margin: float) -> DataFrame:
    """``questions`` (question, selected) with mode: the nearer kind of example, the rules within the margin or without a selected document."""
    kinds = embed(list(OVERVIEW_EXAMPLES)), embed(list(DETAIL_EXAMPLES))

    @F.pandas_udf("double")
    def gap(asked: pd.Series) -> pd.Series:
        rows = np.asarray(embed(asked.tolist()), dtype=float)
        overview, detail = ((rows @ np.asarray(examples, dtype=float).T).max(axis=1) for examples in kinds)
        return pd.Series(overview - detail)

    rules = mode_by_rules(F.col("question"), F.col("selected"))
    near = questions.withColumn("__gap", gap("question"))
    meant = F.when(~F.col("selected") | (rules == "documents") | (F.abs("__gap") < margin), rules).when(F.col("__gap") > 0, "overview").otherwise("detail")
    return near.withColumn("mode", meant).drop("__gap")


def dense(chunks: DataFrame, query: DataFrame, candidates: int, document_id: str | None = None) -> DataFrame:
    """The nearest chunks: dense_rank and dense_score, one per content, cut before equal contents are removed.

    ``query`` is one row with ``query`` (a vector). The scores are an exact
    scan; each task keeps its best ``candidates`` and one merges them.
    """
    pool = chunks if document_id is None else chunks.where(F.col("document_id") == document_id)
    scored = pool.crossJoin(F.broadcast(query)).withColumn("dense_score", F.round(V.dot(F.col("embedding"), F.col("query")), 6)).drop("query", "embedding")
    best = scored.orderBy(F.desc("dense_score"), "vector_chunk_id").limit(candidates)
    same = Window.partitionBy("content_sha256").orderBy(F.desc("dense_score"), "vector_chunk_id")
    once = best.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    return once.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.desc("dense_score"), "vector_chunk_id")))  # at most ``candidates`` rows


def lexical(chunks: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """question_id and the chunks that hold its words, best first: lexical_score, lexical_rank."""
    keyed = questions.select("question_id", X.search_key(F.col("question")).alias("__key"))
    held = chunks.crossJoin(F.broadcast(keyed)).withColumn("lexical_score", X.word_score(F.col("__key"), F.col("content"))).where("lexical_score > 0").drop("__key")
    best = Window.partitionBy("question_id").orderBy(F.desc("lexical_score"), "vector_chunk_id")
    return held.withColumn("lexical_rank", F.row_number().over(best)).where(F.col("lexical_rank") <= limit)


def merged(dense_rows: DataFrame, lexical_rows: DataFrame) -> DataFrame:
    """vector_chunk_id, dense_rank, dense_score, lexical_score, position: dense candidates first, then those found by words only."""
    left = dense_rows.select("vector_chunk_id", "dense_rank", "dense_score")
    right = lexical_rows.select("vector_chunk_id", "lexical_rank", "lexical_score")
    both = left.join(right, "vector_chunk_id", "full")
    order = Window.orderBy(F.col("dense_rank").isNull(), "dense_rank", "lexical_rank")  # a few dozen candidates
    return both.select(
        "vector_chunk_id", "dense_rank", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"),
        F.row_number().over(order).alias("position"),
    )


def reranked(candidates: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` by word score, then rerank_score, one per parent chunk: rank."""
    order = (F.desc("lexical_score"), F.desc("rerank_score"), F.col("position"))
    once = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("parent_chunk_id").orderBy(*order))).where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= top_k)  # candidates only


def unreranked(candidates: DataFrame, top_k: int) -> DataFrame:
    """Without a reranker: the first ``top_k`` candidates as they stand, no parent left out, rerank_score null."""
    return candidates.where(F.col("position") <= top_k).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank", F.col("position"))


def scored(candidates: DataFrame, question: str, rerank: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """``candidates`` with rerank_score by the reranker that is passed in, batch by batch; nulls are read as empty."""

    @F.pandas_udf("double")
    def score(contents: pd.Series) -> pd.Series:
        found = rerank([(question, c or "") for c in contents])
        if len(found) != len(contents):
            raise ValueError("the reranker must give a score for every candidate")
        return pd.Series([float(x) for x in found])

    return candidates.withColumn("rerank_score", F.round(score("content"), 6))


def overlap_scores(candidates: DataFrame, question: Column) -> DataFrame:
    """A stand-in reranker: the share of the question's distinct characters that a content holds."""
    asked = F.array_distinct(F.filter(F.split(F.lower(question), ""), lambda c: F.rlike(c, F.lit(r"[\p{L}\p{N}]"))))
    own = F.lower(F.coalesce("content", F.lit("")))
    held = F.size(F.filter(asked, lambda c: F.contains(own, c)))
    return candidates.withColumn("rerank_score", F.round(held / F.greatest(F.size(asked), F.lit(1)), 6))


def detail_status(results: DataFrame, reranker: bool, accept: float, least: float) -> DataFrame:
    """One row: status, best scores and count of a list of results (rank, scores)."""
    of = results.agg(
        F.count("*").alias("results"), F.max("dense_score").alias("best_dense_score"), F.max("lexical_score").alias("best_lexical_score"),
        F.max(F.when(F.col("rank") == 1, F.col("rerank_score"))).alias("best_rerank_score"),
    )
    status = F.when(F.col("results") == 0, "insufficient_context").when(F.lit(not reranker), "ok").when(F.col("best_lexical_score") >= accept, "ok")
    return of.withColumn("status", status.when(F.col("best_rerank_score") < least, "insufficient_context").otherwise("ok"))


def documents_by_query(documents: DataFrame, query: DataFrame, top_k: int, least: float) -> DataFrame:
    """The nearest documents: rank, score, and whether the best is good enough (status)."""
    scored = documents.crossJoin(F.broadcast(query)).withColumn("score", F.round(V.dot(F.col("embedding"), F.col("query")), 6)).drop("query", "embedding")
    best = scored.orderBy(F.desc("score"), "document_id").limit(top_k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "document_id")))  # top_k rows
    return ranked.withColumn("status", F.when(F.max("score").over(Window.partitionBy()) >= least, "ok").otherwise("insufficient_context"))


def budgeted(results: Column, limit: int) -> Column:
    """Results (structs with content) until ``limit`` characters are used.

    The one that doesn't fit is cut and loses the white space at its new end,
    which leaves that much for the next.
    """
    start = F.struct(F.lit(limit).alias("left"), F.array().cast("array<struct<place:int,content:string,content_truncated:boolean>>").alias("out"))

    def add(state: Column, item: Column) -> Column:
        left, content = state["left"], F.coalesce(item["content"], F.lit(""))
        cut = F.char_length(content) > left
        kept = F.when(cut, X.strip_end(F.substr(content, F.lit(1), left))).otherwise(content)
        row = F.struct(item["place"].cast("int").alias("place"), kept.alias("content"), cut.alias("content_truncated"))
        taken = F.struct((left - F.char_length(kept)).alias("left"), F.concat(state["out"], F.array(row)).alias("out"))
        return F.when(left <= 0, state).otherwise(taken)

    return F.aggregate(results, start, add, lambda s: F.struct(s["out"].alias("results"), (F.lit(limit) - s["left"]).alias("used")))
