"""Messages, prompts, line citations and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import search

# --- fixed values ---
REFUSAL = "文件內容不足以回答這個問題"
ROLES = ("system", "user", "assistant")
SYSTEM = "依據文件回答，並以 [S編號-行號] 標示出處。"
# --------------------


def cited_lines(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """citation_id (``S<rank>-<line>``), rank, line_no, line, source_file, page of every line of ranked results that isn't blank, by ``keys``."""
    rows = results.select(*keys, "rank", "source_file", "page", F.posexplode_outer(X.filled_lines(F.coalesce("content", F.lit("")))).alias("n", "line")).where("line is not null")
    number = F.col("n") + 1
    return rows.select(*keys, F.format_string("S%d-%d", "rank", number).alias("citation_id"), "rank", number.alias("line_no"), "line", "source_file", "page")


def sources(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """source_number, source_file, page: each source (of each of ``keys``) once, in the order it is first met."""
    own = results.where(X.strip(F.coalesce("content", F.lit(""))) != "").select(*keys, *_source(), "rank")
    met = own.groupBy(*keys, "source_file", "page").agg(F.min("rank").alias("first"))
    return met.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("first")).alias("source_number"), "source_file", "page")


def _source() -> tuple[Column, Column]:
    return F.coalesce(F.nullif("source_file", F.lit("")), F.lit("未知文件")).alias("source_file"), F.coalesce("page", F.lit(0)).alias("page")


def contexts(results: DataFrame, limit: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, context, characters: the contents of ranked results under their sources' numbers, until ``limit`` characters are spent.

    Results have rank, source_file, page, content; a result that is blank is left
    out, the one that doesn't fit is cut.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("place"), "content")))
    spent = results.groupBy(*keys).agg(items.alias("items")).select(*keys, search.budgeted(F.col("items"), limit).alias("b"))
    kept = spent.select(*keys, F.col("b.used").alias("characters"), F.explode("b.results").alias("r")).select(*keys, "characters", F.col("r.place").alias("rank"), F.col("r.content").alias("content"))
    named = kept.join(results.select(*keys, F.col("rank").cast("int").alias("rank"), *_source()), [*keys, "rank"])
    numbers = sources(named, keys)
    shown = named.withColumn("content", X.strip(F.col("content"))).where("content <> ''").join(numbers, [*keys, "source_file", "page"])
    block = F.format_string("[來源%d｜%s｜第 %d 頁]\n%s", "source_number", "source_file", "page", "content")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))["block"], "\n\n")
    return shown.groupBy(*keys).agg(text.alias("context"), F.first("characters").alias("characters"))


def listed_documents(documents: DataFrame) -> Column:
    """The block of a document in a context that names documents: rank, source_file, title, page_count, score."""
    title, pages = F.coalesce("title", F.lit("")), F.coalesce(F.col("page_count").cast("string"), F.lit("-"))
    return F.format_string("[候選文件%d]\n檔名：%s\n標題：%s\n頁數：%s\nE5 分數：%s", "rank", "source_file", title, pages, X.score_text(F.col("score")))


def summary_blocks(source_file: Column, summary: Column, topics: Column) -> Column:
    """What stands before a document's chunks in an overview: its summary and its topics, where there are some."""
    text = F.nullif(X.strip(F.coalesce(summary, F.lit(""))), F.lit(""))
    about = F.when(text.isNotNull(), F.concat(F.lit("[文件摘要｜"), source_file, F.lit("]\n"), text))
    named = F.when(F.size(F.coalesce(topics, F.array().cast("array<string>"))) > 0, F.concat(F.lit("[文件主題｜"), source_file, F.lit("]\n"), F.array_join(topics, "、")))
    return F.concat_ws("\n\n", about, named)


def citations(answer: Column) -> Column:
    """All ids cited within brackets."""
    brackets = F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]*S\d+-\d+[^\[\]]*)\]"), F.lit(1))
    return F.regexp_extract_all(F.array_join(brackets, " "), F.lit(r"S\d+-\d+"), F.lit(0))


def validated(answer: Column, valid: Column) -> Column:
    """passed and invalid: a refusal passes, an answer without citations doesn't, nor one that cites what isn't there."""
    refused = F.contains(answer, F.lit(REFUSAL))
    cited = citations(answer)
    wrong = F.filter(cited, lambda c: ~F.array_contains(valid, c))
    none = F.array().cast("array<string>")
    return F.struct(
        (refused | ((F.size(cited) > 0) & (F.size(wrong) == 0))).alias("passed"), F.when(refused, none).otherwise(wrong).alias("invalid")
    )


def with_footer(answer: Column, listed: Column) -> Column:
    """The answer and its sources (structs of source_file, page), numbered."""
    rows = F.transform(listed, lambda s, i: F.concat(F.lit("- [來源"), (i + 1).cast("string"), F.lit("] "), s["source_file"], F.lit("，第 "), s["page"].cast("string"), F.lit(" 頁")))
    return F.when(F.size(listed) > 0, F.concat_ws("\n", X.strip_end(answer), F.lit(""), F.lit("參考來源："), F.array_join(rows, "\n"))).otherwise(X.strip_end(answer))


def sound_messages(messages: DataFrame) -> DataFrame:
    """Messages of a known role that aren't blank, stripped."""
    return messages.where(F.col("role").isin(*ROLES) & (X.strip(F.coalesce("content", F.lit(""))) != "")).withColumn("content", X.strip(F.col("content")))


def checked_messages(messages: DataFrame) -> DataFrame:
    """Messages stripped; an error names the first role that isn't known or the blank content."""
    text = X.strip(F.coalesce("content", F.lit("")))
    known = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    wrong = F.when(~known, F.concat(F.lit("no such role: "), F.coalesce("role", F.lit("null")))).when(text == "", F.lit("a message is blank"))
    return messages.withColumn("content", F.when(wrong.isNull(), text).otherwise(F.raise_error(F.coalesce(wrong, F.lit("")))))


def history(messages: DataFrame, most: int) -> DataFrame:
    """The last ``most`` user and assistant messages of each conversation."""
    spoken = sound_messages(messages).where(F.col("role") != "system")
    last = Window.partitionBy("conversation_id").orderBy(F.desc("position"))
    return spoken.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def chat_prompt(messages: DataFrame, thinking: bool = False) -> DataFrame:
    """conversation_id, prompt: the messages in ChatML, ready for the next answer."""
    body = F.when(F.col("role") == "assistant", X.without_reasoning(F.col("content"))).otherwise(F.col("content"))
    parts = sound_messages(messages).select("conversation_id", "position", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), body, F.lit("<|im_end|>\n")).alias("p"))
    whole = parts.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("position", "p"))).alias("x"))
    lead = "<|im_start|>assistant\n<think>\n" + ("" if thinking else "\n</think>\n\n")
    return whole.select("conversation_id", F.concat(F.array_join("x.p", ""), F.lit(lead)).alias("prompt"))


def sound_decision(decision: Column, sop_prefix: str) -> Column:
    """Whether a structured decision (schemas.DECISION) keeps the rules of its fields."""
    return F.coalesce(
        decision["decision"].isNotNull() & decision["confidence"].between(0, 1) & (X.strip(F.coalesce(decision["reason"], F.lit(""))) != "")
        & F.startswith(decision["sop_reference"], F.lit(sop_prefix)), F.lit(False),
    )
