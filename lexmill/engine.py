"""Facade: ingest chunks, search them, answer with checked citations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import models, schemas
from lexmill.config import Settings
from lexmill.functions import text as X
from lexmill.functions import vectors as V
from lexmill.operators import cache, catalog, grounding, index, search
from lexmill.sources.shared import kept

Messages = list[dict[str, str]]


@dataclass
class Found:
    """What a search found: the mode taken, whether it is good enough, and its rows (``documents`` in an overview: those the chunks are of)."""

    mode: str
    status: str
    rows: DataFrame
    documents: DataFrame | None = None


@dataclass
class Engine:
    """One index over a set of chunks; ``embed``, ``rerank`` and the generators are the caller's models. No reranker: candidates stay as they are found."""

    spark: SparkSession
    embed: models.Embedder
    settings: Settings = Settings()
    fingerprint: str = "stand-in"
    rerank: models.Reranker | None = field(default_factory=models.OverlapReranker)
    selected: str | None = None
    count_tokens: Callable[[Messages], int] | None = None

    # --- the index -----------------------------------------------------------------

    def ingest(self, chunks: DataFrame, stored: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
        """Index records with vectors; only texts whose vector isn't stored are embedded. Returns the new cache.

        ``summaries`` (document_id and the fields of a summary) are embedded as
        well and blended into their documents' vectors.
        """
        s = self.settings.validated()
        records = index.index_records(chunks, s.window_tokens, s.window_overlap)
        passages = records.withColumn("passage", X.passage_text(F.col("source_file"), F.col("title"), F.col("page"), F.col("content")))
        held = stored if stored is not None else self.spark.createDataFrame([], schemas.EMBEDDING_CACHE)
        planned = kept(cache.plan(passages, held, self.fingerprint))
        made = cache.embed_missing(planned, "passage", self.embed, self.fingerprint)
        full = kept(cache.upserted(held, made.select(*held.columns)))
        self.chunks = kept(index.numbered(cache.with_vectors(planned, full).drop("passage", "cached")))
        own = None
        if summaries is not None:
            named = summaries.join(index.document_facts(self.chunks).select("document_id", "source_file", F.col("title").alias("__title")), "document_id")
            fields = F.struct(*(F.col(c) for c in ("title", "summary", "purpose", "intended_audience", "topics")))
            texts = named.withColumn("text", X.summary_text(F.col("source_file"), F.col("__title"), fields)).where("text is not null").select("document_id", "text", "summary", "topics")
            own, full = cache.embed_texts(texts, "text", full, self.embed, self.fingerprint)
        self.documents = kept(index.document_table(self.chunks, s.representative_count, own, s.summary_weight))
        return full

    def listing(self) -> DataFrame:
        """The documents of the index by name."""
        return catalog.listing(self.documents)

    def select(self, wanted: str | None = None) -> str | None:
        """The document later questions are about (by id or file name); None: all. An error if it isn't one document."""
        self.selected = None if wanted is None else self.resolve(wanted)
        return self.selected

    def refresh(self, chunks: DataFrame, documents: DataFrame) -> None:
        """Takes another state of the index; a selected document that is gone is selected no more."""
        self.chunks, self.documents = chunks, documents
        if self.selected is not None and documents.where(F.col("document_id") == self.selected).isEmpty():
            self.selected = None

    def resolve(self, wanted: str) -> str:
        """The id of the one document meant; an error if none or several are."""
        asked = self.spark.createDataFrame([(0, wanted)], "request_id int, wanted string")
        found = catalog.resolve(self.documents, asked).first()
        if found["outcome"] != "found":
            raise LookupError(f"{wanted}: {found['outcome']}")
        return found["document_id"]

    # --- search --------------------------------------------------------------------

    def _query(self, question: str) -> DataFrame:
        vector = self.embed([f"query: {question}"])[0]
        return self.spark.createDataFrame([(vector,)], "query array<double>").select(V.unit(F.col("query")).alias("query"))

    def search(self, question: str, document_id: str | None = None, mode: str = "auto") -> tuple[str, DataFrame]:
        """The mode taken and its rows: documents, representative chunks, or the best chunks."""
        found = self.find(question, document_id, mode)
        return found.mode, found.rows

    def find(self, question: str, document_id: str | None = None, mode: str = "auto") -> Found:
        s, asked = self.settings, " ".join(question.split())
        if not asked:
            raise ValueError("the question is empty")
        document_id = document_id or self.selected
        if mode == "auto":
            one = self.spark.createDataFrame([(asked, document_id is not None)], "question string, selected boolean")
            mode = search.mode_by_meaning(one, self.embed, s.router_margin).first()["mode"]
        query = self._query(asked)
        if mode == "documents":
            near = kept(search.documents_by_query(self.documents, query, s.document_top_k, s.document_min_score))
            return Found(mode, self._status_of(near), near)
        if mode == "overview":
            return self._overview(query, document_id)
        pool = self.chunks if document_id is None else self.chunks.where(F.col("document_id") == document_id)
        near = search.dense(pool, query, s.dense_candidates)
        words = search.lexical(pool.drop("embedding"), self.spark.createDataFrame([(0, asked)], "question_id int, question string"), s.dense_candidates)
        both = search.merged(near, words).join(pool.select("vector_chunk_id", "parent_chunk_id", "source_file", "page", "content"), "vector_chunk_id")
        best = search.unreranked(both, s.top_k) if self.rerank is None else search.reranked(search.scored(both, asked, self.rerank), s.top_k)
        best = kept(best)
        status = search.detail_status(best, self.rerank is not None, s.lexical_accept, s.min_rerank_score).first()["status"]
        return Found("detail", status, best)

    @staticmethod
    def _status_of(documents: DataFrame) -> str:
        best = documents.select("status").first()
        return best["status"] if best else "insufficient_context"

    def _overview(self, query: DataFrame, document_id: str | None) -> Found:
        """Representative chunks of the selected document, or of the nearest ones; those may be too far."""
        s = self.settings
        if document_id is not None:
            chosen, status = self.documents.where(F.col("document_id") == document_id).withColumn("rank", F.lit(1)), "ok"
        else:
            chosen = kept(search.documents_by_query(self.documents, query, s.document_top_k, s.document_min_score))
            status = self._status_of(chosen)
        ranked = chosen.select("document_id", F.col("rank").alias("document_rank"), F.posexplode("representative_chunk_ids").alias("place", "vector_chunk_id"))
        shown = ranked.join(self.chunks.select("vector_chunk_id", "source_file", "page", "content"), "vector_chunk_id")
        rank = F.col("document_rank") * F.lit(s.representative_count) + F.col("place") - s.representative_count + 1
        return Found("overview", status, kept(shown.withColumn("rank", rank)), chosen)

    def context(self, found: Found) -> tuple[str, list[tuple[str, int]]]:
        """What a model reads of a search, in any mode, within the budget of characters; and its sources in order."""
        if found.mode == "documents":
            blocks = found.rows.select("rank", grounding.listed_documents(found.rows).alias("b")).orderBy("rank").collect()  # top documents
            return "\n\n".join(r["b"] for r in blocks), []
        text = grounding.contexts(found.rows, self.settings.max_context_chars).first()
        listed = [(r["source_file"], r["page"]) for r in grounding.sources(self._budgeted(found)).orderBy("source_number").collect()]
        before = []
        if found.documents is not None:
            about = grounding.summary_blocks(F.col("source_file"), F.col("summary"), F.col("topics"))
            before = [r["b"] for r in found.documents.select("rank", about.alias("b")).orderBy("rank").collect() if r["b"]]
        return "\n\n".join([*before, *([text["context"]] if text else [])]), listed

    # --- answers -------------------------------------------------------------------

    def messages(self, system: str, question: str, history: Messages | None = None) -> Messages:
        """The prompt: system, at most twelve earlier messages, the question. A message of an unknown role is an error."""
        for m in history or []:
            if m.get("role") not in grounding.ROLES:
                raise ValueError(f"no such role: {m.get('role')}")
        kept_ = [{"role": m["role"], "content": str(m["content"]).strip()} for m in history or [] if m["role"] != "system" and str(m.get("content") or "").strip()]
        return [{"role": "system", "content": system}, *kept_[-12:], {"role": "user", "content": question}]

    def _said(self, generate: models.Generator, messages: Messages) -> str:
        """The generator's answer; an error if the prompt leaves it too little room (where tokens can be counted)."""
        if self.count_tokens is not None:
            models.room_for_answer(self.settings.context_tokens, self.count_tokens(messages), self.settings.answer_tokens)
        return models.answered(generate, messages)

    def answer(self, question: str, generate: models.Generator, document_id: str | None = None, history: Messages | None = None, mode: str = "detail") -> str:
        """A grounded answer: at most two more tries for sound citations, then the best chunk's own lines."""
        return self._answer(question, self.find(question, document_id, mode), generate, history)

    def _answer(self, question: str, found: Found, generate: models.Generator, history: Messages | None) -> str:
        if found.mode == "documents":
            context, _ = self.context(found)
            return self._said(generate, self.messages(grounding.SYSTEM, f"文件內容：\n{context}\n\n使用者問題：\n{question}", history)) if context else grounding.REFUSAL
        spent = self._budgeted(found)
        lines = grounding.cited_lines(spent).orderBy("rank", "line_no").collect()  # the budget bounds them
        if not lines:
            return grounding.REFUSAL
        context = "\n".join(f"[{r['citation_id']}] {r['line']}" for r in lines)
        prompt = self.messages(grounding.SYSTEM, f"文件內容：\n{context}\n\n使用者問題：\n{question}", history)
        valid, first = {r["citation_id"] for r in lines}, min(r["rank"] for r in lines)
        text = "\n".join(r["line"] for r in lines if r["rank"] == first)
        for _ in range(3):
            tried = self._said(generate, prompt)
            if cited_soundly(tried, valid):
                text = tried
                break
        listed = grounding.sources(spent).groupBy().agg(F.array_sort(F.collect_list(F.struct("source_number", "source_file", "page"))).alias("s"))
        return listed.select(grounding.with_footer(F.lit(text), F.col("s")).alias("t")).first()["t"]

    def _budgeted(self, found: Found) -> DataFrame:
        """The rows of a search as far as the budget of characters goes."""
        items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("place"), "content")))
        kept_ = found.rows.agg(items.alias("items")).select(F.explode(search.budgeted(F.col("items"), self.settings.max_context_chars)["results"]).alias("r"))
        return found.rows.drop("content").join(kept_.select(F.col("r.place").alias("rank"), F.col("r.content").alias("content")), "rank")

    def rewritten(self, question: str, generate: models.Generator, document_id: str | None = None) -> str:
        """The question in the documents' words, from what the search finds for it (five pieces of 200 characters)."""
        rows = self.find(question, document_id, "detail").rows
        seen = [r["c"] or "" for r in rows.orderBy("rank").limit(5).select(F.substring("content", 1, 200).alias("c")).collect()]
        return " ".join(self._said(generate, self.messages("只輸出改寫後的一句查詢。", "\n".join([*seen, question]))).split()) or question

    def grounded(self, question: str, generate: models.Generator, document_id: str | None = None, history: Messages | None = None, mode: str = "detail") -> str:
        """An answer; where the search isn't sure, the question is rewritten and searched once more, then refused."""
        for asked in (question, None):
            asked = asked or self.rewritten(question, generate, document_id)
            found = self.find(asked, document_id, mode)
            if found.status == "ok":
                return self._answer(asked, found, generate, history)
        return grounding.REFUSAL

    def chat(self, question: str, generate: models.Generator, history: Messages | None = None) -> str:
        """An answer without documents: the last twelve messages and the question."""
        return self._said(generate, self.messages("你是設備文件助理。", question, [m for m in history or [] if m.get("role") in ("user", "assistant")]))

    def decide(self, event: str, generate: models.Generator, sop_prefix: str) -> dict[str, object] | None:
        """A structured decision on an event with the sources it rests on, or None if the answer holds none that keeps the rules of its fields."""
        context, listed = self.context(self.find(event, None, "detail"))
        said = self._said(generate, self.messages("以 JSON 物件回答。", f"{context}\n\n{event}"))
        one = self.spark.createDataFrame([(said,)], "t string").select(X.json_object(F.col("t"), schemas.DECISION).alias("d"))
        row = one.select("d", grounding.sound_decision(F.col("d"), sop_prefix).alias("ok")).first()
        return row["d"].asDict(recursive=True) | {"sources": [{"source_file": f, "page": p} for f, p in listed]} if row["ok"] else None


def cited_soundly(answer: str, valid: set[str]) -> bool:
    """``grounding.validated`` for one answer on the driver."""
    cited = [c for inside in re.findall(r"\[([^\[\]]*S\d+-\d+[^\[\]]*)\]", answer) for c in re.findall(r"S\d+-\d+", inside)]
    return grounding.REFUSAL in answer or (bool(cited) and set(cited) <= valid)
