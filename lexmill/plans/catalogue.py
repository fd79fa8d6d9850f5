"""All queries over the given tables, with the same in SQL where SQL can say it.

Every query reads its tables whole. ``reading_order``, ``toc_entries`` and
``toc_levels`` read none, as no table has a layout: they run on the rows written
here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import models, schemas
from lexmill.config import Settings
from lexmill.functions import text as X
from lexmill.functions import vectors as V
from lexmill.operators import cache, catalog, chunkers, grounding, index, pages, search, toc
from lexmill.sources.shared import kept
from lexmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S = Settings()

#: What is asked in the retrieval queries.
QUESTION = "請問 M6 螺絲的規格是多少？"
QUESTIONS = ("請問 M6 螺絲的規格是多少？", "torque wrench", "哪一個壓力開關", "E51 是什麼")
#: Threshold of the document discovery query; words a window holds and shares in the index queries; characters of a context.
DISCOVERY_MIN, WINDOW, WINDOW_OVERLAP, BUDGET = 0.5, 60, 10, 1000


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- shared views -------------------------------------------------------------------

CHUNK = "chunk AS (SELECT DISTINCT * FROM chunk_metadata)"
USABLE = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) n FROM (SELECT DISTINCT * FROM embedding_cache)) WHERE n = 1),
usable AS (SELECT * FROM latest WHERE vector IS NOT NULL AND len(vector) = dimension
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
EMBEDDED = f"""{CHUNK}, {USABLE},
model AS (SELECT model_fingerprint FROM embedding_cache GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
emb AS (SELECT c.*, list_transform(u.vector::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(u.vector::DOUBLE[], lambda y: y * y)))) AS embedding
  FROM chunk c JOIN usable u ON u.text_sha256 = c.embedding_text_sha256 JOIN model USING (model_fingerprint)),
q AS (SELECT embedding AS query FROM emb ORDER BY vector_chunk_id LIMIT 1)"""
CENTROID = """parts AS (SELECT document_id, sqrt(greatest(1, least(length(coalesce(content, '')), 2000))::DOUBLE) AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM emb),
sums AS (SELECT document_id, pos, sum(w * x) / sum(w) AS x FROM parts GROUP BY 1, 2),
raw AS (SELECT document_id, list(x ORDER BY pos) AS v FROM sums GROUP BY 1),
centroid AS (SELECT document_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS embedding FROM raw)"""
REPRESENTATIVE = f"""scored AS (SELECT e.document_id, e.page, e.chunk_index, e.sub_chunk_index, e.vector_chunk_id, round(list_dot_product(e.embedding, c.embedding), 6) AS score FROM emb e JOIN centroid c USING (document_id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, chunk_index NULLS FIRST, sub_chunk_index NULLS FIRST, vector_chunk_id) AS rd FROM scored),
r2 AS (SELECT *, (rd <= 2)::INT AS first, sum((rd <= 2)::INT) OVER (PARTITION BY document_id, page) AS taken,
  row_number() OVER (PARTITION BY document_id, page ORDER BY (rd <= 2)::INT, score DESC, vector_chunk_id) AS place FROM r1),
r3 AS (SELECT *, CASE WHEN first = 1 THEN 0 WHEN place <= 2 - taken THEN 1 ELSE 2 END AS tier FROM r2),
rep AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY tier, CASE WHEN tier = 0 THEN rd END NULLS FIRST, score DESC, vector_chunk_id) AS rank FROM r3 QUALIFY rank <= {S.representative_count})"""
DENSE = f"""s AS (SELECT e.*, round(list_dot_product(e.embedding, q.query), 6) AS dense_score FROM emb e, q),
best AS (SELECT * FROM s ORDER BY dense_score DESC, vector_chunk_id LIMIT {S.dense_candidates}),
near AS (SELECT *, row_number() OVER (ORDER BY dense_score DESC, vector_chunk_id) AS dense_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY dense_score DESC, vector_chunk_id) AS n FROM best) WHERE n = 1)"""


def _key_sql(text: str) -> str:
    out = f"lower({text})"
    for phrase in X.STOP_PHRASES:
        out = f"replace({out}, '{phrase}', '')"
    return f"""regexp_replace({out}, '&quot;|&#34;', '"', 'g')"""


QUESTIONS_SQL = "questions AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUESTIONS)) + ") t(question_id, question))"
WORDS = f"""keyed AS (SELECT question_id, {_key_sql('question')} AS k FROM questions),
texts AS (SELECT *, regexp_replace(lower(coalesce(content, '')), '&quot;|&#34;', '"', 'g') AS t FROM chunk),
pieced AS (SELECT *, list_filter(regexp_extract_all(k, '[a-z0-9.]+|[0-\\\\uf]{{2,}}'), lambda p: length(p) >= 2) AS p FROM keyed),
word AS (SELECT question_id, vector_chunk_id, CASE WHEN length(k) < 2 THEN 0.0 WHEN contains(t, k) THEN 1.0
  WHEN len(p) > 0 AND len(list_filter(p, lambda x: NOT contains(t, x))) = 0 THEN 0.95 ELSE 0.0 END::DOUBLE AS lexical_score FROM texts, pieced),
held AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical_score DESC, vector_chunk_id) AS lexical_rank FROM word WHERE lexical_score > 0 QUALIFY lexical_rank <= {S.dense_candidates})"""
MERGED = """merged AS (SELECT vector_chunk_id, dense_rank, coalesce(dense_score, 0.0) AS dense_score, coalesce(lexical_score, 0.0) AS lexical_score,
  row_number() OVER (ORDER BY (dense_rank IS NULL), dense_rank NULLS FIRST, lexical_rank NULLS FIRST) AS position
  FROM near FULL JOIN (SELECT * FROM held WHERE question_id = 0) h USING (vector_chunk_id))"""
ASKED_CHARS = f"list_distinct(list_filter(string_split(lower('{QUESTION}'), ''), lambda c: regexp_matches(c, '[\\p{{L}}\\p{{N}}]')))"
RANKED = f"""cand AS (SELECT m.*, c.parent_chunk_id, c.source_file, c.page, c.content,
  round(len(list_filter({ASKED_CHARS}, lambda x: contains(lower(coalesce(c.content, '')), x))) / len({ASKED_CHARS})::DOUBLE, 6) AS rerank_score FROM merged m JOIN chunk c USING (vector_chunk_id)),
one AS (SELECT *, row_number() OVER (PARTITION BY parent_chunk_id ORDER BY lexical_score DESC, rerank_score DESC, position) AS n FROM cand),
ranked AS (SELECT *, row_number() OVER (ORDER BY lexical_score DESC, rerank_score DESC, position) AS rank FROM one WHERE n = 1 QUALIFY rank <= {S.top_k})"""
PAGE = "page_text AS (SELECT document_id, page, string_agg(content, chr(10) ORDER BY page_chunk_index NULLS FIRST, sub_chunk_index NULLS FIRST, vector_chunk_id) AS text FROM chunk WHERE content IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2)"
_WS = "[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x85]"
_LF = "regexp_replace({}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"


def _strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _lines_sql(x: str) -> str:
    parts = f"string_split({_LF.format(x)}, chr(10))"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def _title_key_sql(x: str) -> str:
    bare = f"regexp_replace({_strip_sql(x)}, '^#{{1,6}}{_WS}*', '')"
    return f"regexp_replace(translate(regexp_replace({bare}, '[ 　]', '', 'g'), '（）：＂“”', '():\"\"\"'), '[.…·．。]+$', '')"


def chunk_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """vector_chunk_id and the named columns of chunk_metadata, exact repeats once.

    Only these columns are read and shuffled; repeats are equal in all columns.
    """
    return table(spark, d, "chunk_metadata").select("vector_chunk_id", *columns).distinct()


def embedded(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks (and the named columns) with the usable vector of their text under the model with most entries."""
    stored = table(spark, d, "embedding_cache")
    model = stored.groupBy("model_fingerprint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_fingerprint").limit(1).select("model_fingerprint")
    own = cache.usable(stored.join(F.broadcast(model), "model_fingerprint", "left_semi")).select(F.col("text_sha256").alias("embedding_text_sha256"), V.unit_or_null(F.col("vector")).alias("embedding"))
    return chunk_rows(spark, d, "embedding_text_sha256", *columns).join(own, "embedding_text_sha256").persist()  # asked vector, centroids and scores all read it


def first_vector(rows: DataFrame) -> DataFrame:
    """The stand-in for an asked vector: that of the first chunk."""
    return rows.orderBy("vector_chunk_id").limit(1).select(F.col("embedding").alias("query"))


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """document_id, page, text: a page's chunks in order, exact repeats once."""
    rows = table(spark, d, "chunk_metadata").where("content is not null and page is not null")
    of = rows.groupBy("document_id", "page").agg(F.array_sort(F.collect_set(F.struct("page_chunk_index", "sub_chunk_index", "vector_chunk_id", "content"))).alias("x"))
    return of.select("document_id", "page", F.array_join("x.content", "\n").alias("text"))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")


# --- retrieval ----------------------------------------------------------------------


@query(f"WITH {EMBEDDED}, {DENSE} SELECT dense_rank::INTEGER AS dense_rank, vector_chunk_id, document_id, page, dense_score FROM near WHERE dense_rank <= {S.top_k}")
def detail_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "document_id", "page", "content_sha256")
    near = search.dense(rows, first_vector(rows), S.dense_candidates)
    return near.where(F.col("dense_rank") <= S.top_k).select("dense_rank", "vector_chunk_id", "document_id", "page", "dense_score")


@query(f"WITH {EMBEDDED}, {CENTROID} SELECT document_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos, round(unnest(embedding), 6) AS value FROM centroid")
def document_centroids(spark: SparkSession, d: str) -> DataFrame:
    return index.centroids(embedded(spark, d, "document_id", "content")).select("document_id", F.posexplode("embedding").alias("pos", "x")).select("document_id", "pos", F.round("x", 6).alias("value"))


@query(f"WITH {EMBEDDED}, {CENTROID}, {REPRESENTATIVE} SELECT document_id, rank::INTEGER AS rank, vector_chunk_id, score FROM rep")
def representative_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "document_id", "page", "chunk_index", "sub_chunk_index", "content")
    return index.representatives(rows, index.centroids(rows), S.representative_count)


_BY_QUERY = """docs AS (SELECT document_id, round(list_dot_product(embedding, query), 6) AS score FROM centroid, q ORDER BY score DESC, document_id LIMIT {})"""


@query(f"WITH {EMBEDDED}, {CENTROID}, {_BY_QUERY.format(S.document_top_k)} SELECT row_number() OVER (ORDER BY score DESC, document_id)::INTEGER AS rank, document_id, score FROM docs")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "document_id", "content")
    return search.documents_by_query(index.centroids(rows), first_vector(rows), S.document_top_k, S.document_min_score).select("rank", "document_id", "score")


@query(
    f"""WITH {EMBEDDED}, {CENTROID}, {_BY_QUERY.format(S.document_top_k)}, {REPRESENTATIVE}
SELECT o.document_id, o.score AS document_score, p.rank::INTEGER AS rank, p.vector_chunk_id, e.page, e.content FROM docs o JOIN rep p USING (document_id) JOIN emb e USING (vector_chunk_id)"""
)
def overview_context(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "document_id", "page", "chunk_index", "sub_chunk_index", "content")
    middle = index.centroids(rows)
    near = search.documents_by_query(middle, first_vector(rows), S.document_top_k, S.document_min_score).select("document_id", F.col("score").alias("document_score"))
    shown = index.representatives(rows.join(F.broadcast(near), "document_id", "left_semi"), middle, S.representative_count)
    own = rows.select("vector_chunk_id", "page", "content")
    return near.join(shown, "document_id").join(own, "vector_chunk_id").select("document_id", "document_score", "rank", "vector_chunk_id", "page", "content")


@query(
    f"""WITH {EMBEDDED}, {CENTROID}, {_BY_QUERY.format(8)} SELECT document_id, score,
CASE WHEN max(score) OVER () >= {DISCOVERY_MIN} THEN 'ok' ELSE 'insufficient_context' END AS status FROM docs"""
)
def document_discovery(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "document_id", "content")
    return search.documents_by_query(index.centroids(rows), first_vector(rows), 8, DISCOVERY_MIN).select("document_id", "score", "status")


@query(f"WITH {CHUNK}, {QUESTIONS_SQL}, {WORDS} SELECT question_id, vector_chunk_id, lexical_score, lexical_rank::INTEGER AS lexical_rank FROM held")
def lexical_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical(chunk_rows(spark, d, "content"), questions(spark), S.dense_candidates).select("question_id", "vector_chunk_id", "lexical_score", "lexical_rank")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "content_sha256")
    near = search.dense(rows, first_vector(rows), S.dense_candidates)
    return search.merged(near, search.lexical(chunk_rows(spark, d, "content"), questions(spark).where("question_id = 0"), S.dense_candidates))


@query(f"WITH {EMBEDDED}, {DENSE}, {QUESTIONS_SQL}, {WORDS}, {MERGED} SELECT vector_chunk_id, dense_rank::INTEGER AS dense_rank, dense_score, lexical_score::DOUBLE AS lexical_score, position::INTEGER AS position FROM merged")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    own = chunk_rows(spark, d, "parent_chunk_id", "source_file", "page", "content")
    return search.reranked(search.overlap_scores(_merged(spark, d).join(own, "vector_chunk_id"), F.lit(QUESTION)), S.top_k)


_TO_RANKED = f"{EMBEDDED}, {DENSE}, {QUESTIONS_SQL}, {WORDS}, {MERGED}, {RANKED}"


@query(f"WITH {_TO_RANKED} SELECT rank::INTEGER AS rank, vector_chunk_id, parent_chunk_id, rerank_score FROM ranked")
def rerank_parent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("rank", "vector_chunk_id", "parent_chunk_id", "rerank_score")


@query(
    f"""WITH {_TO_RANKED} SELECT count(*) AS results, max(dense_score) AS best_dense_score, max(lexical_score)::DOUBLE AS best_lexical_score, max(CASE WHEN rank = 1 THEN rerank_score END) AS best_rerank_score,
CASE WHEN count(*) = 0 THEN 'insufficient_context' WHEN max(lexical_score) >= {S.lexical_accept} THEN 'ok' WHEN max(CASE WHEN rank = 1 THEN rerank_score END) < {S.min_rerank_score} THEN 'insufficient_context' ELSE 'ok' END AS status FROM ranked"""
)
def detail_status(spark: SparkSession, d: str) -> DataFrame:
    return search.detail_status(_ranked(spark, d), True, S.lexical_accept, S.min_rerank_score)


@query(
    f"""WITH RECURSIVE {EMBEDDED}, {CENTROID}, {REPRESENTATIVE}, items AS (SELECT document_id, p.rank AS place, coalesce(content, '') AS content FROM rep p JOIN chunk USING (document_id, vector_chunk_id)),
fold AS (SELECT document_id, 0::BIGINT AS place, {BUDGET}::BIGINT AS left_, ''::VARCHAR AS kept, false AS cut FROM (SELECT DISTINCT document_id FROM items)
 UNION ALL SELECT document_id, place, left_ - length(k), k, c FROM (SELECT f.document_id, f.left_, i.place, length(i.content) > f.left_ AS c,
  CASE WHEN length(i.content) > f.left_ THEN regexp_replace(substring(i.content, 1, f.left_), '{_WS}+$', '') ELSE i.content END AS k FROM fold f JOIN items i ON i.document_id = f.document_id AND i.place = f.place + 1 WHERE f.left_ > 0))
SELECT document_id, place::INTEGER AS place, length(kept)::INTEGER AS characters, cut AS content_truncated, left_::INTEGER AS remaining FROM fold WHERE place > 0"""
)
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The budget of characters spent on each document's representative chunks, best first."""
    rows = embedded(spark, d, "document_id", "page", "chunk_index", "sub_chunk_index", "content")
    best = index.representatives(rows, index.centroids(rows), S.representative_count)
    items = best.join(rows.select("vector_chunk_id", "content"), "vector_chunk_id")
    listed = items.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), "content"))).alias("items"))
    kept = listed.select("document_id", F.explode(search.budgeted(F.col("items"), BUDGET)["results"]).alias("r"))
    spent = kept.select("document_id", "r.place", F.char_length("r.content").alias("characters"), "r.content_truncated")
    used = F.sum("characters").over(Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return spent.withColumn("remaining", (F.lit(BUDGET) - used).cast("int"))


@query(
    f"""WITH RECURSIVE {EMBEDDED}, {CENTROID}, {REPRESENTATIVE}, items AS (SELECT document_id, p.rank AS place, coalesce(nullif(source_file, ''), '未知文件') AS source_file, coalesce(page, 0) AS page, coalesce(content, '') AS content FROM rep p JOIN chunk USING (document_id, vector_chunk_id, page)),
fold AS (SELECT document_id, 0::BIGINT AS place, {BUDGET}::BIGINT AS left_, ''::VARCHAR AS kept FROM (SELECT DISTINCT document_id FROM items)
 UNION ALL SELECT document_id, place, left_ - length(k), k FROM (SELECT f.document_id, f.left_, i.place,
  CASE WHEN length(i.content) > f.left_ THEN regexp_replace(substring(i.content, 1, f.left_), '{_WS}+$', '') ELSE i.content END AS k FROM fold f JOIN items i ON i.document_id = f.document_id AND i.place = f.place + 1 WHERE f.left_ > 0)),
shown AS (SELECT f.document_id, f.place, i.source_file, i.page, {_strip_sql('f.kept')} AS content FROM fold f JOIN items i USING (document_id, place) WHERE {_strip_sql('f.kept')} <> ''),
met AS (SELECT document_id, source_file, page, row_number() OVER (PARTITION BY document_id ORDER BY min(place)) AS n FROM shown GROUP BY 1, 2, 3)
SELECT document_id, string_agg(concat('[來源', n, '｜', source_file, '｜第 ', page, ' 頁]', chr(10), content), chr(10) || chr(10) ORDER BY place) AS context FROM shown JOIN met USING (document_id, source_file, page) GROUP BY 1"""
)
def context_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a model reads of each document: its representative chunks under their sources' numbers, within the budget."""
    rows = embedded(spark, d, "document_id", "page", "chunk_index", "sub_chunk_index", "source_file", "content")
    best = index.representatives(rows, index.centroids(rows), S.representative_count)
    results = best.join(rows.select("vector_chunk_id", "source_file", "page", "content"), "vector_chunk_id")
    return grounding.contexts(kept(results), BUDGET, ("document_id",)).select("document_id", "context")


@query(f"WITH {_TO_RANKED} SELECT rank::INTEGER AS rank, vector_chunk_id, rerank_score, lexical_score::DOUBLE AS lexical_score FROM ranked")
def rerank_by_model(spark: SparkSession, d: str) -> DataFrame:
    """The candidates scored by a reranker that is passed in."""
    own = chunk_rows(spark, d, "parent_chunk_id", "source_file", "page", "content")
    scores = search.scored(_merged(spark, d).join(own, "vector_chunk_id"), QUESTION, models.OverlapReranker())
    return search.reranked(scores, S.top_k).select("rank", "vector_chunk_id", "rerank_score", "lexical_score")


@query(f"WITH {EMBEDDED}, {DENSE}, {QUESTIONS_SQL}, {WORDS}, {MERGED} SELECT position::INTEGER AS rank, vector_chunk_id, NULL::DOUBLE AS rerank_score FROM merged WHERE position <= {S.top_k}")
def rerank_off(spark: SparkSession, d: str) -> DataFrame:
    """The candidates as they are found, without a reranker."""
    return search.unreranked(_merged(spark, d), S.top_k).select("rank", "vector_chunk_id", "rerank_score")


@query(
    f"""WITH {EMBEDDED}, {CENTROID}, {REPRESENTATIVE}, facts AS (SELECT document_id, min(source_file) AS source_file, coalesce(min(title), regexp_replace(min(source_file), '(.)\\.[^.]*$', '\\1')) AS title,
 array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, max(page) AS page_count, count(*) AS chunk_count FROM emb GROUP BY 1),
shown AS (SELECT document_id, string_agg(vector_chunk_id, ',' ORDER BY rank) AS representative_chunks FROM rep GROUP BY 1)
SELECT row_number() OVER (ORDER BY f.document_id) - 1 AS faiss_id, f.*, 'chunk_centroid' AS vector_source, false AS summary_available, representative_chunks FROM facts f JOIN centroid USING (document_id) JOIN shown USING (document_id)"""
)
def document_table(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "document_id", "page", "chunk_index", "sub_chunk_index", "source_file", "title", "content")
    found = index.document_table(rows, S.representative_count)
    pages_ = F.array_join(F.transform("indexed_page_numbers", lambda p: p.cast("string")), ",").alias("pages")
    return found.select("faiss_id", "document_id", "source_file", "title", pages_, "page_count", F.col("indexed_chunk_count").alias("chunk_count"), "vector_source", "summary_available", F.array_join("representative_chunk_ids", ",").alias("representative_chunks"))


@query()
def semantic_routing(spark: SparkSession, d: str) -> DataFrame:
    """Every heading as a question, routed by a stand-in embedder."""
    asked = table(spark, d, "heading_ref").select(F.col("heading").alias("question"), F.lit(True).alias("selected"))
    return search.mode_by_meaning(asked, models.HashEmbedder(), S.router_margin)


_ROUTED = " UNION ALL ".join(
    f"SELECT concat({a}heading{b}) AS question, {sel} AS selected FROM heading_ref" for a, b, sel in (("", "", "false"), ("'請問哪份文件說明 ', ", "", "false"), ("", ", ' 主要內容'", "true"), ("'Explain the document about ', ", "", "true"))
)


@query(
    f"""WITH asked AS ({_ROUTED}) SELECT question, selected, CASE WHEN regexp_matches(lower(question), '{"|".join(search.DISCOVERY)}') THEN 'documents'
WHEN regexp_matches(lower(question), '{"|".join(search.OVERVIEW).replace("'", "''")}') THEN 'overview' WHEN selected AND regexp_matches(lower(question), '{"|".join(search.SELECTED_OVERVIEW)}') THEN 'overview' ELSE 'detail' END AS mode FROM asked"""
)
def query_routing(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "heading_ref")
    forms = ((lambda h: h, False), (lambda h: F.concat(F.lit("請問哪份文件說明 "), h), False), (lambda h: F.concat(h, F.lit(" 主要內容")), True), (lambda h: F.concat(F.lit("Explain the document about "), h), True))
    rows = heads.select(F.explode(F.array(*(F.struct(f(F.col("heading")).alias("question"), F.lit(s).alias("selected")) for f, s in forms))).alias("q")).select("q.*")
    return rows.withColumn("mode", search.mode_by_rules(F.col("question"), F.col("selected")))


# --- index and cache ----------------------------------------------------------------

_TOKENS = f"list_filter(regexp_split_to_array(content, '{_WS}+'), lambda x: x <> '')"
_WINDOWED = f"""{CHUNK}, base AS (SELECT vector_chunk_id AS chunk_id, document_id, source_file, title, page, page_start, {_strip_sql("coalesce(content, '')")} AS content FROM chunk),
tok AS (SELECT *, {_TOKENS} AS t FROM base WHERE content <> ''),
win AS (SELECT *, unnest(range(0, CASE WHEN len(t) <= {WINDOW} THEN 1 ELSE 1 + ceil((len(t) - {WINDOW}) / {WINDOW - WINDOW_OVERLAP}.0)::BIGINT END)) AS i,
  CASE WHEN len(t) <= {WINDOW} THEN 1 ELSE 1 + ceil((len(t) - {WINDOW}) / {WINDOW - WINDOW_OVERLAP}.0)::BIGINT END AS cnt FROM tok WHERE len(t) > 0),
rec AS (SELECT *, i * {WINDOW - WINDOW_OVERLAP} AS a, least(i * {WINDOW - WINDOW_OVERLAP} + {WINDOW}, len(t)) AS b,
  CASE WHEN cnt = 1 THEN content ELSE array_to_string(t[i * {WINDOW - WINDOW_OVERLAP} + 1 : least(i * {WINDOW - WINDOW_OVERLAP} + {WINDOW}, len(t))], ' ') END AS piece FROM win)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_rows(spark, d, "document_id", "source_file", "title", "page", "page_start", "chunk_index", "content").select(F.col("vector_chunk_id").alias("chunk_id"), "document_id", "source_file", "title", "page", "page_start", "chunk_index", "content")
    return index.index_records(rows, WINDOW, WINDOW_OVERLAP)


@query(f"WITH {_WINDOWED} SELECT chunk_id, i::INTEGER AS sub_chunk_index, cnt::INTEGER AS sub_chunk_count, a::INTEGER AS token_start, b::INTEGER AS token_end, (b - a)::INTEGER AS token_count FROM rec")
def token_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select(F.col("parent_chunk_id").alias("chunk_id"), "sub_chunk_index", "sub_chunk_count", "token_start", "token_end", "token_count")


_STEM = "regexp_replace(coalesce(nullif(source_file, ''), '未知文件'), '(.)\\.[^.]*$', '\\1')"


@query(
    f"""WITH {_WINDOWED}, paged AS (SELECT *, coalesce(nullif(page, 0), page_start, 0) AS pg FROM rec)
SELECT concat(chunk_id, '-s', lpad(i::VARCHAR, 3, '0')) AS vector_chunk_id, chunk_id AS parent_chunk_id, pg AS page, sha256(piece) AS content_sha256,
sha256(concat_ws(chr(10), concat('passage: 文件名稱：', coalesce(nullif(source_file, ''), '未知文件')), concat('文件標題：', coalesce(nullif(title, ''), {_STEM})), concat('頁碼：第 ', pg, ' 頁'), '', {_strip_sql('piece')})) AS embedding_text_sha256 FROM paged"""
)
def index_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("vector_chunk_id", "parent_chunk_id", "page", "content_sha256", "embedding_text_sha256")


@query(
    f"""WITH {_WINDOWED} SELECT (SELECT count(*) FROM base) AS source_chunks, (SELECT count(*) FROM base WHERE content = '') AS skipped_chunks,
(SELECT count(*) FROM rec) AS indexed_chunks, (SELECT count(DISTINCT chunk_id) FROM rec WHERE cnt > 1) AS split_chunks"""
)
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.ingest_counts(chunk_rows(spark, d, "content"), _records(spark, d))


_FP = "(SELECT model_fingerprint FROM embedding_cache GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_PLAN = f"""{CHUNK}, {USABLE}, fp AS {_FP}, plan AS (SELECT c.vector_chunk_id, sha256(concat(fp.model_fingerprint, ':', c.embedding_text_sha256)) AS cache_key FROM chunk c, fp),
planned AS (SELECT p.*, u.cache_key IS NOT NULL AS cached FROM plan p LEFT JOIN usable u USING (cache_key))"""


def _planned(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    stored = table(spark, d, "embedding_cache")
    top = stored.groupBy("model_fingerprint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_fingerprint").first()
    return cache.plan(chunk_rows(spark, d, "embedding_text_sha256", *columns), stored, top["model_fingerprint"] if top else "")


@query(f"WITH {_PLAN} SELECT vector_chunk_id, cache_key, cached FROM planned")
def embedding_cache_plan(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).select("vector_chunk_id", "cache_key", "cached")


@query(
    f"""WITH {_PLAN} SELECT count(*) AS records, count(*) FILTER (cached) AS hit_records, count(DISTINCT cache_key) FILTER (NOT cached) AS new_keys, count(DISTINCT cache_key) AS distinct_keys FROM planned"""
)
def embedding_cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    return cache.statistics(_planned(spark, d))


@query(f"WITH {USABLE} SELECT cache_key, model_fingerprint, text_sha256, dimension, created_at, cache_key IN (SELECT cache_key FROM usable) AS usable FROM latest")
def embedding_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = cache.upserted(table(spark, d, "embedding_cache"))
    return rows.select("cache_key", "model_fingerprint", "text_sha256", "dimension", "created_at", V.is_usable(F.col("vector"), F.col("dimension")).alias("usable"))


@query(f"WITH {USABLE} SELECT cache_key, round(sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))), 5) AS length FROM usable")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    return cache.usable(table(spark, d, "embedding_cache")).select("cache_key", F.round(V.norm(F.col("vector")), 5).alias("length"))


@query(f"WITH {_PLAN} SELECT DISTINCT cache_key, embedding_text_sha256 AS text_sha256, 64 AS dimension, 1.0::DOUBLE AS length FROM planned JOIN chunk USING (vector_chunk_id) WHERE NOT cached")
def incremental_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for all chunks by a stand-in embedder; texts whose vector is stored aren't encoded."""
    planned = _planned(spark, d, "source_file", "title", "page", "content").withColumn("passage", X.passage_text(F.col("source_file"), F.col("title"), F.col("page"), F.col("content")))
    made = cache.embed_missing(planned, "passage", models.HashEmbedder(64), "stand-in")
    return made.select("cache_key", "text_sha256", "dimension", F.round(V.norm(F.col("vector")), 4).alias("length"))


@query(
    f"""WITH {CHUNK} SELECT document_id, min(source_file) AS source_file, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, max(page) AS page_count, count(*) AS chunk_count,
sum(length(content))::BIGINT AS characters FROM chunk GROUP BY 1"""
)
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    facts = index.document_facts(chunk_rows(spark, d, "document_id", "source_file", "title", "page", "content"))
    return facts.select("document_id", "source_file", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "page_count", "chunk_count", "characters")


@query(
    f"""WITH {CHUNK} SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT content_sha256) AS distinct_contents, sum(token_count)::BIGINT AS tokens, min(page) AS first_page,
max(page) AS last_page, count(*) FILTER (sub_chunk_count > 1) AS sub_chunks, sha256('any') AS model_sha256 FROM chunk"""
)
def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    return index.manifest(chunk_rows(spark, d, "document_id", "content_sha256", "token_count", "page", "sub_chunk_count"), "any")


@query(f"WITH {CHUNK} SELECT vector_chunk_id, (row_number() OVER (ORDER BY document_id NULLS FIRST, page NULLS FIRST, chunk_index NULLS FIRST, sub_chunk_index NULLS FIRST, vector_chunk_id) - 1)::BIGINT AS faiss_id FROM chunk")
def index_order(spark: SparkSession, d: str) -> DataFrame:
    return index.numbered(chunk_rows(spark, d, "document_id", "page", "chunk_index", "sub_chunk_index")).select("vector_chunk_id", "faiss_id")


@query(
    f"""WITH {CHUNK} SELECT source_file, min(length(content))::INTEGER AS least, round(avg(length(content)), 4) AS mean, max(length(content))::INTEGER AS most FROM chunk GROUP BY 1"""
)
def chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("content")
    return chunk_rows(spark, d, "source_file", "content").groupBy("source_file").agg(F.min(n).alias("least"), F.round(F.avg(n), 4).alias("mean"), F.max(n).alias("most"))


# --- catalog ------------------------------------------------------------------------

_COMPLETE = "complete AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY lower(source_path), source_path) n FROM (SELECT DISTINCT * FROM doc_catalog) WHERE status = 'complete') WHERE n = 1)"


@query(f"WITH {_COMPLETE} SELECT document_id, source_path, page_count FROM complete")
def catalog_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return catalog.complete_documents(table(spark, d, "doc_catalog").distinct()).select("document_id", "source_path", "page_count")


@query(f"WITH {CHUNK}, {_COMPLETE} SELECT document_id, count(*) AS chunks FROM chunk WHERE document_id IN (SELECT document_id FROM complete) GROUP BY 1")
def global_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.rollup(table(spark, d, "doc_catalog"), chunk_rows(spark, d, "document_id")).groupBy("document_id").agg(F.count("*").alias("chunks"))


_STATE = "state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, ocr_config_hash, page ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST) n FROM page_status) WHERE n = 1)"


@query(
    f"""WITH {_STATE}, known AS (SELECT document_id, ocr_config_hash, max(page_count) AS pages FROM doc_catalog WHERE page_count >= 1 GROUP BY 1, 2),
wanted AS (SELECT document_id, ocr_config_hash, unnest(range(1, pages + 1))::INTEGER AS page FROM known)
SELECT w.document_id, w.ocr_config_hash, w.page, coalesce(s.status, 'missing') AS reason FROM wanted w LEFT JOIN state s USING (document_id, ocr_config_hash, page) WHERE s.status IS NULL OR s.status <> 'done'"""
)
def page_resume_plan(spark: SparkSession, d: str) -> DataFrame:
    return catalog.resume_plan(table(spark, d, "doc_catalog"), table(spark, d, "page_status"))


@query(
    f"""WITH {_STATE} SELECT document_id, ocr_config_hash, count(*) AS pages, count(*) FILTER (status = 'done') AS done, sum(attempts)::BIGINT AS attempts,
CASE WHEN bool_and(status = 'done') THEN 'complete' WHEN count(*) FILTER (status = 'done') > 0 THEN 'partial' ELSE 'pending' END AS state FROM state GROUP BY 1, 2"""
)
def document_states(spark: SparkSession, d: str) -> DataFrame:
    return catalog.document_states(table(spark, d, "page_status"))


_WANTED = """wanted AS (SELECT row_number() OVER (ORDER BY document_id)::INTEGER * 3 AS request_id, document_id[1:9] AS wanted FROM (SELECT DISTINCT document_id FROM doc_catalog)
UNION ALL SELECT 1, 'manual' UNION ALL SELECT 2, 'no such document' UNION ALL SELECT 4, (SELECT min(source_file) FROM doc_catalog))"""


@query(
    f"""WITH {_WANTED}, known AS (SELECT DISTINCT document_id, source_file FROM doc_catalog WHERE document_id IS NOT NULL),
fit AS (SELECT request_id, document_id, CASE WHEN document_id = wanted THEN 1 WHEN starts_with(document_id, wanted) THEN 2 WHEN lower(source_file) = lower(wanted) THEN 3 WHEN contains(lower(source_file), lower(wanted)) THEN 4 END AS way FROM wanted, known),
best AS (SELECT request_id, min(way) AS way FROM fit GROUP BY 1), f AS (SELECT request_id, count(DISTINCT document_id) AS n, min(document_id) AS document_id FROM fit JOIN best USING (request_id, way) GROUP BY 1)
SELECT w.request_id, CASE WHEN n = 1 THEN document_id END AS document_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM wanted w LEFT JOIN f USING (request_id)"""
)
def resolve_document(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "doc_catalog")
    ids = known.select("document_id").distinct().withColumn("n", F.row_number().over(Window.orderBy("document_id")))
    asked = ids.select((F.col("n") * 3).alias("request_id"), F.substring("document_id", 1, 9).alias("wanted"))
    more = spark.createDataFrame([(1, "manual"), (2, "no such document")], "request_id int, wanted string")
    return catalog.resolve(known, asked.unionByName(more).unionByName(known.agg(F.min("source_file").alias("wanted")).withColumn("request_id", F.lit(4))))


@query("SELECT source_file, regexp_replace(source_file, '(.)\\.[^.]*$', '\\1') AS stem FROM (SELECT DISTINCT source_file FROM doc_catalog)")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_catalog").select("source_file").distinct().withColumn("stem", X.stem(F.col("source_file")))


@query(f"WITH {CHUNK}, {PAGE} SELECT DISTINCT p.document_id, p.page, p.text FROM doc_catalog c JOIN page_text p ON p.document_id = c.document_id AND p.page BETWEEN 1 AND c.page_count")
def catalogued_pages(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "doc_catalog").groupBy("document_id").agg(F.max("page_count").alias("page_count"))
    return pages.catalogued_pages(known, page_rows(spark, d))


# --- pages and lines ----------------------------------------------------------------

_FILLED = f"list_filter(list_transform({_lines_sql('text')}, lambda x: {_strip_sql('x')}), lambda x: x <> '')"


@query(
    f"""WITH {CHUNK}, {PAGE}, l AS (SELECT document_id, page, {_FILLED} AS l FROM page_text), e AS (SELECT document_id, page, unnest(list_concat(l[1:4], l[-4:])) AS line FROM l),
k AS (SELECT DISTINCT document_id, page, {_title_key_sql('line')} AS key FROM e WHERE length(line) <= 32 AND NOT starts_with(lower(line), '<table'))
SELECT document_id, key, count(DISTINCT page) AS pages FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3"""
)
def repeated_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.edge_lines(page_rows(spark, d))


@query(
    f"""WITH {CHUNK}, {PAGE}, n AS (SELECT document_id, count(DISTINCT page) AS n FROM page_text GROUP BY 1),
l AS (SELECT document_id, page, unnest(list_transform({_lines_sql('text')}, lambda x: regexp_replace({_strip_sql('x')}, '{_WS}+', ' ', 'g'))) AS line FROM page_text),
o AS (SELECT document_id, line, count(DISTINCT page) AS pages FROM l WHERE line <> '' AND length(line) <= 80 AND NOT regexp_full_match(line, '\\d+') GROUP BY 1, 2)
SELECT document_id, line, pages FROM o JOIN n USING (document_id) WHERE n >= 2 AND pages >= greatest(2, floor(n * 0.2 + 0.999))"""
)
def recurring_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.recurring_lines(page_rows(spark, d), 0.2)


_NUMBER_LINE = f"regexp_full_match({_strip_sql('x')}, '\\d{{1,3}}(-\\d{{1,3}})?')"


@query(
    f"""WITH {CHUNK}, {PAGE}, l AS (SELECT document_id, page, {_FILLED} AS l FROM page_text), e AS (SELECT document_id, page, unnest(list_concat(l[1:4], l[-4:])) AS line FROM l),
k AS (SELECT DISTINCT document_id, page, {_title_key_sql('line')} AS key FROM e WHERE length(line) <= 32 AND NOT starts_with(lower(line), '<table')),
often AS (SELECT document_id, key FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3), of_document AS (SELECT document_id, list(key) AS keys FROM often GROUP BY 1),
shown AS (SELECT document_id, page, coalesce(keys, []) AS keys, list_transform({_lines_sql('text')}, lambda x: CASE WHEN {_strip_sql('x')} = '' THEN '' ELSE x END) AS l FROM page_text LEFT JOIN of_document USING (document_id))
SELECT document_id, page, {_strip_sql(f"regexp_replace(array_to_string(list_filter(l, lambda x: x = '' OR NOT (list_contains(keys, {_title_key_sql('x')}) OR {_NUMBER_LINE})), chr(10)), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM shown"""
)
def noise_line_removal(spark: SparkSession, d: str) -> DataFrame:
    rows = page_rows(spark, d)
    return pages.without_noise(rows, pages.edge_lines(rows)).select("document_id", "page", "text")


@query(
    f"""SELECT doc_id, regexp_replace({_strip_sql('text')}, '{_WS}+', ' ', 'g') AS compared FROM documents WHERE text IS NOT NULL"""
)
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.one_space(F.col("text")).alias("compared"))


def _clean_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '[\\x{{FEFF}}\\x00]', '', 'g'), '\\r\\n?', chr(10), 'g')"
    for token in X.CONTROL_TOKENS:
        out = f"replace({out}, '{token}', '')"
    out = f"array_to_string(list_transform({_lines_sql(out)}, lambda y: regexp_replace(y, '{_WS}+$', '')), chr(10))"
    return _strip_sql(f"regexp_replace(regexp_replace({out}, '\\n[ \\t]+\\n', chr(10) || chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"WITH {CHUNK} SELECT vector_chunk_id, {_clean_sql('content')} AS markdown FROM chunk WHERE content IS NOT NULL")
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d, "content").where("content is not null").select("vector_chunk_id", X.clean_markdown(F.col("content")).alias("markdown"))


def _replaced_sql(x: str, *rules: tuple[str, str]) -> str:
    """Patterns replaced one after the other."""
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _rag_sql(x: str) -> str:
    image = (f"!\\[{_WS}*\\]\\([^)]+\\)", "[圖片]"), (f"!\\[{_WS}*([^\\]]*?){_WS}*\\]\\([^)]+\\)", "[圖片：\\1]")
    return _strip_sql(_replaced_sql(_clean_sql(x), *image, ("<[^>\\n]+>", ""), ("\\n{3,}", "\n\n")))


_RULE = f"{_WS}*:?-{{3,}}:?{_WS}*"


def _plain_sql(x: str) -> str:
    bare = _replaced_sql(
        _rag_sql(x), (f"(?m)^#{{1,6}}{_WS}+", ""), (f"(?m)^{_WS}*[-*+]{_WS}+", ""), (f"(?m)^{_WS}*\\d+[.)]{_WS}+", ""), ("`{1,3}", ""), ("\\*\\*(.*?)\\*\\*", "\\1"), ("__(.*?)__", "\\1"),
        ("(^|[^*])\\*([^*\\n][^\\n]*?)\\*($|[^*])", "\\1\\2\\3"), ("(^|[^_])_([^_\\n][^\\n]*?)_($|[^_])", "\\1\\2\\3"), (f"(?m)^{_WS}*\\|?(?:{_RULE}\\|)+{_RULE}\\|?{_WS}*$", ""), ("\\n{3,}", "\n\n"),
    )
    return _strip_sql(bare)


@query(f"WITH {CHUNK} SELECT vector_chunk_id, {_rag_sql('content')} AS markdown FROM chunk WHERE content IS NOT NULL")
def rag_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d, "content").where("content is not null").select("vector_chunk_id", X.rag_markdown(F.col("content")).alias("markdown"))


@query(f"WITH {CHUNK} SELECT vector_chunk_id, {_plain_sql('content')} AS plain FROM chunk WHERE content IS NOT NULL")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d, "content").where("content is not null").select("vector_chunk_id", X.plain_text(F.col("content")).alias("plain"))


@query(f"SELECT heading_id, {_title_key_sql('heading')} AS key FROM heading_ref")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "heading_ref").select("heading_id", X.title_key(F.col("heading")).alias("key"))


@query(
    f"""WITH p AS (SELECT doc_id, {_strip_sql("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, (len(regexp_extract_all(t, '[^\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]+')) >= 8 AND length(t) >= 45
AND len(regexp_extract_all(t, '[A-Za-z0-9㐀-鿿]')) >= 30 AND (length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1) <= 0.01) AS usable FROM p"""
)
def native_text_usable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", pages.native_usable(F.col("text")).alias("usable"))


_LAYOUT = tuple((f"d{i}", p, x0, y0, x0 + w, y0 + 20.0, f"t{i}-{p}-{n}", 600.0, 800.0) for i in range(3) for p in (1, 2) for n, (x0, y0, w) in enumerate(((20.0, 10.0, 560.0), (20.0, 100.0 + i, 250.0), (320.0, 100.0, 250.0), (20.0, 300.0, 250.0), (320.0, 90.0 + p, 250.0), (250.0, 760.0, 80.0))[: 6 if p == 1 else 2]))
_LAYOUT_SQL = "blocks AS (SELECT * FROM (VALUES " + ", ".join("('{}', {}, {}, {}, {}, {}, '{}', {}, {})".format(*r) for r in _LAYOUT) + ") t(document_id, page, x0, y0, x1, y1, text, page_width, page_height))"


@query(
    f"""WITH {_LAYOUT_SQL}, p AS (SELECT *, CASE WHEN y1 <= page_height * 0.10 OR (x0 < page_width / 2 - greatest(12.0, page_width * 0.035) AND x1 > page_width / 2 + greatest(12.0, page_width * 0.035)) THEN 0
WHEN y0 >= page_height * 0.92 THEN 3 WHEN (x0 + x1) / 2 < page_width / 2 THEN 1 ELSE 2 END AS part FROM blocks),
b AS (SELECT *, CASE WHEN bool_or(part = 1) OVER w AND bool_or(part = 2) OVER w THEN part ELSE 0 END AS g FROM p WINDOW w AS (PARTITION BY document_id, page))
SELECT document_id, page, text, row_number() OVER (PARTITION BY document_id, page ORDER BY g, y0, x0, text)::INTEGER AS place FROM b"""
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    blocks = spark.createDataFrame([tuple(r) for r in _LAYOUT], schemas.LAYOUT_BLOCKS)
    return pages.reading_order(blocks).select("document_id", "page", "text", "place")


_LINKED = "regexp_replace(text, '!\\[([^\\]]*)\\]\\((images/[^)]+)\\)', concat('![\\1](pages/page_', lpad(page::VARCHAR, 4, '0'), '/\\2)'), 'g')"


@query(
    f"""WITH {CHUNK}, {PAGE} SELECT document_id, string_agg(concat('## 第 ', page, ' 頁', chr(10), chr(10), {_LINKED}, chr(10)), chr(10) ORDER BY page) AS markdown,
string_agg(concat(chr(10), '===== 第 ', page, ' 頁 =====', chr(10), chr(10), {_plain_sql('text')}, chr(10)), chr(10) ORDER BY page) AS plain FROM page_text GROUP BY 1"""
)
def document_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as Markdown and plain text."""
    return pages.whole_documents(page_rows(spark, d))


# --- chunkers -----------------------------------------------------------------------


def _windows_sql(source: str, keys: str) -> str:
    """Windows of the texts t of ``source`` (with keys, size, overlap; t, n its length): keys, begun, piece of those that aren't blank."""
    return f"""cut AS (SELECT {keys}, t, length(t) AS n, size, overlap, 0::BIGINT AS start, 0::BIGINT AS begun, NULL::BIGINT AS stop, false AS fin FROM {source}
 UNION ALL SELECT {keys}, t, n, size, overlap, CASE WHEN e >= n THEN n WHEN e - overlap > s THEN e - overlap ELSE e END, s, e, e >= n FROM (SELECT *, CASE WHEN tent < n AND last > s THEN last + 1 ELSE tent END AS e FROM
  (SELECT *, CASE WHEN regexp_matches(w, '[\n。；. ]') THEN s + lo + length(regexp_extract(w, '(?s)^(.*)[\n。；. ]', 1)) ELSE -1 END AS last FROM
   (SELECT {keys}, t, n, size, overlap, start AS s, lo, least(start + size, n) AS tent, substring(t, start + lo + 1, greatest(least(size, n - start) - lo, 0)) AS w FROM (SELECT *, floor(size * 0.6::DOUBLE)::BIGINT AS lo FROM cut WHERE NOT fin)))))"""


@query(
    f"""WITH RECURSIVE src AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL AND {_strip_sql('text')} <> ''),
cut AS (SELECT doc_id, t, n, 0::BIGINT AS start, 0::BIGINT AS begun, NULL::BIGINT AS stop, false AS fin FROM src
 UNION ALL SELECT doc_id, t, n, CASE WHEN e >= n THEN n WHEN e - {S.chunk_overlap} > s THEN e - {S.chunk_overlap} ELSE e END, s, e, e >= n FROM (SELECT doc_id, t, n, s, CASE WHEN tent < n AND last > s THEN last + 1 ELSE tent END AS e FROM
  (SELECT doc_id, t, n, s, tent, CASE WHEN regexp_matches(w, '[\n。；. ]') THEN s + {S.chunk_size * 6 // 10} + length(regexp_extract(w, '(?s)^(.*)[\n。；. ]', 1)) ELSE -1 END AS last FROM
   (SELECT doc_id, t, n, start AS s, least(start + {S.chunk_size}, n) AS tent, substring(t, start + {S.chunk_size * 6 // 10 + 1}, least({S.chunk_size}, n - start) - {S.chunk_size * 6 // 10}) AS w FROM cut WHERE NOT fin))))
SELECT doc_id, sha256(piece) AS piece_sha256, length(piece)::INTEGER AS characters FROM (SELECT doc_id, {_strip_sql('substring(t, begun + 1, stop - begun)')} AS piece FROM cut WHERE stop IS NOT NULL) WHERE piece <> ''"""
)
def long_text_split(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1200 characters that share 180."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    pieces = chunkers.exploded(rows, ["text"], lambda t: chunkers.windows(t, S.chunk_size, S.chunk_overlap), "piece string")
    return pieces.select("doc_id", F.sha2("piece", 256).alias("piece_sha256"), F.char_length("piece").alias("characters"))


_SIZE, _TAIL = S.chunk_size, _strip_sql(f"right(f.held, {S.chunk_overlap})")
_UNDER = f"CASE WHEN {_TAIL} <> '' THEN concat({_TAIL}, chr(10), chr(10), b.block) ELSE b.block END"


@query(
    f"""WITH RECURSIVE {CHUNK}, {PAGE}, src AS (SELECT document_id, page, {_rag_sql('text')} AS body FROM page_text),
blocks AS (SELECT document_id, page, list_filter(list_transform(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS a FROM src),
b AS (SELECT document_id, page, unnest(a) AS block, generate_subscripts(a, 1) AS i FROM blocks), last AS (SELECT document_id, page, max(i) AS most FROM b GROUP BY 1, 2),
f AS (SELECT document_id, page, 0::BIGINT AS i, ''::VARCHAR AS held, ''::VARCHAR AS done, ''::VARCHAR AS big FROM last
 UNION ALL SELECT b.document_id, b.page, b.i, CASE WHEN length(b.block) > {_SIZE} THEN '' WHEN f.held = '' THEN b.block WHEN length(f.held) + 2 + length(b.block) <= {_SIZE} THEN concat(f.held, chr(10), chr(10), b.block) WHEN length({_UNDER}) > {_SIZE} THEN '' ELSE {_UNDER} END,
  CASE WHEN length(b.block) > {_SIZE} OR (f.held <> '' AND length(f.held) + 2 + length(b.block) > {_SIZE}) THEN f.held ELSE '' END,
  CASE WHEN length(b.block) > {_SIZE} THEN b.block WHEN f.held <> '' AND length(f.held) + 2 + length(b.block) > {_SIZE} AND length({_UNDER}) > {_SIZE} THEN {_UNDER} ELSE '' END FROM f JOIN b ON b.document_id = f.document_id AND b.page = f.page AND b.i = f.i + 1),
todo AS (SELECT document_id, page, i, big AS t, {_SIZE}::BIGINT AS size, {S.chunk_overlap}::BIGINT AS overlap FROM f WHERE big <> ''), {_windows_sql('todo', 'document_id, page, i')},
made AS (SELECT document_id, page, i, 0 AS part, 0 AS begun, done AS content FROM f WHERE done <> '' UNION ALL SELECT document_id, page, i, 1, begun, {_strip_sql('substring(t, begun + 1, stop - begun)')} FROM cut WHERE stop IS NOT NULL
 UNION ALL SELECT f.document_id, f.page, f.i, 2, 0, held FROM f JOIN last ON last.document_id = f.document_id AND last.page = f.page AND last.most = f.i WHERE held <> ''),
seen AS (SELECT *, lag(content) OVER (PARTITION BY document_id, page ORDER BY i, part, begun) AS before FROM made WHERE content <> '')
SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY i, part, begun)::INTEGER AS piece_no, content FROM seen WHERE before IS NULL OR before <> content"""
)
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = page_rows(spark, d).withColumn("text", X.rag_markdown(F.col("text")))
    return chunkers.exploded(rows, ["text"], lambda t: chunkers.paragraphs(t, S.chunk_size, S.chunk_overlap), "content string").select("document_id", "page", "piece_no", "content")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    head = F.coalesce(F.nullif(F.trim(F.replace("heading", F.lit("\n"), F.lit(" "))), F.lit("")), F.lit("-"))
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("-")), F.lit("\n\n## "), head, F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return chunk_rows(spark, d, "title", "heading", "content").select("vector_chunk_id", body.alias("text"))


_ATX = f"^(#{{1,6}}){_WS}+(.+?){_WS}*#*{_WS}*$"


_SECTIONS = f"""md AS (SELECT vector_chunk_id, concat('# ', coalesce(title, '-'), chr(10), chr(10), '## ', coalesce(nullif(regexp_replace(replace(heading, chr(10), ' '), '^ +| +$', '', 'g'), ''), '-'), chr(10), chr(10), coalesce(content, '')) AS t FROM chunk),
l AS (SELECT vector_chunk_id, unnest({_lines_sql('t')}) AS line, generate_subscripts({_lines_sql('t')}, 1) AS n FROM md),
k AS (SELECT *, {_strip_sql('line')} AS bare, lead(line) OVER w AS below FROM l WINDOW w AS (PARTITION BY vector_chunk_id ORDER BY n)),
c AS (SELECT *, regexp_matches(bare, '{_ATX}') AS atx, bare <> '' AND NOT regexp_matches(bare, '{_ATX}') AND coalesce(regexp_full_match(below, '{_WS}*(=+|-+){_WS}*'), false) AS cand FROM k),
i AS (SELECT *, n - row_number() OVER (PARTITION BY vector_chunk_id, cand ORDER BY n) AS island FROM c),
o AS (SELECT *, cand AND row_number() OVER (PARTITION BY vector_chunk_id, cand, island ORDER BY n) % 2 = 1 AS setext FROM i),
u AS (SELECT *, atx OR setext AS head, coalesce(lag(setext) OVER (PARTITION BY vector_chunk_id ORDER BY n), false) AS under FROM o),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY vector_chunk_id ORDER BY n) AS g FROM u),
h AS (SELECT vector_chunk_id, g, CASE WHEN atx THEN length(regexp_extract(bare, '^(#{{1,6}})', 1)) WHEN starts_with({_strip_sql('below')}, '=') THEN 1 ELSE 2 END AS level, CASE WHEN atx THEN {_strip_sql(f"regexp_extract(bare, '{_ATX}', 2)")} ELSE bare END AS title FROM g WHERE head),
body AS (SELECT vector_chunk_id, g, {_strip_sql("string_agg(line, chr(10) ORDER BY n)")} AS body FROM g WHERE NOT head AND NOT under GROUP BY 1, 2),
path AS (SELECT a.vector_chunk_id, a.g, a.level, string_agg(b.title, ' > ' ORDER BY b.g) AS path FROM h a JOIN h b ON b.vector_chunk_id = a.vector_chunk_id AND b.g <= a.g
 WHERE b.g = a.g OR NOT EXISTS (SELECT 1 FROM h c WHERE c.vector_chunk_id = a.vector_chunk_id AND c.g > b.g AND c.g <= a.g AND c.level <= b.level) GROUP BY 1, 2, 3),
every AS (SELECT vector_chunk_id, g, path, level, coalesce(body, '') AS body FROM path LEFT JOIN body USING (vector_chunk_id, g) UNION ALL SELECT vector_chunk_id, g, '', NULL, body FROM body WHERE g = 0 AND body <> '')"""


@query(
    f"""WITH {CHUNK}, {_SECTIONS}
SELECT vector_chunk_id, row_number() OVER (PARTITION BY vector_chunk_id ORDER BY g)::INTEGER AS piece_no, path, level::INTEGER AS level, body FROM every"""
)
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    cut = chunkers.exploded(_markdown(spark, d), ["text"], chunkers.sections, "path array<string>, level int, body string")
    return cut.select("vector_chunk_id", "piece_no", F.array_join("path", " > ").alias("path"), "level", "body")


@query(
    f"""WITH RECURSIVE {CHUNK}, {_SECTIONS}, led AS (SELECT vector_chunk_id, g, path, level, body AS t, (SELECT string_agg(concat(repeat('#', least(i, 6)), ' ', x), chr(10) ORDER BY i) FROM (SELECT unnest(string_split(path, ' > ')) AS x, generate_subscripts(string_split(path, ' > '), 1) AS i)) || chr(10) || chr(10) AS lead FROM every WHERE body <> ''),
todo AS (SELECT vector_chunk_id, g, t, greatest({chunkers.LEAST_BODY}, {S.chunk_size} - length(lead))::BIGINT AS size, {S.chunk_overlap}::BIGINT AS overlap FROM led), {_windows_sql('todo', 'vector_chunk_id, g')},
piece AS (SELECT vector_chunk_id, g, begun, path, level, {_strip_sql(f"lead || {_strip_sql('substring(c.t, begun + 1, stop - begun)')}")} AS content FROM cut c JOIN led USING (vector_chunk_id, g) WHERE stop IS NOT NULL AND {_strip_sql('substring(c.t, begun + 1, stop - begun)')} <> ''),
once AS (SELECT *, row_number() OVER (PARTITION BY vector_chunk_id, content ORDER BY g, begun) AS k FROM piece)
SELECT vector_chunk_id, row_number() OVER (PARTITION BY vector_chunk_id ORDER BY g, begun)::INTEGER AS piece_no, content, path, level::INTEGER AS level, 'markdown_heading' AS strategy FROM once WHERE k = 1"""
)
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda t: chunkers.heading_chunks(t, S.chunk_size, S.chunk_overlap)
    pieces = chunkers.exploded(_markdown(spark, d), ["text"], cut, "content string, path array<string>, level int, strategy string")
    return pieces.select("vector_chunk_id", "piece_no", "content", F.array_join("path", " > ").alias("path"), "level", "strategy")


_TABLES = "(?is)<table\\b.*?</table>"


def _atoms_sql(x: str) -> str:
    """Whole tables, and the filled lines between them."""
    between, held = f"regexp_split_to_array({x}, '{_TABLES}')", f"regexp_extract_all({x}, '{_TABLES}')"
    filled = f"list_filter(list_transform({_lines_sql(f'({between})[i + 1]')}, lambda y: {_strip_sql('y')}), lambda y: y <> '')"
    return f"flatten(list_transform(range(len({between})), lambda i: list_concat({filled}, CASE WHEN i < len({held}) THEN [{_strip_sql(f'({held})[i + 1]')}] ELSE [] END)))"


_BLOCKS = "block AS (SELECT DISTINCT block_id, heading, text FROM procedure_block)"


@query(
    f"""WITH {_BLOCKS}, whole AS (SELECT block_id, {_atoms_sql("concat_ws(chr(10), nullif(heading, ''), nullif(text, ''))")} AS a FROM block),
l AS (SELECT block_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM whole),
m AS (SELECT *, regexp_matches(line, '^\\s*\\d{{1,2}}\\s+[^.)、\\s]') AS h, sum(regexp_matches(line, '^\\s*\\d{{1,2}}\\s+[^.)、\\s]')::INT) OVER (PARTITION BY block_id ORDER BY n) AS g FROM l)
SELECT block_id, max(CASE WHEN h THEN regexp_extract(line, '^\\s*(\\d{{1,2}})\\s', 1)::INTEGER END) AS step, string_agg(line, chr(10) ORDER BY n) AS body FROM m GROUP BY block_id, g"""
)
def procedure_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the procedure blocks, their tables whole."""
    rows = table(spark, d, "procedure_block").select("block_id", "heading", "text").distinct()
    whole = rows.select("block_id", F.concat_ws("\n", F.nullif("heading", F.lit("")), F.nullif("text", F.lit(""))).alias("whole"))
    return chunkers.exploded(whole, ["whole"], chunkers.steps, "step int, heading string, body string").select("block_id", "step", "body")


_HEAD = "regexp_matches({}, '^\\s*\\d{{1,2}}\\s+[^.)、\\s]')"
_UNDER_STEP = "CASE WHEN starts_with(a[start + 1], head) THEN 0 ELSE length(head) + 1 END"


@query(
    f"""WITH RECURSIVE whole AS (SELECT document_id, page, source_file, block_id, concat_ws(chr(10), nullif(heading, ''), nullif(text, '')) AS w FROM (SELECT DISTINCT * FROM procedure_block) WHERE page IS NOT NULL),
src AS (SELECT document_id, page, min(source_file) AS source_file, string_agg(w, chr(10) ORDER BY block_id, w) AS body FROM whole GROUP BY 1, 2),
parts AS (SELECT document_id, page, {_atoms_sql('body')} AS a FROM src), l AS (SELECT document_id, page, unnest(a) AS atom, generate_subscripts(a, 1) AS n FROM parts),
m AS (SELECT *, {_HEAD.format('atom')} AS h, sum({_HEAD.format('atom')}::INT) OVER (PARTITION BY document_id, page ORDER BY n) AS g FROM l),
block AS (SELECT document_id, page, g, max(CASE WHEN h THEN regexp_extract(atom, '^\\s*(\\d{{1,2}})\\s', 1)::INTEGER END) AS step, string_agg(atom, chr(10) ORDER BY n) AS text, coalesce(any_value(CASE WHEN h THEN atom END), '') AS head,
 list(atom ORDER BY n) FILTER (NOT h) AS a FROM m GROUP BY 1, 2, 3),
long AS (SELECT *, list_transform(range(len(a) + 1), lambda i: coalesce(list_sum(list_transform(a[1:i], lambda x: length(x))), 0) + i) AS ends FROM block WHERE length(text) > {S.step_hard_max}),
cut AS (SELECT document_id, page, g, a, head, ends, 0::BIGINT AS start, 0::BIGINT AS stop, 0 AS k FROM long WHERE len(a) > 0
 UNION ALL SELECT document_id, page, g, a, head, ends, start, greatest(done + 1, len(list_filter(ends, lambda x: x <= ends[start + 1] + {S.step_hard_max} + 1 - {_UNDER_STEP})) - 1), k + 1 FROM
  (SELECT document_id, page, g, a, head, ends, k, stop AS done, CASE WHEN k = 0 THEN 0 ELSE greatest(start, len(list_filter(ends, lambda x: x <= ends[stop + 1] - {S.step_overlap})) - 1) END AS start FROM cut WHERE stop < len(a))),
single AS (SELECT document_id, page, g, 0 AS k, text FROM block WHERE length(text) <= {S.step_hard_max} OR len(coalesce(a, [])) = 0
 UNION ALL SELECT document_id, page, g, k, CASE WHEN {_UNDER_STEP} = 0 THEN '' ELSE head || chr(10) END || array_to_string(a[start + 1:stop], chr(10)) FROM cut WHERE k > 0),
items AS (SELECT s.*, step, row_number() OVER (PARTITION BY document_id, page ORDER BY g, k) AS n FROM single s JOIN block USING (document_id, page, g)),
fold AS (SELECT document_id, page, n, 1 AS piece_no, length(text) AS held FROM items WHERE n = 1
 UNION ALL SELECT i.document_id, i.page, i.n, CASE WHEN f.held + 1 + length(i.text) > {S.step_target} THEN f.piece_no + 1 ELSE f.piece_no END, CASE WHEN f.held + 1 + length(i.text) > {S.step_target} THEN length(i.text) ELSE f.held + 1 + length(i.text) END
 FROM fold f JOIN items i ON i.document_id = f.document_id AND i.page = f.page AND i.n = f.n + 1),
packed AS (SELECT document_id, page, piece_no, string_agg(text, chr(10) ORDER BY n) AS body FROM fold JOIN items USING (document_id, page, n) GROUP BY 1, 2, 3),
numbers AS (SELECT document_id, page, piece_no, string_agg(step, ',' ORDER BY first) AS steps FROM (SELECT document_id, page, piece_no, step, min(n) AS first FROM fold JOIN items USING (document_id, page, n) WHERE step IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT document_id, page, piece_no, concat('{chunkers.TOPIC}', coalesce(nullif(source_file, ''), '-'), chr(10), chr(10), packed.body) AS content, coalesce(steps, '') AS steps FROM packed JOIN src USING (document_id, page) LEFT JOIN numbers USING (document_id, page, piece_no)"""
)
def procedure_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Procedure blocks of a source page packed to retrieval size under the page's topic."""
    rows = table(spark, d, "procedure_block").distinct().withColumn("whole", F.concat_ws("\n", F.nullif("heading", F.lit("")), F.nullif("text", F.lit("")))).where("page is not null")
    of = rows.groupBy("document_id", "page").agg(F.min("source_file").alias("source_file"), F.array_join(F.array_sort(F.collect_list(F.struct("block_id", "whole")))["whole"], "\n").alias("body"))
    cut = lambda t, f: chunkers.step_chunks(t, [f or "-"], S.step_target, S.step_hard_max, S.step_overlap)
    pieces = chunkers.exploded(of, ["body", "source_file"], cut, "content string, steps array<int>")
    return pieces.select("document_id", "page", "piece_no", "content", F.array_join(F.transform("steps", lambda x: x.cast("string")), ",").alias("steps"))


_LEAKS = " OR ".join(f"starts_with({_strip_sql('z')}, '{prefix}')" for prefix in X.LEAK_PREFIXES)
_UNLEAKED = _strip_sql(f"regexp_replace(array_to_string(list_filter({_lines_sql('text')}, lambda z: NOT ({_LEAKS})), chr(10)), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")


@query(
    f"""WITH RECURSIVE {CHUNK}, {PAGE}, src AS (SELECT document_id, page, {_UNLEAKED} AS body FROM page_text), parts AS (SELECT document_id, page, {_atoms_sql('body')} AS a FROM src),
items AS (SELECT document_id, page, unnest(a) AS atom, generate_subscripts(a, 1) AS n FROM parts),
fold AS (SELECT document_id, page, n, 1 AS piece_no, length(atom) AS held FROM items WHERE n = 1
 UNION ALL SELECT i.document_id, i.page, i.n, CASE WHEN f.held + 1 + length(i.atom) > {S.step_target} THEN f.piece_no + 1 ELSE f.piece_no END, CASE WHEN f.held + 1 + length(i.atom) > {S.step_target} THEN length(i.atom) ELSE f.held + 1 + length(i.atom) END
 FROM fold f JOIN items i ON i.document_id = f.document_id AND i.page = f.page AND i.n = f.n + 1)
SELECT document_id, page, piece_no, string_agg(atom, chr(10) ORDER BY n) AS content FROM fold JOIN items USING (document_id, page, n) GROUP BY 1, 2, 3"""
)
def fallback_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = page_rows(spark, d).withColumn("text", X.without_leaks(F.col("text")))
    return chunkers.exploded(rows, ["text"], lambda t: chunkers.line_chunks(t, S.step_target), "content string").drop("text")


@query(
    f"""WITH {CHUNK} SELECT vector_chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, vector_chunk_id)::INTEGER AS chunk_index,
row_number() OVER (PARTITION BY document_id, page ORDER BY vector_chunk_id)::INTEGER AS page_chunk_index FROM chunk"""
)
def running_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """The chunks' places in their documents and pages."""
    return chunkers.indexed(chunk_rows(spark, d, "document_id", "page"), ["vector_chunk_id"]).select("vector_chunk_id", "chunk_index", "page_chunk_index")


_LEAD = "CASE WHEN path IS NULL THEN 0 ELSE length(topic) + 1 END"
_COUNTED = "list_transform(range(len(a) + 1), lambda i: coalesce(list_sum(list_transform(a[1:i], lambda x: length(x))), 0){})"


@query(
    f"""WITH RECURSIVE {CHUNK}, {PAGE}, rows AS (SELECT document_id, page, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM page_text),
line AS (SELECT document_id, page, unnest(l) AS raw, generate_subscripts(l, 1) AS n FROM rows), bare AS (SELECT *, {_strip_sql('raw')} AS title FROM line), shown AS (SELECT *, string_split({_LF.format('title')}, chr(10))[1] AS part FROM bare),
marked AS (SELECT *, title <> '' AND part <> '' AND length(part) <= 24 AND NOT contains('。．.：:；;，,', right(part, 1)) AND NOT regexp_matches(title, '^[0-9]+$|^\\s*[0-9]+[.)、]\\s+') AND lower(title) NOT IN ('ok', 'ng', 'ok或ng', '是或否', '是', '否') AND NOT starts_with(title, '<table') AS head FROM shown),
under AS (SELECT *, max(CASE WHEN head THEN n END) OVER (PARTITION BY document_id, page ORDER BY n ROWS UNBOUNDED PRECEDING) AS start_line, last_value(CASE WHEN head THEN title END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS path FROM marked),
body AS (SELECT document_id, page, coalesce(start_line, 0) AS begun, any_value(path) AS path, {_strip_sql('string_agg(raw, chr(10) ORDER BY n)')} AS body FROM under WHERE NOT head GROUP BY 1, 2, 3),
section AS (SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY begun) AS place, path, concat('{chunkers.TOPIC}', path) AS topic, {_FILLED.replace('text', 'body')} AS a FROM body WHERE body <> ''),
summed AS (SELECT *, {_COUNTED.format(' + i')} AS ends, {_COUNTED.format('')} AS sizes FROM section),
cut AS (SELECT document_id, page, place, path, topic, a, ends, sizes, 0::BIGINT AS start, 0::BIGINT AS stop, 0 AS k FROM summed
 UNION ALL SELECT document_id, page, place, path, topic, a, ends, sizes, start, greatest(done + 1, len(list_filter(ends, lambda x: x <= ends[start + 1] + {S.section_target} + 1 - {_LEAD})) - 1), k + 1 FROM
  (SELECT *, CASE WHEN k = 0 THEN 0 ELSE least(done, greatest(tail, len(list_filter(ends, lambda x: x < ends[done + 2] - 1 + {_LEAD} - {S.section_target})))) END AS start FROM
   (SELECT document_id, page, place, path, topic, a, ends, sizes, k, stop AS done, greatest(start, len(list_filter(sizes, lambda x: x <= sizes[stop + 1] - {S.section_overlap})) - 1) AS tail FROM cut WHERE stop < len(a)))),
piece AS (SELECT document_id, page, place, path, k, concat(CASE WHEN path IS NULL THEN '' ELSE topic || chr(10) END, array_to_string(a[start + 1:stop], chr(10))) AS content FROM cut WHERE k > 0),
once AS (SELECT *, row_number() OVER (PARTITION BY document_id, page, place, content ORDER BY k) AS again FROM piece)
SELECT document_id, page, place::INTEGER AS place, coalesce(path, '') AS section_path, row_number() OVER (PARTITION BY document_id, page, place ORDER BY k)::INTEGER AS piece_no, content FROM once WHERE again = 1"""
)
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut at headings a stand-in detector finds, packed under their path."""
    rows = page_rows(spark, d)
    lines = pages.numbered_lines(rows, "text").select("document_id", "page", "line_no", F.concat(F.col("line_no").cast("string"), F.lit("| "), X.strip(F.col("line"))).alias("shown"))
    numbered = lines.groupBy("document_id", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "shown")))["shown"], "\n").alias("numbered"))
    found = chunkers.exploded(numbered, ["numbered"], lambda t: [(h["start_line"], h["level"]) for h in models.rule_headings(t)], "start_line int, level int").select("document_id", "page", "start_line", "level")
    sections = toc.section_segments(rows, toc.sound_headings(found, rows))
    cut = lambda b, p: chunkers.section_chunks(b, list(p), S.section_target, S.section_overlap)
    return chunkers.exploded(sections, ["body", "section_path"], cut, "content string").select("document_id", "page", "place", F.array_join("section_path", " > ").alias("section_path"), "piece_no", "content")


# --- tables of contents -------------------------------------------------------------

_TOC = tuple((f"d{i}", 1, t, x, 60.0 + 20 * n, x + 150, 72.0 + 20 * n, 600.0) for i in (1, 2) for n, (t, x) in enumerate(
    (("目錄", 40.0), ("重要故障查修 ...... 4", 40.0), ("煞車控制", 52.0), ("故障 ..... 5", 52.0 + i), ("電動真空泵無作用 …… 6", 66.0), ("燈光 7", 52.5), ("12", 52.0), ("空調 ..... 21", 330.0), ("壓縮機 ... 23", 344.0))))
_TOC_SQL = "layout AS (SELECT * FROM (VALUES " + ", ".join("('{}', {}, '{}', {}, {}, {}, {}, {})".format(*r) for r in _TOC) + ") t(document_id, page, text, x0, y0, x1, y1, page_width))"


_ENTRIES = f"""{_TOC_SQL}, c AS (SELECT *, (x0 >= page_width / 2)::INT AS col, regexp_matches(text, '^.*?(?:[.…·．]{{2,}}|\\s+)\\s*\\d{{1,3}}\\s*$') AS e FROM layout WHERE text NOT IN ('目錄', '目录', '故障查修') AND NOT regexp_full_match(text, '\\d{{1,3}}')),
w AS (SELECT *, lag(text) OVER o AS pt, lag(e) OVER o AS pe, lag(x0) OVER o AS px FROM c WINDOW o AS (PARTITION BY document_id, page, col ORDER BY y0, x0)),
t AS (SELECT *, regexp_replace(regexp_extract(text, '^(.*?)(?:[.…·．]{{2,}}|\\s+)\\s*(\\d{{1,3}})\\s*$', 1), '[ .…·．。]+$', '') AS own FROM w WHERE e),
entry AS (SELECT document_id, page, col, x0, y0, CASE WHEN pt IS NOT NULL AND NOT pe AND abs(px - x0) <= 4.0 THEN pt || own ELSE own END AS title, regexp_extract(text, '(\\d{{1,3}})\\s*$', 1)::INTEGER AS target_page FROM t)"""


@query(f"WITH {_ENTRIES} SELECT document_id, page, title, target_page FROM entry")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return toc.toc_entries(spark.createDataFrame([tuple(r) for r in _TOC], schemas.LAYOUT_LINES)).select("document_id", "page", "title", "target_page")


@query(
    f"""WITH RECURSIVE {_ENTRIES}, xs AS (SELECT *, row_number() OVER (PARTITION BY document_id, page, col ORDER BY x) AS i FROM (SELECT DISTINCT document_id, page, col, round(x0, 1) AS x FROM entry)),
anchor AS (SELECT document_id, page, col, i, x, x AS anchor_x, 1 AS level FROM xs WHERE i = 1
 UNION ALL SELECT n.document_id, n.page, n.col, n.i, n.x, CASE WHEN n.x - a.anchor_x > 4.0 THEN n.x ELSE a.anchor_x END, CASE WHEN n.x - a.anchor_x > 4.0 THEN a.level + 1 ELSE a.level END FROM anchor a JOIN xs n ON n.document_id = a.document_id AND n.page = a.page AND n.col = a.col AND n.i = a.i + 1),
clusters AS (SELECT DISTINCT document_id, page, col, anchor_x, level FROM anchor), rooted AS (SELECT document_id, page, count(*) >= 3 AS root FROM clusters WHERE col = 0 GROUP BY 1, 2),
near AS (SELECT e.*, c.level - (coalesce(root, false) AND e.col = 0)::INT AS level FROM entry e JOIN clusters c USING (document_id, page, col) LEFT JOIN rooted r USING (document_id, page)
 QUALIFY row_number() OVER (PARTITION BY e.document_id, e.page, e.col, e.y0, e.x0 ORDER BY abs(c.anchor_x - e.x0), c.level) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY col, y0, x0) AS place FROM near),
path AS (SELECT a.document_id, a.page, a.place, string_agg(b.title, ' > ' ORDER BY b.place) AS path FROM placed a JOIN placed b ON b.document_id = a.document_id AND b.page = a.page AND b.place <= a.place
 WHERE b.place = a.place OR (a.level > 0 AND b.level >= 1 AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM placed c WHERE c.document_id = a.document_id AND c.page = a.page AND c.place > b.place AND c.place < a.place AND c.level <= b.level)) GROUP BY 1, 2, 3)
SELECT document_id, page, place::INTEGER AS place, title, target_page, level::INTEGER AS level, path FROM placed JOIN path USING (document_id, page, place)
WHERE {_title_key_sql('title')} <> '' QUALIFY row_number() OVER (PARTITION BY document_id, {_title_key_sql('title')} ORDER BY page, place) = 1"""
)
def toc_levels(spark: SparkSession, d: str) -> DataFrame:
    found = toc.toc_levels(toc.toc_entries(spark.createDataFrame([tuple(r) for r in _TOC], schemas.LAYOUT_LINES)))
    return found.withColumn("path", F.array_join("path", " > "))


def _line_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every page that has some, under the smallest heading of its chunks."""
    heads = table(spark, d, "chunk_metadata").where("page is not null").groupBy("document_id", "page").agg(F.min("heading").alias("head"))
    under = page_rows(spark, d).join(heads, ["document_id", "page"])
    rows = under.select("document_id", "page", F.posexplode_outer(F.concat(F.array(F.coalesce("head", F.lit(""))), X.lines(F.col("text")))).alias("line_no", "line"))
    return rows.withColumn("line", X.strip(F.col("line"))).where("line <> ''")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "chunk_metadata").where("heading is not null").select("document_id", F.col("heading").alias("title")).distinct()
    return known.select("document_id", "title", F.array("title").alias("path"))


@query(
    f"""WITH {CHUNK}, t AS (SELECT DISTINCT document_id, {_title_key_sql('heading')} AS key FROM chunk WHERE heading IS NOT NULL), h AS (SELECT document_id, page, {_title_key_sql('min(heading)')} AS key FROM chunk WHERE page IS NOT NULL GROUP BY document_id, page HAVING min(heading) IS NOT NULL)
SELECT h.document_id, h.page, h.key FROM h JOIN t USING (document_id, key) WHERE key <> ''"""
)
def title_match_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose smallest heading is a title of their document."""
    heads = chunk_rows(spark, d, "document_id", "page", "heading").where("page is not null").groupBy("document_id", "page").agg(F.min("heading").alias("line")).where("line is not null")
    known = _titles(spark, d).select("document_id", X.title_key(F.col("title")).alias("key")).distinct()
    return heads.select("document_id", "page", X.title_key(F.col("line")).alias("key")).where("key <> ''").join(known, ["document_id", "key"]).select("document_id", "page", "key")


@query()
def title_segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at lines that are (nearly) one of their titles."""
    return toc.segments(toc.titled_lines(_line_rows(spark, d), _titles(spark, d)).persist())


_LINES = f"""heads AS (SELECT document_id, page, min(heading) AS head FROM chunk WHERE page IS NOT NULL GROUP BY 1, 2),
raw AS (SELECT document_id, page, list_concat([coalesce(head, '')], {_lines_sql('text')}) AS l FROM page_text JOIN heads USING (document_id, page)),
line AS (SELECT document_id, page, generate_subscripts(l, 1) AS line_no, {_strip_sql('unnest(l)')} AS line FROM raw),
filled AS (SELECT *, {_title_key_sql('line')} AS key FROM line WHERE line <> '')"""


@query(
    f"""WITH {CHUNK}, {PAGE}, {_LINES}, titles AS (SELECT document_id, {_title_key_sql('heading')} AS key, min(heading) AS title FROM chunk WHERE heading IS NOT NULL GROUP BY 1, 2),
marked AS (SELECT f.*, t.title FROM filled f LEFT JOIN (SELECT * FROM titles WHERE key <> '') t USING (document_id, key)),
cut AS (SELECT *, sum((title IS NOT NULL)::INT) OVER w AS segment, last_value(title IGNORE NULLS) OVER w AS path FROM marked WINDOW w AS (PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING))
SELECT document_id, segment::BIGINT AS segment, coalesce(any_value(path), '') AS path, min(page) AS page_start, max(page) AS page_end, string_agg(line, chr(10) ORDER BY page, line_no) AS body FROM cut WHERE title IS NULL GROUP BY 1, 2"""
)
def title_segments_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at lines that are one of their titles."""
    titled = toc.titled_lines(_line_rows(spark, d), _titles(spark, d), nearly=False)
    found = toc.segments(kept(titled))
    return found.select("document_id", "segment", F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"), "page_start", "page_end", "body")


# --- grounding ----------------------------------------------------------------------

def _results(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as a ranked result of its document."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("vector_chunk_id"))
    return chunk_rows(spark, d, "document_id", "source_file", "page", "content").select("document_id", place.alias("rank"), "source_file", "page", "content")


@query(
    f"""WITH {CHUNK}, r AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY vector_chunk_id) AS rank, content FROM chunk),
l AS (SELECT document_id, rank, list_filter(list_transform({_lines_sql("coalesce(content, '')")}, lambda x: {_strip_sql('x')}), lambda x: x <> '') AS l FROM r),
n AS (SELECT document_id, rank, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM l) SELECT document_id, concat('S', rank, '-', line_no) AS citation_id, line FROM n"""
)
def line_citations(spark: SparkSession, d: str) -> DataFrame:
    return grounding.cited_lines(_results(spark, d), ("document_id",)).select("document_id", "citation_id", "line")


@query(
    f"""WITH {CHUNK}, r AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY vector_chunk_id) AS rank, coalesce(nullif(source_file, ''), '未知文件') AS source_file, coalesce(page, 0) AS page, content FROM chunk),
s AS (SELECT document_id, source_file, page, min(rank) AS first FROM r WHERE {_strip_sql("coalesce(content, '')")} <> '' GROUP BY 1, 2, 3)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY first)::INTEGER AS source_number, source_file, page FROM s"""
)
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return grounding.sources(_results(spark, d), ("document_id",)).select("document_id", "source_number", "source_file", "page")


@query(
    f"""WITH {CHUNK}, a AS (SELECT vector_chunk_id, concat(content, CASE chunk_index % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' [S1-1, S', page, '-2]') WHEN 2 THEN concat(' {grounding.REFUSAL} [S9-', chunk_index, ']') ELSE concat(' [S1-2][S', page, '-1]') END) AS answer FROM chunk WHERE content IS NOT NULL AND page IS NOT NULL AND chunk_index IS NOT NULL),
c AS (SELECT *, regexp_extract_all(array_to_string(regexp_extract_all(answer, '\\[([^\\[\\]]*S\\d+-\\d+[^\\[\\]]*)\\]', 1), ' '), 'S\\d+-\\d+') AS cited FROM a),
w AS (SELECT *, list_filter(cited, lambda x: x NOT IN ('S1-1', 'S1-2')) AS wrong, contains(answer, '{grounding.REFUSAL}') AS refused FROM c)
SELECT vector_chunk_id, refused OR (len(cited) > 0 AND len(wrong) = 0) AS passed, CASE WHEN refused THEN '' ELSE array_to_string(wrong, ',') END AS invalid FROM w"""
)
def citation_validation(spark: SparkSession, d: str) -> DataFrame:
    """Contents as answers: without citations, with sound and unsound ones, refusing."""
    place = F.col("chunk_index") % 4
    page, chunk = F.col("page").cast("string"), F.col("chunk_index").cast("string")
    end = (
        F.when(place == 0, "").when(place == 1, F.concat(F.lit(" [S1-1, S"), page, F.lit("-2]"))).when(place == 2, F.concat(F.lit(f" {grounding.REFUSAL} [S9-"), chunk, F.lit("]")))
        .otherwise(F.concat(F.lit(" [S1-2][S"), page, F.lit("-1]")))
    )
    rows = chunk_rows(spark, d, "page", "chunk_index", "content").where("content is not null and page is not null and chunk_index is not null")
    checked = rows.select("vector_chunk_id", grounding.validated(F.concat("content", end), F.array(F.lit("S1-1"), F.lit("S1-2"))).alias("v"))
    return checked.select("vector_chunk_id", "v.passed", F.array_join("v.invalid", ",").alias("invalid"))


_MESSAGES = """msg AS (SELECT document_id AS conversation_id, row_number() OVER (PARTITION BY document_id ORDER BY vector_chunk_id)::INTEGER AS position, CASE (chunk_index % 5) WHEN 0 THEN 'assistant' WHEN 1 THEN 'tool' WHEN 2 THEN 'system' ELSE 'user' END AS role, content FROM chunk)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the messages of a conversation per document."""
    role = F.when(F.col("chunk_index") % 5 == 0, "assistant").when(F.col("chunk_index") % 5 == 1, "tool").when(F.col("chunk_index") % 5 == 2, "system").otherwise("user")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("vector_chunk_id"))
    return chunk_rows(spark, d, "document_id", "chunk_index", "content").select(F.col("document_id").alias("conversation_id"), place.alias("position"), role.alias("role"), "content")


@query(
    f"""WITH {CHUNK}, {_MESSAGES}, s AS (SELECT conversation_id, position, role, {_strip_sql('content')} AS content FROM msg WHERE role IN ('user', 'assistant') AND {_strip_sql("coalesce(content, '')")} <> '')
SELECT conversation_id, position, role, content FROM s QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY position DESC) <= 12"""
)
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return grounding.history(_messages(spark, d), 12).select("conversation_id", "position", "role", "content")


@query(
    f"""WITH {CHUNK}, {_MESSAGES}, s AS (SELECT conversation_id, position, role, {_strip_sql('content')} AS content FROM msg WHERE role <> 'tool' AND {_strip_sql("coalesce(content, '')")} <> '')
SELECT conversation_id, string_agg(concat('<|im_start|>', role, chr(10), content, '<|im_end|>', chr(10)), '' ORDER BY position) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS prompt FROM s GROUP BY 1"""
)
def chatml_prompt(spark: SparkSession, d: str) -> DataFrame:
    return grounding.chat_prompt(_messages(spark, d))


@query(
    f"""WITH {CHUNK} SELECT vector_chunk_id, sha256(concat_ws(chr(10), concat('passage: 文件名稱：', coalesce(nullif(source_file, ''), '未知文件')), concat('文件標題：', coalesce(nullif(title, ''), {_STEM})),
CASE WHEN page IS NOT NULL THEN concat('頁碼：第 ', page, ' 頁') END, '', {_strip_sql("coalesce(content, '')")})) AS passage_sha256 FROM chunk"""
)
def passage_texts(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d, "source_file", "title", "page", "content").select("vector_chunk_id", F.sha2(X.passage_text(F.col("source_file"), F.col("title"), F.col("page"), F.col("content")), 256).alias("passage_sha256"))


@query(
    f"""WITH x AS (SELECT doc_id, concat('<think> ', lang, chr(10), text, ' </think>', chr(10), source, chr(10), text) AS t FROM documents)
SELECT doc_id, {_strip_sql(f"regexp_replace({_strip_sql("string_split(t, '</think>')[1]")}, '^<think>', '')")} AS reasoning, {_strip_sql("regexp_replace(t, '(?s)^.*?</think>', '')")} AS answer FROM x"""
)
def reasoning_split(spark: SparkSession, d: str) -> DataFrame:
    """Texts as reasoning and as answer."""
    part = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit("<think> "), part("lang"), F.lit("\n"), part("text"), F.lit(" </think>\n"), part("source"), F.lit("\n"), part("text"))
    return table(spark, d, "documents").select("doc_id", X.split_reasoning(text).alias("s")).select("doc_id", "s.reasoning", "s.answer")


@query(f"SELECT doc_id, {_strip_sql('concat(source, chr(10), text)')} AS answer FROM documents")
def reasoning_final(spark: SparkSession, d: str) -> DataFrame:
    """Answers behind the mark of the final answer, where reasoning stands untagged before it."""
    part = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit("Thinking process: "), part("lang"), F.lit("\nFinal Answer:"), part("source"), F.lit("\n"), part("text"))
    return table(spark, d, "documents").select("doc_id", X.split_reasoning(text)["answer"].alias("answer"))
