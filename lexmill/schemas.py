"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

PAGE = "document_id string NOT NULL, page int NOT NULL, text string, extraction_method string"
CHUNK = (
    "chunk_id string NOT NULL, document_id string NOT NULL, source_file string, source_path string, page int, page_start int, page_end int,"
    " chunk_index int, page_chunk_index int, content string, content_sha256 string,"
    " metadata struct<title: string, pdf_sha256: string, page_count: int, section_path: array<string>, section_title: string,"
    " procedure_steps: array<int>, chunking_strategy: string>"
)
INDEX_CHUNK = (
    "vector_chunk_id string NOT NULL, parent_chunk_id string, document_id string NOT NULL, source_file string, source_path string, title string,"
    " page int, page_start int, page_end int, chunk_index int, page_chunk_index int, sub_chunk_index int, sub_chunk_count int, token_count int,"
    " token_start int, token_end int, content string, content_sha256 string, embedding_text_sha256 string, faiss_id int, embedding array<float>"
)
DOCUMENT = (
    "faiss_id int, document_id string NOT NULL, source_file string, source_path string, title string, page_count int, indexed_page_numbers array<int>,"
    " indexed_chunk_count int, vector_source string, summary_available boolean, summary string, topics array<string>,"
    " representative_chunk_ids array<string>, embedding array<double>"
)
DOCUMENT_SUMMARY = "document_id string, title string, summary string, purpose string, intended_audience string, topics array<string>"
EMBEDDING_CACHE = (
    "cache_key string NOT NULL, cache_format_version int, model_fingerprint string NOT NULL, text_sha256 string, dimension int,"
    " vector array<float>, created_at timestamp"
)
PAGE_STATUS = "document_id string, ocr_config_hash string, page int, status string, attempts int, last_error string, updated_at timestamp"
CATALOG = (
    "source_path string, source_file string, document_id string, ocr_config_hash string, cache_dir string, page_count int, status string, error string"
)
LAYOUT_LINES = "document_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, page_width double"
LAYOUT_BLOCKS = "document_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"
HEADING = "document_id string, page int, start_line int, level int, title string"
MESSAGE = "conversation_id string, position int, role string, content string"
DECISION = "decision string, severity string, confidence double, reason string, sop_reference string, actions array<string>"
