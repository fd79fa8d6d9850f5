"""Settings of ingestion and retrieval, with named profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """All thresholds in one place; ``validated`` refuses values that make no sense."""

    chunk_size: int = 1200
    chunk_overlap: int = 180
    window_tokens: int = 400
    window_overlap: int = 60
    step_target: int = 320
    step_hard_max: int = 520
    step_overlap: int = 40
    section_target: int = 500
    section_overlap: int = 60
    document_top_k: int = 3
    dense_candidates: int = 20
    top_k: int = 6
    document_min_score: float = 0.25
    min_rerank_score: float = 0.50
    lexical_accept: float = 0.95
    router_margin: float = 0.035
    max_context_chars: int = 9000
    representative_count: int = 6
    summary_weight: float = 0.65
    watch_interval_s: int = 15
    settle_s: int = 5
    upload_limit: int = 30 * 1024 * 1024
    context_tokens: int = 8192
    answer_tokens: int = 768

    def validated(self) -> Settings:
        sizes = (("chunk_size", "chunk_overlap"), ("window_tokens", "window_overlap"), ("step_hard_max", "step_overlap"), ("section_target", "section_overlap"))
        for size, overlap in sizes:
            if not 0 <= getattr(self, overlap) < getattr(self, size):
                raise ValueError(f"{overlap} must be at least 0 and below {size}")
        for name in ("document_top_k", "dense_candidates", "top_k", "max_context_chars", "representative_count"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.top_k > self.dense_candidates:
            raise ValueError("top_k can't exceed dense_candidates")
        for name in ("min_rerank_score", "summary_weight", "lexical_accept"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        return self


PROFILES: dict[str, Settings] = {
    "cli": Settings(),
    "api": replace(Settings(), max_context_chars=7000),
    "engine": replace(Settings(), min_rerank_score=0.25),
    "gui": replace(Settings(), min_rerank_score=0.25, max_context_chars=7000),
}
