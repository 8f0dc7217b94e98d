"""Defaults of the operators; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_size: int = 500
    chunk_overlap: int = 50
    chunk_minimum: int = 100
    max_file_bytes: int = 50 * 1024 * 1024
    extensions: tuple[str, ...] = (".pdf", ".docx", ".txt", ".md")
    retrieve_k: int = 10
    return_k: int = 5
    score_threshold: float = 0.30
    alpha: float = 0.5
    rrf_k: int = 60
    rerank_original: float = 0.3
    rerank_new: float = 0.7
    prefix_chars: int = 120
    compare_chars: int = 80
    history_turns: int = 6
    turn_chars: int = 400
    rewrite_turns: int = 2
    max_conversations: int = 1000
    max_messages: int = 50
    cache_ttl_s: int = 3600
    table_rows_limit: int = 10
    table_batch: int = 5
    excerpt_chars: int = 500
    faithful_at: float = 0.4
    new_numbers_over: float = 0.3
    dissimilar_under: float = 0.3


DEFAULTS = Defaults()
