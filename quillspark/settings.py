"""Default constants of the evidence engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The engine's published defaults."""

    child_size: int = 350
    child_overlap: int = 50
    parent_size: int = 900
    parent_overlap: int = 100
    rrf_constant: int = 60
    vector_weight: float = 1.0
    graph_weight: float = 0.85
    lexical_weight: float = 0.90
    candidate_depth: int = 40
    rerank_documents: int = 10
    local_per_document: int = 6
    local_max: int = 80
    chunks_per_document: int = 2
    slot_match_top: int = 4
    base_weight: float = 1.0
    slot_weight: float = 1.0
    window_neighbours: int = 1
    window_chars: int = 8000
    answer_chunks: int = 8
    answer_chars: int = 18000
    top_k: int = 8
    max_top_k: int = 20
    debounce_seconds: float = 2.0
    retries: int = 3
    error_chars: int = 2000
    quote_chars: int = 300
    rerank_chars: int = 8000
    row_batch: int = 20
    max_depth: int = 64
    max_nodes: int = 200_000


DEFAULTS = Settings()
