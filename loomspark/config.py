"""Defaults of the engine in one place (fixed values that results depend on)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_target: int = 650
    chunk_max: int = 900
    chunk_min: int = 120
    chunk_overlap: int = 80
    weight_vector: float = 0.7
    weight_lexical: float = 0.3
    top_k: int = 5
    neighbour_window: int = 1
    expansion_cap: int = 12
    expansion_base: int = 8
    expansion_docs: int = 4
    extra_total: int = 12
    link_depth: float = 1.5
    link_docs: int = 1
    link_chunks: int = 2
    extra_per_document: int = 6
    fetch_lexical: int = 20
    fetch_vector: int = 20
    redundancy_threshold: float = 0.92
    min_gain: float = 0.01
    max_context_tokens: int = 65_536
    context_margin: int = 256
    sentence_similarity: float = 0.65
    lexical_support: float = 0.25
    history_turns: int = 6
    history_tokens: int = 2_048
    topic_reset: float = 0.35
    summary_turns: int = 12
    idle_minutes: int = 30
    boost_cap: float = 0.12
    boost_floor: float = 0.3
    boost_step: float = 0.2
    boost_rows: int = 20
    decay_score: float = 0.92
    decay_component: float = 0.95
    rate_window_s: int = 60
    rate_limit: int = 30
    rate_burst: int = 10
    words_to_tokens: float = 1.33

    def __post_init__(self) -> None:
        if abs(self.weight_vector + self.weight_lexical - 1) > 1e-9:
            raise ValueError("the fusion weights must add up to 1")
        if not 0 <= self.chunk_overlap < self.chunk_max or self.chunk_min > self.chunk_target or self.chunk_target > self.chunk_max:
            raise ValueError("chunk sizes must satisfy min <= target <= max and overlap < max")


DEFAULTS = Config()
