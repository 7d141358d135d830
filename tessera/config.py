"""Numbers that define the semantics of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# Names and numbers that results depend on.
RELATIONSHIPS = ("supports", "contradicts", "example_of", "caused_by", "related_to")
BASE_WEIGHTS = {"supports": 0.8, "contradicts": 0.7, "example_of": 0.75, "caused_by": 0.75, "related_to": 0.3}
SUPPORTING = ("supports", "example_of", "caused_by")
DEFAULT_DATABASE = "default"
UNLABELED = "Unlabeled Concept"
BENCHMARK_QUERIES = (
    "What is the main topic of this document?",
    "How does memory consolidation work?",
    "What are the key concepts discussed?",
    "Explain the relationship between learning and memory.",
    "What methods are used for knowledge representation?",
)
NO_CONTEXT = "No relevant information was found."


@dataclass(frozen=True)
class Config:
    """Defaults of all operators; every one is also a parameter of the operator that uses it."""

    embed_dims: int = 384
    embed_max_tokens: int = 512
    embed_chars_per_token: int = 12
    concept_boost: float = 0.08
    concept_top_k: int = 3
    concept_min_score: float = 0.45
    min_score: float = 0.35
    max_context_tokens: int = 500
    context_top_k: int = 3
    max_evidence: int = 5
    chunk_min_tokens: int = 350
    chunk_max_tokens: int = 500
    chunk_overlap_tokens: int = 40
    semantic_min_tokens: int = 60
    semantic_max_tokens: int = 400
    llm_window_tokens: int = 1200
    llm_overlap_tokens: int = 200
    max_hops: int = 2
    hop_decay: float = 0.9
    min_edge_weight: float = 0.3
    rerank_candidates: int = 20
    rerank_weight: float = 0.4
    rescore_exponent: float = 2.5
    vector_weight: float = 0.6
    graph_weight: float = 0.25
    prior_weight: float = 0.15
    duplicate_threshold: float = 0.97
    seed_fan_out: int = 6
    seed_weight: float = 0.3
    seed_confidence: float = 0.5
    ingest_batch: int = 32
    hebbian_rate: float = 0.05
    base_decay: float = 0.01
    stale_days: int = 7
    stale_factor: float = 1.5
    weight_low: float = 0.05
    weight_high: float = 1.0
    hot_access: int = 3
    cluster_min_size: int = 3
    cluster_min_weight: float = 0.6
    merge_jaccard: float = 0.7
    merge_cosine: float = 0.85
    validation_least: float = 0.3
    leader_cosine: float = 0.85
    hebbian_cosine: float = 0.4
    prior_min_samples: int = 10
    prior_epochs: int = 3
    prior_batch: int = 8


CONFIG = Config()
