"""Parameters of every phase. The defaults are fixed values of the risk model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IngestConfig:
    event_types: tuple[str, ...] = (
        "TRANSACTION", "EMAIL", "SMS", "LOG_ACCES", "APPROBATION", "PARTAGE_IP", "COSIGNATURE", "PARTAGE_ADRESSE",
    )
    source_types: tuple[str, ...] = ("INTERNE", "EXTERNE")
    dedup_seconds: int = 3600
    spike_factor: float = 10.0
    spike_minutes: int = 10
    flag_age_days: int = 30
    reject_age_days: int = 180
    min_corroboration: float = 0.33
    max_sources: int = 5
    outlier_factor: float = 5.0
    outlier_history: int = 1000
    outlier_min: int = 10
    max_jump: int = 2


@dataclass(frozen=True)
class ResolutionConfig:
    merge_at: float = 0.80
    prefilter: float = 0.30
    weights: tuple[tuple[str, float], ...] = (
        ("nom", 0.15), ("phonetique", 0.08), ("adresse", 0.12), ("telephone", 0.15),
        ("email", 0.15), ("adresse_ip", 0.12), ("numero_compte", 0.13), ("siret", 0.10),
    )
    synthetic_days: int = 30
    synthetic_min: int = 3
    nulls_match: bool = True  # two missing values of an exact attribute count as equal


@dataclass(frozen=True)
class GraphConfig:
    causal_hours: int = 72
    inactive_days: int = 365
    causal_patterns: tuple[tuple[str, str], ...] = (
        ("EMAIL", "TRANSACTION"), ("TRANSACTION", "TRANSACTION"), ("LOG_ACCES", "TRANSACTION"), ("EMAIL", "APPROBATION"),
    )


@dataclass(frozen=True)
class TopologyConfig:
    damping: float = 0.85
    max_rounds: int = 100
    tolerance: float = 1e-6
    clique_min: int = 3
    hub_factor: float = 3.0
    dedup_paths: bool = False  # True: out-degree counts distinct successors, so no rank leaks
    closeness_depth: int = 3


@dataclass(frozen=True)
class ConfidenceConfig:
    frequency: float = 0.25
    recency: float = 0.20
    diversity: float = 0.20
    jaccard: float = 0.20
    corroboration: float = 0.15
    decay_per_day: float = 0.005
    whitelist_factor: float = 0.30
    proof_types: int = 5
    null_draws: int = 1000
    z_limit: float = 2.0
    skew_limit: float = 0.50


@dataclass(frozen=True)
class CommunityConfig:
    overlap_stable: float = 0.70
    overlap_transition: float = 0.30
    fragmentation: int = 5
    cohesion_levels: tuple[float, float, float] = (0.05, 0.30, 0.60)
    core_density: float = 0.70
    core_age_days: int = 30


@dataclass(frozen=True)
class ScoringConfig:
    trees: int = 100
    sample: int = 256
    weight_forest: float = 0.40
    weight_propagation: float = 0.60
    cost_false_negative: float = 50000.0
    cost_false_positive: float = 200.0
    default_risk: float = 0.1
    default_confidence: float = 0.5
    layers: int = 2

    @property
    def threshold(self) -> float:
        return self.cost_false_positive / (self.cost_false_positive + self.cost_false_negative)


@dataclass(frozen=True)
class FeedbackConfig:
    train_share: float = 0.70
    retrain_at: int = 50
    neighbour_step: float = 0.10
    community_step: float = 0.05
    false_positive_step: float = 0.15
    cohesion_at: float = 0.50
    max_disparity: float = 1.50
