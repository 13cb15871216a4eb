"""Defaults that define the semantics of the operators. Fixed values, passed explicitly as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Weights of the trend components.
SCORE_WEIGHTS = {
    "freshness": 0.10,
    "independent_sources": 0.12,
    "velocity": 0.14,
    "scale": 0.07,
    "novelty": 0.06,
    "significance": 0.10,
    "practical_value": 0.10,
    "audience_interest": 0.06,
    "discussion": 0.04,
    "fact_sufficiency": 0.06,
    "source_quality": 0.06,
    "feasibility": 0.04,
    "historical": 0.05,
}


@dataclass(frozen=True)
class TrendSettings:
    half_life_h: float = 14.0
    velocity_window_h: float = 2.0
    saturation: float = 12.0
    world_priority: float = 0.92
    max_age_h: float = 72.0
    weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))


@dataclass(frozen=True)
class FunnelSettings:
    stages: tuple = (50, 15, 10, 5)
    score_floor: float = 28.0
    min_facts: int = 2
    max_unverified: int = 2
    geo_target: float = 0.6
    geo_strength: float = 0.35
    look_ahead: int = 80


@dataclass(frozen=True)
class LearningSettings:
    half_life_days: float = 90.0
    shrink_n: float = 15.0
    history_shrink: float = 5.0
