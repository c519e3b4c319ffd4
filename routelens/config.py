"""Run configuration: one dataclass, no hidden defaults elsewhere."""

from __future__ import annotations

from dataclasses import dataclass

# Grids and levels that must match for results to be comparable.
BETA_GRID = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.2, 1.6, 2.4, 3.2)
COVERAGE_LEVELS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
ECE_BINS = 15
AURC_POINTS = 50
CONFORMAL_DELTAS = (0.10, 0.20, 0.30, 0.40)
TARGET_SHARES = (0.60, 0.30, 0.10)


@dataclass(frozen=True)
class RouterConfig:
    """Everything a routing run depends on."""

    pool: tuple[str, ...] = ("v_cheap", "v_mid", "v_high")
    features: tuple[str, ...] = (
        "structured_source_line_ratio",
        "bm25_mean3",
        "entity_coverage",
        "entity_value_colocation",
        "year_count",
        "conflicting_value_rate",
    )
    beta_grid: tuple[float, ...] = BETA_GRID
    quality_tolerance: float = 0.005
    validation_fraction: float = 0.2
    folds: int = 10
    latency_ceiling: float = 1.5
    num_trees: int = 200
    max_depth: int = 10
    min_leaf: int = 5
    draws: int = 2000
