"""Thresholds every operator takes as plain arguments, gathered in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Mapping

from cartlens.fixed_values import DEFAULT_MARGIN, MARGIN_RATES

SQL = "sql"
FRAME = "frame"


def check_dialect(dialect: str) -> str:
    """The same report exists in two dialects with different day and tie rules."""
    if dialect not in (SQL, FRAME):
        raise ValueError(f"dialect must be '{SQL}' or '{FRAME}', got {dialect!r}")
    return dialect


@dataclass(frozen=True)
class Thresholds:
    cutoff_date: str = "2018-10-17"
    # churn
    churn_percentile: float = 0.75
    churn_multiplier: float = 2.0
    min_orders: int = 2
    # reviews and delivery
    low_review_score: int = 2
    high_review_score: int = 4
    severe_delay_days: int = 7
    # scoring
    rfm_bins: int = 4
    # models
    test_size: float = 0.2
    cv_folds: int = 5
    smote_enabled: bool = True
    seed: int = 42
    # clustering
    min_k: int = 2
    max_k: int = 8
    # matching
    caliper: float = 0.05
    wide_caliper: float = 0.1
    min_match_rate: float = 0.5
    neighbours: int = 10
    smd_threshold: float = 0.1
    bootstrap_n: int = 100
    # margins
    margin_rates: Mapping[str, float] = field(default_factory=lambda: MappingProxyType(dict(MARGIN_RATES)))
    default_margin: float = DEFAULT_MARGIN

    def with_(self, **changes) -> "Thresholds":
        return replace(self, **changes)
