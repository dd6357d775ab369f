"""All registered queries, gathered from the query modules."""

from __future__ import annotations

from raingrid.plans import (  # noqa: F401
    q_align, q_clean, q_decide, q_fitting, q_forecast, q_impute, q_linear, q_patterns, q_quality,
    q_sources, q_stats, q_trends, q_windows,
)
from raingrid.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
