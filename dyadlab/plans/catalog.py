"""All registered queries (importing a query module registers its entries)."""

from dyadlab.plans import audit_queries, cohort_queries, gate_queries, interval_queries, model_queries, resample_queries, risk_queries, scalar_queries  # noqa: F401
from dyadlab.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
