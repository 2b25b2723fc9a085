"""Registered queries (one per operator key of the inventory) and the oracle check."""

from . import extract_plans, feature_plans, io_plans, maintain_plans, profile_plans, runs_plans, stream_plans, study_plans, table_plans  # noqa: F401
from . import live_plans  # noqa: F401  (after the plans whose SQL it goes on from)
from .registry import REGISTRY, oracle_sqls, spark_queries  # noqa: F401
