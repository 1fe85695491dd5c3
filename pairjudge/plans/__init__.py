"""Registered queries (one per operator key) and their DuckDB oracle SQL."""

from pairjudge.plans import q_agree, q_io, q_metrics, q_runs, q_scoring, q_screen, q_stats, q_text  # noqa: F401  (registration side effects)
from pairjudge.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
