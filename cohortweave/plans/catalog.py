"""Importing this module fills the registry."""

from cohortweave.plans.registry import ORACLES, QUERIES
from cohortweave.plans import queries_metrics, queries_models, queries_space, queries_spatial, queries_tables, queries_values  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
