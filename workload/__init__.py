"""Queries over the driver's tables, with their oracles."""

from workload.registry import QUERIES
from workload import curation_queries, evaluation_queries, inference_queries, source_queries  # noqa: F401

__all__ = ["QUERIES"]
