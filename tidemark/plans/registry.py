"""All registered queries."""

from tidemark.plans import queries_inject, queries_models, queries_reports, queries_scores, queries_stream, queries_windows  # noqa: F401
from tidemark.plans.catalog import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
