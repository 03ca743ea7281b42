"""All registered queries."""

from . import (  # noqa: F401
    feature_queries,
    model_queries,
    quality_queries,
    scoring_queries,
    workflow_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
