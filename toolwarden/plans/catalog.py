"""All registered queries."""

from . import analysis_queries, drift_queries, index_queries, source_queries, stream_queries  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
