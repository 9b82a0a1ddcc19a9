"""All queries of this subpackage."""

from . import decontamination_queries, jaccard_queries, line_queries, lm_queries, quality_queries, rule_queries, run_queries, sentencepiece_queries, sharding_queries, token_queries, topk_queries, url_queries, whitening_queries  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
