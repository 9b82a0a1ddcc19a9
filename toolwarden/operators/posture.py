"""Authentication and transport security of remote endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .findings import explode_findings, finding


def posture_hits():
    """The three endpoint checks as structs; scans without a posture row yield nothing."""
    plain = F.col("scheme") == "http"
    tls = F.col("tls_version")
    weak = ~plain & (tls != 0) & (tls < C.TLS_1_2)
    name = (F.when(tls == C.TLS_1_0, F.lit("TLS 1.0")).when(tls == C.TLS_1_1, F.lit("TLS 1.1"))
            .otherwise(F.lit("an old TLS/SSL version")))
    return {
        "unauthenticated_listing": F.when(
            F.col("unauthenticated_listing"), finding("authposture.unauthenticated_listing", F.lit(0))),
        "plaintext_http": F.when(plain, finding("authposture.plaintext_http", F.lit(1))),
        "weak_tls": F.when(weak, finding("authposture.weak_tls", F.lit(2), detail=(name,))),
    }


def posture_findings(posture: DataFrame, only: str | None = None) -> DataFrame:
    """Findings of all endpoint checks, or of the one named ``only``."""
    hits = posture_hits()
    return explode_findings(posture, *([hits[only]] if only else hits.values()))
