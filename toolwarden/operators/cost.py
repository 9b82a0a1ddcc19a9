"""What a server's tool definitions cost on every request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.detect import quoted
from ..functions.jsontext import json_depth
from ..functions.tokens import scale_tokens, serialize_tool, token_base
from ..session import stored
from .findings import SERVER_SEQ, TOOL_STRIDE, explode_findings, finding
from .ranking import rank_within


def tool_tokens(tools: DataFrame, tokenizer=token_base) -> DataFrame:
    """Add the unscaled token count of each tool and its count for the first model.

    ``tokenizer`` maps a text column to a count column, so an exact tokenizer can
    replace the estimate.
    """
    if "token_base" in tools.columns:
        return tools
    text = serialize_tool(F.col("name"), F.col("description"), F.col("input_schema"))
    return (tools.withColumn("token_base", tokenizer(text))
            .withColumn("tokens", scale_tokens(F.col("token_base"), C.MODELS[0][3])))


def model_costs(tools: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """One row per scan: tool_count, and ``models`` with tokens and price per request of each model.

    Per-tool counts are rounded before they are summed.  ``scans`` adds zero rows for scans
    without tools.
    """
    sums = [F.sum(scale_tokens(F.col("token_base"), factor)).alias(f"t{i}")
            for i, (_, _, _, factor) in enumerate(C.MODELS)]
    totals = tool_tokens(tools).groupBy("scan_id").agg(F.count("*").alias("tool_count"), *sums)
    if scans is not None:
        totals = scans.select("scan_id").join(totals, "scan_id", "left").na.fill(0)
    rows = F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(family).alias("family"),
                 F.col(f"t{i}").cast("bigint").alias("tokens"),
                 (F.col(f"t{i}") / F.lit(1_000_000.0) * F.lit(price)).alias("usd_per_request"))
        for i, (name, family, price, _) in enumerate(C.MODELS)])
    return totals.select("scan_id", "tool_count", rows.alias("models"))


def model_cost(tools: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Tokens and price per request for each model; scans are fanned out to the models last."""
    return model_costs(tools, scans).select("scan_id", "tool_count", F.explode("models").alias("m")).select(
        "scan_id", "tool_count", "m.*")


def per_tool_tokens(tools: DataFrame) -> DataFrame:
    """Tools of each scan, most expensive first; ``rank`` starts at 1, ties keep list order.

    Texts are read once: their counts are stored, and the ranking reads only these.
    """
    counted = stored(tool_tokens(tools).select("scan_id", "pos", F.col("name").alias("tool"), "tokens"), "token-counts")
    return rank_within(counted, ["scan_id"], major=-F.col("tokens"), minor=F.col("pos"), name="rank")


def schema_depth(tools: DataFrame) -> DataFrame:
    """Add ``depth``: how deep each input schema nests."""
    return tools.withColumn("depth", json_depth(F.col("input_schema")))


def bloat_hit():
    """The struct for an input schema nested deeper than can be justified."""
    return F.when(F.col("depth") > C.SCHEMA_DEPTH_LIMIT, finding(
        "context.schema_bloat", F.col("pos").cast("bigint") * TOOL_STRIDE, tool=F.col("name"),
        detail=(F.col("depth"),), meta=F.to_json(F.struct("depth"))))


def schema_bloat(tools: DataFrame) -> DataFrame:
    """Findings for over-deep input schemas."""
    return explode_findings(schema_depth(tools), bloat_hit())


def oversized_tool(tools: DataFrame) -> DataFrame:
    """One tool takes over 40% of the budget and over twice its even share.

    The top tool is a partial maximum, so a server with very many tools is never
    sorted or gathered.
    """
    top = F.max_by(F.col("name"), F.struct(F.col("tokens"), -F.col("pos"))).alias("top_name")
    per_scan = (tool_tokens(tools).groupBy("scan_id")
                .agg(F.sum("tokens").alias("total"), F.max("tokens").alias("tokens"),
                     F.count("*").alias("n"), top))
    share = F.col("tokens") / F.col("total")
    big = per_scan.where((F.col("total") > 0) & (share > C.OVERSIZED_SHARE) & (share > 2 / F.col("n")))
    percent = F.bround(share * 100, 0).cast("bigint")
    return explode_findings(big, finding(
        "context.oversized_tool", F.lit(SERVER_SEQ), tool=F.col("top_name"),
        detail=(quoted(F.col("top_name")), percent), meta=F.to_json(F.struct("tokens", "total"))))
