"""Who used what: totals A1, by model A2, tool A3, server A4, families A5, A6, cache A7, A8, harness A9, A10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output", "context_total")
UNATTRIBUTED = "(unattributed)"


def sums() -> list[Column]:
    """Token sums, cost and whether all is priced; of nothing, zeros and true."""
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]
    return [*tokens, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.bool_and("priced"), F.lit(True)).alias("priced")]


def session_totals(turns: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A1: a line a session, also for one without turns if sessions are given."""
    out = turns.groupBy("session_key").agg(*sums())
    if sessions is None:
        return out
    empty = dict.fromkeys(TOKENS, 0) | {"cost": 0.0}
    return sessions.select("session_key").join(out, "session_key", "left").fillna(empty).withColumn("priced", F.coalesce("priced", F.lit(True)))


def by_model(turns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A2: by model (and keys); models of turns without usage have their line too."""
    return turns.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("turns"), *sums())


def tool_spans(spans: DataFrame) -> DataFrame:
    """P33, P34."""
    return spans.filter(F.col("category").isin("toolCallArgs", "toolResults")).withColumn("tool_name", F.coalesce("tool_name", F.lit(UNATTRIBUTED)))


def _span_sums() -> list[Column]:
    call, result = F.col("category") == "toolCallArgs", F.col("category") == "toolResults"
    return [
        F.sum(F.when(call, F.col("char_count")).otherwise(0)).cast("long").alias("call_chars"), F.count_if(call).alias("call_spans"),
        F.sum(F.when(result, F.col("char_count")).otherwise(0)).cast("long").alias("result_chars"), F.count_if(result).alias("result_spans"),
        F.sum("char_count").cast("long").alias("total_chars"), F.count(F.lit(1)).alias("total_spans"), F.ceil(F.sum("char_count") / 4).cast("long").alias("tokens_est"),
    ]


def by_tool(spans: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("session_key", "turn_index", "ord")) -> DataFrame:
    """A3: by tool (and keys): characters and spans of calls and results; the server is the first one seen, in `order`."""
    first = F.min_by(F.when(F.col("mcp_server").isNotNull(), F.col("mcp_server")), F.when(F.col("mcp_server").isNotNull(), F.struct(*order)))
    return tool_spans(spans).groupBy(*keys, "tool_name").agg(first.alias("mcp_server"), *_span_sums())


def by_server(spans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A4: by MCP server (and keys), with its tools' names in order."""
    return tool_spans(spans).filter("mcp_server is not null").groupBy(*keys, "mcp_server").agg(F.array_sort(F.collect_set("tool_name")).alias("tools"), *_span_sums())


def subagent_rollup(turns: DataFrame) -> DataFrame:
    """By family: of the parent (member 0), the children together and both, over turns of zero_family_replays(); the
    children's share of the cost is 0 where there is none."""
    parent, child = F.col("member_ordinal") == 0, F.col("member_ordinal") > 0
    tokens = F.col("context_total") + F.col("output")
    of = lambda held, x: F.coalesce(F.sum(F.when(held, x)), F.lit(0))
    out = turns.groupBy("family_id").agg(
        F.countDistinct(F.when(child, F.col("member_ordinal"))).alias("children"),
        of(parent, tokens).cast("long").alias("parent_tokens"), of(child, tokens).cast("long").alias("child_tokens"), F.sum(tokens).cast("long").alias("combined_tokens"),
        of(parent, F.col("cost")).cast("double").alias("parent_cost"), of(child, F.col("cost")).cast("double").alias("child_cost"), F.sum("cost").alias("combined_cost"), F.bool_and("priced").alias("priced"),
    )
    return out.withColumn("child_cost_share", F.when(F.col("combined_cost") > 0, F.col("child_cost") / F.col("combined_cost")).otherwise(F.lit(0.0)))


def by_member(turns: DataFrame) -> DataFrame:
    """Each member of each family by itself."""
    return turns.groupBy("family_id", "member_ordinal").agg(F.count(F.lit(1)).alias("turns"), *sums())


def cache_use(turns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the cache's counters, the share of input that was read from it, and the tokens that missed."""
    read, all_input = F.sum("cache_read"), F.sum(F.col("input_uncached") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h"))
    return turns.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS[:4]],
        F.coalesce(F.when(all_input > 0, read / all_input), F.lit(0.0)).alias("hit_rate"),
        F.count("cache_miss_type").alias("misses"), F.coalesce(F.sum("cache_missed_tokens"), F.lit(0)).cast("long").alias("wasted_tokens"),
    )


def by_harness(totals: DataFrame) -> DataFrame:
    """By harness and, as the null harness, over all: one aggregation with a rollup."""
    return totals.rollup("harness").agg(F.count(F.lit(1)).alias("sessions"), F.sum("context_total").cast("long").alias("context_total"), F.sum("output").cast("long").alias("output"), F.sum("cost").alias("cost"), F.bool_and("priced").alias("priced"))
