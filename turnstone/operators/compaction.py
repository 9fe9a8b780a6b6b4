"""Compaction events: anchors J11-J13, deltas C10, completion C11, the summary's estimate C18.

events: (session_key, ord, turn_index, tokens_before, tokens_after, shrink, discarded_est, summary_tokens_est, ...). A null
number is unknown, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary_estimate(chars: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(chars / 4).cast("long")


def deltas(before: Column, after: Column, summary: Column) -> tuple[Column, Column]:
    """(shrink, discarded): null unless both ends are known."""
    shrink = before - after
    return shrink, shrink + summary


def anchors(events: DataFrame, turns: DataFrame) -> DataFrame:
    """J11, J12 (by index): events with near_before, of the last turn with usage before turn_index, and near_after, of the
    first at or after it.

    Turns and events are one sorted sequence a session, so both as-of lookups are one window pass, without a range join.
    At one index events come before the turn, which makes 'before' strict and 'after' inclusive.
    """
    turn = turns.select("session_key", F.col("turn_index").alias("__at"), F.lit(1).alias("__kind"), F.when(F.col("context_total") != 0, F.col("context_total")).alias("__usage"))
    event = events.withColumn("__event", F.struct(*events.columns)).select("session_key", F.col("turn_index").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__usage"), "__event")
    rows = turn.unionByName(event, allowMissingColumns=True)
    order = Window.partitionBy("session_key").orderBy("__at", "__kind")
    rows = rows.withColumn("near_before", F.last("__usage", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("near_after", F.first("__usage", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return rows.filter("__kind = 0").select("__event.*", "near_before", "near_after")


def finalize(events: DataFrame, turns: DataFrame) -> DataFrame:
    """C11: fill what is null from the anchors; deltas that are there stay as they are, so doing it twice changes nothing."""
    rows = anchors(events, turns).withColumn("tokens_before", F.coalesce("tokens_before", "near_before")).withColumn("tokens_after", F.coalesce("tokens_after", "near_after"))
    shrink, discarded = deltas(F.col("tokens_before"), F.col("tokens_after"), F.col("summary_tokens_est"))
    preset = F.col("shrink").isNotNull()
    rows = rows.withColumn("discarded_est", F.when(preset, F.col("discarded_est")).otherwise(discarded)).withColumn("shrink", F.coalesce("shrink", shrink))
    return rows.select(events.columns)


def marker_anchors(markers: DataFrame, turns: DataFrame) -> DataFrame:
    """J11-J13 (by line): markers (session_key, line) with turn_index of the first turn after the line, or the number of
    turns; tokens_before and tokens_after of the nearest turns with usage (no API errors) before and after it."""
    real = (F.col("context_total") != 0) & ~F.coalesce(F.col("is_api_error"), F.lit(False))
    turn = turns.select("session_key", F.col("src_line").alias("__line"), F.lit(1).alias("__kind"), F.col("turn_index").alias("__turn"), F.when(real, F.col("context_total")).alias("__usage"))
    marker = markers.withColumn("__marker", F.struct(*markers.columns)).select("session_key", F.col("line").alias("__line"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__turn"), F.lit(None).cast("long").alias("__usage"), "__marker")
    session = Window.partitionBy("session_key")
    order = session.orderBy("__line", "__kind")
    rows = turn.unionByName(marker, allowMissingColumns=True)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("tokens_before", F.last("__usage", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("tokens_after", F.first("__usage", ignorenulls=True).over(after))
    rows = rows.withColumn("turn_index", F.coalesce(F.first("__turn", ignorenulls=True).over(after), F.count("__turn").over(session)))
    return rows.filter("__kind = 0").select("__marker.*", "turn_index", "tokens_before", "tokens_after")
