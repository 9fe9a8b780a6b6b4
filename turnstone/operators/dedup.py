"""Deduplication of turns: D1-D8 and the remap J14.

turns: one line a turn, keyed (session_key, turn_index), with role, message_id, request_id, is_sidechain and the usage
counters. Everything is keyed by session first, so one exchange on session_key serves all windows and groups below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output")
#: What goes with the usage of the fragment it is taken from.
USAGE = (*COUNTERS, "context_total", "is_sidechain", "logged_cost")


def eligible() -> Column:
    """Assistant turns that name both a message and a request."""
    named = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    return (F.col("role") == "assistant") & named("message_id") & named("request_id")


def total_tokens() -> Column:
    """What ties are broken by."""
    return F.col("context_total") + F.col("output")


def _keyed(turns: DataFrame) -> DataFrame:
    """By session, with __slot: null for eligible turns, its own for each other, which so is a group of one below."""
    return turns.repartition("session_key").withColumn("__eligible", eligible()).withColumn("__slot", F.when(~F.col("__eligible"), F.col("turn_index")))


def _with_slot(turns: DataFrame, *keys: str) -> list[str]:
    return [*keys, *[c for c in ("__slot",) if c in turns.columns]]


def merge_fragments(turns: DataFrame) -> DataFrame:
    """One line a (session, message, request) of eligible turns, with first_index, fragments and the merged usage.

    Fragments of equal counters keep the first one's usage, else that of the largest (the earliest of equals).
    """
    keys = _with_slot(turns, "session_key", "message_id", "request_id")
    rest = [c for c in turns.columns if c not in (*USAGE, *keys, "turn_index", "__eligible")]
    usage = F.struct(*USAGE)
    order = F.struct(total_tokens().alias("t"), (-F.col("turn_index")).alias("i"))
    alike = None
    for c in COUNTERS:
        one = F.min(c) == F.max(c)
        alike = one if alike is None else alike & one
    grouped = turns.groupBy(*keys).agg(
        F.min("turn_index").alias("first_index"),
        F.count(F.lit(1)).alias("fragments"),
        F.min_by(F.struct(*rest), "turn_index").alias("first"),
        F.when(alike, F.min_by(usage, "turn_index")).otherwise(F.max_by(usage, order)).alias("usage"),
    )
    return grouped.select(*keys, "first_index", "fragments", *[F.col(f"first.{c}") for c in rest], *[F.col(f"usage.{c}") for c in USAGE])


def pick_replay(merged: DataFrame) -> DataFrame:
    """D3: of the requests of one message, the one that isn't a sidechain, then the larger, then the earlier.

    anchor is the place of the earliest, winner the surviving request.
    """
    message = Window.partitionBy(*_with_slot(merged, "session_key", "message_id"))
    best = message.orderBy(F.col("is_sidechain"), total_tokens().desc(), "first_index")
    return merged.withColumn("anchor", F.min("first_index").over(message)).withColumn("winner", F.row_number().over(best) == 1)


def dedup_turns(turns: DataFrame) -> DataFrame:
    """The surviving turns at compacted places; turn_index is the new one, anchor the old. One scan, one exchange."""
    chosen = pick_replay(merge_fragments(_keyed(turns))).filter("winner")
    place = F.row_number().over(Window.partitionBy("session_key").orderBy("anchor")) - 1
    return chosen.select(*[c for c in turns.columns if c != "turn_index"], "anchor").withColumn("turn_index", place.cast("long"))


def index_map(turns: DataFrame) -> DataFrame:
    """(session_key, old_index, new_index, survives): where each turn went, and whether its content stays."""
    keyed = _keyed(turns)
    groups = pick_replay(merge_fragments(keyed.filter("__eligible").drop("__slot"))).select("session_key", "message_id", "request_id", "anchor", "winner")
    placed = keyed.select("session_key", "turn_index", "message_id", "request_id", "__eligible").join(groups, ["session_key", "message_id", "request_id"], "left")
    mine = F.col("__eligible") & F.col("anchor").isNotNull()
    placed = placed.select("session_key", F.col("turn_index").alias("old_index"), F.when(mine, F.col("anchor")).otherwise(F.col("turn_index")).alias("slot"), F.when(mine, F.col("winner")).otherwise(F.lit(True)).alias("survives"))
    rank = F.dense_rank().over(Window.partitionBy("session_key").orderBy("slot")) - 1
    return placed.select("session_key", "old_index", rank.cast("long").alias("new_index"), "survives")


def dedup_spans(spans: DataFrame, mapped: DataFrame) -> DataFrame:
    """D2, D3 for content: the survivors' spans, in the order of the fragments, at the new places."""
    joined = spans.withColumnRenamed("turn_index", "old_index").join(mapped.filter("survives"), ["session_key", "old_index"])
    order = F.row_number().over(Window.partitionBy("session_key", "new_index").orderBy("old_index", "ord")) - 1
    return joined.withColumn("ord", order.cast("long")).withColumnRenamed("new_index", "turn_index").drop("old_index", "survives")


def remap_events(events: DataFrame, mapped: DataFrame) -> DataFrame:
    """turn_index of events through the map; one past the last turn goes to one past the last that is left."""
    ends = mapped.groupBy("session_key").agg((F.max("old_index") + 1).alias("__old_end"), (F.max("new_index") + 1).alias("__new_end"))
    joined = events.join(mapped.select("session_key", F.col("old_index").alias("turn_index"), "new_index"), ["session_key", "turn_index"], "left").join(ends, "session_key", "left")
    at_end = F.when(F.col("turn_index") >= F.coalesce("__old_end", F.lit(0)), F.coalesce("__new_end", F.lit(0)))
    return joined.withColumn("turn_index", F.coalesce("new_index", at_end, "turn_index")).select(events.columns)


def _replayed() -> Column:
    """Whether an eligible turn's message came before in its family. Turns that aren't eligible are each a group of one."""
    slot = F.when(~eligible(), F.struct("session_key", "turn_index"))
    return eligible() & (F.row_number().over(Window.partitionBy("family_id", "message_id", slot).orderBy("member_ordinal", "turn_index")) > 1)


def zero_family_replays(turns: DataFrame) -> DataFrame:
    """In a family, later turns of a message id cost and use nothing, but stay; they count as priced.

    Goes by the message id alone, also within one member; turns that aren't eligible are left as they are.
    """
    again = turns.withColumn("__again", _replayed())
    for c in (*COUNTERS, "context_total"):
        again = again.withColumn(c, F.when(F.col("__again"), F.lit(0).cast("long")).otherwise(F.col(c)))
    if "cost" in turns.columns:
        again = again.withColumn("cost", F.when(F.col("__again"), F.lit(0.0)).otherwise(F.col("cost"))).withColumn("priced", F.col("__again") | F.col("priced"))
    return again.select(*turns.columns, F.col("__again").alias("is_replay"))


def drop_family_replays(turns: DataFrame) -> DataFrame:
    """As D6, but replayed turns go; for merging attributions over sessions."""
    return turns.withColumn("__again", _replayed()).filter("not __again").drop("__again")
