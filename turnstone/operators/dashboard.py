"""Trends over sessions: A13-A19, O5.

rows: a line a session: session_key, harness, cwd, model, started_at, cost, priced, compactions and tokens in
input_uncached, cache_read, cache_write, output, context_total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.text import day

CLASSES = ("input_uncached", "cache_read", "cache_write", "output")
DAYS, MODELS, PROJECTS = 30, 5, 15


def headline(rows: DataFrame) -> DataFrame:
    """A13."""
    return rows.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count_if(~F.col("priced")).alias("unpriced_sessions"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in CLASSES], F.countDistinct(day(F.col("started_at"))).alias("active_days"),
    )


def window(rows: DataFrame, since: str | None = None) -> DataFrame:
    """Rows of the last DAYS active days, with their day; of all days if the caller set the start."""
    dated = rows.withColumn("day", day(F.col("started_at")))
    if since is not None:
        return dated.filter(F.col("started_at") >= F.lit(since).cast("timestamp"))
    last = dated.select("day").distinct().orderBy(F.col("day").desc()).limit(DAYS)
    return dated.join(F.broadcast(last), "day", "left_semi")  # DAYS lines at most


def _spine(rows: DataFrame) -> DataFrame:
    return rows.select("day").distinct()


def daily_cost(windowed: DataFrame) -> DataFrame:
    """By day and model, the MODELS dearest in the window by name and the rest as 'other'; days without are 0."""
    top = windowed.groupBy("model").agg(F.sum("cost").alias("cost")).orderBy(F.col("cost").desc(), "model").limit(MODELS).select(F.col("model").alias("__top"))
    named = windowed.join(F.broadcast(top), F.col("model") == F.col("__top"), "left").withColumn("series", F.coalesce("__top", F.lit("other")))
    sums = named.groupBy("day", "series").agg(F.sum("cost").alias("cost"))
    grid = _spine(windowed).crossJoin(F.broadcast(named.select("series").distinct()))
    return grid.join(sums, ["day", "series"], "left").fillna(0.0, ["cost"])


def daily_tokens(windowed: DataFrame) -> DataFrame:
    """By day and token class."""
    return windowed.groupBy("day").agg(*[F.sum(c).cast("long").alias(c) for c in CLASSES]).unpivot(["day"], list(CLASSES), "class", "tokens")


def daily_hit_rate(windowed: DataFrame) -> DataFrame:
    """Null where nothing was sent."""
    sent = F.sum(F.col("cache_read") + F.col("input_uncached") + F.col("cache_write"))
    return windowed.groupBy("day").agg(F.when(sent > 0, F.sum("cache_read") / sent).alias("hit_rate"))


def daily_compactions(windowed: DataFrame) -> DataFrame:
    """A17."""
    return windowed.groupBy("day").agg(F.sum("compactions").cast("long").alias("compactions"))


def per_project(rows: DataFrame, top: int = PROJECTS) -> DataFrame:
    """The dearest projects."""
    found = rows.groupBy("cwd").agg(F.count(F.lit(1)).alias("sessions"), F.sum("context_total").cast("long").alias("tokens"), F.sum("cost").alias("cost"), F.max("started_at").alias("last_activity"))
    return found.orderBy(F.col("cost").desc(), "cwd").limit(top)


def per_harness(rows: DataFrame) -> DataFrame:
    """A19."""
    return rows.groupBy("harness").agg(F.count(F.lit(1)).alias("sessions"), F.sum("context_total").cast("long").alias("tokens"), F.sum("cost").alias("cost"), F.count_if(~F.col("priced")).alias("unpriced_sessions"))


def running_spend(trials: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """What a run had spent after each trial; trials without a price add nothing."""
    spent = F.sum(F.when(F.col("priced"), F.col("cost")).otherwise(0.0)).over(Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return trials.withColumn("spent", spent)
