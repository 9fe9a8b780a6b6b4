"""A/B trials: A20-A23, J18, C19.

trials: task_name, config_name, wall_ms, passed, has_totals, priced, context_total, cost, compactions, row_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats() -> list[Column]:
    """Exact medians, over the trials with totals or with a price; null of none."""
    totals, priced = F.col("has_totals"), F.col("has_totals") & F.col("priced")
    return [
        F.count(F.lit(1)).alias("trials"), F.count_if("passed").alias("successes"), (F.count_if("passed") / F.count(F.lit(1))).alias("success_rate"),
        F.median("wall_ms").alias("median_wall_ms"), F.count_if(totals).alias("with_totals"), F.median(F.when(totals, F.col("context_total"))).alias("median_tokens"),
        F.count_if(priced).alias("priced_trials"), F.median(F.when(priced, F.col("cost"))).alias("median_cost"),
        F.sum(F.when(totals, F.col("compactions"))).cast("long").alias("compactions"), F.min("row_no").alias("first_row"),
    ]


def cells(trials: DataFrame) -> DataFrame:
    """By task and config; first_row is the order in which they were seen."""
    return trials.groupBy("task_name", "config_name").agg(*stats())


def cells_and_overall(trials: DataFrame) -> DataFrame:
    """Cells and, with a null task, each config over all tasks; medians are of the trials, so both levels are grouped
    from them in one pass."""
    return trials.groupingSets([["task_name", "config_name"], ["config_name"]], "task_name", "config_name").agg(*stats())


def paired(found: DataFrame, a: str, b: str) -> DataFrame:
    """By task, both sides' statistics, and which side is missing (a is looked at first)."""
    fields = [c for c in found.columns if c not in ("task_name", "config_name")]
    left = found.filter(F.col("config_name") == a).select("task_name", F.struct(*fields).alias("a"))
    right = found.filter(F.col("config_name") == b).select("task_name", F.struct(*fields).alias("b"))
    tasks = found.select("task_name").distinct()
    both = tasks.join(left, "task_name", "left").join(right, "task_name", "left")
    return both.withColumn("missing", F.when(F.col("a").isNull(), "a").when(F.col("b").isNull(), "b"))


def deltas(pairs: DataFrame) -> DataFrame:
    """Of the tasks that both sides have: points of success, and differences of medians with their share of a."""
    held = pairs.filter("missing is null")
    columns = [((F.col("b.success_rate") - F.col("a.success_rate")) * 100).alias("success_pp")]
    for c in ("median_wall_ms", "median_tokens", "median_cost"):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        columns += [(y - x).alias(f"{c}_delta"), (F.try_divide(y - x, F.nullif(x, F.lit(0).cast("double"))) * 100).alias(f"{c}_pct")]
    return held.select("task_name", *columns, (F.col("b.compactions") - F.col("a.compactions")).alias("compactions_delta"))
