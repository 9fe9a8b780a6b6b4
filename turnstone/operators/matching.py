"""Lookups in order, as windows: J2, J3, J5-J7, J16, W8, W9, W11, A24, P9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def last_known(value: Column, key: str = "session_key", order: str = "line") -> Column:
    """The latest value that isn't null, this row's included."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(*_SO_FAR))


def seen_before(value: Column, key: str = "session_key", order: str = "line") -> Column:
    """How many rows before this one hold."""
    return F.count_if(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def latest_call(rows: DataFrame, call: Column, key: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """For a result, the latest call of its id that came before it."""
    return F.last(call, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(*_SO_FAR))


def next_holder(rows: DataFrame, holds: Column, value: Column, key: str = "session_key", order: tuple[str, ...] = ("line",)) -> Column:
    """The value of the next row that holds, null at the end: where pending content goes."""
    return F.first(F.when(holds, value), ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing))


def changes(rows: DataFrame, value: str, key: str = "session_key", order: str = "line") -> DataFrame:
    """Rows at which the value differs from the one before, with that; the first is no change, nulls are skipped."""
    known = rows.filter(F.col(value).isNotNull())
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return known.withColumn("was", before).filter(F.col("was").isNotNull() & (F.col("was") != F.col(value)))


def match_stack(rows: DataFrame, push: Column, pop: Column, key: str = "session_key", order: str = "line", peek: Column | None = None, value: str | None = None) -> DataFrame:
    """Each pop takes the nearest push before it that no pop took yet; partner is its `value` (its order unless given),
    null for an orphan. A peek finds the same push as a pop would, but leaves it.

    Nested matching as windows: with d the pushes less the pops so far and its running minimum, a pop that makes a new
    minimum is an orphan, and a push and its pop are neighbours on their level of the stack.
    """
    by = Window.partitionBy(key).orderBy(order)
    step = F.when(push, 1).when(pop, -1).otherwise(0)
    marked = rows.withColumn("__push", push).withColumn("__pop", pop).withColumn("__peek", F.lit(False) if peek is None else peek).withColumn("__d", F.sum(step).over(by.rowsBetween(*_SO_FAR)))
    marked = marked.withColumn("__low", F.least(F.lit(0), F.min("__d").over(by.rowsBetween(*_SO_FAR))))
    marked = marked.withColumn("__was", F.least(F.lit(0), F.coalesce(F.min("__d").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    depth = F.col("__d") - F.col("__low")
    marked = marked.withColumn("orphan", (F.col("__pop") & (F.col("__d") < F.col("__was"))) | (F.col("__peek") & (depth == 0)))
    marked = marked.withColumn("__level", F.when(F.col("__push") | (F.col("__peek") & ~F.col("orphan")), depth).when(F.col("__pop") & ~F.col("orphan"), depth + 1))
    level = Window.partitionBy(key, "__level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    partner = F.when((F.col("__pop") | F.col("__peek")) & ~F.col("orphan"), F.last(F.when(F.col("__push"), F.col(value or order)), ignorenulls=True).over(level))
    return marked.withColumn("partner", partner).drop("__push", "__pop", "__peek", "__d", "__low", "__was", "__level")


def drop_consumed_markers(rows: DataFrame, marker: str, consumer: str, key: str = "session_key", order: str = "line", kind: str = "kind") -> DataFrame:
    """A consumer takes the next marker; rows of other kinds don't matter. What is left are all but those markers."""
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(order))
    return rows.filter(F.col(kind).isin(marker, consumer)).withColumn("__before", before).filter(~((F.col(kind) == marker) & (F.coalesce("__before", F.lit("")) == consumer))).drop("__before")


def first_text(value: Column, order: Column) -> Column:
    """The first string that isn't empty, as an aggregate."""
    held = F.when(F.length(value) > 0, order)
    return F.min_by(value, held)


def counter_gap(turns: DataFrame, counters: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Sessions whose last cumulative counter is further than the tolerance from the sum of their turns with usage."""
    last = counters.groupBy("session_key").agg(F.max_by("total_tokens", "line").alias("counted"))
    summed = turns.filter("context_total <> 0").groupBy("session_key").agg(F.sum(F.col("context_total") + F.col("output")).alias("summed"))
    both = last.join(summed, "session_key", "left").fillna(0, ["summed"])
    return both.withColumn("gap", F.abs(F.col("summed") - F.col("counted")) / F.greatest(F.abs("counted"), F.lit(1))).filter(F.col("gap") > tolerance)
