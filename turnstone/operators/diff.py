"""Differences of sessions: C12-C17, A11, A12, J19-J21, O3, O4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.attribution import TOKENS
from turnstone.operators.composition import CATEGORIES, last_usage_turn


def change(a: Column, b: Column) -> list[Column]:
    """Delta and its share of a, null where a is 0."""
    return [(b - a).alias("delta"), ((b - a) / F.nullif(a, F.lit(0))).alias("pct")]


def divergence(x: Column, y: Column) -> Column:
    """Larger over smaller; 1 if both are 0, infinite if one is."""
    both, one = (x == 0) & (y == 0), (x == 0) | (y == 0)
    safe = F.when(one, F.lit(1)).otherwise(F.least(x, y))
    return F.when(both, F.lit(1.0)).when(one, F.lit(float("inf"))).otherwise(F.greatest(x, y) / safe)


def token_changes(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """By pair (a, b) of sessions and token class."""
    long = totals.unpivot(["session_key"], list(TOKENS), "class", "value")
    a, b = long.select(F.col("session_key").alias("a"), "class", F.col("value").alias("a_value")), long.select(F.col("session_key").alias("b"), "class", F.col("value").alias("b_value"))
    return pairs.join(a, "a").join(b, ["b", "class"]).select("a", "b", "class", "a_value", "b_value", *change(F.col("a_value"), F.col("b_value")))


def composition_changes(composed: DataFrame, pairs: DataFrame) -> DataFrame:
    """C17: categories and residual at each side's last turn with usage; a side without one has zeros."""
    long = last_usage_turn(composed).unpivot(["session_key"], [*CATEGORIES, "residual"], "category", "value")
    names = pairs.sparkSession.createDataFrame([(c,) for c in (*CATEGORIES, "residual")], "category string")
    a, b = (long.select(F.col("session_key").alias(s), "category", F.col("value").alias(f"{s}_value")) for s in "ab")
    both = pairs.crossJoin(F.broadcast(names)).join(a, ["a", "category"], "left").join(b, ["b", "category"], "left").fillna(0, ["a_value", "b_value"])
    shown = (F.col("a_value") != 0) | (F.col("b_value") != 0) | (F.col("category") == "residual")
    return both.filter(shown).select("a", "b", "category", "a_value", "b_value", *change(F.col("a_value"), F.col("b_value")))


def poisoned_sum(c: str) -> Column:
    """Null if any is null, 0 of none."""
    return F.when(F.count(F.lit(1)) == 0, F.lit(0)).when(F.count(c) < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(c)).cast("long")


def compaction_totals(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """By session, also those without events."""
    found = events.groupBy("session_key").agg(F.count(F.lit(1)).alias("compactions"), poisoned_sum("shrink").alias("shrink_total"), poisoned_sum("discarded_est").alias("discarded_total"), F.lit(True).alias("__any"))
    joined = sessions.select("session_key").join(found, "session_key", "left")
    zero = lambda c: F.when(F.col("__any"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return joined.select("session_key", zero("compactions"), zero("shrink_total"), zero("discarded_total"))


def models_in_order(turns: DataFrame) -> DataFrame:
    """By session, its models as they first appear."""
    first = turns.groupBy("session_key", "model").agg(F.min("turn_index").alias("at"))
    return first.groupBy("session_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))


def compare_logged(a: Column, b: Column) -> Column:
    """Same, differs, or unknown where either is missing."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(F.sha2(a, 256) == F.sha2(b, 256), "same").otherwise("differs")


def config_changes(sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """By pair: what differs in configuration, and what makes the two hard to compare.

    sessions: session_key, harness, harness_version, model, cwd, git_branch, system_prompt, project_instructions, turns,
    duration_ms.
    """
    fields = [c for c in sessions.columns if c != "session_key"]
    a = sessions.select(F.col("session_key").alias("a"), F.struct(*fields).alias("x"))
    b = sessions.select(F.col("session_key").alias("b"), F.struct(*fields).alias("y"))
    differs = lambda c: ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    warn = lambda held, name: F.when(held, F.lit(name))
    warnings = F.array_compact(F.array(
        warn(divergence(F.col("x.turns"), F.col("y.turns")) > 3, "turns"), warn(divergence(F.col("x.duration_ms"), F.col("y.duration_ms")) > 5, "duration"),
        warn(differs("git_branch"), "branch"), warn(differs("harness"), "harness"), warn(differs("cwd"), "cwd"),
    ))
    return pairs.join(a, "a").join(b, "b").select(
        "a", "b", differs("model").alias("model_changed"), differs("harness_version").alias("version_changed"),
        compare_logged(F.col("x.system_prompt"), F.col("y.system_prompt")).alias("system_prompt"), compare_logged(F.col("x.project_instructions"), F.col("y.project_instructions")).alias("project_instructions"),
        F.array_join(warnings, ",").alias("warnings"),
    )


def against_base(base: str, others: list[str], spark) -> DataFrame:
    """One base against each of the others."""
    return spark.createDataFrame([(base, o) for o in others], "a string, b string")


def last_comparable(refs: DataFrame, take: int = 2, scope: str | None = None, harness: str | None = None, all_projects: bool = False) -> DataFrame:
    """The newest `take` main sessions of one harness in scope; fewer, and there are none.

    The harness is that of the newest session known to be in scope. Candidates are sessions in scope or of unknown cwd.
    """
    main = refs.filter("kind = 'main'")
    inside = F.lit(True) if all_projects or scope is None else (F.col("cwd") == scope)
    wide = F.lit(True) if all_projects or scope is None else (F.col("cwd").isNull() | (F.col("cwd") == scope))
    newest = [F.col("mtime").desc(), F.col("path")]
    if harness is None:
        top = main.filter(inside).orderBy(*newest).select("harness").limit(1)
        main = main.join(F.broadcast(top.withColumnRenamed("harness", "__h")), F.col("harness") == F.col("__h"), "left_semi")
    else:
        main = main.filter(F.col("harness") == harness)
    chosen = main.filter(wide).orderBy(*newest).limit(take)
    return chosen.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).filter(F.col("__n") == take).drop("__n")


def resolve_id(refs: DataFrame, wanted: str) -> DataFrame:
    """Refs of that id, else, from 6 characters, those that start with it; the caller judges none or several."""
    exact = refs.filter(F.col("session_id") == wanted)
    if len(wanted) < 6 or not exact.isEmpty():
        return exact
    return refs.filter(F.col("session_id").startswith(wanted))
