"""Composition of the context by turn: W1-W7, P36.

spans: (session_key, turn_index, ord, category, char_count, truncated, ...); compactions: (session_key, turn_index);
sessions: (session_key, harness, system_prompt, tool_schemas).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.text import utf16_length

CATEGORIES = ("userText", "assistantText", "thinking", "toolResults", "toolCallArgs", "instructionInjection", "systemPrompt", "toolSchemas", "compactionSummaries", "coordination")


def phases(turns: DataFrame, compactions: DataFrame) -> DataFrame:
    """Phase is the number of distinct compaction places at or before the turn; two on one place reset once."""
    resets = compactions.select("session_key", "turn_index").distinct().withColumn("__reset", F.lit(1))
    upto = Window.partitionBy("session_key").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    return turns.join(resets, ["session_key", "turn_index"], "left").withColumn("phase", F.sum(F.coalesce("__reset", F.lit(0))).over(upto)).drop("__reset")


def compose(turns: DataFrame, spans: DataFrame, compactions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns with phase, a column of tokens for each category, residual, residual_share and truncated.

    Characters run up within a phase, a quarter of them (rounded up) counts as tokens, and what they don't explain of
    context_total is the residual, which may be negative. A turn without usage shows zeros, but its spans count later.
    """
    held = spans.join(sessions.select("session_key", "harness"), "session_key").filter("category <> 'thinking' or harness = 'codex'")
    own = held.groupBy("session_key", "turn_index").agg(
        *[F.sum(F.when(F.col("category") == c, F.col("char_count")).otherwise(0)).alias(f"__{c}") for c in CATEGORIES], F.max(F.coalesce("truncated", F.lit(False))).alias("__cut")
    )
    seed = {"systemPrompt": utf16_length(F.col("system_prompt")), "toolSchemas": utf16_length(F.col("tool_schemas"))}
    seeds = sessions.select("session_key", *[F.coalesce(seed[c], F.lit(0)).alias(f"__seed_{c}") for c in seed])
    rows = phases(turns, compactions).join(own, ["session_key", "turn_index"], "left").join(seeds, "session_key", "left")
    upto = Window.partitionBy("session_key", "phase").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    running = {c: F.sum(F.coalesce(f"__{c}", F.lit(0))).over(upto) + (F.coalesce(f"__seed_{c}", F.lit(0)) if c in seed else F.lit(0)) for c in CATEGORIES}
    used = F.col("context_total") != 0
    rows = rows.withColumns({f"__run_{c}": running[c] for c in CATEGORIES} | {"__sticky": F.max(F.coalesce("__cut", F.lit(False))).over(upto)})
    rows = rows.withColumns({c: F.when(used, F.ceil(F.col(f"__run_{c}") / 4)).otherwise(F.lit(0)).cast("long") for c in CATEGORIES})
    explained = sum((F.col(c) for c in CATEGORIES), F.lit(0))
    rows = rows.withColumn("residual", F.when(used, F.col("context_total") - explained).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("residual_share", F.when(used, F.col("residual") / F.col("context_total")).otherwise(F.lit(0.0)))
    return rows.withColumn("truncated", used & F.col("__sticky")).select(*turns.columns, "phase", *CATEGORIES, "residual", "residual_share", "truncated")


def category_rows(composed: DataFrame) -> DataFrame:
    """One line a turn and category that isn't 0, with its place in the order of categories and its share."""
    long = composed.unpivot(["session_key", "turn_index", "context_total"], list(CATEGORIES), "category", "tokens").filter("tokens <> 0")
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return long.withColumn("rank", rank).withColumn("share", F.col("tokens") / F.col("context_total"))


def last_usage_turn(composed: DataFrame) -> DataFrame:
    """Each session's last turn with usage."""
    rest = [c for c in composed.columns if c != "session_key"]
    return composed.filter("context_total <> 0").groupBy("session_key").agg(F.max_by(F.struct(*rest), "turn_index").alias("x")).select("session_key", "x.*")
