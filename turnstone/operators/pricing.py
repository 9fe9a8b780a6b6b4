"""Prices: lookup J10, costs C1-C9.

prices: (model_key, input, output, cache_read, cc_5m, cc_1h, t_input, t_output, t_cache_read, t_cc_5m, t_cc_1h, threshold,
tier), rates in USD a token; tier 1 comes before tier 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = ("input", "output", "cache_read", "cc_5m", "cc_1h", "t_input", "t_output", "t_cache_read", "t_cc_5m", "t_cc_1h", "threshold")
PARTS = ("cost_input", "cost_output", "cost_cache_read", "cost_cache_write_5m", "cost_cache_write_1h")
_PREFIX, _DATE = r"(?i)^[a-z0-9_.]+/", r"-(\d{4}-\d{2}-\d{2}|\d{8})$"


def candidates(model: Column) -> Column:
    """The keys that a model is looked up by, the likeliest first."""
    bare = F.regexp_replace(model, _PREFIX, "")
    undated = lambda c: F.regexp_replace(c, _DATE, "")
    return F.array(model, bare, undated(model), undated(bare))


def provider_family(model: Column) -> Column:
    """How a provider prices long contexts, by the model's name."""
    bare = F.regexp_replace(model, _PREFIX, "")
    return F.when(bare.rlike("(?i)^claude"), "marginal").when(bare.rlike("(?i)^(gpt|o|codex)"), "whole").otherwise("none")


def match_prices(turns: DataFrame, prices: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Turns with the rates of their model, null where it has none: tier by tier, then key by key.

    Only the distinct models are looked up; how many there are doesn't grow with the turns, and Spark broadcasts the
    result by its measured size. Without `models`, which names them all (and maybe more), they are found by computing the
    turns once more.
    """
    tried = (turns if models is None else models).select("model").distinct().select("model", F.posexplode(candidates(F.col("model"))).alias("rank", "model_key"))
    found = tried.join(prices, "model_key").groupBy("model").agg(F.min_by(F.struct(*RATES), F.struct("tier", "rank")).alias("price"))
    return turns.join(found, "model", "left")


def cost_columns(turns: DataFrame, mode: str = "auto") -> DataFrame:
    """Cost, its five parts, priced; turns carry price, a struct of RATES or null, and logged_cost."""
    p = lambda c: F.col(f"price.{c}")
    base = {"input_uncached": p("input"), "cache_read": F.coalesce(p("cache_read"), F.lit(0.0)), "cache_write_5m": F.coalesce(p("cc_5m"), p("input") * 1.25), "cache_write_1h": F.coalesce(p("cc_1h"), p("input") * 2.0), "output": p("output")}
    tier = {"input_uncached": p("t_input"), "cache_read": p("t_cache_read"), "cache_write_5m": p("t_cc_5m"), "cache_write_1h": p("t_cc_1h"), "output": p("t_output")}
    over = p("threshold").isNotNull() & (F.col("context_total") > p("threshold"))
    family = provider_family(F.col("model"))
    offset, columns = F.lit(0).cast("long"), {}
    for c, name in zip(("input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output"), ("cost_input", "cost_cache_read", "cost_cache_write_5m", "cost_cache_write_1h", "cost_output")):
        rate, tokens = F.coalesce(tier[c], base[c]), F.col(c)
        if c == "output":
            split = tokens * rate
        else:
            below = F.greatest(F.lit(0), F.least(tokens, p("threshold") - offset))
            split = below * base[c] + (tokens - below) * rate
            offset = offset + tokens
        columns[name] = F.when(over & (family == "whole"), tokens * rate).when(over & (family == "marginal"), split).otherwise(tokens * base[c])
    out = turns.withColumns(columns)
    total = F.col("cost_input") + F.col("cost_output") + F.col("cost_cache_read") + F.col("cost_cache_write_5m") + F.col("cost_cache_write_1h")
    finite = F.coalesce(~F.isnan(total) & (F.abs(total) < float("inf")), F.lit(False))
    logged = F.col("logged_cost").isNotNull() & F.lit(mode != "calculate")
    computed = finite & F.col("price").isNotNull() & F.lit(mode != "display")
    out = out.withColumn("__total", total).withColumn("__logged", logged).withColumn("__computed", computed)
    out = out.withColumns({n: F.when(~F.col("__logged") & F.col("__computed"), F.col(n)).otherwise(F.lit(0.0)) for n in PARTS})
    cost = F.when(F.col("__logged"), F.col("logged_cost")).when(F.col("__computed"), F.col("__total")).otherwise(F.lit(0.0))
    return out.withColumn("cost", cost).withColumn("priced", F.col("__logged") | F.col("__computed")).drop("__total", "__logged", "__computed", "price")


def price_turns(turns: DataFrame, prices: DataFrame, mode: str = "auto", models: DataFrame | None = None) -> DataFrame:
    return cost_columns(match_prices(turns, prices, models), mode)
