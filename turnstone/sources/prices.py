"""Price tables S17-S19: two JSON layouts to one relation, see operators.pricing."""

from __future__ import annotations

import json
import math
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Providers whose own prices come before those of others, in order.
FIRST = ("anthropic", "openai", "google", "alibaba", "deepseek")
SCHEMA = "model_key string, input double, output double, cache_read double, cc_5m double, cc_1h double, t_input double, t_output double, t_cache_read double, t_cc_5m double, t_cc_1h double, threshold long, tier int"
THRESHOLD, MAX_AGE_DAYS, LEAST_MODELS = 200_000, 30, 100
_PER_TOKEN = {
    "input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cc_5m": "cache_creation_input_token_cost", "cc_1h": "cache_creation_input_token_cost_above_1hr",
    "t_input": "input_cost_per_token_above_200k_tokens", "t_output": "output_cost_per_token_above_200k_tokens", "t_cache_read": "cache_read_input_token_cost_above_200k_tokens",
    "t_cc_5m": "cache_creation_input_token_cost_above_200k_tokens", "t_cc_1h": "cache_creation_input_token_cost_above_1hr_above_200k_tokens",
}


def _number(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _row(key: str, rates: dict, tier: int) -> tuple | None:
    if rates.get("input") is None or rates.get("output") is None:
        return None  # not sold by input and output
    tiered = any(rates.get(c) is not None for c in ("t_input", "t_output", "t_cache_read", "t_cc_5m", "t_cc_1h"))
    return (key, *[rates.get(c) for c in _PER_TOKEN], THRESHOLD if tiered else None, tier)


def per_token_rows(snapshot: dict) -> list[tuple]:
    """{model: {..._cost_per_token}}; models without input and output rates go."""
    return [r for key, record in snapshot.items() if isinstance(record, dict) and (r := _row(key, {c: _number(record.get(f)) for c, f in _PER_TOKEN.items()}, 1))]


def per_million_rows(payload: dict) -> list[tuple]:
    """{provider: {models: {id: {cost}}}}, USD a million; a model's price is its first provider's, FIRST before others."""
    out: dict[str, tuple] = {}
    for provider in [*[p for p in FIRST if p in payload], *[p for p in payload if p not in FIRST]]:
        models = payload[provider].get("models") if isinstance(payload[provider], dict) else None
        for key, entry in (models if isinstance(models, dict) else {}).items():
            cost = entry.get("cost") if isinstance(entry, dict) else None
            if key in out or not isinstance(cost, dict):
                continue
            over = cost.get("context_over_200k")
            take = lambda c, f: None if not isinstance(c, dict) or _number(c.get(f)) is None else _number(c.get(f)) / 1e6
            rates = {"input": take(cost, "input"), "output": take(cost, "output"), "cache_read": take(cost, "cache_read"), "cc_5m": take(cost, "cache_write"), "t_input": take(over, "input"), "t_output": take(over, "output"), "t_cache_read": take(over, "cache_read"), "t_cc_5m": take(over, "cache_write")}
            if row := _row(key, rates, 2):
                out[key] = row
    return list(out.values())


def sound(row: tuple) -> bool:
    """Rates are finite and not negative, the threshold is the known one."""
    return all(x is None or (math.isfinite(x) and x >= 0) for x in row[1:11]) and row[11] in (None, THRESHOLD)


def cached_rows(path: str, now: float | None = None) -> list[tuple]:
    """{fetchedAt: ms, models} kept on disk, with rates in the second layout; nothing if it is missing, broken, older than
    30 days or from the future; rows that aren't sound are left out one by one."""
    try:
        held = json.loads(Path(path).read_text())
        age = (now or time.time()) - float(held["fetchedAt"]) / 1000
        if not 0 <= age <= MAX_AGE_DAYS * 86400:
            return []
        return [r for r in per_million_rows(held["payload"]) if sound(r)]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return []


def save_cached(path: str, payload: dict, now: float | None = None) -> int:
    """S20 without the network: keep a payload that the caller fetched, if it prices enough models; a rename puts it there."""
    rows = per_million_rows(payload)
    if len(rows) < LEAST_MODELS:
        raise ValueError(f"only {len(rows)} priced models")
    temporary = Path(f"{path}.tmp")
    temporary.write_text(json.dumps({"fetchedAt": (now or time.time()) * 1000, "payload": payload}))
    temporary.rename(path)
    return len(rows)


def prices(spark: SparkSession, snapshot: dict | None = None, payload: dict | None = None, cache: str | None = None) -> DataFrame:
    rows = per_token_rows(snapshot or {}) + (per_million_rows(payload) if payload else []) + (cached_rows(cache) if cache else [])
    return spark.createDataFrame(rows, SCHEMA).dropDuplicates(["model_key", "tier"])
