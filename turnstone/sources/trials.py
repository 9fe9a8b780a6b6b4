"""A/B suites and results S21, S22, K10."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import json as j

#: What is kept of an agent's own result line.
KEPT = ("type", "subtype", "is_error", "duration_ms", "duration_api_ms", "num_turns", "session_id", "total_cost_usd", "usage", "modelUsage", "stop_reason", "permission_denials")


def load_suite(folder: str) -> list[dict]:
    """The *.json tasks of a folder by name; each needs name, prompt and verify."""
    tasks = []
    for path in sorted(Path(folder).glob("*.json")):
        task = json.loads(path.read_text())
        missing = [k for k in ("name", "prompt", "verify") if not isinstance(task, dict) or not isinstance(task.get(k), str) or not task[k]]
        if missing:
            raise ValueError(f"{path.name} lacks {', '.join(missing)}")
        tasks.append(task)
    names = [t["name"] for t in tasks]
    if len(set(names)) < len(names):
        raise ValueError("two tasks have one name")
    return sorted(tasks, key=lambda t: t["name"])


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trials, warnings) of results.jsonl; torn lines are warnings."""
    v = F.col("v")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw")).filter(F.trim("raw") != "")
    rows = lines.withColumn("v", F.try_parse_json("raw")).withColumn("v", F.when(j.is_object(v), v))
    warnings = rows.filter("v is null").select((F.col("pos") + 1).alias("line"), F.lit("torn line").alias("message"))
    t = "$.totals"
    trials = rows.filter("v is not null").select(
        j.text(v, "$.taskName").alias("task_name"), j.text(v, "$.configName").alias("config_name"), j.text(v, "$.harness").alias("harness"), j.number(v, "$.trialIndex").alias("trial_index"), j.text(v, "$.startedAt").alias("started_at"),
        j.number(v, "$.wallMs").alias("wall_ms"), j.flag(v, "$.timedOut").alias("timed_out"), j.flag(v, "$.verify.passed").alias("passed"), j.is_object(v, t).alias("has_totals"), j.flag(v, f"{t}.priced").alias("priced"),
        j.real(v, f"{t}.tokens.contextTotal").cast("long").alias("context_total"), j.real(v, f"{t}.cost").alias("cost"), j.real(v, f"{t}.compactionCount").cast("long").alias("compactions"), F.col("pos").cast("long").alias("row_no"),
    )
    return trials, warnings


def append_result(path: str, row: dict) -> None:
    """One line, of whose raw part only the KEPT keys stay, with a mark that others went."""
    raw = row.get("raw")
    if isinstance(raw, dict) and set(raw) - set(KEPT):
        row = row | {"raw": {k: raw[k] for k in KEPT if k in raw} | {"_reduced": True}}
    with open(path, "a") as out:
        out.write(json.dumps(row, separators=(",", ":")) + "\n")


def rollout_of_trial(rollouts: DataFrame, workspace: str, started_day: str) -> DataFrame:
    """Of the rollouts (path, cwd, mtime, day) of the start day and the next, in the workspace, the newest."""
    days = F.array(F.lit(started_day).cast("date"), F.date_add(F.lit(started_day).cast("date"), 1))
    return rollouts.filter((F.col("cwd") == workspace) & F.array_contains(days, F.to_date("day"))).agg(F.max_by("path", F.struct("mtime", "path")).alias("path")).filter("path is not null")
