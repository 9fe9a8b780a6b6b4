"""Tolerant line reader S7, S8 and harness sniffing S12: raw lines with their numbers, and warnings instead of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import json as j

WARNINGS = "session_key string, code string, line long, record_type string, message string"


def read_lines(refs: DataFrame) -> DataFrame:
    """(session_key, line, raw) of the refs' files; numbers start at 1 and count blank lines, which are left out.

    A file is read whole, since splitting it would lose the numbers; transcripts are megabytes. The path is the key.
    """
    spark = refs.sparkSession
    paths = [r["path"] for r in refs.select("path").collect()]  # a plan of files, as for any scan
    if not paths:
        return spark.createDataFrame([], "session_key string, line long, raw string")
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("session_key"), "value")
    rows = whole.select("session_key", F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw"))
    return rows.select("session_key", (F.col("pos") + 1).cast("long").alias("line"), "raw").filter(F.trim(F.regexp_replace("raw", r"[\s﻿]+", " ")) != "")


def object_of(raw: Column) -> Column:
    """The object that a line is, as VARIANT; null for other JSON and for none. The schema of a whole line isn't made for it."""
    return F.when(raw.rlike(r"^\s*\{"), F.try_parse_json(F.trim(raw)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds v, the object of the line, null where it is none, and type, '' where it has none."""
    parsed = lines.withColumn("v", object_of(F.col("raw"))).drop("raw")
    return parsed.withColumn("type", F.coalesce(j.text(F.col("v"), "$.type"), F.lit("")))


def line_warnings(parsed: DataFrame, known: list[str]) -> DataFrame:
    """malformed-line and unknown-record-type."""
    bad = parsed.filter("v is null").select("session_key", F.lit("malformed-line").alias("code"), "line", F.lit(None).cast("string").alias("record_type"), F.concat(F.lit("line "), F.col("line"), F.lit(": no JSON object")).alias("message"))
    odd = parsed.filter(F.col("v").isNotNull() & ~F.col("type").isin(known))
    return bad.unionByName(odd.select("session_key", F.lit("unknown-record-type").alias("code"), "line", F.when(F.col("type") != "", F.col("type")).alias("record_type"), F.concat(F.lit("line "), F.col("line"), F.lit(": unknown type "), F.col("type")).alias("message")))


def sniff(lines: DataFrame) -> DataFrame:
    """(session_key, harness) by each file's first line; null where nothing fits."""
    first = lines.groupBy("session_key").agg(F.min_by("raw", "line").alias("raw"))
    v = F.try_parse_json(F.trim("raw"))
    keys = F.array_sort(F.map_keys(F.from_json("raw", "map<string,string>")))
    harness = F.when(keys == F.array(F.lit("payload"), F.lit("timestamp"), F.lit("type")), "codex").when((j.text(F.col("v"), "$.type") == "session") | j.at(F.col("v"), "$.kind").isNotNull(), "pi").when(j.text(F.col("v"), "$.sessionId").isNotNull(), "claude-code")
    return first.withColumn("v", v).select("session_key", harness.alias("harness"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
