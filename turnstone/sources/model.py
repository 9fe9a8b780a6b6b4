"""What every parser gives: one set of relations, keyed (session_key, ...)."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions.text import utf16_length

TEXT_CAP = 2000

TURNS = (
    "session_key string, turn_index long, src_line long, role string, model string, ts timestamp, message_id string, request_id string, is_sidechain boolean, is_api_error boolean, "
    "input_uncached long, cache_read long, cache_write_5m long, cache_write_1h long, output long, reasoning_output long, context_total long, cache_miss_type string, cache_missed_tokens long, logged_cost double"
)
SPANS = "session_key string, turn_index long, ord long, category string, char_count long, text string, truncated boolean, tool_name string, mcp_server string, turn_role string"
COMPACTIONS = "session_key string, ord long, at timestamp, turn_index long, tokens_before long, tokens_after long, shrink long, summary_tokens_est long, discarded_est long, cost double, lineage struct<window_number:long,window_id:string,previous_window_id:string,first_window_id:string>"
EVENTS = "session_key string, kind string, at timestamp, field string, was string, now string, message string, raw string"
SESSIONS = "session_key string, harness string, harness_version string, session_id string, cwd string, git_branch string, started_at timestamp, ended_at timestamp, model string, system_prompt string, project_instructions string, tool_schemas string"
WARNINGS = "session_key string, code string, line long, record_type string, message string"


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly these columns, missing ones null."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


@dataclass
class Parsed:
    """The relations of parsed sessions."""

    turns: DataFrame
    spans: DataFrame
    compactions: DataFrame
    events: DataFrame
    sessions: DataFrame
    warnings: DataFrame

    def union(self, other: Parsed) -> Parsed:
        return Parsed(*[getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)])


def finished(turns, spans, compactions, events, sessions, warnings) -> Parsed:
    """Shapes the relations; spans come with text, whose length is taken here and which is kept up to TEXT_CAP."""
    spans = spans.withColumn("char_count", utf16_length(F.col("text"))).withColumn("text", F.when(F.col("char_count") <= TEXT_CAP, F.col("text")))
    return Parsed(shaped(turns, TURNS), shaped(spans, SPANS), shaped(compactions, COMPACTIONS), shaped(events, EVENTS), shaped(sessions, SESSIONS), shaped(warnings, WARNINGS))
