"""Parser of transcripts with one record a line: P3, P7-P9, P18, P20-P25, J1, J3, J4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import json as j
from turnstone.functions.text import utf16_length
from turnstone.operators import compaction, matching
from turnstone.plans import tables
from turnstone.sources.lines import line_warnings, parse_lines, read_lines
from turnstone.sources.model import Parsed, finished

KNOWN = (
    "agent-name agent-setting ai-title assistant attachment file-history-delta file-history-snapshot fork-context-ref frame-link last-prompt "
    "mode permission-mode pr-link progress queue-operation relocated system user worktree-state"
).split()
COORDINATION = ("<teammate-message", "<task-notification")


def usage(u: Column) -> Column:
    """Counters; the two lifetimes of cache writes are apart only if cache_creation is an object, else all are 5m."""
    apart = j.is_object(u, "$.cache_creation")
    return F.struct(
        j.number(u, "$.input_tokens").alias("input_uncached"), j.number(u, "$.cache_read_input_tokens").alias("cache_read"),
        F.when(apart, j.number(u, "$.cache_creation.ephemeral_5m_input_tokens")).otherwise(j.number(u, "$.cache_creation_input_tokens")).alias("cache_write_5m"),
        F.when(apart, j.number(u, "$.cache_creation.ephemeral_1h_input_tokens")).otherwise(F.lit(0)).cast("long").alias("cache_write_1h"), j.number(u, "$.output_tokens").alias("output"),
    )


_COUNTERS = ("input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output")


def turn_usage(u: Column) -> Column:
    """Iterations, where there are any, replace the top level by their sum."""
    steps = F.transform(j.items(u, "$.iterations"), usage)
    adding = lambda c: lambda a, x: a + x[c]
    total = F.struct(*[F.aggregate(steps, F.lit(0).cast("long"), adding(c)).alias(c) for c in _COUNTERS])
    return F.when(F.coalesce(F.size(steps), F.lit(0)) > 0, total).otherwise(usage(u))


def split_name(name: Column) -> tuple[Column, Column]:
    """(tool, server) of mcp__server__tool; other names are tools without a server."""
    parts = F.split(name, "__")
    remote = name.startswith("mcp__") & (F.size(parts) >= 3)
    return F.when(remote, F.array_join(F.slice(parts, 3, 1 << 20), "__")).otherwise(name), F.when(remote, F.get(parts, F.lit(1)))


def _span(category, text, role: str, tool_id=None, name=None, truncated_by=None) -> Column:
    null = F.lit(None).cast("string")
    as_column = lambda x: null if x is None else x
    return F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), text.alias("text"), F.lit(role).alias("turn_role"), as_column(tool_id).alias("tool_use_id"), as_column(name).alias("tool"))


def _user_class(text: Column) -> Column:
    """P18."""
    bare = F.regexp_replace(text, r"^[\s﻿]+", "")
    return F.when(bare.startswith(COORDINATION[0]) | bare.startswith(COORDINATION[1]), "coordination").otherwise("userText")


def assistant_spans(v: Column) -> Column:
    """P20."""
    def one(block):
        kind = j.text(block, "$.type")
        tool = F.coalesce(j.text(block, "$.name"), F.lit("unknown"))
        given = j.at(block, "$.input")
        args = F.when(given.isNull() | (j.kind(block, "$.input") == "VOID"), F.lit("{}")).otherwise(j.dumped(given))
        return F.when((kind == "text") & j.text(block, "$.text").isNotNull(), _span("assistantText", j.text(block, "$.text"), "assistant")).when(
            (kind == "thinking") & j.text(block, "$.thinking").isNotNull(), _span("thinking", j.text(block, "$.thinking"), "assistant")
        ).when(kind == "tool_use", _span("toolCallArgs", args, "assistant", name=tool))

    return F.array_compact(F.transform(j.items(v, "$.message.content"), one))


def user_spans(v: Column) -> Column:
    """Text blocks, then results of tools; those from toolUseResult if the record has one, else from the blocks."""
    content = "$.message.content"
    whole, blocks = j.text(v, content), j.items(v, content)
    summary = F.coalesce(whole, j.dumped(j.at(v, content)), F.lit('""'))
    texts = F.array_compact(F.transform(blocks, lambda b: F.when((j.text(b, "$.type") == "text") & j.text(b, "$.text").isNotNull(), _span(_user_class(j.text(b, "$.text")), j.text(b, "$.text"), "user"))))
    results = F.filter(blocks, lambda b: F.coalesce(j.text(b, "$.type") == "tool_result", F.lit(False)))
    given = j.at(v, "$.toolUseResult")
    out, err = j.text(v, "$.toolUseResult.stdout"), j.text(v, "$.toolUseResult.stderr")
    single = F.when(out.isNotNull() | err.isNotNull(), F.concat(F.coalesce(out, F.lit("")), F.coalesce(err, F.lit("")))).otherwise(j.dumped(given))
    inline = F.transform(results, lambda b: _span("toolResults", F.coalesce(j.text(b, "$.content"), j.dumped(j.at(b, "$.content")), F.lit("")), "user", tool_id=j.text(b, "$.tool_use_id")))
    one = F.array(_span("toolResults", single, "user", tool_id=j.text(F.get(results, F.lit(0)), "$.tool_use_id")))
    any_result = F.coalesce(F.size(results), F.lit(0)) > 0
    tools = F.when(any_result & given.isNotNull(), one).when(any_result, inline)
    nothing = F.filter(F.array(_span("", F.lit(""), "user")), lambda s: F.lit(False))
    plain = F.when(whole.isNotNull(), F.array(_span(_user_class(whole), whole, "user"))).otherwise(F.coalesce(texts, nothing))
    return F.when(j.flag(v, "$.isCompactSummary"), F.array(_span("compactionSummaries", summary, "user"))).otherwise(F.concat(plain, F.coalesce(tools, nothing)))


def parse(refs: DataFrame, offloaded: DataFrame | None = None) -> Parsed:
    """Sessions of the refs' files. offloaded: (family_id, tool_use_id) of results that were cut out of the transcript."""
    lines = parse_lines(read_lines(refs))
    return parse_records(lines, refs, offloaded)


def parse_records(parsed: DataFrame, refs: DataFrame, offloaded: DataFrame | None = None, cut=tables.cut) -> Parsed:
    """The relations of parsed lines, which are written once and read by each."""
    v = F.col("v")
    parsed = cut(parsed)
    warnings = line_warnings(parsed, KNOWN)
    records = parsed.filter("v is not null")
    session = Window.partitionBy("session_key")
    so_far = session.orderBy("line")
    talk = records.filter("type in ('user', 'assistant')").withColumn("own", F.when(F.col("type") == "assistant", F.count_if(F.col("type") == "assistant").over(so_far.rowsBetween(Window.unboundedPreceding, -1))))
    talk = talk.withColumn("own", F.when(F.col("type") == "assistant", F.coalesce("own", F.lit(0))))
    # What a user says goes with the next assistant turn
    talk = talk.withColumn("turn_index", F.coalesce("own", matching.next_holder(talk, F.col("type") == "assistant", F.col("own"))))
    u = turn_usage(j.at(v, "$.message.usage"))
    turns = talk.filter("type = 'assistant'").withColumn("u", u).select(
        "session_key", F.col("own").alias("turn_index"), F.col("line").alias("src_line"), F.lit("assistant").alias("role"), F.coalesce(j.text(v, "$.message.model"), F.lit("unknown")).alias("model"), F.coalesce(j.instant(v, "$.timestamp"), F.timestamp_seconds(F.lit(0))).alias("ts"),
        j.filled(v, "$.message.id").alias("message_id"), j.filled(v, "$.requestId").alias("request_id"), j.flag(v, "$.isSidechain").alias("is_sidechain"), j.flag(v, "$.isApiErrorMessage").alias("is_api_error"), "u.*",
        (F.col("u.input_uncached") + F.col("u.cache_read") + F.col("u.cache_write_5m") + F.col("u.cache_write_1h")).alias("context_total"),
        j.text(v, "$.message.diagnostics.cache_miss_reason.type").alias("cache_miss_type"), j.real(v, "$.message.diagnostics.cache_miss_reason.cache_missed_input_tokens").cast("long").alias("cache_missed_tokens"), j.real(v, "$.costUSD").alias("logged_cost"),
    )
    spread = talk.withColumn("spans", F.when(F.col("type") == "assistant", assistant_spans(v)).otherwise(user_spans(v))).select("session_key", "line", "turn_index", F.posexplode("spans").alias("pos", "s")).select("session_key", "line", "turn_index", "pos", "s.*")
    loose = spread.filter("turn_index is null").groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))
    trailing = loose.select("session_key", F.lit("trailing-user-content-unattached").alias("code"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("record_type"), F.concat(F.col("n"), F.lit(" spans after the last assistant turn")).alias("message"))
    # The last definition of a tool call in the file names its results
    uses = talk.filter("type = 'assistant'").select("session_key", "line", F.posexplode(j.items(v, "$.message.content")).alias("pos", "b")).filter(j.text(F.col("b"), "$.type") == "tool_use")
    uses = uses.select("session_key", j.text(F.col("b"), "$.id").alias("tool_use_id"), j.text(F.col("b"), "$.name").alias("used"), "line", "pos").filter("tool_use_id is not null and used is not null")
    named = uses.groupBy("session_key", "tool_use_id").agg(F.max_by("used", F.struct("line", "pos")).alias("used"))
    spans = spread.filter("turn_index is not null").join(named, ["session_key", "tool_use_id"], "left")
    if offloaded is not None:  # J4
        spans = spans.withColumn("family_id", F.regexp_replace("session_key", r"\.jsonl$", "")).join(offloaded.withColumn("there", F.lit(True)), ["family_id", "tool_use_id"], "left").withColumn("truncated", F.coalesce("there", F.lit(False)))
    else:
        spans = spans.withColumn("truncated", F.lit(False))
    tool, server = split_name(F.coalesce("tool", "used"))
    order = F.row_number().over(Window.partitionBy("session_key", "turn_index").orderBy("line", "pos")) - 1
    spans = spans.withColumn("tool_name", tool).withColumn("mcp_server", server).withColumn("ord", order)
    markers = talk.filter(j.flag(v, "$.isCompactSummary") & (F.col("type") == "user")).select("session_key", "line", F.coalesce(j.instant(v, "$.timestamp"), F.timestamp_seconds(F.lit(0))).alias("at"), F.coalesce(j.text(v, "$.message.content"), j.dumped(j.at(v, "$.message.content")), F.lit('""')).alias("summary"))
    found = compaction.marker_anchors(markers, turns).withColumn("summary_tokens_est", compaction.summary_estimate(utf16_length(F.col("summary"))))
    shrink, discarded = compaction.deltas(F.col("tokens_before"), F.col("tokens_after"), F.col("summary_tokens_est"))
    found = found.withColumn("shrink", shrink).withColumn("discarded_est", discarded).withColumn("ord", F.col("line"))
    edits = talk.filter((F.col("type") == "assistant") & (F.coalesce(F.size(j.items(v, "$.message.context_management.applied_edits")), F.lit(0)) > 0)).select("session_key", F.lit("contextEdit").alias("kind"), j.instant(v, "$.timestamp").alias("at"), F.lit(None).cast("string").alias("message"), j.dumped(j.at(v, "$.message.context_management.applied_edits")).alias("raw"))
    errors = talk.filter((F.col("type") == "assistant") & j.flag(v, "$.isApiErrorMessage")).select("session_key", F.lit("error").alias("kind"), j.instant(v, "$.timestamp").alias("at"), F.lit("api-error assistant record").alias("message"), j.text(v, "$.message.id").alias("raw"))
    first = lambda path: matching.first_text(j.text(v, path), F.col("line"))
    stamp = j.instant(v, "$.timestamp")
    on = F.when(stamp.isNotNull(), F.col("line"))
    meta = records.groupBy("session_key").agg(
        first("$.version").alias("harness_version"), first("$.cwd").alias("seen_cwd"), first("$.gitBranch").alias("git_branch"), F.min_by(stamp, on).alias("started_at"), F.max_by(stamp, on).alias("ended_at"),
        F.max_by(F.coalesce(j.text(v, "$.message.model"), F.lit("unknown")), F.when(F.col("type") == "assistant", F.col("line"))).alias("model"),
    )
    sessions = refs.withColumnRenamed("path", "session_key").join(meta, "session_key", "left").withColumn("cwd", F.coalesce("seen_cwd", "cwd", F.lit(""))).withColumn("model", F.coalesce("model", F.lit("unknown"))).withColumn("harness_version", F.coalesce("harness_version", F.lit("")))
    return finished(turns, spans, found, edits.unionByName(errors), sessions, warnings.unionByName(trailing))
