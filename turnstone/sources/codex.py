"""Parser of rollouts, whose lines are {timestamp, type, payload}: P4, P10-P17, P19, J2, J5-J7, J16, W8, W11, A24."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import json as j
from turnstone.functions.text import utf16_length
from turnstone.operators import compaction, matching
from turnstone.plans import tables
from turnstone.sources.lines import line_warnings, parse_lines, read_lines
from turnstone.sources.model import Parsed, finished

KNOWN = "compacted event_msg inter_agent_communication inter_agent_communication_metadata response_item session_meta turn_context world_state".split()
TOLERATED = "agent_message agent_reasoning task_complete task_started turn_complete turn_started user_message".split()
CALLS = ("function_call", "custom_tool_call", "local_shell_call", "tool_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")
INJECTED = ("<INSTRUCTIONS>", "# AGENTS.md instructions")
ENVIRONMENT = "<environment_context>"


def usage(u: Column) -> Column:
    """What is cached is part of the input; reasoning stays beside the output."""
    cached = j.number(u, "$.cached_input_tokens")
    zero = F.lit(0).cast("long")
    return F.struct(
        F.greatest(zero, j.number(u, "$.input_tokens") - cached).alias("input_uncached"), cached.alias("cache_read"), j.number(u, "$.cache_write_input_tokens").alias("cache_write_5m"),
        zero.alias("cache_write_1h"), j.number(u, "$.output_tokens").alias("output"), j.real(u, "$.reasoning_output_tokens").cast("long").alias("reasoning_output"),
    )


def tool_schemas(tools: Column) -> Column:
    """The tools' schemas as compact JSON, those of a server with its name; null of none."""
    def one(t, server):
        given = lambda name, path, shown: F.when(shown, F.concat(F.lit(f',"{name}":'), j.dumped(j.at(t, path))))
        fields = [
            F.concat(F.lit('{"name":'), j.dumped(j.at(t, "$.name"))), given("description", "$.description", j.filled(t, "$.description").isNotNull()), given("inputSchema", "$.input_schema", j.at(t, "$.input_schema").isNotNull()),
            given("deferLoading", "$.defer_loading", j.kind(t, "$.defer_loading") == "BOOLEAN"), F.when(server.isNotNull(), F.concat(F.lit(',"serverName":"'), server, F.lit('"'))), F.lit("}"),
        ]
        return F.when(j.filled(t, "$.name").isNotNull(), F.concat_ws("", *fields))

    flat = F.flatten(F.transform(tools, lambda e: F.when(j.is_array(e, "$.tools"), F.transform(j.items(e, "$.tools"), lambda t: one(t, j.filled(e, "$.name")))).otherwise(F.array(one(e, F.lit(None).cast("string"))))))
    kept = F.array_compact(flat)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")))


def _spans(p: Column, limit: Column) -> Column:
    """[(category, text, turn_role, truncated)] of a response item."""
    kind, role = j.text(p, "$.type"), j.text(p, "$.role")
    span = lambda category, text, who, cut=None: F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), text.alias("text"), F.lit(who).alias("turn_role"), (F.lit(False) if cut is None else cut).alias("truncated"))
    texts = lambda path, want: F.transform(F.filter(j.items(p, path), lambda i: (F.lit(True) if want is None else F.coalesce(j.text(i, "$.type") == want, F.lit(False))) & j.filled(i, "$.text").isNotNull()), lambda i: j.filled(i, "$.text"))
    bare = lambda t: F.regexp_replace(t, r"^[\s﻿]+", "")
    injected = lambda t: bare(t).startswith(INJECTED[0]) | bare(t).startswith(INJECTED[1])
    user = F.transform(texts("$.content", "input_text"), lambda t: span(F.when(injected(t) | bare(t).startswith(ENVIRONMENT), "instructionInjection").otherwise("userText"), t, "user", injected(t) & F.coalesce(limit <= utf16_length(t), F.lit(False))))
    system = F.transform(texts("$.content", "input_text"), lambda t: span("instructionInjection", t, "system"))
    said = F.transform(texts("$.content", "output_text"), lambda t: span("assistantText", t, "assistant"))
    thought = F.transform(texts("$.summary", None), lambda t: span("thinking", t, "assistant"))
    args = F.when(j.text(p, "$.arguments").isNotNull(), j.text(p, "$.arguments")).when(j.text(p, "$.input").isNotNull(), j.text(p, "$.input")).when(j.at(p, "$.input").isNotNull(), j.dumped(j.at(p, "$.input"))).otherwise(j.dumped(p))
    joined = F.array_join(F.transform(j.items(p, "$.output.content_items"), lambda i: F.coalesce(j.filled(i, "$.text"), F.lit(""))), "")
    out = F.coalesce(j.text(p, "$.output"), joined, j.dumped(j.at(p, "$.output")), F.lit('""'))
    return (
        F.when((kind == "message") & (role == "developer"), system).when((kind == "message") & (role == "assistant"), said).when(kind == "message", user).when(kind == "reasoning", thought)
        .when(kind.isin(*CALLS), F.array(span("toolCallArgs", args, "assistant"))).when(kind.isin(*OUTPUTS), F.array(span("toolResults", out, "user")))
    )


def _role(p: Column) -> Column:
    kind, role = j.text(p, "$.type"), j.text(p, "$.role")
    return F.when(kind == "message", F.when(role == "developer", "system").when(role == "assistant", "assistant").otherwise("user")).when((kind == "reasoning") | kind.isin(*CALLS), "assistant").when(kind.isin(*OUTPUTS), "user")


def attach_counts(rows: DataFrame) -> DataFrame:
    """(session_key, line, turn_index) of token counts, null for an orphan.

    rows: line, push (an assistant turn, with its turn_index), pop (a count that uses context) and peek (a count without:
    it writes to the same turn but leaves it free). A stack as windows, see matching.match_stack().
    """
    matched = matching.match_stack(rows, F.col("push"), F.col("pop"), peek=F.col("peek"), value="turn_index")
    return matched.filter(F.col("pop") | F.col("peek")).select("session_key", "line", F.col("partner").alias("turn_index"))


def parse(refs: DataFrame) -> Parsed:
    return parse_records(parse_lines(read_lines(refs)), refs)


def _warn(df: DataFrame, code: str, message: str, record_type: str | None) -> DataFrame:
    return df.select("session_key", F.lit(code).alias("code"), "line", F.lit(record_type).cast("string").alias("record_type"), F.concat(F.lit(message + ", line "), F.coalesce(F.col("line").cast("string"), F.lit("none"))).alias("message"))


def parse_records(parsed: DataFrame, refs: DataFrame, cut=tables.cut) -> Parsed:
    """The relations of parsed lines, which are written once, with what is in force at each, and read by each."""
    v, p = F.col("v"), F.col("p")
    parsed = cut(parsed)
    records = parsed.filter("v is not null").withColumn("p", j.at(v, "$.payload")).withColumn("at", j.instant(v, "$.timestamp"))
    is_type = lambda t: F.col("type") == t
    by = Window.partitionBy("session_key").orderBy("line")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    meta_first = F.min(F.when(is_type("session_meta"), F.col("line"))).over(Window.partitionBy("session_key"))
    # The model in force is that of the latest turn context, then that of the session, if it came before
    own = matching.last_known(F.when(is_type("turn_context"), j.filled(p, "$.model")))
    meta_model = matching.last_known(F.when(is_type("session_meta") & (F.col("line") == F.col("meta_line")), j.filled(p, "$.model")))
    # The latest context, though its limit be null
    context = matching.last_known(F.when(is_type("turn_context"), F.struct(j.real(p, "$.truncation_policy.limit").alias("limit"))))
    rows = records.withColumn("meta_line", meta_first).withColumn("model", F.coalesce(own, meta_model, F.lit("unknown"))).withColumn("limit", context["limit"])
    rows = rows.withColumn("is_item", is_type("response_item") & _role(p).isNotNull()).withColumn("turns_before", F.coalesce(matching.seen_before(F.col("is_item")), F.lit(0)))
    rows = rows.withColumn("now", F.coalesce("at", F.last("at", ignorenulls=True).over(so_far), F.timestamp_seconds(F.lit(0))))
    rows = cut(rows)
    items = rows.filter("is_item").withColumn("turn_index", F.col("turns_before"))
    # J5
    counts = rows.filter(is_type("event_msg") & (j.text(p, "$.type") == "token_count")).withColumn("u", usage(j.at(p, "$.info.last_token_usage")))
    counts = counts.withColumn("context_total", F.col("u.input_uncached") + F.col("u.cache_read") + F.col("u.cache_write_5m") + F.col("u.cache_write_1h"))
    push = items.filter(_role(p) == "assistant").select("session_key", "line", "turn_index", F.lit(True).alias("push"), F.lit(False).alias("pop"), F.lit(False).alias("peek"))
    pops = counts.select("session_key", "line", F.lit(None).cast("long").alias("turn_index"), F.lit(False).alias("push"), (F.col("context_total") != 0).alias("pop"), (F.col("context_total") == 0).alias("peek"))
    attached = attach_counts(push.unionByName(pops))
    used = counts.select("session_key", "line", "u", "context_total").join(attached, ["session_key", "line"])
    latest = used.filter("turn_index is not null").groupBy("session_key", "turn_index").agg(F.max_by(F.struct("u", "context_total"), "line").alias("x")).select("session_key", "turn_index", "x.u", "x.context_total")
    zero = ("input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output", "context_total")
    turns = items.select("session_key", "turn_index", F.col("line").alias("src_line"), _role(p).alias("role"), "model", F.coalesce("at", F.timestamp_seconds(F.lit(0))).alias("ts"), F.lit(False).alias("is_sidechain"), F.lit(False).alias("is_api_error"))
    turns = turns.join(latest, ["session_key", "turn_index"], "left").select(*turns.columns, "u.*", "context_total").fillna(0, list(zero))
    # The tool of a result is that of the latest call of its id
    call_id = j.filled(p, "$.call_id")
    call = F.when(j.text(p, "$.type").isin(*CALLS), F.struct(F.coalesce(j.filled(p, "$.name"), F.lit("unknown")).alias("tool_name"), j.filled(p, "$.namespace").alias("mcp_server")))
    named = items.withColumn("call_id", call_id).withColumn("call", call)
    named = named.withColumn("linked", F.coalesce("call", F.when(j.text(p, "$.type").isin(*OUTPUTS) & F.col("call_id").isNotNull(), matching.latest_call(named, F.col("call"), ("session_key", "call_id"), ("line",)))))
    spans = named.select("session_key", "turn_index", "linked", F.posexplode(_spans(p, F.col("limit"))).alias("ord", "s")).select("session_key", "turn_index", "ord", "s.*", "linked.tool_name", "linked.mcp_server")
    # J16, W11
    kinds = rows.withColumn("kind", F.when(is_type("compacted"), "compacted").when(is_type("event_msg") & (j.text(p, "$.type") == "context_compacted"), "marker")).filter("kind is not null")
    held = matching.drop_consumed_markers(kinds, "marker", "compacted")
    full = F.col("kind") == "compacted"
    lineage = F.struct(j.real(p, "$.window_number").cast("long").alias("window_number"), *[j.text(p, f"$.{c}").alias(c) for c in ("window_id", "previous_window_id", "first_window_id")])
    none = F.coalesce(*[lineage[c].cast("string") for c in ("window_number", "window_id", "previous_window_id", "first_window_id")]).isNull()
    compactions = held.select("session_key", F.col("line").alias("ord"), F.col("now").alias("at"), F.col("turns_before").alias("turn_index"), F.when(full, compaction.summary_estimate(utf16_length(F.coalesce(j.text(p, "$.message"), F.lit(""))))).otherwise(0).cast("long").alias("summary_tokens_est"), F.when(full & ~none, lineage).alias("lineage"))
    # W8
    models = rows.filter(is_type("turn_context")).select("session_key", "line", j.filled(p, "$.model").alias("value"), F.col("now").alias("at"))
    events = matching.changes(models, "value").select("session_key", F.lit("modeChange").alias("kind"), "at", F.lit("model").alias("field"), "was", F.col("value").alias("now"))
    first = lambda c: F.min_by(c, F.when(is_type("session_meta"), F.col("line")))
    on = F.when(F.col("at").isNotNull(), F.col("line"))
    meta = rows.groupBy("session_key").agg(
        first(j.text(p, "$.cli_version")).alias("harness_version"), first(j.filled(p, "$.cwd")).alias("seen_cwd"), first(F.coalesce(j.filled(p, "$.git.branch"), j.filled(p, "$.branch"))).alias("git_branch"),
        first(j.filled(p, "$.base_instructions.text")).alias("system_prompt"), first(tool_schemas(j.items(p, "$.dynamic_tools"))).alias("tool_schemas"), F.max_by("model", "line").alias("model"),
        F.max_by(j.filled(p, "$.user_instructions"), F.when(is_type("turn_context") & j.filled(p, "$.user_instructions").isNotNull(), F.col("line"))).alias("project_instructions"),
        F.min_by("at", on).alias("started_at"), F.max_by("at", on).alias("ended_at"),
    )
    sessions = refs.withColumnRenamed("path", "session_key").join(meta, "session_key", "left").withColumn("cwd", F.coalesce("seen_cwd", "cwd", F.lit(""))).withColumn("model", F.coalesce("model", F.lit("unknown"))).withColumn("harness_version", F.coalesce("harness_version", F.lit("")))
    odd_item = rows.filter(is_type("response_item") & ~F.col("is_item"))
    kind = F.coalesce(j.text(p, "$.type"), F.lit(""))
    odd_event = rows.filter(is_type("event_msg") & ~kind.isin("token_count", "context_compacted", *TOLERATED))
    orphans = used.filter("turn_index is null")
    gaps = matching.counter_gap(turns, counts.select("session_key", "line", j.real(p, "$.info.total_token_usage.total_tokens").alias("total_tokens")).filter("total_tokens is not null")).withColumn("line", F.lit(None).cast("long"))
    warnings = line_warnings(parsed, KNOWN).unionByName(_warn(odd_item, "unknown-response-item", "unknown item", "response_item")).unionByName(_warn(odd_event, "unknown-event-msg", "unknown event", "event_msg"))
    warnings = warnings.unionByName(_warn(orphans, "orphan-token-count", "no turn for a token count", "event_msg")).unionByName(_warn(gaps, "token-count-mismatch", "the counter is over 1 % off the sum of turns", None))
    return finished(turns, spans, compactions, events, sessions, warnings)
