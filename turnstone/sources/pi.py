"""Parser of entry trees and of mutation logs: S9-S11, P5, P26-P32, J8, J9, W9, W11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import json as j
from turnstone.functions.text import utf16_length
from turnstone.operators import compaction, matching, tree
from turnstone.plans import tables
from turnstone.sources.lines import object_of, read_lines
from turnstone.sources.model import Parsed, finished

KNOWN = "branch_summary compaction custom custom_message label message model_change session_info thinking_level_change".split()


def usage(u: Column) -> Column:
    """P5: an hour's writes are a part of all writes, if they are there and not null; the rest, unclamped, is 5m."""
    given = j.at(u, "$.cacheWrite1h").isNotNull() & (F.coalesce(j.kind(u, "$.cacheWrite1h"), F.lit("")) != "VOID")
    hour = F.when(given, j.number(u, "$.cacheWrite1h")).otherwise(F.lit(0).cast("long"))
    return F.struct(j.number(u, "$.input").alias("input_uncached"), j.number(u, "$.cacheRead").alias("cache_read"), (j.number(u, "$.cacheWrite") - hour).alias("cache_write_5m"), hour.alias("cache_write_1h"), j.number(u, "$.output").alias("output"), j.real(u, "$.reasoning").cast("long").alias("reasoning_output"))


def display_cost(u: Column) -> Column:
    """What the log says was paid, null where it has no cost."""
    return F.when(j.is_object(u, "$.cost"), F.coalesce(j.real(u, "$.cost.total"), F.lit(0.0)))


def display_parts(u: Column) -> Column:
    """The parts of it; the dollars of cache writes are divided as their tokens are."""
    tokens, hour = j.number(u, "$.cacheWrite"), j.number(u, "$.cacheWrite1h")
    share = F.when(tokens > 0, hour / tokens).otherwise(F.lit(0.0))
    writes = F.coalesce(j.real(u, "$.cost.cacheWrite"), F.lit(0.0))
    part = lambda c: F.coalesce(j.real(u, f"$.cost.{c}"), F.lit(0.0))
    return F.struct(part("input").alias("input"), part("output").alias("output"), part("cacheRead").alias("cache_read"), (writes - writes * share).alias("cache_write_5m"), (writes * share).alias("cache_write_1h"), part("total").alias("total"))


def flat_text(v: Column, path: str) -> Column:
    """A string, or blocks: strings and texts as they are, others as JSON."""
    one = lambda b: F.when(j.kind(b) == "STRING", j.text(b, "$")).when((j.text(b, "$.type") == "text") & j.text(b, "$.text").isNotNull(), j.text(b, "$.text")).otherwise(j.dumped(b))
    return F.coalesce(j.text(v, path), F.array_join(F.transform(j.items(v, path), one), ""), F.lit(""))


def _span(category: str, text: Column, role: str, tool=None, truncated=None) -> Column:
    return F.struct(F.lit(category).alias("category"), text.alias("text"), F.lit(role).alias("turn_role"), (F.lit(None).cast("string") if tool is None else tool).alias("tool_name"), (F.lit(False) if truncated is None else truncated).alias("truncated"))


def spans_of(v: Column, entry_type: Column) -> Column:
    """The spans of an entry."""
    m = j.at(v, "$.message")
    role = j.text(m, "$.role")
    filled = lambda text, span: F.when(F.length(text) > 0, F.array(span))

    def block(b):
        kind, given = j.text(b, "$.type"), j.at(b, "$.arguments")
        args = F.when(given.isNull() | (F.coalesce(j.kind(b, "$.arguments"), F.lit("")) == "VOID"), F.lit("{}")).otherwise(j.dumped(given))
        return F.when((kind == "text") & j.filled(b, "$.text").isNotNull(), _span("assistantText", j.filled(b, "$.text"), "assistant")).when(
            (kind == "thinking") & j.filled(b, "$.thinking").isNotNull(), _span("thinking", j.filled(b, "$.thinking"), "assistant")
        ).when(kind == "toolCall", _span("toolCallArgs", args, "assistant", F.coalesce(j.text(b, "$.name"), F.lit("unknown"))))

    said = F.array_compact(F.transform(j.items(m, "$.content"), block))
    body = flat_text(m, "$.content")
    bash = F.concat(F.coalesce(j.text(m, "$.command"), F.lit("")), F.coalesce(j.text(m, "$.output"), F.lit("")))
    message = (
        F.when(role == "assistant", said).when(role == "user", filled(body, _span("userText", body, "user"))).when(role == "toolResult", F.array(_span("toolResults", body, "user", F.coalesce(j.text(m, "$.toolName"), F.lit("unknown")))))
        .when((role == "bashExecution") & ~j.flag(m, "$.excludeFromContext"), F.array(_span("toolResults", bash, "user", F.lit("bash"), j.flag(m, "$.truncated")))).when((role == "custom") & j.flag(m, "$.display"), filled(body, _span("coordination", body, "user")))
    )
    custom, summary = flat_text(v, "$.content"), F.coalesce(j.text(v, "$.summary"), F.lit(""))
    return F.when(entry_type == "message", message).when((entry_type == "custom_message") & j.flag(v, "$.display"), filled(custom, _span("coordination", custom, "user"))).when(entry_type == "compaction", filled(summary, _span("compactionSummaries", summary, "user")))


def _warning(df: DataFrame, code, message: str, line="line", record_type=None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    return df.select("session_key", (F.lit(code) if isinstance(code, str) else code).alias("code"), (null("long") if line is None else F.col(line)).alias("line"), (null("string") if record_type is None else F.col(record_type)).alias("record_type"), F.lit(message).alias("message"))


def parse(refs: DataFrame) -> Parsed:
    return parse_lines(read_lines(refs), refs)


def parse_lines(lines: DataFrame, refs: DataFrame, cut=tables.cut) -> Parsed:
    """Sessions of both layouts; which one a file has, its first line says. Lines are numbered without blank ones.

    Parsed lines, entries and the walked entries are written, since all relations read them. What is narrow is taken from a
    line where it is parsed; contents go by session only to the relations that have them.
    """
    v = F.col("v")
    nth = F.row_number().over(Window.partitionBy("session_key").orderBy("line"))
    loose_text = lambda p: F.coalesce(j.text(v, p), j.dumped(j.at(v, p)), F.lit(""))
    rows = lines.select("session_key", nth.cast("long").alias("line"), object_of(F.col("raw")).alias("v"))
    rows = rows.withColumns({"id": j.text(v, "$.id"), "entry_type": j.text(v, "$.type"), "parent_id": j.text(v, "$.parentId"), "said_role": j.text(v, "$.message.role")})
    assistant = (F.col("entry_type") == "message") & (F.col("said_role") == "assistant")
    rows = rows.withColumn("used", F.when(assistant, j.at(v, "$.message.usage"))).withColumns({
        "there": v.isNotNull(), "parent_fits": F.col("parent_id").isNotNull() | (j.at(v, "$.parentId").isNotNull() & F.coalesce(j.kind(v, "$.parentId"), F.lit("VOID")).isin("VOID", "STRING")), "kind": j.text(v, "$.kind"), "stamp": j.text(v, "$.timestamp"), "ms": j.real(v, "$.timestamp"),
        "said_model": F.when(assistant, j.text(v, "$.message.model")), "model_id": F.when(F.col("entry_type") == "model_change", loose_text("$.modelId")), "said_ms": F.when(F.col("entry_type") == "message", j.real(v, "$.message.timestamp")),
        "u": F.when(F.col("used").isNotNull(), usage(F.col("used"))), "paid": display_cost(F.col("used")),
    }).drop("used")
    rows = cut(rows)
    head = rows.filter("line = 1").select("session_key", F.col("v").alias("h"))
    h = F.col("h")
    layout_b = j.at(h, "$.kind").isNotNull() & (F.coalesce(j.text(h, "$.type"), F.lit("")) != "session")
    sound = (j.text(h, "$.type") == "session") & j.text(h, "$.id").isNotNull() & j.text(h, "$.timestamp").isNotNull() & j.text(h, "$.cwd").isNotNull()
    head = head.withColumn("layout", F.when(layout_b, "b").when(sound, "a"))
    keyed = rows.filter("line > 1").join(head.select("session_key", "layout"), "session_key")
    # Entries with what they need
    named = F.col("id").isNotNull() & F.col("entry_type").isNotNull() & F.col("parent_fits")
    entry_a = (F.col("layout") == "a") & F.coalesce(named & F.col("stamp").isNotNull(), F.lit(False))
    is_b = F.col("layout") == "b"
    entry_b = is_b & F.coalesce((F.col("kind") == "entry") & named & F.col("ms").isNotNull(), F.lit(False))
    keyed = keyed.withColumn("is_entry", entry_a | entry_b)
    # a repeated id has its last value at its first place
    held = F.struct("line", "parent_id", "entry_type", "said_role", "stamp", "ms", "said_model", "model_id", "said_ms", "u", "paid")
    entries = cut(keyed.filter("is_entry").groupBy("session_key", "layout", "id").agg(F.max_by(held, "line").alias("x"), F.min("line").alias("place")).select("session_key", "layout", "id", "place", "x.*"))
    seq = F.coalesce(j.real(v, "$.seq"), F.col("line").cast("double"))
    moves = keyed.filter(is_b & (F.col("kind") == "lane") & j.text(v, "$.laneId").isNotNull() & j.text(v, "$.entryId").isNotNull()).select("session_key", j.text(v, "$.laneId").alias("lane_id"), j.text(v, "$.entryId").alias("entry_id"), seq.alias("seq"), "line")
    lanes = tree.active_lane(moves)
    leaves = entries.filter("layout = 'a'").groupBy("session_key").agg(F.max_by("id", "place").alias("id")).unionByName(lanes.select("session_key", "id"))
    path = tree.paths_to_root(entries.select("session_key", "id", "parent_id"), leaves, cut)
    walked = entries.join(path, ["session_key", "id"]).withColumn("step", -F.col("up"))
    # turns
    role = F.col("said_role")
    turn_role = F.when(role == "assistant", "assistant").when(role.isin("user", "toolResult", "bashExecution", "custom"), "user")
    walked = walked.withColumn("role", F.when(F.col("entry_type") == "message", turn_role))
    by = Window.partitionBy("session_key").orderBy("step")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    in_a = F.col("layout") == "a"
    says = F.when(F.col("role") == "assistant", F.col("said_model")).when(in_a & (F.col("entry_type") == "model_change"), F.col("model_id"))
    walked = walked.withColumn("says", says).withColumn("model", F.coalesce(matching.last_known(F.col("says"), order="step"), F.lit(""))).withColumn("model_before", F.last("says", ignorenulls=True).over(before))
    walked = walked.withColumn("turns_before", F.coalesce(matching.seen_before(F.col("role").isNotNull(), order="step"), F.lit(0)))
    walked = walked.withColumn("own", F.when(F.col("role") == "assistant", F.col("turns_before")))
    walked = walked.withColumn("goes_to", F.coalesce("own", matching.next_holder(walked, F.col("role") == "assistant", F.col("own"), order=("step",))))
    entry_time = F.coalesce(F.try_to_timestamp("stamp"), F.timestamp_millis(F.col("ms").cast("long")))
    walked = walked.withColumn("entry_at", entry_time)
    walked = cut(walked)
    contents = lambda df, those: df.join(rows.filter(those).select("session_key", "line", "v"), ["session_key", "line"])
    turns = walked.filter("role is not null").select(
        "session_key", F.col("turns_before").alias("turn_index"), F.col("place").alias("src_line"), "role", "model", F.coalesce(F.timestamp_millis(F.col("said_ms").cast("long")), "entry_at").alias("ts"), F.lit(False).alias("is_sidechain"), F.lit(False).alias("is_api_error"),
        *[F.coalesce(f"u.{c}", F.lit(0).cast("long")).alias(c) for c in ("input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output")], "u.reasoning_output", F.coalesce(F.col("u.input_uncached") + F.col("u.cache_read") + F.col("u.cache_write_5m") + F.col("u.cache_write_1h"), F.lit(0)).alias("context_total"), F.col("paid").alias("logged_cost"),
    )
    own_type = F.when((F.col("entry_type") == "message") & F.col("role").isNotNull(), "message").when((F.col("entry_type") == "compaction") | (in_a & (F.col("entry_type") == "custom_message")), F.col("entry_type"))
    speaking = walked.select("session_key", "line", "layout", "step", "goes_to", own_type.alias("own_type")).filter("own_type is not null")
    spread = contents(speaking, F.col("entry_type").isin("message", "compaction", "custom_message"))
    spread = spread.select("session_key", "layout", "step", "goes_to", F.posexplode(spans_of(v, F.col("own_type"))).alias("pos", "s")).select("session_key", "layout", "step", "goes_to", "pos", "s.*")
    order = F.row_number().over(Window.partitionBy("session_key", "goes_to").orderBy("step", "pos")) - 1
    spans = spread.filter("goes_to is not null").withColumn("ord", order).withColumnRenamed("goes_to", "turn_index")
    summary = F.coalesce(j.text(v, "$.summary"), F.lit(""))
    compactions = contents(walked.filter("entry_type = 'compaction'"), "entry_type = 'compaction'").select(
        "session_key", (F.col("step") + F.max("up").over(Window.partitionBy("session_key"))).alias("ord"), F.col("entry_at").alias("at"), F.col("turns_before").alias("turn_index"), j.real(v, "$.tokensBefore").cast("long").alias("tokens_before"),
        compaction.summary_estimate(utf16_length(summary)).alias("summary_tokens_est"), display_cost(j.at(v, "$.usage")).alias("cost"),
    )
    levels = contents(walked.filter(in_a & (F.col("entry_type") == "thinking_level_change")), "entry_type = 'thinking_level_change'").withColumn("now", loose_text("$.thinkingLevel"))
    level_events = levels.select("session_key", F.lit("modeChange").alias("kind"), F.col("entry_at").alias("at"), F.lit("thinkingLevel").alias("field"), F.lag("now").over(by).alias("was"), "now")
    models = walked.filter(in_a & (F.col("entry_type") == "model_change")).select("session_key", F.lit("modeChange").alias("kind"), F.col("entry_at").alias("at"), F.lit("model").alias("field"), F.nullif("model_before", F.lit("")).alias("was"), F.col("says").alias("now"))
    last = walked.groupBy("session_key").agg(F.max_by("entry_at", "step").alias("last_at"), F.max_by("model", "step").alias("model"))
    started = F.when(F.col("layout") == "a", j.instant(h, "$.timestamp")).when(F.col("layout") == "b", F.coalesce(F.timestamp_millis(j.real(h, "$.timestamp").cast("long")), F.col("mtime"))).otherwise(F.timestamp_seconds(F.lit(0)))
    version = j.real(h, "$.version").cast("long").cast("string")
    sessions = refs.withColumnRenamed("path", "session_key").join(head, "session_key", "left").join(last, "session_key", "left").withColumn("started_at", started)
    sessions = sessions.withColumns({
        "harness_version": F.coalesce(version, F.when(F.col("layout") == "b", "4").otherwise("unknown")), "session_id": F.coalesce(j.text(h, "$.id"), F.col("session_id")), "cwd": F.coalesce(j.text(h, "$.cwd"), F.col("cwd"), F.lit("")),
        "ended_at": F.coalesce("last_at", "started_at"), "model": F.coalesce("model", F.lit("")),
    })
    # warnings
    no_line = refs.select(F.col("path").alias("session_key")).join(rows.select("session_key").distinct(), "session_key", "left_anti").withColumn("line", F.lit(1).cast("long"))
    out = _warning(no_line, "pi-empty-file", "no header line")
    add = lambda df, *a, **k: out.unionByName(_warning(df, *a, **k))
    out = add(head.filter("layout is null").withColumn("line", F.lit(1).cast("long")), "pi-malformed-header", "the header isn't one")
    out = add(keyed.filter("layout = 'a' and not is_entry"), "pi-malformed-entry", "an entry lacks what it needs", record_type="entry_type")
    out = add(keyed.filter(F.col("is_entry") & in_a & ~F.col("entry_type").isin(KNOWN)), "pi-unknown-entry-type", "unknown type of entry", record_type="entry_type")
    out = add(tree.off_path(entries.filter(in_a), path), "pi-off-path-branches", "entries on branches that aren't visited", line=None)
    out = add(head.filter(in_a & j.text(h, "$.parentSession").isNotNull()), "pi-forked-session", "forked from another session", line=None)
    no_role = walked.filter("entry_type = 'message' and role is null")
    out = add(no_role, F.when(F.col("layout") == "a", "pi-unrecognized-message-role").otherwise("pi-systemb-unrecognized-message-role"), "a message without a known role", line=None, record_type="entry_type")
    trailing = spread.filter("goes_to is null").select("session_key", "layout").distinct()
    out = add(trailing, F.when(F.col("layout") == "a", "pi-trailing-content-unattached").otherwise("pi-systemb-trailing-content-unattached"), "content after the last assistant turn", line=None)
    b_rows = keyed.filter("layout = 'b'")
    out = add(b_rows.filter("not there"), "pi-systemb-malformed-line", "no JSON object")
    out = add(b_rows.filter("kind = 'entry' and not is_entry"), "pi-systemb-malformed-entry", "an entry lacks what it needs", record_type="entry_type")
    out = add(b_rows.filter((F.col("kind") == "lane") & (j.text(v, "$.laneId").isNull() | j.text(v, "$.entryId").isNull())), "pi-systemb-malformed-lane", "a lane lacks what it needs")
    out = add(b_rows.filter(F.col("there") & ~F.coalesce(F.col("kind"), F.lit("")).isin("entry", "lane", "record", "fact")), "pi-systemb-unknown-kind", "unknown kind of mutation", record_type="kind")
    out = add(lanes.filter("others > 0"), "pi-systemb-multiple-lanes", "other lanes are ignored", line=None)
    b_walked = walked.filter("layout = 'b'")
    out = add(b_walked.filter("entry_type = 'compaction'"), "pi-systemb-compaction-retained-tail", "what a compaction retained isn't replayed", line=None)
    out = add(b_walked.filter("entry_type not in ('message', 'compaction')"), "pi-systemb-unrecognized-entry-type", "unknown type of entry", line=None, record_type="entry_type")
    samples = b_rows.filter((F.col("kind") == "record") & j.at(v, "$.usage").isNotNull()).withColumn("first", -F.col("line"))
    counters = samples.groupBy("session_key").agg(F.max_by(j.number(v, "$.usage.totalTokens"), F.struct(seq, "first")).alias("total_tokens")).withColumn("line", F.lit(0))
    out = add(matching.counter_gap(turns, counters), "pi-systemb-usage-record-mismatch", "the counter is over 1 % off the sum of turns", line=None)
    return finished(turns, spans, compactions, level_events.unionByName(models), sessions, out)
