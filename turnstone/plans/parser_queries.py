"""Queries of the parsers: events spelt as the lines of transcripts, parsed, and the same computed in SQL from the events.

A user's events are a session; an event's place is its line. What an event says follows from its type and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.plans import mapping as m
from turnstone.plans.queries import _query
from turnstone.sources import claude, codex, pi
from turnstone.sources.lines import parse_lines

_E = f"{m.TIMELINE}, e AS (SELECT 's' || session_key AS s, session_key AS u, turn_index + 1 AS line, event_type AS kind, event_id AS n FROM timeline)"


def _lines(spark, d, spelt: dict[str, str], shift: int = 1) -> DataFrame:
    """(session_key, line, raw) of events, spelt by kind in Spark SQL over n, the event's number, and t, its place."""
    cases = " ".join(f"WHEN '{kind}' THEN {raw}" for kind, raw in spelt.items())
    rows = m.timeline(spark, d).select(F.concat(F.lit("s"), F.col("session_key")).alias("session_key"), F.col("turn_index").alias("t"), F.col("event_id").alias("n"), "event_type")
    return rows.select("session_key", (F.col("t") + shift).alias("line"), F.expr(f"CASE event_type {cases} END").alias("raw"))


def _refs(lines: DataFrame, harness: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return lines.select(F.col("session_key").alias("path")).distinct().select(
        F.lit(harness).alias("harness"), F.col("path").alias("session_id"), "path", F.lit("main").alias("kind"), null.alias("parent_id"), null.alias("cwd"), F.timestamp_seconds(F.lit(0)).alias("mtime"), F.lit(1).cast("long").alias("size_bytes")
    )


_CLAUDE = {
    "view": """concat('{"type":"assistant","requestId":"r', n, '","message":{"id":"m', n, '","model":"x', n % 3, '","usage":{"input_tokens":', n, ',"output_tokens":5,"cache_read_input_tokens":7', CASE WHEN n % 4 = 0 THEN ',"iterations":[{"input_tokens":10,"output_tokens":2},{"input_tokens":1,"output_tokens":4}]' ELSE '' END,
        '},"content":[{"type":"text","text":"say', n, '"},{"type":"thinking","thinking":"hm"},{"type":"tool_use","id":"t', n % 10, '","name":"', CASE WHEN n % 2 = 1 THEN 'mcp__srv__do' ELSE 'Read' END, '","input":{"a":', n, '}}]}}')""",
    "signup": """'{"type":"assistant","isApiErrorMessage":true,"message":{"usage":"none"}}'""",
    "click": """concat('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t', n % 10, '","content":"res', n, '"},{"type":"text","text":"also"}]}', CASE WHEN n % 3 = 0 THEN ',"toolUseResult":{"stdout":"out","stderr":"err"}' ELSE '' END, '}')""",
    "purchase": """concat('{"type":"user","message":{"content":"', CASE WHEN n % 2 = 1 THEN concat(' <teammate-message id=', n, '>') ELSE concat('hello', n) END, '"}}')""",
    "error": """CASE WHEN n % 2 = 1 THEN '{"type":"novel"}' ELSE '{bad' END""",
}
_CLAUDE_SQL = f"""{_E}, own AS (SELECT *, CASE WHEN kind IN ('view', 'signup') THEN row_number() OVER (PARTITION BY s, kind IN ('view', 'signup') ORDER BY line) - 1 END AS own FROM e),
    held AS (SELECT *, coalesce(own, min(own) OVER (PARTITION BY s ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS turn_index FROM own),
    calls AS (SELECT DISTINCT s, n % 10 AS id FROM e WHERE kind = 'view'),
    said AS (
        SELECT s, line, 0 AS pos, turn_index, 'assistantText' AS category, length('say' || n) AS size, NULL AS id FROM held WHERE kind = 'view' UNION ALL SELECT s, line, 1, turn_index, 'thinking', 2, NULL FROM held WHERE kind = 'view'
        UNION ALL SELECT s, line, 2, turn_index, 'toolCallArgs', length('{{"a":' || n || '}}'), n % 10 FROM held WHERE kind = 'view' UNION ALL SELECT s, line, 0, turn_index, 'userText', 4, NULL FROM held WHERE kind = 'click'
        UNION ALL SELECT s, line, 1, turn_index, 'toolResults', CASE WHEN n % 3 = 0 THEN 6 ELSE length('res' || n) END, n % 10 FROM held WHERE kind = 'click'
        UNION ALL SELECT s, line, 0, turn_index, CASE WHEN n % 2 = 1 THEN 'coordination' ELSE 'userText' END, CASE WHEN n % 2 = 1 THEN length(' <teammate-message id=' || n || '>') ELSE length('hello' || n) END, NULL FROM held WHERE kind = 'purchase')"""


def _claude(spark, d):
    lines = _lines(spark, d, _CLAUDE)
    refs = _refs(lines, "claude-code")
    offloaded = refs.filter(F.substring("path", 2, 9).cast("long") % 2 == 0).select(F.col("path").alias("family_id"), F.explode(F.array(F.lit("t1"), F.lit("t4"))).alias("tool_use_id"))
    return claude.parse_records(parse_lines(lines), refs, offloaded)


@_query(f"""WITH {_CLAUDE_SQL} SELECT s AS session_key, own AS turn_index, line AS src_line, CASE WHEN kind = 'view' THEN 'x' || (n % 3) ELSE 'unknown' END AS model, CASE WHEN kind = 'view' THEN 'm' || n END AS message_id, kind = 'signup' AS is_api_error,
    CASE WHEN kind = 'signup' THEN 0 WHEN n % 4 = 0 THEN 11 ELSE n END AS input_uncached, CASE WHEN kind = 'view' AND n % 4 <> 0 THEN 7 ELSE 0 END AS cache_read, CASE WHEN kind = 'signup' THEN 0 WHEN n % 4 = 0 THEN 6 ELSE 5 END AS output,
    CASE WHEN kind = 'signup' THEN 0 WHEN n % 4 = 0 THEN 11 ELSE n + 7 END AS context_total FROM held WHERE own IS NOT NULL""")  # fmt: skip
def p7_claude_turns(spark, d):
    return _claude(spark, d).turns.select("session_key", "turn_index", "src_line", "model", "message_id", "is_api_error", "input_uncached", "cache_read", "output", "context_total")


@_query(f"""WITH {_CLAUDE_SQL} SELECT x.s AS session_key, turn_index, row_number() OVER (PARTITION BY x.s, turn_index ORDER BY line, pos) - 1 AS ord, category, size AS char_count, CASE WHEN c.id IS NULL THEN NULL WHEN x.id % 2 = 1 THEN 'do' ELSE 'Read' END AS tool_name, CASE WHEN c.id % 2 = 1 THEN 'srv' END AS mcp_server,
    category = 'toolResults' AND x.id IN (1, 4) AND substr(x.s, 2)::BIGINT % 2 = 0 AS truncated FROM said x LEFT JOIN calls c ON c.s = x.s AND c.id = x.id WHERE turn_index IS NOT NULL""")  # fmt: skip
def p20_claude_spans(spark, d):
    return _claude(spark, d).spans.select("session_key", "turn_index", "ord", "category", "char_count", "tool_name", "mcp_server", "truncated")


@_query(f"""WITH {_CLAUDE_SQL} SELECT s AS session_key, CASE WHEN n % 2 = 1 THEN 'unknown-record-type' ELSE 'malformed-line' END AS code, line FROM e WHERE kind = 'error' UNION ALL SELECT DISTINCT s, 'trailing-user-content-unattached', NULL FROM said WHERE turn_index IS NULL""")
def wn_claude_warnings(spark, d):
    return _claude(spark, d).warnings.select("session_key", "code", "line")


_AT = """'{"timestamp":"2026-01-01T00:00:00Z","type":'"""
_CODEX = {
    "view": f"""concat({_AT}, '"response_item","payload":{{"type":"function_call","name":"f', n % 4, '","call_id":"c', n % 6, '","arguments":"{{}}"', CASE WHEN n % 3 = 0 THEN ',"namespace":"ns"' ELSE '' END, '}}}}')""",
    "click": f"""concat({_AT}, '"response_item","payload":{{"type":"function_call_output","call_id":"c', n % 6, '","output":"out', n, '"}}}}')""",
    "purchase": f"""concat({_AT}, '"turn_context","payload":{{', CASE WHEN n % 5 <> 0 THEN concat('"model":"g', n % 2, '",') ELSE '' END, '"truncation_policy":{{', CASE WHEN n % 4 <> 0 THEN concat('"limit":', n % 40) ELSE '' END, '}}}}}}')""",
    "error": f"""concat({_AT}, '"event_msg","payload":{{"type":"token_count","info":{{"last_token_usage":{{"input_tokens":', CASE WHEN n % 7 = 0 THEN 0 ELSE n END, ',"cached_input_tokens":', CASE WHEN n % 7 = 0 THEN 0 ELSE 3 END, ',"output_tokens":2}}}}}}}}')""",
    "signup": f"""concat({_AT}, '"response_item","payload":{{"type":"message","role":"user","content":[{{"type":"input_text","text":"', CASE WHEN n % 2 = 1 THEN '# AGENTS.md instructions ' ELSE 'hi' END, n, '"}}]}}}}')""",
}
_CODEX_SQL = f"""{_E}, rows_ AS (SELECT *, CASE WHEN kind IN ('view', 'click', 'signup') THEN row_number() OVER (PARTITION BY s, kind IN ('view', 'click', 'signup') ORDER BY line) - 1 END AS turn_index,
        coalesce(last_value(CASE WHEN kind = 'purchase' AND n % 5 <> 0 THEN 'g' || (n % 2) END IGNORE NULLS) OVER so_far, 'unknown') AS model, max(CASE WHEN kind = 'purchase' THEN line END) OVER so_far AS context,
        sum(CASE WHEN kind = 'view' THEN 1 WHEN kind = 'error' AND n % 7 <> 0 THEN -1 ELSE 0 END) OVER so_far AS depth FROM e WINDOW so_far AS (PARTITION BY s ORDER BY line)),
    counted AS (SELECT p.*, (SELECT max(q.line) FROM rows_ q WHERE q.s = p.s AND q.kind = 'view' AND q.line < p.line AND q.depth = p.depth + CASE WHEN p.n % 7 <> 0 THEN 1 ELSE 0 END) AS target FROM rows_ p WHERE kind = 'error'),
    latest AS (SELECT s, target, max(line) AS line FROM counted WHERE target IS NOT NULL GROUP BY 1, 2),
    used AS (SELECT s, target, CASE WHEN n % 7 = 0 THEN 0 ELSE greatest(0, n - 3) END AS i, CASE WHEN n % 7 = 0 THEN 0 ELSE 3 END AS r, 2 AS o FROM counted JOIN latest USING (s, target, line))"""


def _codex(spark, d):
    lines = _lines(spark, d, _CODEX)
    return codex.parse_records(parse_lines(lines), _refs(lines, "codex"))


@_query(f"""WITH {_CODEX_SQL} SELECT r.s AS session_key, turn_index, line AS src_line, CASE WHEN kind = 'view' THEN 'assistant' ELSE 'user' END AS role, model, coalesce(i, 0) AS input_uncached, coalesce(u.r, 0) AS cache_read, coalesce(o, 0) AS output
    FROM rows_ r LEFT JOIN used u ON u.s = r.s AND u.target = r.line WHERE turn_index IS NOT NULL""")  # fmt: skip
def j5_codex_turns(spark, d):
    return _codex(spark, d).turns.select("session_key", "turn_index", "src_line", "role", "model", "input_uncached", "cache_read", "output")


@_query(f"""WITH {_CODEX_SQL}, limits AS (SELECT s, line AS context, CASE WHEN n % 4 <> 0 THEN n % 40 END AS most FROM e WHERE kind = 'purchase'), linked AS (SELECT r.*, CASE WHEN kind = 'view' THEN n ELSE (SELECT arg_max(c.n, c.line) FROM e c WHERE c.s = r.s AND c.kind = 'view' AND c.n % 6 = r.n % 6 AND c.line < r.line) END AS by_ FROM rows_ r WHERE turn_index IS NOT NULL)
    SELECT l.s AS session_key, turn_index, CASE WHEN kind = 'view' THEN 'toolCallArgs' WHEN kind = 'click' THEN 'toolResults' WHEN n % 2 = 1 THEN 'instructionInjection' ELSE 'userText' END AS category,
        CASE WHEN kind = 'view' THEN 2 WHEN kind = 'click' THEN length('out' || n) WHEN n % 2 = 1 THEN length('# AGENTS.md instructions ' || n) ELSE length('hi' || n) END AS char_count,
        CASE WHEN kind <> 'signup' THEN 'f' || (by_ % 4) END AS tool_name, CASE WHEN kind <> 'signup' AND by_ % 3 = 0 THEN 'ns' END AS mcp_server, coalesce(kind = 'signup' AND n % 2 = 1 AND most <= length('# AGENTS.md instructions ' || n), FALSE) AS truncated FROM linked l LEFT JOIN limits USING (s, context)""")  # fmt: skip
def j7_codex_spans(spark, d):
    return _codex(spark, d).spans.select("session_key", "turn_index", "category", "char_count", "tool_name", "mcp_server", "truncated")


@_query(f"""WITH {_CODEX_SQL}, named AS (SELECT s, line, 'g' || (n % 2) AS now, lag('g' || (n % 2)) OVER (PARTITION BY s ORDER BY line) AS was FROM e WHERE kind = 'purchase' AND n % 5 <> 0) SELECT s AS session_key, was, now FROM named WHERE was <> now""")
def p32_codex_model_changes(spark, d):
    return _codex(spark, d).events.filter("kind = 'modeChange'").select("session_key", "was", "now")


@_query(f"WITH {_CODEX_SQL} SELECT s AS session_key, 'orphan-token-count' AS code, line FROM counted WHERE target IS NULL")
def wn_codex_orphans(spark, d):
    return _codex(spark, d).warnings.select("session_key", "code", "line")


_ENTRY = """concat('{"id":"e', t, '","parentId":', CASE WHEN t = 0 THEN 'null' WHEN n % 10 = 0 AND t > 1 THEN concat('"e', t - 2, '"') ELSE concat('"e', t - 1, '"') END, ',"timestamp":"2026-01-01T00:00:00Z",'"""
_PI = {
    "view": _ENTRY + """, '"type":"message","message":{"role":"assistant","model":"p', n % 3, '","usage":{"input":', n, ',"output":2,"cacheRead":1,"cacheWrite":10,"cacheWrite1h":4,"cost":{"total":0.5}},"content":[{"type":"text","text":"a', n, '"},{"type":"toolCall","name":"bash"}]}}')""",
    "click": _ENTRY + """, '"type":"message","message":{"role":"toolResult","toolName":"bash","content":[{"type":"text","text":"r', n, '"}]}}')""",
    "purchase": _ENTRY + """, '"type":"model_change","modelId":"q', n % 2, '"}')""",
    "error": _ENTRY + """, '"type":"message","message":{"role":"bashExecution","command":"c","output":"o', n, '","excludeFromContext":', CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END, '}}')""",
    "signup": _ENTRY + """, '"type":"message","message":{"role":"user","content":"hi', n, '"}}')""",
}
_PI_SQL = f"""{_E.replace("WITH ", "")}, up AS (SELECT *, line - 1 AS t, CASE WHEN line = 1 THEN NULL WHEN n % 10 = 0 AND line > 2 THEN line - 3 ELSE line - 2 END AS parent FROM e),
    walk AS (SELECT s, max(t) AS t FROM up GROUP BY s UNION ALL SELECT w.s, p.parent FROM walk w JOIN up p ON p.s = w.s AND p.t = w.t WHERE p.parent IS NOT NULL),
    path AS (SELECT up.* FROM up JOIN walk USING (s, t)),
    placed AS (SELECT *, last_value(CASE kind WHEN 'view' THEN 'p' || (n % 3) WHEN 'purchase' THEN 'q' || (n % 2) END IGNORE NULLS) OVER (PARTITION BY s ORDER BY t) AS model, CASE WHEN kind <> 'purchase' THEN row_number() OVER (PARTITION BY s, kind <> 'purchase' ORDER BY t) - 1 END AS turn_index FROM path),
    held AS (SELECT *, coalesce(CASE WHEN kind = 'view' THEN turn_index END, min(CASE WHEN kind = 'view' THEN turn_index END) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS goes_to FROM placed)"""


def _pi(spark, d):
    lines = _lines(spark, d, _PI, 2)
    heads = lines.select("session_key").distinct().select("session_key", F.lit(1).cast("long").alias("line"), F.lit('{"type":"session","version":3,"id":"x","timestamp":"2026-01-01T00:00:00Z","cwd":"/w"}').alias("raw"))
    return pi.parse_lines(lines.unionByName(heads), _refs(lines, "pi"))


@_query(f"""WITH RECURSIVE {_PI_SQL} SELECT s AS session_key, turn_index, CASE WHEN kind = 'view' THEN 'assistant' ELSE 'user' END AS role, coalesce(model, '') AS model, CASE WHEN kind = 'view' THEN n ELSE 0 END AS input_uncached, CASE WHEN kind = 'view' THEN 6 ELSE 0 END AS cache_write_5m,
    CASE WHEN kind = 'view' THEN 4 ELSE 0 END AS cache_write_1h, CASE WHEN kind = 'view' THEN n + 11 ELSE 0 END AS context_total, CASE WHEN kind = 'view' THEN 0.5::DOUBLE END AS logged_cost FROM placed WHERE turn_index IS NOT NULL""")  # fmt: skip
def w9_pi_turns(spark, d):
    return _pi(spark, d).turns.select("session_key", "turn_index", "role", "model", "input_uncached", "cache_write_5m", "cache_write_1h", "context_total", "logged_cost")


@_query(f"""WITH RECURSIVE {_PI_SQL} SELECT s AS session_key, goes_to AS turn_index, CASE kind WHEN 'view' THEN 'assistantText' WHEN 'signup' THEN 'userText' ELSE 'toolResults' END AS category, CASE WHEN kind = 'error' THEN length('co' || n) WHEN kind = 'signup' THEN length('hi' || n) ELSE length('a' || n) END AS char_count,
    CASE WHEN kind IN ('click', 'error') THEN 'bash' END AS tool_name FROM held WHERE goes_to IS NOT NULL AND kind <> 'purchase' AND NOT (kind = 'error' AND n % 2 = 0)
    UNION ALL SELECT s, goes_to, 'toolCallArgs', 2, 'bash' FROM held WHERE kind = 'view'""")  # fmt: skip
def p27_pi_spans(spark, d):
    return _pi(spark, d).spans.select("session_key", "turn_index", "category", "char_count", "tool_name")


@_query(f"""WITH RECURSIVE {_PI_SQL} SELECT DISTINCT s AS session_key, 'pi-off-path-branches' AS code FROM up WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.s = up.s AND w.t = up.t)
    UNION ALL SELECT DISTINCT s, 'pi-trailing-content-unattached' FROM held WHERE goes_to IS NULL AND kind <> 'purchase' AND NOT (kind = 'error' AND n % 2 = 0)""")  # fmt: skip
def wn_pi_warnings(spark, d):
    return _pi(spark, d).warnings.select("session_key", "code")
