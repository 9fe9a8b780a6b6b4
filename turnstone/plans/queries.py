"""One query an operator over the mapped tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import attribution as at
from turnstone.operators import compaction, compare, composition, dashboard, dedup, diff, matching, pricing
from turnstone.plans import mapping as m

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ELIGIBLE = "role = 'assistant' AND coalesce(message_id, '') <> '' AND coalesce(request_id, '') <> ''"
_DEDUP = f"""
frag AS (
    SELECT session_key, message_id, request_id, min(turn_index) AS first_index, count(*) AS fragments,
           count(DISTINCT (input_uncached, cache_read, cache_write_5m, cache_write_1h, output)) AS kinds
    FROM raw_turns WHERE {_ELIGIBLE} GROUP BY ALL),
source AS (
    SELECT t.session_key, t.message_id, t.request_id, f.first_index, f.fragments, t.turn_index AS source_index,
           row_number() OVER (PARTITION BY t.session_key, t.message_id, t.request_id ORDER BY CASE WHEN f.kinds = 1 THEN 0 ELSE -(t.context_total + t.output) END, t.turn_index) AS rn
    FROM raw_turns t JOIN frag f USING (session_key, message_id, request_id) WHERE {_ELIGIBLE}),
merged AS (
    SELECT s.session_key, s.message_id, s.request_id, s.first_index, s.fragments, h.role, h.model, h.cache_miss_type, h.cache_missed_tokens,
           u.input_uncached, u.cache_read, u.cache_write_5m, u.cache_write_1h, u.output, u.context_total, u.is_sidechain, u.logged_cost
    FROM source s JOIN raw_turns u ON u.session_key = s.session_key AND u.turn_index = s.source_index
    JOIN raw_turns h ON h.session_key = s.session_key AND h.turn_index = s.first_index WHERE rn = 1),
replays AS (
    SELECT *, min(first_index) OVER (PARTITION BY session_key, message_id) AS anchor,
           row_number() OVER (PARTITION BY session_key, message_id ORDER BY is_sidechain, context_total + output DESC, first_index) = 1 AS winner FROM merged),
kept AS (
    SELECT session_key, anchor, role, model, message_id, request_id, is_sidechain, input_uncached, cache_read, cache_write_5m, cache_write_1h, output, context_total, logged_cost, cache_miss_type, cache_missed_tokens FROM replays WHERE winner
    UNION ALL BY NAME
    SELECT session_key, turn_index AS anchor, role, model, message_id, request_id, is_sidechain, input_uncached, cache_read, cache_write_5m, cache_write_1h, output, context_total, logged_cost, cache_miss_type, cache_missed_tokens FROM raw_turns WHERE NOT ({_ELIGIBLE})),
deduped AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY anchor) - 1 AS turn_index FROM kept)"""


def _priced(source: str) -> str:
    """CTE `priced` over a relation of turns, written as plain SQL joins."""
    over = "(p.threshold IS NOT NULL AND context_total > p.threshold)"
    bare, own = (f"regexp_replace({x}, '^[a-z0-9_.]+/', '', 'i')" for x in ("model", "d.model"))
    fam = f"CASE WHEN {own} ILIKE 'claude%' THEN 'm' WHEN regexp_matches({own}, '^(gpt|o|codex)', 'i') THEN 'w' ELSE 'n' END"
    base = {"input_uncached": "p.input", "cache_read": "coalesce(p.cache_read, 0)", "cache_write_5m": "coalesce(p.cc_5m, p.input * 1.25)", "cache_write_1h": "coalesce(p.cc_1h, p.input * 2.0)", "output": "p.output"}
    tier = {"input_uncached": "p.t_input", "cache_read": "p.t_cache_read", "cache_write_5m": "p.t_cc_5m", "cache_write_1h": "p.t_cc_1h", "output": "p.t_output"}
    names = {"input_uncached": "cost_input", "cache_read": "cost_cache_read", "cache_write_5m": "cost_cache_write_5m", "cache_write_1h": "cost_cache_write_1h", "output": "cost_output"}
    parts, before = [], "0"
    for c in names:
        t, col = f"coalesce({tier[c]}, {base[c]})", f"d.{c}"
        below = f"greatest(0, least({col}, p.threshold - ({before})))"
        marginal = f"{col} * {t}" if c == "output" else f"{below} * {base[c]} + ({col} - {below}) * {t}"
        parts.append(f"CASE WHEN d.logged_cost IS NOT NULL OR p.input IS NULL THEN 0.0 WHEN {over} AND {fam} = 'w' THEN {col} * {t} WHEN {over} AND {fam} = 'm' THEN {marginal} ELSE {col} * {base[c]} END AS {names[c]}")
        before += f" + d.{c}"
    cut = r"regexp_replace({}, '-(\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})$', '')"
    return f"""
keys AS (SELECT model, unnest([model, {bare}, {cut.format("model")}, {cut.format(bare)}]) AS model_key, unnest([0, 1, 2, 3]) AS rank FROM (SELECT DISTINCT model FROM {source})),
best AS (SELECT k.model, q.*, row_number() OVER (PARTITION BY k.model ORDER BY q.tier, k.rank) AS rn FROM keys k JOIN prices q USING (model_key)),
parts AS (SELECT d.*, p.input IS NOT NULL AS found, {", ".join(parts)} FROM {source} d LEFT JOIN best p ON d.model = p.model AND p.rn = 1),
priced AS (SELECT *, coalesce(logged_cost, cost_input + cost_output + cost_cache_read + cost_cache_write_5m + cost_cache_write_1h) AS cost, logged_cost IS NOT NULL OR found AS priced FROM parts)"""


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in at.TOKENS) + ", round(sum(cost), 6) AS cost, bool_and(priced) AS priced"


def _deduped(spark, d):
    return dedup.dedup_turns(m.turns(spark, d))


def _priced_turns(spark, d):
    return pricing.price_turns(_deduped(spark, d), m.prices(spark, d), models=m.models(spark, d))


_PRICED = f"WITH {m.TURNS}, {_DEDUP}, {m.PRICES}, {_priced('deduped')}"


@_query(f"WITH {m.TURNS} SELECT session_key, count(*) AS turns, count(*) FILTER ({_ELIGIBLE}) AS eligible FROM raw_turns GROUP BY session_key")
def d1_eligible(spark: SparkSession, d: str) -> DataFrame:
    return m.turns(spark, d).groupBy("session_key").agg(F.count(F.lit(1)).alias("turns"), F.count_if(dedup.eligible()).alias("eligible"))


@_query(f"WITH {m.TURNS}, {_DEDUP} SELECT session_key, message_id, request_id, first_index, fragments, model, input_uncached, cache_read, output, context_total, is_sidechain FROM merged")
def d2_merge_fragments(spark, d):
    raw = m.turns(spark, d)
    out = dedup.merge_fragments(raw.filter(dedup.eligible()))
    return out.select("session_key", "message_id", "request_id", "first_index", "fragments", "model", "input_uncached", "cache_read", "output", "context_total", "is_sidechain")


@_query(f"WITH {m.TURNS}, {_DEDUP} SELECT session_key, message_id, request_id, anchor, winner FROM replays")
def d3_pick_replay(spark, d):
    return dedup.pick_replay(dedup.merge_fragments(m.turns(spark, d).filter(dedup.eligible()))).select("session_key", "message_id", "request_id", "anchor", "winner")


@_query(f"WITH {m.TURNS}, {_DEDUP} SELECT session_key, turn_index, anchor, role, model, message_id, input_uncached, cache_read, cache_write_5m, cache_write_1h, output, context_total FROM deduped")
def d4_dedup_turns(spark, d):
    return _deduped(spark, d).select("session_key", "turn_index", "anchor", "role", "model", "message_id", "input_uncached", "cache_read", "cache_write_5m", "cache_write_1h", "output", "context_total")


_MAP = f"""
slots AS (SELECT r.session_key, r.turn_index AS old_index, CASE WHEN {_ELIGIBLE} THEN q.anchor ELSE r.turn_index END AS slot, CASE WHEN {_ELIGIBLE} THEN q.winner ELSE TRUE END AS survives
    FROM raw_turns r LEFT JOIN (SELECT session_key, message_id, request_id, anchor, winner FROM replays) q USING (session_key, message_id, request_id)),
map_ AS (SELECT session_key, old_index, dense_rank() OVER (PARTITION BY session_key ORDER BY slot) - 1 AS new_index, survives FROM slots)"""


@_query(f"WITH {m.TURNS}, {_DEDUP}, {_MAP} SELECT * FROM map_")
def d4_index_map(spark, d):
    return dedup.index_map(m.turns(spark, d))


@_query(f"""WITH {m.TURNS}, {_DEDUP}, {_MAP},
    marks AS (SELECT session_key, turn_index AS was, turn_index FROM raw_turns WHERE cache_miss_type IS NOT NULL UNION ALL SELECT session_key, max(turn_index) + 1, max(turn_index) + 1 FROM raw_turns GROUP BY 1),
    ends AS (SELECT session_key, max(new_index) + 1 AS e FROM map_ GROUP BY 1)
    SELECT k.session_key, k.was, coalesce(p.new_index, e.e) AS turn_index FROM marks k LEFT JOIN map_ p ON k.session_key = p.session_key AND k.turn_index = p.old_index JOIN ends e ON e.session_key = k.session_key""")
def d5_remap_events(spark, d):
    raw = m.turns(spark, d)
    inner = raw.filter("cache_miss_type is not null").select("session_key", F.col("turn_index").alias("was"), "turn_index")
    ends = raw.groupBy("session_key").agg((F.max("turn_index") + 1).alias("turn_index")).select("session_key", F.col("turn_index").alias("was"), "turn_index")
    return dedup.remap_events(inner.unionByName(ends), dedup.index_map(raw))


_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY family_id, message_id ORDER BY member_ordinal, turn_index) AS rn FROM family_turns WHERE {_ELIGIBLE} UNION ALL SELECT *, 1 FROM family_turns WHERE NOT ({_ELIGIBLE}))"


@_query(f"""WITH {m.FAMILY}, {_RANKED} SELECT family_id, session_key, turn_index, rn > 1 AS is_replay, CASE WHEN rn > 1 THEN 0 ELSE context_total END AS context_total, CASE WHEN rn > 1 THEN 0 ELSE output END AS output FROM ranked""")
def d6_zero_family_replays(spark, d):
    return dedup.zero_family_replays(m.family_turns(spark, d)).select("family_id", "session_key", "turn_index", "is_replay", "context_total", "output")


@_query(f"WITH {m.FAMILY}, {_RANKED} SELECT family_id, model, count(*) AS turns, sum(context_total)::BIGINT AS context_total FROM ranked WHERE rn = 1 GROUP BY ALL")
def d7_drop_family_replays(spark, d):
    return dedup.drop_family_replays(m.family_turns(spark, d)).groupBy("family_id", "model").agg(F.count(F.lit(1)).alias("turns"), F.sum("context_total").alias("context_total"))


@_query(f"{_PRICED} SELECT session_key, turn_index, model, " + ", ".join(f"round({c}, 13) AS {c}" for c in (*pricing.PARTS, "cost")) + ", priced FROM priced")
def c1_price_turns(spark, d):
    return _rounded(_priced_turns(spark, d).select("session_key", "turn_index", "model", *pricing.PARTS, "cost", "priced"), 13)


@_query(f"""{_PRICED} SELECT mode, model, round(sum(CASE mode WHEN 'display' THEN coalesce(logged_cost, 0) WHEN 'auto' THEN cost END), 6) AS cost, count(*) FILTER (CASE mode WHEN 'display' THEN logged_cost IS NOT NULL ELSE priced END) AS priced_turns
    FROM priced, (VALUES ('display'), ('auto')) v(mode) GROUP BY ALL""")
def c7_modes(spark, d):
    # both modes of a turn side by side: the turns are computed once
    matched = pricing.match_prices(_deduped(spark, d), m.prices(spark, d), m.models(spark, d)).withColumn("rates", F.col("price"))
    shown = pricing.cost_columns(matched, "display").withColumnsRenamed({"cost": "display_cost", "priced": "display_priced", "rates": "price"})
    sums = lambda mode, cost, priced: F.struct(F.round(F.sum(cost), 6).alias("cost"), F.count_if(F.col(priced)).alias("priced_turns"), F.lit(mode).alias("mode"))
    both = pricing.cost_columns(shown, "auto").groupBy("model").agg(sums("display", "display_cost", "display_priced").alias("a"), sums("auto", "cost", "priced").alias("b"))
    return both.select("model", F.inline(F.array("a", "b")))


@_query(f"""WITH {m.TURNS}, {m.PRICES}, {_priced("raw_turns")} SELECT DISTINCT model, found, CASE WHEN found THEN (SELECT b.model_key FROM best b WHERE b.model = p.model AND b.rn = 1) END AS model_key FROM (SELECT DISTINCT model, found FROM parts) p""")
def j10_match_prices(spark, d):
    models = m.turns(spark, d).select("model").distinct()
    prices = m.prices(spark, d)
    tried = models.select("model", F.posexplode(pricing.candidates(F.col("model"))).alias("rank", "model_key")).join(prices, "model_key")
    key = tried.groupBy("model").agg(F.min_by("model_key", F.struct("tier", "rank")).alias("model_key"))
    found = pricing.match_prices(models, prices).select("model", F.col("price").isNotNull().alias("found"))
    return found.join(key, "model", "left")


@_query(f"{_PRICED} SELECT session_key, {_SUMS} FROM priced GROUP BY session_key")
def a1_session_totals(spark, d):
    return _rounded(at.session_totals(_priced_turns(spark, d)))


@_query(f"{_PRICED} SELECT model, count(*) AS turns, {_SUMS} FROM priced GROUP BY model")
def a2_cost_by_model(spark, d):
    return _rounded(at.by_model(_priced_turns(spark, d)))


_TOOL_SUMS = """sum(CASE WHEN category = 'toolCallArgs' THEN char_count ELSE 0 END)::BIGINT AS call_chars, count(*) FILTER (category = 'toolCallArgs') AS call_spans,
    sum(CASE WHEN category = 'toolResults' THEN char_count ELSE 0 END)::BIGINT AS result_chars, count(*) FILTER (category = 'toolResults') AS result_spans, sum(char_count)::BIGINT AS total_chars, count(*) AS total_spans, ceil(sum(char_count) / 4.0)::BIGINT AS tokens_est"""
_TOOL = f"WITH {m.TIMELINE}, {m.TOOLS}, held AS (SELECT * REPLACE (coalesce(tool_name, '(unattributed)') AS tool_name) FROM tool_spans WHERE category IN ('toolCallArgs', 'toolResults'))"


@_query(f"{_TOOL} SELECT tool_name, arg_min(mcp_server, (session_key, turn_index, ord)) FILTER (mcp_server IS NOT NULL) AS mcp_server, {_TOOL_SUMS} FROM held GROUP BY tool_name")
def a3_by_tool(spark, d):
    return at.by_tool(m.tool_spans(spark, d))


@_query(f"{_TOOL} SELECT mcp_server, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools, {_TOOL_SUMS} FROM held WHERE mcp_server IS NOT NULL GROUP BY mcp_server")
def a4_by_server(spark, d):
    return at.by_server(m.tool_spans(spark, d)).withColumn("tools", F.array_join("tools", ","))


_FAMILY_PRICED = f"WITH {m.FAMILY}, {m.PRICES}, {_priced('family_turns')}, r AS (SELECT *, {_ELIGIBLE} AND row_number() OVER (PARTITION BY family_id, message_id, {_ELIGIBLE} ORDER BY member_ordinal, turn_index) > 1 AS again FROM priced)"


def _family_priced(spark, d, turns=None):
    return pricing.price_turns(m.family_turns(spark, d) if turns is None else turns, m.prices(spark, d), models=m.models(spark, d))


@_query(f"{_FAMILY_PRICED} SELECT model, count(*) AS turns, {_SUMS} FROM r WHERE NOT again GROUP BY model")
def a5_merged_by_model(spark, d):
    return _rounded(at.by_model(_family_priced(spark, d, dedup.drop_family_replays(m.family_turns(spark, d)))))


@_query(f"""{_FAMILY_PRICED}, z AS (SELECT family_id, member_ordinal, CASE WHEN again THEN 0 ELSE context_total + output END AS t, CASE WHEN again THEN 0 ELSE cost END AS cost, priced OR again AS priced FROM r)
    SELECT family_id, count(DISTINCT member_ordinal) FILTER (member_ordinal > 0) AS children, coalesce(sum(t) FILTER (member_ordinal = 0), 0)::BIGINT AS parent_tokens, coalesce(sum(t) FILTER (member_ordinal > 0), 0)::BIGINT AS child_tokens, sum(t)::BIGINT AS combined_tokens,
           round(coalesce(sum(cost) FILTER (member_ordinal = 0), 0), 6) AS parent_cost, round(coalesce(sum(cost) FILTER (member_ordinal > 0), 0), 6) AS child_cost, round(sum(cost), 6) AS combined_cost, bool_and(priced) AS priced,
           round(CASE WHEN sum(cost) > 0 THEN coalesce(sum(cost) FILTER (member_ordinal > 0), 0) / sum(cost) ELSE 0 END, 6) AS child_cost_share FROM z GROUP BY family_id""")
def a6_subagent_rollup(spark, d):
    return _rounded(at.subagent_rollup(dedup.zero_family_replays(_family_priced(spark, d))))


@_query(f"""WITH {m.TURNS} SELECT session_key, {", ".join(f"sum({c})::BIGINT AS {c}" for c in at.TOKENS[:4])}, round(CASE WHEN sum(context_total) > 0 THEN sum(cache_read) / sum(context_total) ELSE 0 END, 6) AS hit_rate,
    count(cache_miss_type) AS misses, coalesce(sum(cache_missed_tokens), 0)::BIGINT AS wasted_tokens FROM raw_turns GROUP BY session_key""")
def a7_cache_use(spark, d):
    return _rounded(at.cache_use(m.turns(spark, d), ("session_key",)))


@_query(f"""WITH {m.SESSIONS} SELECT harness, count(*) AS sessions, sum(context_total)::BIGINT AS context_total, sum(output)::BIGINT AS output, round(sum(cost), 6) AS cost, bool_and(priced) AS priced FROM session_rows GROUP BY ROLLUP (harness)""")
def a9_by_harness(spark, d):
    return _rounded(at.by_harness(m.session_rows(spark, d)))


@_query(f"""WITH {m.TIMELINE}, {m.COMPACTIONS},
    e AS (SELECT session_key, CASE WHEN tokens_before IS NULL THEN NULL ELSE tokens_before - 1000 END AS shrink FROM compaction_events)
    SELECT u.session_key, count(e.session_key) AS compactions, CASE WHEN count(e.session_key) = 0 THEN 0 WHEN count(e.shrink) < count(e.session_key) THEN NULL ELSE sum(e.shrink) END::BIGINT AS shrink_total
    FROM (SELECT DISTINCT session_key FROM timeline) u LEFT JOIN e ON e.session_key = u.session_key GROUP BY u.session_key""")
def a11_compaction_totals(spark, d):
    line = m.timeline(spark, d)
    events = m.compaction_events(line).withColumn("shrink", F.col("tokens_before") - 1000)
    return diff.compaction_totals(events, line.select("session_key").distinct()).select("session_key", "compactions", "shrink_total")


@_query(f"WITH {m.TIMELINE}, f AS (SELECT session_key, event_type, min(turn_index) AS i FROM timeline GROUP BY ALL) SELECT session_key, string_agg(event_type, ',' ORDER BY i, event_type) AS models FROM f GROUP BY session_key")
def a12_models_in_order(spark, d):
    return diff.models_in_order(m.timeline(spark, d).withColumn("model", F.col("event_type"))).withColumn("models", F.array_join("models", ","))


@_query(f"""WITH {m.SESSIONS} SELECT round(sum(cost), 6) AS cost, count(*) FILTER (NOT priced) AS unpriced_sessions, {", ".join(f"sum({c})::BIGINT AS {c}" for c in dashboard.CLASSES)}, count(DISTINCT started_at::DATE) AS active_days FROM session_rows""")
def a13_headline(spark, d):
    return _rounded(dashboard.headline(m.session_rows(spark, d)))


_WINDOW = f"WITH {m.SESSIONS}, days AS (SELECT DISTINCT started_at::DATE AS day FROM session_rows ORDER BY 1 DESC LIMIT 30), w AS (SELECT *, started_at::DATE AS day FROM session_rows WHERE started_at::DATE IN (SELECT day FROM days))"


@_query(f"""{_WINDOW}, top AS (SELECT model FROM w GROUP BY model ORDER BY sum(cost) DESC, model LIMIT 5), n AS (SELECT day, cost, CASE WHEN model IN (SELECT model FROM top) THEN model ELSE 'other' END AS series FROM w)
    SELECT days.day, s.series, round(coalesce(sum(n.cost), 0), 6) AS cost FROM days CROSS JOIN (SELECT DISTINCT series FROM n) s LEFT JOIN n ON n.day = days.day AND n.series = s.series GROUP BY ALL""")
def a14_daily_cost(spark, d):
    return _rounded(dashboard.daily_cost(dashboard.window(m.session_rows(spark, d))))


@_query(f"{_WINDOW} SELECT day, class, tokens::BIGINT AS tokens FROM (SELECT day, sum(input_uncached) AS input_uncached, sum(cache_read) AS cache_read, sum(cache_write) AS cache_write, sum(output) AS output FROM w GROUP BY day) UNPIVOT (tokens FOR class IN (input_uncached, cache_read, cache_write, output))")
def a15_daily_tokens(spark, d):
    return dashboard.daily_tokens(dashboard.window(m.session_rows(spark, d)))


@_query(f"{_WINDOW} SELECT day, round(sum(cache_read) / nullif(sum(cache_read + input_uncached + cache_write), 0), 6) AS hit_rate FROM w GROUP BY day")
def a16_daily_hit_rate(spark, d):
    return _rounded(dashboard.daily_hit_rate(dashboard.window(m.session_rows(spark, d))))


@_query(f"{_WINDOW} SELECT day, sum(compactions)::BIGINT AS compactions FROM w GROUP BY day")
def a17_daily_compactions(spark, d):
    return dashboard.daily_compactions(dashboard.window(m.session_rows(spark, d)))


@_query(f"WITH {m.SESSIONS} SELECT cwd, count(*) AS sessions, sum(context_total)::BIGINT AS tokens, round(sum(cost), 6) AS cost, max(started_at)::DATE AS last_day FROM session_rows GROUP BY cwd ORDER BY sum(cost) DESC, cwd LIMIT 15")
def a18_per_project(spark, d):
    return _rounded(dashboard.per_project(m.session_rows(spark, d)).select("cwd", "sessions", "tokens", "cost", F.to_date("last_activity").alias("last_day")))


@_query(f"WITH {m.SESSIONS} SELECT harness, count(*) AS sessions, sum(context_total)::BIGINT AS tokens, round(sum(cost), 6) AS cost, count(*) FILTER (NOT priced) AS unpriced_sessions FROM session_rows GROUP BY harness")
def a19_per_harness(spark, d):
    return _rounded(dashboard.per_harness(m.session_rows(spark, d)))


_STATS = """count(*) AS trials, count(*) FILTER (passed) AS successes, round(count(*) FILTER (passed) / count(*), 6) AS success_rate, median(wall_ms)::DOUBLE AS median_wall_ms, count(*) FILTER (has_totals) AS with_totals,
    (median(context_total) FILTER (has_totals))::DOUBLE AS median_tokens, count(*) FILTER (has_totals AND priced) AS priced_trials, round(median(cost) FILTER (has_totals AND priced), 6) AS median_cost, (sum(compactions) FILTER (has_totals))::BIGINT AS compactions, min(row_no) AS first_row"""


@_query(f"WITH {m.TRIALS} SELECT task_name, config_name, {_STATS} FROM trials GROUP BY task_name, config_name")
def a20_trial_cells(spark, d):
    return _rounded(compare.cells(m.trials(spark, d)))


@_query(f"WITH {m.TRIALS} SELECT task_name, config_name, {_STATS} FROM trials GROUP BY GROUPING SETS ((task_name, config_name), (config_name))")
def a23_trial_overall(spark, d):
    return _rounded(compare.cells_and_overall(m.trials(spark, d)))


@_query(f"""WITH {m.TRIALS}, c AS (SELECT task_name, config_name, {_STATS} FROM trials WHERE NOT (task_name = 'P' AND config_name = '2-HIGH') GROUP BY ALL), a AS (SELECT * FROM c WHERE config_name = '1-URGENT'), b AS (SELECT * FROM c WHERE config_name = '2-HIGH')
    SELECT t.task_name, CASE WHEN a.trials IS NULL THEN 'a' WHEN b.trials IS NULL THEN 'b' END AS missing, a.trials AS a_trials, b.trials AS b_trials FROM (SELECT DISTINCT task_name FROM c) t LEFT JOIN a ON a.task_name = t.task_name LEFT JOIN b ON b.task_name = t.task_name""")
def j18_pair_configs(spark, d):
    held = m.trials(spark, d).filter("not (task_name = 'P' and config_name = '2-HIGH')")
    return compare.paired(compare.cells(held), "1-URGENT", "2-HIGH").select("task_name", "missing", F.col("a.trials").alias("a_trials"), F.col("b.trials").alias("b_trials"))


@_query(f"""WITH {m.TRIALS}, c AS (SELECT task_name, config_name, {_STATS} FROM trials GROUP BY ALL)
    SELECT a.task_name, round((b.successes / b.trials - a.successes / a.trials) * 100, 3) AS success_pp, b.median_wall_ms - a.median_wall_ms AS median_wall_ms_delta, round((b.median_wall_ms - a.median_wall_ms) / a.median_wall_ms * 100, 3) AS median_wall_ms_pct, b.compactions - a.compactions AS compactions_delta
    FROM c a JOIN c b ON a.task_name = b.task_name AND a.config_name = '1-URGENT' AND b.config_name = '2-HIGH'""")
def c19_trial_deltas(spark, d):
    out = compare.deltas(compare.paired(compare.cells(m.trials(spark, d)), "1-URGENT", "2-HIGH"))
    return _rounded(out.select("task_name", "success_pp", "median_wall_ms_delta", "median_wall_ms_pct", "compactions_delta"), 3)


@_query(f"WITH {m.TRIALS} SELECT config_name AS run, row_no, round(sum(CASE WHEN priced THEN cost ELSE 0 END) OVER (PARTITION BY config_name ORDER BY row_no), 8) AS spent FROM trials")
def a26_running_spend(spark, d):
    return dashboard.running_spend(m.trials(spark, d).withColumn("run", F.col("config_name")), ("row_no",)).select("run", "row_no", F.round("spent", 8).alias("spent"))


_CUM = ", ".join(f"coalesce(sum(char_count) FILTER (category = '{c}'), 0)" + " AS {0}".format(f'"{c}"') for c in composition.CATEGORIES)
_COMPOSED = f"""WITH {m.TALK}, own AS (SELECT s.session_key, s.turn_index, {_CUM}, coalesce(bool_or(truncated), FALSE) AS cut FROM talk_spans s JOIN talk_sessions USING (session_key) WHERE category <> 'thinking' OR harness = 'codex' GROUP BY s.session_key, s.turn_index),
    ph AS (SELECT t.session_key, t.turn_index, t.context_total, sum(CASE WHEN turn_index = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY turn_index)::BIGINT AS phase FROM talk t),
    runs AS (SELECT p.*, {", ".join(f'''coalesce(sum(o."{c}") OVER w, 0) + {"coalesce(length(system_prompt), 0)" if c == "systemPrompt" else "0"} AS "{c}_"''' for c in composition.CATEGORIES)}, coalesce(bool_or(o.cut) OVER w, FALSE) AS cut
        FROM ph p JOIN talk_sessions USING (session_key) LEFT JOIN own o ON o.session_key = p.session_key AND o.turn_index = p.turn_index WINDOW w AS (PARTITION BY p.session_key, p.phase ORDER BY p.turn_index)),
    est AS (SELECT session_key, turn_index, context_total, phase, {", ".join(f'CASE WHEN context_total = 0 THEN 0 ELSE ceil("{c}_" / 4.0)::BIGINT END AS "{c}"' for c in composition.CATEGORIES)}, context_total <> 0 AND cut AS truncated FROM runs),
    composed AS (SELECT *, CASE WHEN context_total = 0 THEN 0 ELSE context_total - ({" + ".join(f'"{c}"' for c in composition.CATEGORIES)}) END AS residual FROM est)"""


def _composed(spark, d):
    return composition.compose(*m.talk(spark, d))


@_query(f"""{_COMPOSED} SELECT session_key, turn_index, phase, {", ".join(f'"{c}"' for c in composition.CATEGORIES)}, residual::BIGINT AS residual, round(CASE WHEN context_total = 0 THEN 0 ELSE residual / context_total END, 6) AS residual_share, truncated FROM composed""")
def w1_composition(spark, d):
    return _rounded(_composed(spark, d).drop("role", "context_total"))


@_query(f"{_COMPOSED} SELECT session_key, turn_index, category, tokens, round(tokens / context_total, 6) AS share FROM composed UNPIVOT (tokens FOR category IN ({', '.join(chr(34) + c + chr(34) for c in composition.CATEGORIES)})) WHERE tokens <> 0")
def p36_category_rows(spark, d):
    return _rounded(composition.category_rows(_composed(spark, d)).select("session_key", "turn_index", "category", "tokens", "share"))


@_query(f"{_COMPOSED} SELECT session_key, max(turn_index) AS turn_index, arg_max(residual, turn_index)::BIGINT AS residual FROM composed WHERE context_total <> 0 GROUP BY session_key")
def w7_last_usage_turn(spark, d):
    return composition.last_usage_turn(_composed(spark, d)).select("session_key", "turn_index", "residual")


_ANCHORED = f"""WITH {m.TIMELINE}, {m.COMPACTIONS}, a AS (SELECT e.*,
    coalesce(e.tokens_before, (SELECT arg_max(t.context_total, t.turn_index) FROM timeline t WHERE t.session_key = e.session_key AND t.turn_index < e.turn_index AND t.context_total <> 0)) AS b,
    (SELECT arg_min(t.context_total, t.turn_index) FROM timeline t WHERE t.session_key = e.session_key AND t.turn_index >= e.turn_index AND t.context_total <> 0) AS f FROM compaction_events e)"""


@_query(f"{_ANCHORED} SELECT session_key, ord, turn_index, b::BIGINT AS tokens_before, f::BIGINT AS tokens_after, (b - f)::BIGINT AS shrink, (b - f + summary_tokens_est)::BIGINT AS discarded_est, summary_tokens_est FROM a")
def c11_finalize_compactions(spark, d):
    line = m.timeline(spark, d)
    return compaction.finalize(m.compaction_events(line), line)


@_query(f"WITH {m.TIMELINE} SELECT session_key, turn_index, last_value(CASE WHEN k % 4 <> 0 THEN k END IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY turn_index) AS model FROM timeline")
def j6_last_known(spark, d):
    line = m.timeline(spark, d)
    return line.select("session_key", "turn_index", matching.last_known(F.when(F.col("k") % 4 != 0, F.col("k")), order="turn_index").alias("model"))


@_query(f"WITH {m.TIMELINE}, k AS (SELECT session_key, turn_index, k % 3 AS v FROM timeline WHERE k IS NOT NULL), l AS (SELECT *, lag(v) OVER (PARTITION BY session_key ORDER BY turn_index) AS was FROM k) SELECT session_key, turn_index, v, was FROM l WHERE was IS NOT NULL AND was <> v")
def w8_changes(spark, d):
    line = m.timeline(spark, d).withColumn("v", F.col("k") % 3)
    return matching.changes(line, "v", order="turn_index").select("session_key", "turn_index", "v", "was")


@_query(f"""WITH {m.TIMELINE} SELECT r.session_key, r.turn_index, (SELECT arg_max(c.event_id, c.turn_index) FROM timeline c WHERE c.session_key = r.session_key AND c.k = r.k AND c.event_type = 'view' AND c.turn_index < r.turn_index) AS call_id FROM timeline r WHERE r.event_type = 'click'""")
def j2_latest_call(spark, d):
    line = m.timeline(spark, d)
    call = F.when(F.col("event_type") == "view", F.col("event_id"))
    return line.withColumn("call_id", matching.latest_call(line, call, ("session_key", "k"), ("turn_index",))).filter("event_type = 'click'").select("session_key", "turn_index", "call_id")


@_query("""SELECT c.conv_id AS session_key, c.turn AS line, (SELECT min(n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND n.role = 'assistant') AS holder FROM conversations c WHERE c.role <> 'assistant'""")
def j3_pending_spans(spark, d):
    rows = m.read(spark, d, "conversations").select(F.col("conv_id").alias("session_key"), F.col("turn").alias("line"), "role")
    return rows.withColumn("holder", matching.next_holder(rows, F.col("role") == "assistant", F.col("line"))).filter("role <> 'assistant'").select("session_key", "line", "holder")


@_query(f"""WITH {m.TIMELINE}, s AS (SELECT *, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY turn_index) AS depth FROM timeline),
    p AS (SELECT c.session_key, c.turn_index, (SELECT max(q.turn_index) FROM s q WHERE q.session_key = c.session_key AND q.event_type = 'view' AND q.turn_index < c.turn_index AND q.depth = c.depth + 1) AS partner FROM s c WHERE c.event_type = 'click')
    SELECT session_key, turn_index, partner IS NULL AS orphan, partner FROM p""")
def j5_match_stack(spark, d):
    line = m.timeline(spark, d)
    return matching.match_stack(line, F.col("event_type") == "view", F.col("event_type") == "click", order="turn_index").filter("event_type = 'click'").select("session_key", "turn_index", "orphan", "partner")


@_query(f"""WITH {m.TIMELINE}, two AS (SELECT *, lag(event_type) OVER (PARTITION BY session_key ORDER BY turn_index) AS was FROM timeline WHERE event_type IN ('purchase', 'error')) SELECT session_key, turn_index, event_type FROM two WHERE NOT (event_type = 'error' AND was IS NOT DISTINCT FROM 'purchase')""")
def j16_consumed_markers(spark, d):
    return matching.drop_consumed_markers(m.timeline(spark, d), "error", "purchase", order="turn_index", kind="event_type").select("session_key", "turn_index", "event_type")


@_query(f"""WITH {m.TIMELINE}, c AS (SELECT session_key, arg_max(event_id * 3, turn_index) AS counted FROM timeline GROUP BY 1), s AS (SELECT session_key, sum(context_total + 5) AS summed FROM timeline WHERE context_total <> 0 GROUP BY 1)
    SELECT session_key, counted, coalesce(summed, 0)::BIGINT AS summed, round(abs(coalesce(summed, 0) - counted) / counted, 6) AS gap FROM c LEFT JOIN s USING (session_key) WHERE counted > 0 AND abs(coalesce(summed, 0) - counted) / counted > 0.01""")
def a24_counter_gap(spark, d):
    line = m.timeline(spark, d)
    return _rounded(matching.counter_gap(line.withColumn("output", F.lit(5)), line.select("session_key", F.col("turn_index").alias("line"), (F.col("event_id") * 3).alias("total_tokens"))))


@_query(f"""WITH {m.TURNS}, t AS (SELECT session_key, {", ".join(f"sum({c})::BIGINT AS {c}" for c in at.TOKENS)} FROM raw_turns GROUP BY 1), u AS (SELECT * FROM t UNPIVOT (value FOR class IN ({", ".join(at.TOKENS)})))
    SELECT x.session_key AS a, y.session_key AS b, x.class, x.value AS a_value, y.value AS b_value, y.value - x.value AS delta, round((y.value - x.value) / nullif(x.value, 0), 6) AS pct FROM u x JOIN u y ON x.class = y.class AND y.session_key = x.session_key + 1""")
def c12_token_changes(spark, d):
    totals = m.turns(spark, d).groupBy("session_key").agg(*[F.sum(c).alias(c) for c in at.TOKENS])
    keys = totals.select(F.col("session_key").alias("a"))
    pairs = keys.withColumn("b", F.col("a") + 1).join(keys.select(F.col("a").alias("b")), "b", "left_semi")
    return _rounded(diff.token_changes(totals, pairs))


@_query(f"""{_COMPOSED}, l AS (SELECT session_key, {", ".join(f'arg_max("{c}", turn_index) AS "{c}"' for c in (*composition.CATEGORIES, "residual"))} FROM composed WHERE context_total <> 0 GROUP BY 1), u AS (SELECT * FROM l UNPIVOT (value FOR category IN ({", ".join(chr(34) + c + chr(34) for c in (*composition.CATEGORIES, "residual"))}))),
    p AS (SELECT DISTINCT session_key AS a, session_key + 1 AS b FROM talk WHERE session_key + 1 IN (SELECT session_key FROM talk)), g AS (SELECT p.*, c.category, coalesce(x.value, 0)::BIGINT AS a_value, coalesce(y.value, 0)::BIGINT AS b_value FROM p CROSS JOIN (SELECT unnest({[*composition.CATEGORIES, "residual"]}) AS category) c LEFT JOIN u x ON x.session_key = a AND x.category = c.category LEFT JOIN u y ON y.session_key = b AND y.category = c.category)
    SELECT a, b, category, a_value, b_value, b_value - a_value AS delta, round((b_value - a_value) / nullif(a_value, 0), 6) AS pct FROM g WHERE a_value <> 0 OR b_value <> 0 OR category = 'residual'""")
def c17_composition_changes(spark, d):
    parts = m.talk(spark, d)
    keys = parts[3].select(F.col("session_key").alias("a"))
    pairs = keys.withColumn("b", F.col("a") + 1).join(keys.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    return _rounded(diff.composition_changes(composition.compose(*parts), pairs))
