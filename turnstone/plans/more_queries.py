"""Queries of lookups, paths, lanes, filters, kept totals and scalar operators, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import json as j
from turnstone.functions import text as tx
from turnstone.operators import compaction, diff, matching, tree
from turnstone.plans import mapping as m
from turnstone.plans import tables
from turnstone.plans.queries import _query, _rounded
from turnstone.sources import claude, codex, discover, pi
from turnstone.store import totals as store

#: Refs: a document a file, of a harness by language, of unknown directory now and then.
_REFS = """refs AS (SELECT CASE lang WHEN 'en' THEN 'claude-code' WHEN 'fr' THEN 'codex' ELSE 'pi' END AS harness, md5(doc_id::VARCHAR) AS session_id, '/r/' || doc_id AS path,
    CASE WHEN doc_id % 9 = 0 THEN 'subagent' ELSE 'main' END AS kind, CASE WHEN doc_id % 5 <> 0 THEN source END AS cwd, (doc_id * 7919) % 10007 AS mtime, n_chars AS size_bytes, doc_id FROM documents)"""


def _refs(spark, d):
    doc = F.col("doc_id")
    harness = F.when(F.col("lang") == "en", "claude-code").when(F.col("lang") == "fr", "codex").otherwise("pi")
    return m.read(spark, d, "documents").select(
        harness.alias("harness"), F.md5(doc.cast("string").cast("binary")).alias("session_id"), F.concat(F.lit("/r/"), doc).alias("path"), F.when(doc % 9 == 0, "subagent").otherwise("main").alias("kind"),
        F.when(doc % 5 != 0, F.col("source")).alias("cwd"), (doc * 7919 % 10007).alias("mtime"), F.col("n_chars").alias("size_bytes"), "doc_id",
    )


@_query(f"WITH {_REFS} SELECT path, harness, cwd FROM refs WHERE kind = 'main' AND harness = 'claude-code' AND (cwd IS NULL OR cwd = 'src3')")
def p1_filtered_refs(spark, d):
    return discover.filtered(_refs(spark, d), "claude-code", "src3").select("path", "harness", "cwd")


@_query(f"WITH {_REFS}, m AS (SELECT * FROM refs WHERE kind = 'main'), h AS (SELECT harness FROM m WHERE cwd = 'src4' ORDER BY mtime DESC, path LIMIT 1) SELECT path, harness FROM m WHERE harness = (SELECT harness FROM h) AND (cwd IS NULL OR cwd = 'src4') ORDER BY mtime DESC, path LIMIT 3")
def o4_last_comparable(spark, d):
    return diff.last_comparable(_refs(spark, d), 3, "src4").select("path", "harness")


@_query(f"WITH {_REFS} SELECT path, harness FROM refs WHERE starts_with(session_id, substring(md5('7'), 1, 7))")
def j21_resolve_prefix(spark, d):
    import hashlib

    return diff.resolve_id(_refs(spark, d), hashlib.md5(b"7").hexdigest()[:7]).select("path", "harness")


_KEPT = "kept AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN doc_id % 7 = 0 THEN size_bytes - 1 ELSE size_bytes END AS size_bytes FROM refs WHERE doc_id % 3 <> 0)"


def _kept(refs):
    doc = F.col("doc_id")
    return refs.filter(doc % 3 != 0).select("path", F.when(doc % 4 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(doc % 7 == 0, F.col("size_bytes") - 1).otherwise(F.col("size_bytes")).alias("size_bytes"))


@_query(f"WITH {_REFS}, {_KEPT} SELECT k.path FROM kept k JOIN refs r ON k.path = r.path AND k.mtime = r.mtime AND k.size_bytes = r.size_bytes")
def j17_store_hits(spark, d):
    refs = _refs(spark, d)
    return store.hits(refs, _kept(refs)).select("path")


@_query(f"WITH {_REFS}, {_KEPT} SELECT r.path FROM refs r WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.path = r.path AND k.mtime = r.mtime AND k.size_bytes = r.size_bytes)")
def u6_store_misses(spark, d):
    refs = _refs(spark, d)
    return store.misses(refs, _kept(refs)).select("path")


@_query("SELECT user_id AS path, arg_max(event_type, event_id) AS value, max(event_id) AS line FROM events GROUP BY user_id")
def s15_last_writes(spark, d):
    log = m.read(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("value"), F.col("event_id").alias("line"))
    return store.last_writes(log)


@_query(f"WITH {m.SESSIONS} SELECT session_key AS path, model FROM session_rows WHERE model NOT LIKE 'click%' AND cost >= 0 AND session_key % 10 <> 0")
def s16_valid_rows(spark, d):
    rows = m.session_rows(spark, d).withColumnRenamed("session_key", "path")
    bad = F.col("path") % 10 == 0
    rows = rows.withColumn("mtime", F.col("started_at")).withColumn("size_bytes", F.lit(1)).withColumn("ended_at", F.col("started_at")).withColumn("turns", F.when(bad, -1).otherwise(1))
    rows = rows.withColumn("harness", F.when(F.col("model").startswith("click"), "other").otherwise(F.col("harness"))).withColumns({c: F.lit(0) for c in ("cache_write_5m", "cache_write_1h")})
    return store.valid(rows).select("path", "model")


@_query("SELECT DISTINCT event_type AS model FROM events")
def u3_distinct_models(spark, d):
    return m.read(spark, d, "events").select(F.col("event_type").alias("model")).distinct()


@_query("SELECT d.doc_id, l.doc_id IS NOT NULL AS truncated FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id")
def j4_offloaded_flag(spark, d):
    known = m.read(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("there", F.lit(True))
    return m.read(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("truncated"))


_PARENT = "CASE WHEN p_partkey <= 1 THEN NULL WHEN p_partkey % 97 = 0 THEN -1 ELSE p_partkey // 2 END"


@_query(f"""WITH RECURSIVE e AS (SELECT p_partkey AS id, {_PARENT} AS parent FROM part), leaf AS (SELECT p_partkey % 8 AS session_key, max(p_partkey) AS id FROM part GROUP BY 1),
    walk AS (SELECT session_key, leaf.id, 0 AS up FROM leaf UNION ALL SELECT w.session_key, p.id, w.up + 1 FROM walk w JOIN e ON e.id = w.id JOIN e p ON p.id = e.parent) SELECT session_key, id, up::BIGINT AS up FROM walk""")
def j8_paths_to_root(spark, d):
    part = m.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    parent = F.when(F.col("id") <= 1, None).when(F.col("id") % 97 == 0, -1).otherwise(F.floor(F.col("id") / 2))
    leaves = part.groupBy((F.col("id") % 8).alias("session_key")).agg(F.max("id").alias("id"))
    # every session has the same tree
    entries = leaves.select("session_key").crossJoin(part.withColumn("parent_id", parent))
    return tree.paths_to_root(entries, leaves, tables.cut)


_MOVES = "moves AS (SELECT user_id AS session_key, event_type AS lane_id, event_id AS entry_id, event_id % 50 AS seq, event_id AS line FROM events)"


@_query(f"""WITH {_MOVES}, latest AS (SELECT *, row_number() OVER (PARTITION BY session_key, lane_id ORDER BY seq DESC, line) AS rn, min(line) OVER (PARTITION BY session_key, lane_id) AS seen FROM moves),
    act AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY seq DESC, seen) AS r2, count(*) OVER (PARTITION BY session_key) - 1 AS others FROM latest WHERE rn = 1) SELECT session_key, entry_id AS id, others FROM act WHERE r2 = 1""")
def j9_active_lane(spark, d):
    e = m.read(spark, d, "events")
    return tree.active_lane(e.select(F.col("user_id").alias("session_key"), F.col("event_type").alias("lane_id"), F.col("event_id").alias("entry_id"), (F.col("event_id") % 50).alias("seq"), F.col("event_id").alias("line")))


@_query(f"""WITH {m.TIMELINE}, t AS (SELECT session_key, turn_index * 2 AS src_line, turn_index, context_total, event_id % 11 = 0 AS is_api_error FROM timeline), k AS (SELECT session_key, turn_index * 2 + 1 AS line FROM timeline WHERE event_type = 'purchase')
    SELECT k.session_key, k.line, coalesce((SELECT min(t.turn_index) FROM t WHERE t.session_key = k.session_key AND t.src_line > k.line), (SELECT count(*) FROM t WHERE t.session_key = k.session_key)) AS turn_index,
           (SELECT arg_max(t.context_total, t.src_line) FROM t WHERE t.session_key = k.session_key AND t.src_line < k.line AND t.context_total <> 0 AND NOT t.is_api_error) AS tokens_before,
           (SELECT arg_min(t.context_total, t.src_line) FROM t WHERE t.session_key = k.session_key AND t.src_line > k.line AND t.context_total <> 0 AND NOT t.is_api_error) AS tokens_after FROM k""")
def j13_marker_anchors(spark, d):
    line = m.timeline(spark, d)
    turns = line.select("session_key", (F.col("turn_index") * 2).alias("src_line"), "turn_index", "context_total", (F.col("event_id") % 11 == 0).alias("is_api_error"))
    return compaction.marker_anchors(line.filter("event_type = 'purchase'").select("session_key", (F.col("turn_index") * 2 + 1).alias("line")), turns)


@_query(f"WITH {m.TIMELINE} SELECT session_key, turn_index, coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM timeline")
def w11_turns_before(spark, d):
    line = m.timeline(spark, d)
    return line.select("session_key", "turn_index", F.coalesce(matching.seen_before(F.col("event_type") == "view", order="turn_index"), F.lit(0)).alias("before"))


@_query(f"WITH {m.TIMELINE} SELECT session_key, arg_min(event_type, turn_index) FILTER (event_type <> 'view') AS first FROM timeline GROUP BY session_key")
def p9_first_text(spark, d):
    line = m.timeline(spark, d).withColumn("x", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return line.groupBy("session_key").agg(matching.first_text(F.col("x"), F.col("turn_index")).alias("first"))


#: A record with numbers, numeric strings and absent fields, from an event.
_RECORD = """concat('{"u":{"input_tokens":', CASE WHEN event_id % 3 = 0 THEN concat('"', user_id, '"') ELSE concat('', user_id) END, ',"output_tokens":', event_id, ',"cache_creation_input_tokens":40', CASE WHEN event_id % 2 = 0 THEN ',"cache_creation":{"ephemeral_5m_input_tokens":30,"ephemeral_1h_input_tokens":10}' ELSE '' END, '}}')"""


def _records(spark, d):
    return m.read(spark, d, "events").select("event_id", F.try_parse_json(F.expr(_RECORD)).alias("v"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS input_uncached, event_id AS output, CASE WHEN event_id % 2 = 0 THEN 30 ELSE 40 END AS cache_write_5m, CASE WHEN event_id % 2 = 0 THEN 10 ELSE 0 END AS cache_write_1h FROM events")
def p3_claude_usage(spark, d):
    return _records(spark, d).select("event_id", claude.usage(j.at(F.col("v"), "$.u")).alias("u")).select("event_id", "u.input_uncached", "u.output", "u.cache_write_5m", "u.cache_write_1h")


@_query("SELECT event_id, greatest(0, user_id - 40) AS input_uncached, 40 AS cache_read FROM events")
def p4_codex_usage(spark, d):
    v = F.try_parse_json(F.expr("""concat('{"input_tokens":', user_id, ',"cached_input_tokens":40}')"""))
    return m.read(spark, d, "events").withColumn("v", v).select("event_id", codex.usage(F.col("v")).alias("u")).select("event_id", "u.input_uncached", "u.cache_read")


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 100 - user_id ELSE 100 END AS cache_write_5m, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS cache_write_1h FROM events")
def p5_pi_usage(spark, d):
    v = F.try_parse_json(F.expr("""concat('{"cacheWrite":100,"cacheWrite1h":', CASE WHEN event_id % 2 = 0 THEN concat('', user_id) ELSE 'null' END, '}')"""))
    return m.read(spark, d, "events").withColumn("v", v).select("event_id", pi.usage(F.col("v")).alias("u")).select("event_id", "u.cache_write_5m", "u.cache_write_1h")


@_query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'a__b' WHEN event_id % 3 = 2 THEN 'mcp__x' ELSE event_type END AS tool, CASE WHEN event_id % 3 = 1 THEN 'srv' END AS server FROM events")
def p24_tool_names(spark, d):
    name = F.when(F.col("event_id") % 3 == 1, "mcp__srv__a__b").when(F.col("event_id") % 3 == 2, "mcp__x").otherwise(F.col("event_type"))
    tool, server = claude.split_name(name)
    return m.read(spark, d, "events").select("event_id", tool.alias("tool"), server.alias("server"))


@_query("SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units, regexp_replace(source, '[^A-Za-z0-9]', '-', 'g') AS slug, left(md5(text), 8) AS short FROM documents")
def f_scalar_text(spark, d):
    return m.read(spark, d, "documents").select("doc_id", tx.utf16_length(F.col("text")).alias("units"), tx.slug(F.col("source")).alias("slug"), tx.short_id(F.md5(F.col("text").cast("binary"))).alias("short"))


@_query("""WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS x, b.s_nationkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
    SELECT a, b, round(CASE WHEN x = 0 AND y = 0 THEN 1.0 WHEN x = 0 OR y = 0 THEN 1e300 ELSE greatest(x, y) / least(x, y) END, 6) AS ratio, CASE WHEN x = 3 OR y = 3 THEN 'unknown' WHEN x % 4 = y % 4 THEN 'same' ELSE 'differs' END AS logged FROM p""")
def c13_c15_comparability(spark, d):
    s = m.read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    p = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("x")).join(s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("y")), F.col("b") == F.col("a") + 1)
    of = lambda c: F.when(F.col(c) != 3, (F.col(c) % 4).cast("string"))
    ratio = diff.divergence(F.col("x"), F.col("y"))
    return _rounded(p.select("a", "b", F.when(ratio == float("inf"), 1e300).otherwise(ratio).alias("ratio"), diff.compare_logged(of("x"), of("y")).alias("logged")))
