import json

import pytest
from pyspark.sql import functions as F

from tests import make
from turnstone.operators import composition, dedup
from turnstone.plans.tables import cut as lines_cut
from turnstone.sources import claude, codex, discover, lines, pi, prices, trials


def rows(df, *keys):
    return [r.asDict(True) for r in df.orderBy(*keys).collect()]


def codes(p):
    return sorted((r["code"], r["line"]) for r in p.warnings.collect())


@pytest.fixture(scope="module")
def claude_parsed(spark, tmp_path_factory):
    root = str(make.claude_root(tmp_path_factory.mktemp("cl")))
    refs = discover.claude(spark, [root])
    return refs, claude.parse(refs, discover.offloaded(spark, [root]))


def test_s1_s14_discovery_and_families(claude_parsed):
    refs, _ = claude_parsed
    got = {r["session_id"]: r for r in refs.collect()}
    assert set(got) == {make.UUIDS[0], make.UUIDS[1], "agent-x"} and got["agent-x"]["kind"] == "subagent" and got["agent-x"]["parent_id"] == make.UUIDS[0]
    assert got[make.UUIDS[0]]["cwd"] == "/w/app"
    members = {r["session_id"]: (r["family_id"], r["member_ordinal"]) for r in discover.families(refs).collect()}
    assert members["agent-x"][0] == members[make.UUIDS[0]][0] and members["agent-x"][1] == 1 and members[make.UUIDS[0]][1] == 0


def test_s6_missing_root_is_empty(spark, tmp_path):
    assert discover.everything(spark, {"claude-code": [str(tmp_path / "no")], "codex": [], "pi": []}).count() == 0


def test_claude_turns_spans_warnings(claude_parsed):
    _, p = claude_parsed
    main = p.turns.filter(F.col("session_key").contains(make.UUIDS[0]) & ~F.col("session_key").contains("agent"))
    got = rows(main, "turn_index")
    assert [(t["message_id"], t["context_total"], t["output"], t["src_line"]) for t in got] == [("m1", 1500, 300, 2), ("m1", 1500, 300, 3), ("m1", 1500, 300, 4), ("m2", 110, 5, 10), ("m2", 90, 5, 12)]
    assert (got[3]["cache_write_5m"], got[3]["cache_write_1h"]) == (7, 3) and got[4]["is_sidechain"]
    spans = rows(p.spans.filter(F.col("session_key").contains(make.UUIDS[0]) & ~F.col("session_key").contains("agent")), "turn_index", "ord")
    assert [(s["turn_index"], s["category"], s["text"], s["tool_name"], s["mcp_server"], s["truncated"]) for s in spans] == [
        (0, "userText", "hello", None, None, False), (0, "thinking", "hm" * 5, None, None, False), (1, "assistantText", "I say", None, None, False), (2, "toolCallArgs", '{"n":4}', "get_issue", "github", False),
        (3, "toolResults", "outerr", "get_issue", "github", False), (3, "assistantText", "done", None, None, False), (3, "toolCallArgs", '{"p":1}', "Read", None, False),
        (4, "coordination", "<task-notification>x", None, None, False), (4, "toolResults", "big", "Read", None, True), (4, "assistantText", "again", None, None, False),
    ]
    assert [c for c in codes(p)] == [("malformed-line", 5), ("malformed-line", 7), ("trailing-user-content-unattached", None), ("unknown-record-type", 9)]


def test_claude_compaction_iterations_errors(claude_parsed):
    _, p = claude_parsed
    t = rows(p.turns.filter(F.col("session_key").contains(make.UUIDS[1])), "turn_index")
    assert [x["context_total"] for x in t] == [20000, 0, 3000, 500] and t[3]["output"] == 120 and t[3]["logged_cost"] == 0.25 and t[1]["model"] == "<synthetic>"
    assert (t[2]["cache_miss_type"], t[2]["cache_missed_tokens"]) == ("system_changed", 4500)
    (c,) = rows(p.compactions, "ord")
    assert (c["turn_index"], c["tokens_before"], c["tokens_after"], c["shrink"], c["summary_tokens_est"], c["discarded_est"]) == (2, 20000, 3000, 17000, 40, 17040)
    assert [e["kind"] for e in rows(p.events, "kind")] == ["error"]
    s = {r["session_id"]: r for r in p.sessions.collect()}[make.UUIDS[1]]
    assert (s["harness_version"], s["cwd"], s["git_branch"], s["model"]) == ("9.1", "/w/app", "main", "claude-test-1") and s["ended_at"].second == 9


def test_invariant_context_total_and_dedup(claude_parsed):
    _, p = claude_parsed
    assert p.turns.filter("context_total <> input_uncached + cache_read + cache_write_5m + cache_write_1h").isEmpty()
    once = dedup.dedup_turns(p.turns).drop("anchor")
    main = rows(once.filter(F.col("session_key").contains(make.UUIDS[0]) & ~F.col("session_key").contains("agent")), "turn_index")
    assert [(t["message_id"], t["request_id"], t["context_total"]) for t in main] == [("m1", "r1", 1500), ("m2", "r2", 110)]
    key = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    assert key(once) == key(dedup.dedup_turns(once).select(once.columns))
    mapped = dedup.index_map(p.turns)
    kept = rows(dedup.dedup_spans(p.spans, mapped).filter(F.col("session_key").contains(make.UUIDS[0]) & ~F.col("session_key").contains("agent")), "turn_index", "ord")
    assert [s["turn_index"] for s in kept] == [0, 0, 0, 0, 1, 1, 1]


def test_family_replay_is_zeroed_or_dropped(spark, claude_parsed):
    refs, p = claude_parsed
    place = discover.families(refs).select(F.col("path").alias("session_key"), "family_id", "member_ordinal")
    t = dedup.dedup_turns(p.turns).drop("anchor").join(place, "session_key").withColumn("cost", F.lit(1.0)).withColumn("priced", F.lit(False))
    z = {(r["message_id"], r["member_ordinal"]): r for r in dedup.zero_family_replays(t).collect()}
    assert z["m1", 1]["context_total"] == 0 and z["m1", 1]["priced"] and z["m1", 1]["cost"] == 0 and z["m1", 0]["context_total"] == 1500 and z["k1", 1]["context_total"] == 600
    assert {(r["message_id"], r["member_ordinal"]) for r in dedup.drop_family_replays(t).collect()} == set(z) - {("m1", 1)}


def test_composition_invariant(claude_parsed):
    _, p = claude_parsed
    c = composition.compose(p.turns, p.spans, p.compactions, p.sessions)
    explained = sum((F.col(x) for x in composition.CATEGORIES), F.lit(0))
    assert c.filter((F.col("context_total") != 0) & (explained + F.col("residual") != F.col("context_total"))).isEmpty()
    got = rows(c.filter(F.col("session_key").contains(make.UUIDS[1])), "turn_index")
    assert [(r["phase"], r["userText"], r["assistantText"], r["compactionSummaries"], r["residual"]) for r in got] == [(0, 10, 17, 0, 19973), (0, 0, 0, 0, 0), (1, 0, 15, 40, 2945), (1, 0, 15, 40, 445)]


def test_codex(spark, tmp_path):
    p = codex.parse(discover.codex(spark, [str(make.codex_root(tmp_path))]))
    t = rows(p.turns, "turn_index")
    assert [(x["role"], x["model"]) for x in t] == [("user", "unknown"), ("user", "gpt-x"), ("system", "gpt-x"), ("assistant", "gpt-x"), ("assistant", "gpt-x"), ("user", "gpt-x"), ("user", "gpt-x"), ("assistant", "gpt-x"), ("assistant", "gpt-y")]
    used = {x["turn_index"]: (x["input_uncached"], x["cache_read"], x["output"]) for x in t if x["context_total"] or x["output"]}
    # the count without context went to turn 7 and was overwritten; later counts unwind the stack 8, 4, 3 and then none is left
    assert used == {7: (6000, 12000, 600), 8: (3000, 0, 10), 4: (5, 0, 0), 3: (5, 0, 0)} and t[7]["reasoning_output"] == 100
    spans = rows(p.spans, "turn_index", "ord")
    assert [(s["category"], s["text"], s["tool_name"], s["mcp_server"], s["truncated"]) for s in spans] == [
        ("userText", "early", None, None, False), ("instructionInjection", "# AGENTS.md instructions and more", None, None, True), ("instructionInjection", "sys", None, None, False), ("thinking", "thought", None, None, False),
        ("toolCallArgs", '{"q": 1}', "search", "gh", False), ("toolResults", "abcd", "search", "gh", False), ("toolResults", "raw", None, None, False), ("assistantText", "answer", None, None, False), ("assistantText", "after", None, None, False),
    ]
    c = rows(p.compactions, "ord")
    assert [(x["turn_index"], x["summary_tokens_est"], x["lineage"] and x["lineage"]["window_number"]) for x in c] == [(8, 3, 1), (8, 0, None)]
    assert [(e["was"], e["now"]) for e in rows(p.events, "at")] == [("gpt-x", "gpt-y")]
    (s,) = p.sessions.collect()
    assert (s["session_id"], s["git_branch"], s["model"], s["system_prompt"], s["project_instructions"]) == (make.UUIDS[2], "dev", "gpt-y", "p" * 21, "rules")
    assert json.loads(s["tool_schemas"]) == [{"name": "a", "description": "d", "serverName": "srv"}, {"name": "b"}]
    assert [c for c, _ in codes(p)] == ["orphan-token-count", "unknown-event-msg", "unknown-response-item"]


def test_pi_both_layouts(spark, tmp_path):
    refs = discover.pi(spark, [str(make.pi_root(tmp_path))])
    p = pi.parse(refs)
    a = rows(p.turns.filter(F.col("session_key").contains(make.UUIDS[3])), "turn_index")
    assert [(x["role"], x["model"], x["context_total"]) for x in a] == [("user", "", 0), ("assistant", "pm", 1600), ("user", "pm", 0), ("user", "pm", 0), ("assistant", "pm2", 7), ("user", "pm2", 0)]
    assert (a[1]["cache_write_5m"], a[1]["cache_write_1h"], a[1]["logged_cost"]) == (75, 25, 0.34) and a[4]["logged_cost"] is None
    spans = rows(p.spans.filter(F.col("session_key").contains(make.UUIDS[3])), "turn_index", "ord")
    assert [(s["turn_index"], s["category"], s["text"]) for s in spans] == [
        (1, "userText", "hi"), (1, "thinking", "t"), (1, "assistantText", "out"), (1, "toolCallArgs", '{"c":"ls"}'), (4, "toolResults", "files"), (4, "compactionSummaries", "s" * 9), (4, "coordination", "note"), (4, "assistantText", "end"),
    ]
    c = {make.UUIDS.index(k): r for r in rows(p.compactions, "session_key") for k in make.UUIDS if k in r["session_key"]}
    assert (c[3]["turn_index"], c[3]["tokens_before"], c[3]["summary_tokens_est"]) == (4, 8500, 3)
    assert sorted((e["field"], e["was"], e["now"]) for e in p.events.collect()) == [("model", "pm", "pm2"), ("thinkingLevel", None, "high")]
    b = rows(p.turns.filter(F.col("session_key").contains(make.UUIDS[4])), "turn_index")
    assert [(x["role"], x["context_total"]) for x in b] == [("user", 0), ("assistant", 1600)]
    got = {c for c, _ in codes(p)}
    assert got == {
        "pi-forked-session", "pi-malformed-entry", "pi-off-path-branches", "pi-unknown-entry-type", "pi-unrecognized-message-role", "pi-trailing-content-unattached", "pi-systemb-malformed-entry", "pi-systemb-malformed-lane",
        "pi-systemb-malformed-line", "pi-systemb-multiple-lanes", "pi-systemb-unknown-kind", "pi-systemb-usage-record-mismatch",
    }


def test_s12_sniff(spark, tmp_path):
    make.claude_root(tmp_path / "a"), make.codex_root(tmp_path / "b"), make.pi_root(tmp_path / "c")
    refs = discover.everything(spark, {"claude-code": [str(tmp_path / "a")], "codex": [str(tmp_path / "b")], "pi": [str(tmp_path / "c")]})
    wrong = lines.sniff(lines.read_lines(refs)).join(refs.select(F.col("path").alias("session_key"), F.col("harness").alias("h")), "session_key").filter("harness is null or harness <> h")
    assert wrong.isEmpty() and refs.count() == 6


def test_prices(spark, tmp_path):
    assert prices.per_token_rows({"m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "input_cost_per_token_above_200k_tokens": 3e-6}, "e": {"input_cost_per_token": 1}})[0][11] == 200000
    payload = {"gate": {"models": {"m": {"cost": {"input": 9, "output": 9}}, "n": {"cost": {"input": 1, "output": 2, "cache_read": 0.5}}}}, "openai": {"models": {"m": {"cost": {"input": 3, "output": 4}}}}}
    got = {r[0]: r for r in prices.per_million_rows(payload)}
    assert got["m"][1] == 3e-6 and got["n"][3] == 5e-7
    path = str(tmp_path / "c.json")
    with pytest.raises(ValueError):
        prices.save_cached(path, payload)
    (tmp_path / "c.json").write_text(json.dumps({"fetchedAt": 1000, "payload": payload}))
    assert len(prices.cached_rows(path, now=1000)) == 2 and prices.cached_rows(path, now=1000 + 31 * 86400) == [] and prices.cached_rows(path, now=0) == [] and prices.cached_rows("/none") == []


def test_trials_reader(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    row = {"taskName": "t", "configName": "a", "wallMs": 10, "verify": {"passed": True}, "raw": {"type": "x", "secret": 1}, "totals": {"priced": True, "cost": 0.5, "compactionCount": 1, "tokens": {"contextTotal": 9}}}
    trials.append_result(path, row)
    assert "secret" not in open(path).read() and "_reduced" in open(path).read()
    with open(path, "a") as f:
        f.write('{"torn')
    got, warnings = trials.read_results(spark, path)
    (r,) = got.collect()
    assert (r["passed"], r["has_totals"], r["context_total"], r["cost"]) == (True, True, 9, 0.5) and warnings.count() == 1


def test_pi_contents_stay_out_of_entries_and_walk(spark):
    """Only parsed lines hold VARIANT: what is written of entries, pointers and walked entries is narrow."""
    raw = ['{"type":"session","id":"x","timestamp":"2026-01-01T00:00:00Z","cwd":"/w"}', '\t{"id":"a","parentId":null,"timestamp":"2026-01-01T00:00:00Z","type":"message","message":{"role":"user","content":"hi"}}', "[1]", '{"id":"b","parentId":"a","timestamp":"2026-01-01T00:00:00Z","type":"message","message":{"role":"assistant","content":"no list"}}']
    given = spark.createDataFrame([("s", k + 1, r) for k, r in enumerate(raw)], "session_key string, line long, raw string")
    refs = spark.createDataFrame([("pi", "s", "s", "main", None, None, None, 1)], "harness string, session_id string, path string, kind string, parent_id string, cwd string, mtime timestamp, size_bytes long")
    written = []
    p = pi.parse_lines(given, refs, lambda df: written.append(df) or lines_cut(df))
    assert sum("variant" in dict(df.dtypes).values() for df in written) == 1 and len(written) == 4
    assert [(r["turn_index"], r["role"], r["input_uncached"], r["context_total"], r["logged_cost"]) for r in p.turns.orderBy("turn_index").collect()] == [(0, "user", 0, 0, None), (1, "assistant", 0, 0, None)]
    assert [(r["turn_index"], r["text"]) for r in p.spans.collect()] == [(1, "hi")] and codes(p) == [("pi-malformed-entry", 3)]
