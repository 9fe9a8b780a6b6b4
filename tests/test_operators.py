import random

import pytest
from pyspark.sql import functions as F

from tests import make
from turnstone.functions import text as t
from turnstone.operators import compaction, compare, dashboard, diff, matching, pricing, tree
from turnstone.plans import tables
from turnstone.plans.engine import Engine
from turnstone.plans.queries import QUERIES
from turnstone.render import fmt
from turnstone.sources import prices
from turnstone.store.totals import valid

USAGE = "session_key string, turn_index long, model string, input_uncached long, cache_read long, cache_write_5m long, cache_write_1h long, output long, context_total long, logged_cost double"


def priced(spark, rows, table, mode="auto"):
    turns = spark.createDataFrame([("s", k, *r[:6], sum(r[1:5]), r[6]) for k, r in enumerate(rows)], USAGE)
    return [r.asDict() for r in pricing.price_turns(turns, spark.createDataFrame(table, prices.SCHEMA), mode).orderBy("turn_index").collect()]


def rate(key, i=5e-6, o=2.5e-5, r=5e-7, w5=6.25e-6, w1=1e-5, ti=None, to=None, th=None, tier=1):
    return (key, i, o, r, w5, w1, ti, to, None, None, None, th, tier)


def test_c1_flat_cost_and_lookup_order(spark):
    a, b, c, d = priced(spark, [("prov/claude-z-20260101", 1000, 500, 200, 100, 300, None), ("nope", 1, 0, 0, 0, 0, None), ("x", 10, 0, 0, 0, 0, None), ("x", 1, 0, 0, 0, 1, 0.5)], [rate("claude-z"), rate("x", i=1.0, tier=2), rate("x", i=2.0, tier=1)])
    assert a["cost"] == pytest.approx(0.015) and a["priced"] and (b["cost"], b["priced"]) == (0.0, False) and c["cost"] == pytest.approx(20.0) and d["cost"] == 0.5 and d["cost_input"] == 0


def test_c4_c5_tiers_at_the_edge(spark):
    table = [rate("claude-t", 1.0, 1.0, ti=2.0, to=3.0, th=200000), rate("gpt-t", 1.0, 1.0, ti=2.0, to=3.0, th=200000)]
    cost = [r["cost"] for r in priced(spark, [("claude-t", 200000, 0, 0, 0, 1, None), ("claude-t", 200001, 0, 0, 0, 1, None), ("gpt-t", 200001, 0, 0, 0, 1, None)], table)]
    assert cost == [200001, 200000 + 2 + 3, 400002 + 3]


def test_c6_c7_modes_and_infinite_prices(spark):
    table = [rate("m", float("inf"))]
    assert not priced(spark, [("m", 1, 0, 0, 0, 0, None)], table)[0]["priced"]
    assert not priced(spark, [("k", 1, 0, 0, 0, 0, None)], [rate("k")], "display")[0]["priced"]
    assert priced(spark, [("k", 1, 0, 0, 0, 0, 9.0)], [rate("k")], "calculate")[0]["cost"] == 5e-6


def test_c10_worked_example_and_idempotence(spark):
    turns = spark.createDataFrame([("s", 0, 844000), ("s", 1, 0), ("s", 2, 0), ("s", 3, 54437)], "session_key string, turn_index long, context_total long")
    schema = "session_key string, ord long, turn_index long, tokens_before long, tokens_after long, shrink long, discarded_est long, summary_tokens_est long"
    events = spark.createDataFrame([("s", 1, 2, None, None, None, None, 30581), ("s", 2, 0, None, None, None, None, 1), ("s", 3, 4, 5, None, 7, 8, 1)], schema)
    once = compaction.finalize(events, turns)
    got = {r["ord"]: r for r in once.collect()}
    assert (got[1]["shrink"], got[1]["discarded_est"]) == (789563, 820144) and got[2]["shrink"] is None and (got[3]["shrink"], got[3]["tokens_after"]) == (7, None)
    assert sorted(compaction.finalize(once, turns).collect()) == sorted(once.collect())


def test_j5_stack_matches_a_stack(spark):
    rng, rows, want = random.Random(5), [], {}
    for s in range(60):
        stack = []
        for k in range(40):
            kind = rng.choice("+-.")
            rows.append((str(s), k, kind))
            if kind == "+":
                stack.append(k)
            elif kind == "-":
                want[str(s), k] = stack.pop() if stack else None
    df = spark.createDataFrame(rows, "session_key string, line int, kind string")
    got = matching.match_stack(df, F.col("kind") == "+", F.col("kind") == "-").filter("kind = '-'").collect()
    assert {(r["session_key"], r["line"]): r["partner"] for r in got} == want and all(r["orphan"] == (r["partner"] is None) for r in got)


def test_j8_paths_with_cycles_gaps_and_depth(spark):
    deep = [("d", str(k), str(k - 1) if k else None) for k in range(300)]
    entries = spark.createDataFrame([*deep, ("c", "a", "b"), ("c", "b", "a"), ("c", "z", "a"), ("g", "x", "missing")], "session_key string, id string, parent_id string")
    leaves = spark.createDataFrame([("d", "299"), ("c", "z"), ("g", "x"), ("n", "none")], "session_key string, id string")
    path = tree.paths_to_root(entries, leaves, tables.cut)
    got = sorted((r["session_key"], r["id"], r["up"]) for r in path.collect() if r["session_key"] != "d")
    assert got == [("c", "a", 1), ("c", "b", 2), ("c", "z", 0), ("g", "x", 0)] and path.filter("session_key = 'd' and up = 299 - cast(id as int)").count() == 300


def test_j8_walks_in_one_written_table_and_doubles_what_is_large(spark, monkeypatch):
    entries = spark.createDataFrame([("d", str(k), str(k - 1) if k else None) for k in range(300)] + [("c", "a", "b"), ("c", "b", "a")], "session_key string, id string, parent_id string")
    leaves = spark.createDataFrame([("d", "299"), ("d", "100"), ("c", "a")], "session_key string, id string")
    written = []
    cut = lambda df: written.append(df) or tables.cut(df)
    once = tree.paths_to_root(entries, leaves, cut).collect()
    assert len(written) == 1 and len(once) == 302 and max(r["up"] for r in once) == 198
    monkeypatch.setattr(tree, "WALKED", 1000)
    both = tree.paths_to_root(entries, leaves, cut).collect()
    assert len(written) > 5 and sorted(both) == sorted(once)


@pytest.mark.parametrize("name", ["c7_modes", "a5_merged_by_model", "a6_subagent_rollup"])
def test_priced_turns_are_computed_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 1


def test_a20_a21_medians(spark):
    rows = [("t", "a", w, p, True, True, 5, 0.1, 1, k) for k, (w, p) in enumerate([(10000, True), (20000, True), (30000, False), (40000, True)])] + [("t", "b", 1, True, False, False, None, None, None, 9), ("u", "a", 1, True, True, False, 7, 1.0, 2, 10)]
    df = spark.createDataFrame(rows, "task_name string, config_name string, wall_ms long, passed boolean, has_totals boolean, priced boolean, context_total long, cost double, compactions long, row_no long")
    got = {(r["task_name"], r["config_name"]): r for r in compare.cells_and_overall(df).collect()}
    a = got["t", "a"]
    assert (a["median_wall_ms"], a["successes"], a["success_rate"]) == (25000, 3, 0.75) and got["t", "b"]["median_tokens"] is None and got[None, "a"]["median_wall_ms"] == 20000 and got["u", "a"]["median_cost"] is None
    missing = {r["task_name"]: r["missing"] for r in compare.paired(compare.cells(df), "a", "b").collect()}
    assert missing == {"t": None, "u": "b"}


def test_dashboard_last_active_days_and_other(spark):
    rows = [(f"s{k}", "pi", "/p", f"m{k % 7}", f"2026-0{1 + k // 28}-{1 + k % 28:02d}T23:59:00", float(10 - k % 7), True, 0, 1, 1, 1, 1, 3) for k in range(56)]
    df = spark.createDataFrame(rows, "session_key string, harness string, cwd string, model string, at string, cost double, priced boolean, compactions long, input_uncached long, cache_read long, cache_write long, output long, context_total long").withColumn("started_at", F.col("at").cast("timestamp"))
    w = dashboard.window(df)
    assert w.select("day").distinct().count() == 30 and dashboard.window(df, "2026-01-01").select("day").distinct().count() == 56
    series = {r["series"] for r in dashboard.daily_cost(w).collect()}
    assert len(series) == 6 and "other" in series and dashboard.daily_cost(w).count() == 180


def test_diff_scalars(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (2, 6)], "a long, b long")
    assert [r[0] for r in df.select(diff.divergence(F.col("a"), F.col("b"))).collect()] == [1.0, float("inf"), 3.0]
    got = df.select(*diff.change(F.col("a"), F.col("b"))).collect()
    assert [r["pct"] for r in got] == [None, None, 2.0]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a😀b", "/home/x/1/2/3/4/5/6/7/8/9/10/11/12/13/14/15/16/17")], "s string, p string")
    r = df.select(t.utf16_length(F.col("s")).alias("n"), t.shorten_path(F.col("p"), "/home/x").alias("p"), t.compact_number(F.lit(1234567)).alias("c"), t.round_half_up(F.lit(-2.5)).alias("h"), t.words_of_camel(F.lit("userText")).alias("w")).first()
    assert tuple(r) == (4, "~/…/16/17", "1.2M", -2, "user text")


def test_formats():
    assert (fmt.cost(1.005), fmt.cost(0.0086), fmt.cost(-2.5), fmt.cost(1, False)) == ("$1.00", "$0.0086", "-$2.50", "—")
    assert (fmt.compact(37481), fmt.compact(823), fmt.number(-1234.5), fmt.bar(1.5), fmt.bar(-0.12)) == ("37.5k", "823", "-1,234", "████████ 150%", "░░░░░░░░ -12%")
    assert (fmt.duration(64000), fmt.tenths(8300), fmt.tenths(125000), fmt.percent(-0.191), fmt.signed(1788)) == ("1m4s", "8.3s", "2m 5.0s", "-19.1%", "+1,788")


PRICES = {"claude-test-1": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "gpt-x": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}}


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("roots")
    return {"claude-code": [str(make.claude_root(base / "a"))], "codex": [str(make.codex_root(base / "b"))], "pi": [str(make.pi_root(base / "c"))]}


def test_engine_list_and_store(spark, roots, tmp_path):
    import os

    e = Engine(spark, roots, prices.prices(spark, PRICES), str(tmp_path / "store"))
    first = {r["session_id"]: r for r in e.list().collect()}
    assert len(first) == 5 and first[make.UUIDS[0]]["turns"] == 2 and first[make.UUIDS[0]]["context_total"] == 1610 and first[make.UUIDS[1]]["compactions"] == 1 and not first[make.UUIDS[2]]["priced"]
    target = first[make.UUIDS[1]]["path"].removeprefix("file:").replace("///", "/")
    os.utime(target, (1, 1))
    again = Engine(spark, roots, prices.prices(spark, PRICES), str(tmp_path / "store"))
    seen = []
    real, again.parse = again.parse, lambda refs: (seen.append(refs.count()), real(refs))[1]
    assert {r["session_id"] for r in again.list().collect()} == set(first) and seen == [1]
    assert valid(again.store.load()).count() == 5


def test_engine_lists_fresh_sessions_that_the_store_rejects(spark, tmp_path):
    u = {"input": 10, "output": 2, "cacheRead": 0, "cacheWrite": 5, "cacheWrite1h": 25}
    make.write(tmp_path / "pi" / "--w--" / f"2026-05-01T08-00-00-000Z_{make.UUIDS[3]}.jsonl", [
        {"type": "session", "version": 3, "id": make.UUIDS[3], "timestamp": "2026-05-01T08:00:00.000Z", "cwd": "/w"},
        {"type": "message", "id": "1", "parentId": None, "timestamp": "2026-05-01T08:00:01.000Z", "message": {"role": "assistant", "model": "m", "usage": u, "content": []}},
    ])
    make.pi_root(tmp_path / "pi")
    (tmp_path / "pi" / "--w-pi--" / f"2026-05-01T08-00-00-000Z_{make.UUIDS[3]}.jsonl").unlink()
    roots = {"pi": [str(tmp_path / "pi")]}
    plain = {(r["path"], r["cache_write_5m"]) for r in Engine(spark, roots, prices.prices(spark, PRICES)).list().collect()}
    assert len(plain) == 2 and min(x for _, x in plain) == -20
    for _ in range(2):  # the second time one comes from the store and one is parsed again
        e = Engine(spark, roots, prices.prices(spark, PRICES), str(tmp_path / "store"))
        assert {(r["path"], r["cache_write_5m"]) for r in e.list().collect()} == plain and e.store.load().count() == 1


def test_engine_commands(spark, roots):
    from turnstone.render import html, text

    e = Engine(spark, roots, prices.prices(spark, PRICES))
    one = e.resolve(make.UUIDS[1])
    cost = e.cost(one)
    assert cost["cache"].first()["wasted_tokens"] == 4500 and "claude-test-1" in text.cost(cost) and text.cost(cost, "model").startswith("by model")
    context = e.context(one)
    assert "shrunk 17,000 tokens" in text.context(context) and "17,000" in text.compactions(e.compactions(one))
    assert "<svg" in html.session_page(context, cost, True)
    every = e.cost_all()
    family = {r["children"]: r for r in every["families"].collect()}
    assert family[1]["child_tokens"] == 650 and {r["harness"] for r in every["harness"].collect()} == {None, "claude-code", "codex", "pi"}
    keys = [e.resolve(make.UUIDS[k]).first()["path"] for k in (0, 1)]
    d = e.diff(e.refs.filter(F.col("path").isin(keys)), keys[0], keys[1:])
    assert "composition" in text.diff(d, keys[0]) and "<table>" in html.diff_page(d)
    assert "<svg" in html.dashboard_page(e.dashboard()) and e.turn_detail(one, 1).count() == 2
    with pytest.raises(LookupError):
        e.resolve("ffffffff")


def test_cli(spark, roots, tmp_path, capsys, monkeypatch):
    from turnstone.cli import main

    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("PI_AGENT_DIR", raising=False)
    flags = [f"--claude-root={roots['claude-code'][0]}"]
    assert main([*flags, "list"], spark) == 0 and make.UUIDS[0][:8] in capsys.readouterr().out
    assert main(["list"], spark) == 0 and main(["nonsense"], spark) == 1 and main([*flags, "cost", "nothing-here"], spark) == 1
    assert main([*flags, "diff", "--last", "5"], spark) == 2
    out = tmp_path / "r.html"
    assert main([*flags, "report", make.UUIDS[1], "-o", str(out)], spark) == 0 and out.read_text().startswith("<!doctype html>")


def test_cli_usual_roots_files_and_dates(spark, roots, tmp_path, capsys, monkeypatch):
    from pathlib import Path

    from turnstone.cli import main, since

    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("PI_AGENT_DIR", str(tmp_path / "agent"))
    assert main(["list"], spark) == 0 and capsys.readouterr().out.strip() == f"no sessions; checked {tmp_path}/.claude/projects, {tmp_path}/.codex/sessions, {tmp_path}/agent/sessions"
    assert main(["cost", "--harness", "codex"], spark) == 1 and capsys.readouterr().err.strip() == f"no sessions; checked {tmp_path}/.codex/sessions"
    # a file outside the roots, of each harness
    files = {h: next(p for p in sorted(Path(roots[h][0]).rglob("*.jsonl")) if "subagents" not in p.parts) for h in roots}
    for harness, path in files.items():
        assert main(["cost", str(path)], spark) == 0 and main(["cost", "--harness", harness, str(path)], spark) == 0
        other = "pi" if harness != "pi" else "codex"
        capsys.readouterr()
        assert main(["cost", "--harness", other, str(path)], spark) == 1 and f"a session of {harness}, not of {other}" in capsys.readouterr().err
    assert main(["diff", str(files["codex"]), str(files["claude-code"])], spark) == 0
    make.write(tmp_path / "x.jsonl", [{"a": 1}])
    assert main(["cost", str(tmp_path / "x.jsonl")], spark) == 1 and main(["cost", str(tmp_path / "none.jsonl")], spark) == 1
    # sessions at the usual places
    make.claude_root(tmp_path / ".claude" / "projects")
    make.codex_root(tmp_path / ".codex" / "sessions")
    make.pi_root(tmp_path / "agent" / "sessions")
    capsys.readouterr()
    assert main(["list"], spark) == 0 and all(make.UUIDS[k][:8] in capsys_out for capsys_out in [capsys.readouterr().out] for k in range(5))
    assert main(["list", "--since", "yesterday"], spark) == 1 and "--since must be a date" in capsys.readouterr().err
    assert main(["list", "--since", "2999-01-01"], spark) == 0 and "no sessions" in capsys.readouterr().out
    assert since("2026-03-01") == "2026-03-01T00:00:00+00:00" and since("2026-03-01T10:00:00Z").endswith("10:00:00+00:00")
