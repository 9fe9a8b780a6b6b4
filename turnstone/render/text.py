"""Aligned tables and JSON: K1, K2, and the printed form of each command."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame

from turnstone.operators.composition import CATEGORIES
from turnstone.render import fmt

RESIDUAL = {"codex": "framing and what is encrypted"}


def table(head: list[str], rows: list[list[str]], right: set[int] = frozenset()) -> str:
    """Columns two blanks apart, the named ones to the right."""
    cells = [head, *rows]
    widths = [max(len(r[k]) for r in cells) for k in range(len(head))]
    return "\n".join("  ".join(c.rjust(w) if k in right else c.ljust(w) for k, (c, w) in enumerate(zip(r, widths))).rstrip() for r in cells)


def as_json(x) -> str:
    """Two blanks of indent, times in ISO, absent fields left out."""
    def plain(v):
        if isinstance(v, DataFrame):
            return [plain(r.asDict(True)) for r in v.collect()]
        if isinstance(v, dict):
            return {k: plain(w) for k, w in v.items() if w is not None}
        if isinstance(v, (list, tuple)):
            return [plain(w) for w in v]
        if isinstance(v, datetime):
            return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
        return v.isoformat() if isinstance(v, date) else v

    return json.dumps(plain(x), indent=2, ensure_ascii=False)


def listing(rows: DataFrame, limit: int = 50) -> str:
    """O2: at most `limit` lines (0: all), and how many more there are."""
    shown = (rows.limit(limit) if limit else rows).collect()
    more = max(0, rows.count() - len(shown)) if limit else 0
    lines = [[r["harness"], fmt.short(r["session_id"]), fmt.path(r["cwd"], 28), fmt.moment(r["started_at"]), str(r["turns"]), fmt.compact(r["context_total"]), fmt.cost(r["cost"], r["priced"]), str(r["compactions"])] for r in shown]
    out = table(["harness", "session", "cwd", "started", "turns", "tokens", "cost", "compactions"], lines, {4, 5, 6, 7}) if lines else "no sessions"
    return out + (f"\n{more} more" if more else "")


def cost(report: dict[str, DataFrame], by: str | None = None) -> str:
    model = lambda: "by model\n" + table(["model", "turns", "tokens", "cost"], [[r["model"], str(r["turns"]), fmt.number(r["context_total"]), fmt.cost(r["cost"], r["priced"])] for r in report["model"].collect()], {1, 2, 3})
    tool = lambda: "by tool (tokens are a quarter of the characters)\n" + table(["tool", "mcp server", "calls", "results", "~tokens"], [[r["tool_name"], r["mcp_server"] or "", str(r["call_spans"]), str(r["result_spans"]), f"~{fmt.number(r['tokens_est'])}"] for r in report["tool"].collect()], {2, 3, 4})
    mcp = lambda: "by MCP server\n" + table(["server", "tools", "calls", "~tokens"], [[r["mcp_server"], ", ".join(r["tools"]), str(r["call_spans"]), f"~{fmt.number(r['tokens_est'])}"] for r in report["mcp"].collect()], {2, 3})
    sections = {"model": model, "tool": tool, "mcp": mcp}
    if by:
        return sections[by]()
    parts = []
    if "totals" in report:
        t = report["totals"].first()
        parts.append(f"total: {fmt.cost(t['cost'], t['priced'])}  ({fmt.number(t['context_total'])} tokens)")
    if "harness" in report:
        parts.append("by harness\n" + table(["harness", "sessions", "tokens", "cost"], [[r["harness"] or "all", str(r["sessions"]), fmt.number(r["context_total"]), fmt.cost(r["cost"], r["priced"])] for r in report["harness"].orderBy("harness").collect()], {1, 2, 3}))
    parts += [f() for f in sections.values()]
    if "cache" in report and (c := report["cache"].first()):
        parts.append(f"cache: {fmt.bar(c['hit_rate']).split()[-1]} hit rate, {fmt.number(c['wasted_tokens'])} tokens paid again on {c['misses']} documented misses")
    return "\n\n".join(parts)


def compactions(rows: DataFrame) -> str:
    exact, est = (lambda x: "unknown" if x is None else fmt.number(x)), (lambda x: "unknown" if x is None else f"~{fmt.number(x)}")
    lines = [[str(r["turn_number"]), fmt.moment(r["at"]), exact(r["tokens_before"]), exact(r["tokens_after"]), exact(r["shrink"]), est(r["discarded_est"]), est(r["summary_tokens_est"]), fmt.cost(r["cost"])] for r in rows.collect()]
    return table(["turn", "when", "before", "after", "shrink", "~discarded", "~summary", "cost"], lines, {0, 2, 3, 4, 5, 6, 7}) if lines else "no compactions"


def context(report: dict[str, DataFrame]) -> str:
    """R1, R2."""
    harness = {r["session_key"]: r["harness"] for r in report["sessions"].collect()}
    marks = {}
    for c in report["compactions"].collect():
        size = "unknown" if c["shrink"] is None else f"shrunk {fmt.number(c['shrink'])} tokens (exact)"
        marks.setdefault((c["session_key"], c["turn_index"]), []).append(f"── compaction: {size} ──")
    out = []
    for t in report["turns"].collect():
        out += marks.pop((t["session_key"], t["turn_index"]), [])
        total = t["context_total"]
        rows = [[c, f"~{fmt.number(t[c])}", fmt.bar(t[c] / total)] for c in CATEGORIES if t[c]]
        note = RESIDUAL.get(harness.get(t["session_key"]), "system prompt, tool schemas and framing, which aren't logged")
        rows.append(["residual", fmt.number(t["residual"]), f"{fmt.bar(t['residual_share'])}  {note}"])
        more = " (some content was cut short)" if t["truncated"] else ""
        out.append(f"Turn {t['turn_number']}  {t['role']}  {t['model']}  context {fmt.number(total)}{more}\n" + table(["  category", "tokens", "share"], [[f"  {r[0]}", *r[1:]] for r in rows], {1}))
    return "\n\n".join(out + [m for v in marks.values() for m in v])


def diff(report: dict[str, DataFrame], base: str) -> str:
    """Each other session against the base."""
    meta = {r["session_key"]: r for r in report["meta"].collect()}
    money = {r["session_key"]: r for r in report["cost"].collect()}
    squeezed = {r["session_key"]: r for r in report["compactions"].collect()}
    parts = []
    for c in report["config"].collect():
        a, b = c["a"], c["b"]
        fields = [[f, str(meta[a][f]), str(meta[b][f])] for f in ("harness", "harness_version", "model", "turns")] + [["duration", fmt.duration(meta[a]["duration_ms"]), fmt.duration(meta[b]["duration_ms"])]]
        parts.append(table(["field", "a", "b"], fields))
        rows = [[r["class"].replace("_", " "), fmt.number(r["a_value"]), fmt.number(r["b_value"]), fmt.signed(r["delta"]), fmt.percent(r["pct"])] for r in report["totals"].collect() if r["b"] == b]
        parts.append("totals\n" + table(["class", "a", "b", "Δ", "%"], rows, {1, 2, 3, 4}))
        x, y = money[a], money[b]
        both = x["priced"] and y["priced"]
        parts.append(f"cost\n  {fmt.cost(x['cost'], x['priced'])} → {fmt.cost(y['cost'], y['priced'])}   Δ {fmt.signed(y['cost'] - x['cost'], fmt.cost) if both else fmt.DASH}")
        rows = [[fmt.words(r["category"]), fmt.number(r["a_value"]), fmt.number(r["b_value"]), fmt.signed(r["delta"])] for r in report["composition"].collect() if r["b"] == b]
        parts.append("composition (last turn with usage)\n" + table(["category", "a", "b", "Δ"], rows, {1, 2, 3}))
        line = lambda s, k: f"  {s}: {squeezed[k]['compactions']} compactions, shrink {fmt.number(squeezed[k]['shrink_total'])}, discarded ~{fmt.number(squeezed[k]['discarded_total'])}"
        parts.append("compactions\n" + line("a", a) + "\n" + line("b", b))
        changed = lambda held: "changed" if held else "unchanged"
        parts.append(f"config\n  model: {changed(c['model_changed'])}\n  harness version: {changed(c['version_changed'])}\n  system prompt: {c['system_prompt']}\n  project instructions: {c['project_instructions']}")
        if c["warnings"]:
            parts.append("hard to compare: " + c["warnings"].replace(",", ", "))
    return "\n\n".join(parts)


def trials(report: dict[str, DataFrame]) -> str:
    """R13, R14."""
    rows = []
    for pairs, deltas in (("pairs", "deltas"), ("overall_pair", "overall")):
        change = {r["task_name"]: r for r in report[deltas].collect()}
        for r in report[pairs].collect():
            if r["missing"] is None:
                d, a, b = change[r["task_name"]], r["a"], r["b"]
                rate = lambda s: f"{s['successes']}/{s['trials']} ({round(s['success_rate'] * 100)}%)"
                delta = lambda c, shown: fmt.DASH if d[f"{c}_delta"] is None else f"{fmt.signed(d[f'{c}_delta'], shown)}" + ("" if d[f"{c}_pct"] is None else f" ({fmt.percent(d[f'{c}_pct'] / 100)})")
                rows.append([r["task_name"], rate(a), rate(b), f"{'+' if d['success_pp'] > 0 else ''}{d['success_pp']:.1f}pp", fmt.tenths(a["median_wall_ms"]), fmt.tenths(b["median_wall_ms"]), delta("median_wall_ms", fmt.tenths), delta("median_tokens", fmt.number), delta("median_cost", fmt.cost)])
    missing = [f"{r['task_name']}: nothing of {r['missing']}" for r in report["missing"].collect()]
    out = table(["task", "success a", "success b", "Δ", "wall a", "wall b", "Δ", "tokens Δ", "cost Δ"], rows, {3, 4, 5, 6, 7, 8})
    return out + ("\n\n" + "\n".join(missing) if missing else "")
