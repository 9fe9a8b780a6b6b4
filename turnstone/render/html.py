"""Pages K5-K9: session, difference, trends and trials, each one file without scripts. No text of a conversation goes in."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from turnstone.operators.composition import CATEGORIES
from turnstone.render import fmt
from turnstone.render.text import as_json

COLOURS = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5", "#9c6b4e", "#9498a0")
STYLE = "body{font:14px system-ui;margin:2rem auto;max-width:1100px;color:#222}table{border-collapse:collapse;margin:1rem 0}td,th{padding:.2rem .7rem;text-align:left;border-bottom:1px solid #ddd}td.n,th.n{text-align:right}svg{width:100%;height:auto}.stat{display:inline-block;margin-right:2rem}.stat b{display:block;font-size:1.4rem}"


def escaped(x) -> str:
    return html.escape(str(x), quote=True)


def embedded(x) -> str:
    """K9: JSON in a script element of data; nothing in it can end the element."""
    return '<script type="application/json" id="data">' + json.dumps(json.loads(as_json(x))).replace("<", "\\u003c") + "</script>"


def page(title: str, *sections: str) -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escaped(title)}</title><style>{STYLE}</style></head><body><h1>{escaped(title)}</h1>{"".join(sections)}</body></html>'


def section(title: str, body: str) -> str:
    return f"<section><h2>{escaped(title)}</h2>{body}</section>"


def grid(head: list[str], rows: list[list], right: set[int] = frozenset()) -> str:
    cell = lambda tag, k, x: f"<{tag}{' class=n' if k in right else ''}>{escaped(x)}</{tag}>"
    return "<table><tr>" + "".join(cell("th", k, h) for k, h in enumerate(head)) + "</tr>" + "".join("<tr>" + "".join(cell("td", k, c) for k, c in enumerate(r)) + "</tr>" for r in rows) + "</table>"


def stats(pairs: list[tuple[str, str]]) -> str:
    return "<p>" + "".join(f'<span class="stat"><b>{escaped(v)}</b>{escaped(k)}</span>' for k, v in pairs) + "</p>"


def _ticks(names: list[str], most: int = 8) -> set[int]:
    """At most `most` labels, the last always among them."""
    step = max(1, -(-len(names) // most))
    return {*range(0, len(names), step), len(names) - 1}


def stacked(days: list[str], series: dict[str, list[float]], shown) -> str:
    """Stacked bars; the axis ends 8 % over the highest."""
    w, h, left = 960, 240, 60
    top = max((sum(s[k] for s in series.values()) for k in range(len(days))), default=0) * 1.08 or 1
    step = (w - left) / max(len(days), 1)
    parts, ticks = [], _ticks(days) if days else set()
    for k, d in enumerate(days):
        y = h
        for c, (name, values) in zip(COLOURS, series.items()):
            size = values[k] / top * h
            y -= size
            if size:
                parts.append(f'<rect x="{left + k * step + 1:.1f}" y="{y:.1f}" width="{max(step - 2, 1):.1f}" height="{size:.1f}" fill="{c}"><title>{escaped(d)} {escaped(name)} {escaped(shown(values[k]))}</title></rect>')
        if k in ticks:
            parts.append(f'<text x="{left + k * step:.1f}" y="{h + 16}" font-size="11">{escaped(d[5:])}</text>')
    legend = "".join(f'<tspan dx="12" fill="{c}">■</tspan> {escaped(n)}' for c, n in zip(COLOURS, series))
    return f'<svg viewBox="0 0 {w} {h + 44}"><text x="0" y="10" font-size="11">{escaped(shown(top))}</text>{"".join(parts)}<text x="{left}" y="{h + 38}" font-size="12">{legend}</text></svg>'


def line(days: list[str], values: list[float | None], shown) -> str:
    """A line that breaks where a value is unknown."""
    w, h, left = 960, 160, 60
    top = max((v for v in values if v is not None), default=0) * 1.08 or 1
    step, parts, run = (w - left) / max(len(days) - 1, 1), [], []
    for k, v in enumerate([*values, None]):
        if v is None:
            if run:
                parts.append(f'<polyline fill="none" stroke="{COLOURS[0]}" stroke-width="2" points="{" ".join(run)}"/>')
            run = []
        else:
            run.append(f"{left + k * step:.1f},{h - v / top * h:.1f}")
    return f'<svg viewBox="0 0 {w} {h + 10}"><text x="0" y="10" font-size="11">{escaped(shown(top))}</text>{"".join(parts)}</svg>'


def session_page(context: dict[str, DataFrame], cost: dict[str, DataFrame], embed: bool = False) -> str:
    """One session: turns with usage as bars, compactions, and who used what."""
    s = context["sessions"].first()
    total = cost["totals"].first()
    turns = [t for t in context["turns"].collect() if t["context_total"] > 0]
    names = [f"00000{t['turn_number']}" for t in turns]
    series = {c: [float(t[c]) for t in turns] for c in CATEGORIES if any(t[c] for t in turns)} | {"residual": [float(max(0, t["residual"])) for t in turns]}
    squeezed = [[c["turn_index"] + 1, fmt.moment(c["at"]), fmt.number(c["tokens_before"]), fmt.number(c["tokens_after"]), fmt.number(c["shrink"]), _lineage(c["lineage"])] for c in context["compactions"].collect()]
    body = [
        stats([("harness", s["harness"]), ("version", s["harness_version"]), ("directory", fmt.path(s["cwd"])), ("started", fmt.moment(s["started_at"])), ("cost", fmt.cost(total["cost"], total["priced"])), ("tokens", fmt.number(total["context_total"]))]),
        section("Composition", stacked(names, series, fmt.compact)), section("Compactions", grid(["turn", "when", "before", "after", "shrink", "window"], squeezed, {0, 2, 3, 4})),
        section("Models", grid(["model", "turns", "tokens", "cost"], [[r["model"], r["turns"], fmt.number(r["context_total"]), fmt.cost(r["cost"], r["priced"])] for r in cost["model"].collect()], {1, 2, 3})),
        section("Tools", grid(["tool", "server", "calls", "results", "~tokens"], [[r["tool_name"], r["mcp_server"] or "", r["call_spans"], r["result_spans"], fmt.number(r["tokens_est"])] for r in cost["tool"].collect()], {2, 3, 4})),
        section("Servers", grid(["server", "tools", "~tokens"], [[r["mcp_server"], ", ".join(r["tools"]), fmt.number(r["tokens_est"])] for r in cost["mcp"].collect()], {2})),
    ]
    if embed:
        body.append(embedded({"turns": context["turns"], "compactions": context["compactions"], "models": cost["model"], "tools": cost["tool"]}))
    return page(f"Session {s['session_id']}", *body)


def _lineage(x) -> str:
    """C20."""
    return "" if x is None else " · ".join(str(p) for p in (f"window {x['window_number']}" if x["window_number"] is not None else None, x["window_id"] and fmt.short(x["window_id"])) if p)


def diff_page(report: dict[str, DataFrame]) -> str:
    """K6."""
    body = [section("Sessions", grid(["session", "harness", "version", "model", "turns", "duration"], [[fmt.path(r["session_key"]), r["harness"], r["harness_version"], r["model"], r["turns"], fmt.padded_duration(r["duration_ms"])] for r in report["meta"].collect()], {4, 5}))]
    body.append(section("Totals", grid(["class", "a", "b", "Δ", "%"], [[r["class"], fmt.number(r["a_value"]), fmt.number(r["b_value"]), fmt.signed(r["delta"]), fmt.percent(r["pct"])] for r in report["totals"].collect()], {1, 2, 3, 4})))
    body.append(section("Composition", grid(["category", "a", "b", "Δ"], [[fmt.words(r["category"]), fmt.number(r["a_value"]), fmt.number(r["b_value"]), fmt.signed(r["delta"])] for r in report["composition"].collect()], {1, 2, 3})))
    body.append(section("Configuration", grid(["model changed", "version changed", "system prompt", "project instructions", "hard to compare"], [[r["model_changed"], r["version_changed"], r["system_prompt"], r["project_instructions"], r["warnings"]] for r in report["config"].collect()])))
    return page("Difference", *body)


def dashboard_page(report: dict[str, DataFrame]) -> str:
    """K7."""
    h = report["headline"].first()
    cost, tokens = report["cost"].collect(), report["tokens"].collect()
    days = sorted({str(r["day"]) for r in cost})
    by = lambda rows, key, value: {s: [next((float(r[value]) for r in rows if str(r["day"]) == d and r[key] == s), 0.0) for d in days] for s in dict.fromkeys(r[key] for r in rows)}
    rate = {str(r["day"]): r["hit_rate"] for r in report["hit_rate"].collect()}
    squeezed = {str(r["day"]): float(r["compactions"]) for r in report["compactions"].collect()}
    return page(
        "Trends", stats([("cost", fmt.cost(h["cost"])), ("sessions without a price", str(h["unpriced_sessions"])), ("active days", str(h["active_days"])), ("output", fmt.compact(h["output"]))]),
        section("Cost by day and model", stacked(days, by(cost, "series", "cost"), fmt.cost)), section("Tokens by day", stacked(days, by(tokens, "class", "tokens"), fmt.compact)),
        section("Cache hit rate", line(days, [rate.get(d) for d in days], lambda x: f"{x * 100:.0f}%")), section("Compactions", stacked(days, {"compactions": [squeezed.get(d, 0.0) for d in days]}, fmt.number)),
        section("Projects", grid(["project", "sessions", "tokens", "cost", "last"], [[fmt.path(r["cwd"]), r["sessions"], fmt.number(r["tokens"]), fmt.cost(r["cost"]), fmt.moment(r["last_activity"])] for r in report["projects"].collect()], {1, 2, 3})),
        section("Harnesses", grid(["harness", "sessions", "tokens", "cost", "without a price"], [[r["harness"], r["sessions"], fmt.number(r["tokens"]), fmt.cost(r["cost"]), r["unpriced_sessions"]] for r in report["harnesses"].collect()], {1, 2, 3, 4})),
    )


def trials_page(report: dict[str, DataFrame]) -> str:
    """K8."""
    cells = [[r["task_name"], r["config_name"], f"{r['successes']}/{r['trials']}", fmt.tenths(r["median_wall_ms"]), fmt.number(r["median_tokens"]), fmt.cost(r["median_cost"])] for r in report["cells"].collect()]
    missing = [[r["task_name"], r["missing"]] for r in report["missing"].collect()]
    deltas = [[r["task_name"], f"{r['success_pp']:+.1f}pp", fmt.signed(r["median_wall_ms_delta"], fmt.tenths), fmt.signed(r["median_tokens_delta"]), fmt.signed(r["median_cost_delta"], fmt.cost)] for k in ("deltas", "overall") for r in report[k].collect()]
    head = section("Missing", grid(["task", "side"], missing)) if missing else ""
    return page("Trials", head, section("Differences", grid(["task", "success", "wall", "tokens", "cost"], deltas, {1, 2, 3, 4})), section("Cells", grid(["task", "config", "passed", "wall", "tokens", "cost"], cells, {2, 3, 4, 5})))
