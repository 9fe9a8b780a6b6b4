"""Command line: list, cost, compactions, context, diff, report, trials, prices (survey 2.16)."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

HARNESSES = ("claude-code", "codex", "pi")


def default_roots() -> dict[str, list[str]]:
    """Where each harness keeps its sessions unless a root is given."""
    agent = os.environ.get("PI_AGENT_DIR") or Path.home() / ".pi" / "agent"
    return {"claude-code": [str(Path.home() / ".claude" / "projects")], "codex": [str(Path.home() / ".codex" / "sessions")], "pi": [str(Path(agent) / "sessions")]}


def since(value: str) -> str:
    """A date or a time of ISO 8601, UTC unless it says otherwise; ValueError for anything else."""
    try:
        at = datetime.fromisoformat(value.strip())
    except ValueError as e:
        raise ValueError(f"--since must be a date or a time like 2026-03-01T10:00Z, not {value!r}") from e
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).isoformat()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turnstone")
    p.add_argument("--claude-root", action="append", default=[])
    p.add_argument("--codex-root", action="append", default=[])
    p.add_argument("--pi-root", action="append", default=[])
    p.add_argument("--prices", help="JSON of rates a token by model")
    p.add_argument("--price-cache", help="kept second table of prices")
    p.add_argument("--store", help="folder of the kept session totals")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *flags, session=None):
        c = sub.add_parser(name)
        if session:
            c.add_argument("session", nargs=session)
        if "scope" in flags:
            c.add_argument("--harness", choices=HARNESSES)
            c.add_argument("--cwd")
        if "since" in flags:
            c.add_argument("--since")
        if "json" in flags:
            c.add_argument("--json", action="store_true")
        return c

    c = command("list", "scope", "since", "json")
    c.add_argument("--subagents", action="store_true")
    c.add_argument("--no-cache", action="store_true")
    c.add_argument("--limit", type=int, default=50)
    c = command("cost", "scope", "since", "json", session="?")
    c.add_argument("--all", action="store_true")
    c.add_argument("--by", choices=("tool", "mcp", "model"))
    command("compactions", "scope", "json", session="?")
    command("context", "scope", "json", session="?").add_argument("--turn", type=int)
    c = command("diff", "scope", "json", session="*")
    c.add_argument("--last", type=int)
    c.add_argument("--all-projects", action="store_true")
    c = command("report", "scope", "since", session="*")
    c.add_argument("--all", action="store_true")
    c.add_argument("--diff", action="store_true")
    c.add_argument("-o", "--output", default="report.html")
    c.add_argument("--json-embed", action="store_true")
    c = command("trials", "json")
    c.add_argument("results")
    c.add_argument("--config-a")
    c.add_argument("--config-b")
    c.add_argument("-o", "--output")
    c = sub.add_parser("prices")
    c.add_argument("payload", help="a fetched table of prices, to be kept")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done, also for an empty list; 1: an error or a session that can't be found; 2: too few sessions for --last."""
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 1
    try:
        if getattr(args, "since", None):
            args.since = since(args.since)
        return _run(args, spark)
    except (LookupError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def _run(args, spark) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from turnstone.plans.engine import Engine
    from turnstone.render import html, text
    from turnstone.sources import prices, trials

    if args.command == "prices":
        if not args.price_cache:
            raise ValueError("--price-cache names where to keep it")
        print(f"{prices.save_cached(args.price_cache, json.loads(Path(args.payload).read_text()))} models")
        return 0
    spark = spark or SparkSession.builder.appName("turnstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "trials":
        rows, warnings = trials.read_results(spark, args.results)
        names = [r["config_name"] for r in rows.groupBy("config_name").agg(F.min("row_no").alias("n")).orderBy("n").collect()]
        a, b = args.config_a or (names[0] if names else None), args.config_b or (names[1] if len(names) > 1 else None)
        if not a or not b:
            raise ValueError("two configurations are needed")
        for w in warnings.collect():
            print(f"line {w['line']}: {w['message']}", file=sys.stderr)
        found = Engine.trials(rows, a, b)
        print(text.as_json(found) if args.json else text.trials(found))
        if args.output:
            Path(args.output).write_text(html.trials_page(found))
        return 0
    usual = default_roots()
    roots = {h: given or usual[h] for h, given in zip(HARNESSES, (args.claude_root, args.codex_root, args.pi_root))}
    checked = ", ".join(r for h in HARNESSES if getattr(args, "harness", None) in (None, h) for r in roots[h])
    snapshot = json.loads(Path(args.prices).read_text()) if args.prices else {}
    store = None if getattr(args, "no_cache", False) else args.store
    engine = Engine(spark, roots, prices.prices(spark, snapshot, cache=args.price_cache), store)

    def chosen(name):
        found = engine.resolve(name, args.harness) if name else engine.newest(args.harness, args.cwd)
        if found.isEmpty():
            raise LookupError(f"no sessions; checked {checked}")
        return found

    show = lambda x, printed: print(text.as_json(x) if args.json else printed())
    if args.command == "list":
        rows = engine.list(args.harness, args.cwd, args.since, args.subagents)
        show(rows, lambda: text.listing(rows, args.limit) if not rows.isEmpty() else f"no sessions; checked {checked}")
    elif args.command == "cost":
        report = engine.cost_all(args.harness, args.cwd, args.since) if args.all else engine.cost(chosen(args.session))
        show(report, lambda: text.cost(report, args.by))
    elif args.command == "compactions":
        rows = engine.compactions(chosen(args.session))
        show(rows, lambda: text.compactions(rows))
    elif args.command == "context":
        if args.turn:
            rows = engine.turn_detail(chosen(args.session), args.turn)
            show(rows, lambda: text.table(["category", "tool", "~tokens"], [[r["category"], r["tool_name"] or "", str(r["tokens_est"])] for r in rows.collect()], {2}))
        else:
            report = engine.context(chosen(args.session))
            show({k: report[k] for k in ("turns", "categories", "compactions", "warnings")}, lambda: text.context(report))
    elif args.command == "diff" or (args.command == "report" and args.diff):
        if getattr(args, "last", None):
            refs = engine.last(args.last, args.cwd, args.harness, args.all_projects)
            keys = [r["path"] for r in refs.orderBy(F.col("mtime"), "path").collect()]
            if not keys:
                print("too few sessions in scope", file=sys.stderr)
                return 2
        else:
            if len(args.session) < 2:
                raise ValueError("two sessions are needed")
            found = [engine.resolve(s, args.harness) for s in args.session]
            keys = [f.first()["path"] for f in found]
            refs = reduce(lambda a, b: a.unionByName(b), found).dropDuplicates(["path"])
        # parsers key sessions by the path as Spark reports it
        report = engine.diff(refs, keys[0], keys[1:])
        if args.command == "report":
            Path(args.output).write_text(html.diff_page(report))
            print(args.output)
        else:
            show(report, lambda: text.diff(report, keys[0]))
    elif args.command == "report":
        if args.all:
            out = html.dashboard_page(engine.dashboard(args.since, args.harness, args.cwd))
        else:
            refs = chosen(args.session[0] if args.session else None)
            out = html.session_page(engine.context(refs), engine.cost(refs), args.json_embed)
        Path(args.output).write_text(out)
        print(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
