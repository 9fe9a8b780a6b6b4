"""The commands as plans: list, cost, compactions, context, diff, report, dashboard, trials. Each gives DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import attribution, compaction, compare, composition, dashboard, dedup, diff, pricing
from turnstone.plans import tables
from turnstone.sources import claude, codex, discover, lines, pi
from turnstone.sources.model import Parsed
from turnstone.store.totals import TotalsStore, build, hits, misses


class Engine:
    """Sessions below roots by harness, priced by a table of prices (see sources.prices)."""

    def __init__(self, spark: SparkSession, roots: dict[str, list[str]], prices: DataFrame, store: str | None = None):
        self.spark, self.roots, self.prices = spark, roots, prices
        self.store = TotalsStore(spark, store) if store else None
        self._refs: DataFrame | None = None

    @property
    def refs(self) -> DataFrame:
        if self._refs is None:
            self._refs = tables.cut(discover.everything(self.spark, self.roots))
        return self._refs

    def parse(self, refs: DataFrame) -> Parsed:
        of = lambda h: refs.filter(F.col("harness") == h)
        there = {r["harness"] for r in refs.select("harness").distinct().collect()}
        out = None
        for name, read in (("claude-code", lambda r: claude.parse(r, discover.offloaded(self.spark, self.roots.get("claude-code", [])))), ("codex", codex.parse), ("pi", pi.parse)):
            if name in there:
                one = read(of(name))
                out = one if out is None else out.union(one)
        if out is None:
            raise LookupError("no sessions")
        return out

    def resolve(self, wanted: str, harness: str | None = None) -> DataFrame:
        """An existing file, inside the roots or not, whose first line says whose it is; else by the end of a
        path, by id, or by an unambiguous beginning of one (6 characters or more)."""
        file = discover.one_file(self.spark, wanted) if "/" in wanted or wanted.endswith(".jsonl") else None
        if file is not None:
            of = lines.sniff(lines.read_lines(file)).first()
            if of is None or of["harness"] is None:
                raise LookupError(f"{wanted}: no session of a known layout")
            if harness and of["harness"] != harness:
                raise LookupError(f"{wanted}: a session of {of['harness']}, not of {harness}")
            return file.withColumn("harness", F.lit(of["harness"]))
        refs = discover.filtered(self.refs, harness, subagents=True)
        found = refs.filter(F.col("path").endswith(wanted)) if "/" in wanted else diff.resolve_id(refs, wanted)
        n = found.count()
        if n != 1:
            raise LookupError(f"{wanted}: {'no session' if not n else f'{n} sessions'} of that name")
        return found

    def newest(self, harness: str | None = None, cwd: str | None = None) -> DataFrame:
        """O3."""
        return discover.filtered(self.refs, harness, cwd).orderBy(F.col("mtime").desc(), "path").limit(1)

    # stages

    def deduped(self, p: Parsed) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(turns, spans, compactions) after D5."""
        mapped = tables.cut(dedup.index_map(p.turns))
        return dedup.dedup_turns(p.turns), dedup.dedup_spans(p.spans, mapped), dedup.remap_events(p.compactions, mapped)

    def priced(self, turns: DataFrame, mode: str = "auto") -> DataFrame:
        return pricing.price_turns(turns, self.prices, mode)

    # commands

    def list(self, harness: str | None = None, cwd: str | None = None, since: str | None = None, subagents: bool = False) -> DataFrame:
        """A line a session, newest file first; files that didn't change come from the store. Spans are never read."""
        refs = discover.filtered(self.refs, harness, cwd, since, subagents)
        kept = self.store.load() if self.store else None
        todo = misses(refs, kept) if kept is not None else refs
        out = hits(refs, kept) if kept is not None else None
        if not todo.isEmpty():
            p = self.parse(todo)
            turns = tables.cut(self.priced(dedup.dedup_turns(p.turns)))
            rows = tables.cut(build(p.sessions, attribution.session_totals(turns, p.sessions), turns, p.compactions, todo))
            # only what the store gives is validated: fresh rows are listed whatever they hold
            if self.store:
                out = tables.cut(out).select(rows.columns).unionByName(rows)
                self.store.upsert(rows)
            else:
                out = rows
        if out is None:
            from turnstone.store.totals import SCHEMA

            out = self.spark.createDataFrame([], SCHEMA)
        ids = refs.select("path", "session_id")
        rank = F.array_position(F.array(F.lit("claude-code"), F.lit("codex"), F.lit("pi")), F.col("harness"))
        return out.join(ids, "path").orderBy(F.col("mtime").desc(), rank, "path")

    def cost(self, refs: DataFrame) -> dict[str, DataFrame]:
        """Totals, and by model, tool, server, and the cache's use."""
        p = self.parse(refs)
        turns, spans, _ = self.deduped(p)
        turns, spans = tables.cut(self.priced(turns)), tables.cut(spans)
        return {
            "totals": attribution.session_totals(turns, p.sessions), "model": attribution.by_model(turns).orderBy("model"), "tool": attribution.by_tool(spans).orderBy(F.col("total_chars").desc(), "tool_name"),
            "mcp": attribution.by_server(spans).orderBy(F.col("total_chars").desc(), "mcp_server"), "cache": attribution.cache_use(turns),
            "misses": turns.filter("cache_miss_type is not null").select("turn_index", "cache_miss_type", "cache_missed_tokens").orderBy("turn_index"),
        }

    def cost_all(self, harness: str | None = None, cwd: str | None = None, since: str | None = None) -> dict[str, DataFrame]:
        """Over families, replays counted once."""
        main = discover.filtered(self.refs, harness, cwd, since)
        members = discover.families(discover.filtered(self.refs, harness, subagents=True))
        keys = discover.families(main).select("family_id")
        refs = members.join(keys, "family_id", "left_semi")
        p = self.parse(refs.drop("family_id", "member_ordinal"))
        turns, spans, _ = self.deduped(p)
        place = refs.select(F.col("path").alias("session_key"), "family_id", "member_ordinal", "harness")
        turns = tables.cut(self.priced(turns).join(place, "session_key"))
        zeroed = tables.cut(dedup.zero_family_replays(turns))
        kept = tables.cut(dedup.drop_family_replays(turns))
        spans = tables.cut(spans.join(kept.select("session_key", "turn_index"), ["session_key", "turn_index"], "left_semi"))
        families = zeroed.groupBy("family_id", "harness").agg(*attribution.sums())
        return {
            "harness": attribution.by_harness(families), "families": attribution.subagent_rollup(zeroed), "members": attribution.by_member(zeroed),
            "model": attribution.by_model(kept).orderBy("model"), "tool": attribution.by_tool(spans).orderBy(F.col("total_chars").desc(), "tool_name"), "mcp": attribution.by_server(spans).orderBy(F.col("total_chars").desc(), "mcp_server"),
        }

    def compactions(self, refs: DataFrame) -> DataFrame:
        """Finished events by turn number."""
        p = self.parse(refs)
        turns, _, events = self.deduped(p)
        done = compaction.finalize(events, turns)
        return done.withColumn("turn_number", F.col("turn_index") + 1).orderBy("session_key", "turn_number", "ord")

    def context(self, refs: DataFrame) -> dict[str, DataFrame]:
        """The composition by turn, its categories, the compactions in between, and the spans."""
        p = self.parse(refs)
        turns, spans, events = self.deduped(p)
        turns, spans, events = tables.cut(turns), tables.cut(spans), tables.cut(events)
        composed = tables.cut(composition.compose(turns, spans, events, p.sessions))
        return {"turns": composed.withColumn("turn_number", F.col("turn_index") + 1).orderBy("session_key", "turn_index"), "categories": composition.category_rows(composed), "compactions": compaction.finalize(events, turns), "spans": spans, "sessions": p.sessions, "warnings": p.warnings}

    def turn_detail(self, refs: DataFrame, number: int) -> DataFrame:
        """The spans of one turn, with what they are estimated at."""
        return self.context(refs)["spans"].filter(F.col("turn_index") == number - 1).withColumn("tokens_est", F.ceil(F.col("char_count") / 4)).orderBy("ord")

    def diff(self, refs: DataFrame, base: str, others: list[str]) -> dict[str, DataFrame]:
        """The base session against each other one, by session_key."""
        p = self.parse(refs)
        turns, spans, events = self.deduped(p)
        turns, spans, events = tables.cut(self.priced(turns)), tables.cut(spans), tables.cut(events)
        pairs = diff.against_base(base, others, self.spark)
        totals = tables.cut(attribution.session_totals(turns, p.sessions))
        count = turns.groupBy("session_key").agg(F.count(F.lit(1)).alias("turns"))
        duration = (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms")
        meta = p.sessions.join(count, "session_key", "left").fillna(0, ["turns"]).select("session_key", "harness", "harness_version", "model", "cwd", "git_branch", "system_prompt", "project_instructions", "turns", F.coalesce(duration, F.lit(0)).alias("duration_ms"))
        meta = tables.cut(meta)
        return {
            "meta": meta, "totals": diff.token_changes(totals, pairs), "cost": totals.select("session_key", "cost", "priced"), "composition": diff.composition_changes(composition.compose(turns, spans, events, p.sessions), pairs),
            "compactions": diff.compaction_totals(compaction.finalize(events, turns), p.sessions), "config": diff.config_changes(meta, pairs), "models": diff.models_in_order(turns),
        }

    def last(self, take: int = 2, scope: str | None = None, harness: str | None = None, all_projects: bool = False) -> DataFrame:
        """O4."""
        return diff.last_comparable(self.refs, min(5, max(2, take)), scope, harness, all_projects)

    def dashboard(self, since: str | None = None, harness: str | None = None, cwd: str | None = None) -> dict[str, DataFrame]:
        """A13-A19, R12."""
        rows = tables.cut(self.list(harness, cwd, since).withColumn("cache_write", F.col("cache_write_5m") + F.col("cache_write_1h")))
        window = tables.cut(dashboard.window(rows, since))
        return {
            "headline": dashboard.headline(rows), "cost": dashboard.daily_cost(window).orderBy("day", "series"), "tokens": dashboard.daily_tokens(window).orderBy("day"), "hit_rate": dashboard.daily_hit_rate(window).orderBy("day"),
            "compactions": dashboard.daily_compactions(window).orderBy("day"), "projects": dashboard.per_project(rows), "harnesses": dashboard.per_harness(rows).orderBy(F.col("cost").desc(), "harness"),
        }

    @staticmethod
    def trials(rows: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
        """All cells, the pair's differences by task, what is missing, and both over all tasks."""
        found = tables.cut(compare.cells_and_overall(rows))
        pairs = compare.paired(found.filter("task_name is not null"), a, b)
        overall = compare.paired(found.filter("task_name is null").withColumn("task_name", F.lit("ALL TASKS")), a, b)
        return {"cells": found.filter("task_name is not null").orderBy("first_row"), "pairs": pairs, "deltas": compare.deltas(pairs), "missing": pairs.filter("missing is not null").select("task_name", "missing"), "overall": compare.deltas(overall), "overall_pair": overall}
