"""Session totals that are kept: S15, S16, K3, K4, J17, U6.

A row a file: path, mtime, size_bytes, harness, turns, compactions, started_at, ended_at, cwd, model, cost, priced and the
token sums. A file whose time or size changed is a miss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.operators.attribution import TOKENS
from turnstone.sources.discover import exists

HARNESSES = ("claude-code", "codex", "pi")
SCHEMA = "path string, mtime timestamp, size_bytes long, harness string, turns long, compactions long, started_at timestamp, ended_at timestamp, cwd string, model string, cost double, priced boolean, " + ", ".join(f"{c} long" for c in TOKENS)
_COLUMNS = [p.split()[0] for p in SCHEMA.split(", ")]


def valid(rows: DataFrame) -> DataFrame:
    """All fields there, numbers finite and not negative, a known harness."""
    ok = F.col("harness").isin(*HARNESSES)
    for c in ("path", "mtime", "size_bytes", "started_at", "ended_at", "cwd", "model", "priced"):
        ok = ok & F.col(c).isNotNull()
    for c in ("turns", "compactions", "cost", *TOKENS):
        x = F.col(c).cast("double")
        ok = ok & F.coalesce((x >= 0) & (x < float("inf")), F.lit(False))
    return rows.filter(ok)


def last_writes(log: DataFrame, order: str = "line") -> DataFrame:
    """Of rows of one path the last written."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.col(order).desc()))
    return log.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def build(sessions: DataFrame, totals: DataFrame, turns: DataFrame, compactions: DataFrame, refs: DataFrame) -> DataFrame:
    """K4: rows of freshly parsed sessions."""
    count = lambda df, name: df.groupBy("session_key").agg(F.count(F.lit(1)).alias(name))
    joined = sessions.select("session_key", "harness", "started_at", "ended_at", "cwd", "model").join(totals, "session_key", "left").join(count(turns, "turns"), "session_key", "left").join(count(compactions, "compactions"), "session_key", "left")
    rows = joined.join(refs.select(F.col("path").alias("session_key"), "mtime", "size_bytes"), "session_key").withColumnRenamed("session_key", "path")
    zero = dict.fromkeys(("turns", "compactions", *TOKENS), 0) | {"cost": 0.0}
    epoch = F.timestamp_seconds(F.lit(0))
    return rows.fillna(zero).withColumn("priced", F.coalesce("priced", F.lit(True))).withColumn("started_at", F.coalesce("started_at", epoch)).withColumn("ended_at", F.coalesce("ended_at", epoch)).select(_COLUMNS)


def hits(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept rows whose path, time and size are all as they were."""
    return kept.join(refs.select("path", "mtime", "size_bytes"), ["path", "mtime", "size_bytes"], "left_semi")


def misses(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """Refs that must be read."""
    return refs.join(kept.select("path", "mtime", "size_bytes"), ["path", "mtime", "size_bytes"], "left_anti")


class TotalsStore:
    """Versions of the table below a folder; the newest whole one counts, and an upsert writes the next."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not exists(self.spark, self.folder):
            return []
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def load(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        return valid(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{versions[-1]}"))

    def upsert(self, rows: DataFrame) -> DataFrame:
        """K3: rows in place of those of their paths; written aside, then renamed, so readers see whole versions only."""
        versions = self._versions()
        now = (versions[-1] if versions else 0) + 1
        kept = self.load().join(rows.select("path"), "path", "left_anti").select(_COLUMNS).unionByName(rows.select(_COLUMNS))
        aside = f"{self.folder}/.new-{uuid.uuid4().hex}"
        kept.write.parquet(aside)
        path, fs = self._fs()
        if not fs.rename(path(aside), path(f"{self.folder}/v{now}")):
            raise FileExistsError(f"version {now} was written meanwhile")
        for old in versions[:-1]:
            fs.delete(path(f"{self.folder}/v{old}"), True)
        return self.load()
