"""Parent pointers and lanes: J8, J9, U4."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a session's pointers that one task walks; pointers of a larger session are doubled instead.
WALKED = 16 << 20

# the walk runs on executors, which needn't have this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _steps(parents: dict, leaves: list) -> dict:
    """id to its distance from the nearest leaf, for all that is reached."""
    up: dict = {}
    for at in leaves:
        n = 0
        while at in parents and up.get(at, n + 1) > n:
            up[at] = n
            at, n = parents[at], n + 1
    return up


def _walk(batches: Iterator, schema, most: int) -> Iterator:
    """(session_key, id, up) of rows (session_key, id, parent_id, leaf) that come session by session; a session of over
    `most` bytes gives one line without id instead."""
    import pyarrow as pa

    out, session, parents, leaves, held = ([], [], []), None, {}, [], 0.0

    def close():
        up = {None: None} if held > most else _steps(parents, leaves)
        for column, values in zip(out, ([session] * len(up), up.keys(), up.values())):
            column.extend(values)

    for batch in batches:
        share = batch.nbytes / max(batch.num_rows, 1)
        for s, i, parent, leaf in zip(*[c.to_pylist() for c in batch.columns]):
            if s != session:
                close()
                session, parents, leaves, held = s, {}, [], 0.0
            held += share
            if held > most:
                parents, leaves = {}, []
            elif leaf:
                leaves.append(i)
            else:
                parents[i] = parent
        if len(out[0]) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
            out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)


def paths_to_root(entries: DataFrame, leaves: DataFrame, cut) -> DataFrame:
    """(session_key, id, up): what is reached from each session's leaf by parent pointers, and in how many steps.

    entries: (session_key, id, parent_id); leaves: (session_key, id). A missing parent ends the path, a cycle ends it at
    the first entry seen again. Sessions are walked one by one after one exchange of their pointers; those of over WALKED
    bytes by doubling. `cut` writes a table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    of = entries.schema["id"].dataType
    pointers = entries.select("session_key", "id", F.col("parent_id").cast(of).alias("parent_id"), F.lit(False).alias("leaf"))
    ends = leaves.select("session_key", "id", F.lit(None).cast(of).alias("parent_id"), F.lit(True).alias("leaf"))
    keyed = pointers.unionByName(ends).filter(F.col("session_key").isNotNull() & F.col("id").isNotNull())
    kind = keyed.select("session_key", "id", F.lit(None).cast("long").alias("up")).schema
    arrow, most = to_arrow_schema(kind), WALKED
    walked = cut(keyed.repartition("session_key").sortWithinPartitions("session_key").mapInArrow(lambda it: _walk(it, arrow, most), kind))
    large = walked.filter("id is null").select("session_key")
    found = walked.filter("id is not null")
    if large.isEmpty():
        return found
    return found.unionByName(_doubled(entries.join(large, "session_key", "left_semi"), leaves.join(large, "session_key", "left_semi"), cut))


def _doubled(entries: DataFrame, leaves: DataFrame, cut) -> DataFrame:
    """The same for sessions of any size: after k rounds all within 2^k steps is known, so a path of a million entries
    takes 20 rounds of joins, not a million levels of recursion."""
    jump = cut(entries.select("session_key", F.col("id").alias("from"), F.col("parent_id").alias("to")).join(entries.select("session_key", F.col("id").alias("to")), ["session_key", "to"]).select("session_key", "from", "to"))
    known = cut(leaves.join(entries.select("session_key", "id"), ["session_key", "id"]).select("session_key", "id", F.lit(0).cast("long").alias("up")))
    step, count = 1, known.count()
    while True:
        further = known.withColumnRenamed("id", "from").join(jump, ["session_key", "from"]).select("session_key", F.col("to").alias("id"), (F.col("up") + step).alias("up"))
        known = cut(known.unionByName(further).groupBy("session_key", "id").agg(F.min("up").alias("up")))
        now = known.count()
        if now == count:
            return known
        count, step = now, step * 2
        other = jump.select("session_key", F.col("from").alias("to"), F.col("to").alias("next"))
        jump = cut(jump.join(other, ["session_key", "to"]).select("session_key", "from", F.col("next").alias("to")))


def off_path(entries: DataFrame, path: DataFrame) -> DataFrame:
    """Entries that the path doesn't visit, counted by session."""
    return entries.join(path, ["session_key", "id"], "left_anti").groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))


def active_lane(moves: DataFrame) -> DataFrame:
    """(session_key, id, others): where the lane that moved last stands, and how many other lanes there are.

    moves: (session_key, lane_id, entry_id, seq, line). Of one seq the first counts: within a lane the first move, over
    lanes the lane that was seen first.
    """
    latest = moves.groupBy("session_key", "lane_id").agg(F.max_by(F.struct("entry_id", "seq"), F.struct("seq", -F.col("line"))).alias("x"), F.min("line").alias("seen"))
    return latest.groupBy("session_key").agg(F.max_by("x.entry_id", F.struct(F.col("x.seq"), -F.col("seen"))).alias("id"), (F.count(F.lit(1)) - 1).alias("others"))
