"""Operator 4, sequence packing by shortest-pack-first over the histogram of lengths.

Lengths are placed longest first, each into the emptiest pack that has room, many equal packs at a time: what is kept is
how many packs have each pattern of lengths. Patterns then go back to the documents by their rank.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import cut, release, table, type_of

#: Byte-level tokens of a pack; a document is its UTF-8 bytes and one end token.
CAPACITY = 8192


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, packs)]: packs that hold exactly these lengths. Work and memory follow the number of distinct lengths.

    Lengths descend; the pieces of a length go to the pack with the most room, ties by pattern. Where none has room, new
    packs open, each filled with pieces of this length as far as they go, for it stays the emptiest meanwhile.
    """
    open_packs: dict[tuple[int, ...], int] = defaultdict(int)
    heap: list[tuple[int, tuple[int, ...]]] = []  # emptiest first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while heap and not open_packs.get(heap[0][1]):
                heapq.heappop(heap)
            if heap and heap[0][0] + length <= capacity:
                used, pattern = heapq.heappop(heap)
                packs = min(left, open_packs[pattern])
                rest = open_packs.pop(pattern) - packs
                if rest:
                    open_packs[pattern] = rest
                    heapq.heappush(heap, (used, pattern))
                longer, placed = pattern + (length,), packs
            else:
                most = min(left, capacity // length)
                packs, longer = left // most, (length,) * most
                placed = packs * most
            if longer not in open_packs:
                heapq.heappush(heap, (sum(longer), longer))
            open_packs[longer] += packs
            left -= placed
    return sorted((p, n) for p, n in open_packs.items() if n)


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length) in tokens: a document longer than a pack is full pieces and a rest."""
    tokens = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    rows = docs.select("doc_id", tokens.alias("tokens"))
    cutup = rows.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cutup.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("length"))


def _slots(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """What the patterns give to each length, as rows (first rank over all pieces, length, first pack, pieces a pack, offset)
    in order of rank: pieces are ranked by length, then within it."""
    base, at = {}, 0
    for length in sorted(histogram):
        base[length] = at
        at += histogram[length]
    slots, taken, packs = [], defaultdict(int), 0
    for pattern, count in patterns(histogram, capacity):
        offset = 0
        for length, run in groupby(pattern):
            times = len(list(run))
            slots.append((base[length] + taken[length], length, packs, times, offset))
            taken[length] += count * times
            offset += length * times
        packs += count
    return np.array(sorted(slots), np.int64).reshape(-1, 5), packs


def _placed(batches, firsts: np.ndarray, slots: np.ndarray):
    """(doc_id, piece, start, length, at) to (doc_id, piece, start, length, pack_id, offset). at is the number of a partition
    and the place in it, firsts the rank of each partition's first piece."""
    for batch in batches:
        at = batch.column("at").to_numpy(zero_copy_only=False)
        rank = firsts[at >> 33] + (at & ((1 << 33) - 1))
        first, length, pack_, times, offset = slots[np.searchsorted(slots[:, 0], rank, "right") - 1].T
        nth = rank - first
        yield pa.record_batch([*batch.columns[:4], pa.array(pack_ + nth // times), pa.array((offset + nth % times * length).astype(np.int32))], names=["doc_id", "piece", "start", "length", "pack_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, pack_id, offset): where each piece of each row of docs lies; a pack's pieces fill it
    from offset 0 without gaps, up to `capacity` tokens.

    A text is its bytes and an end token, so an empty or null text is one token. Null doc_ids rank last and repeated rows
    are packed each. Ties of length are ranked by doc_id, which may be of any type that has an order, and start. No rows
    give no rows; columns other than doc_id and text are ignored.

    Ranks come from one range sort of the pieces, without texts, cut anywhere, also within a length: what comes to the
    driver is how many pieces of each length each range has, one line a range and one a length.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, capacity).withColumn("tie", F.monotonically_increasing_id()))
    order = [F.col("length"), F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("doc_id", "piece", "start", "length", F.monotonically_increasing_id().alias("at")))
    release(rows)
    counted = ranged.groupBy(F.shiftright("at", 33).alias("part"), "length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram, parts = Counter(), Counter()
    for r in counted:
        histogram[r["length"]] += r["n"]
        parts[r["part"]] += r["n"]
    sizes = np.zeros(max(parts, default=0) + 1, np.int64)
    sizes[list(parts)] = list(parts.values())
    held = spark.sparkContext.broadcast((np.cumsum(sizes) - sizes, _slots(dict(histogram), capacity)[0]))
    return ranged.mapInArrow(lambda it: _placed(it, *held.value), f"doc_id {type_of(docs, 'doc_id')}, piece int, start long, length int, pack_id long, offset int")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
