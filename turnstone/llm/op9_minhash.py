"""Operator 9, MinHash near-dedup with tensored banding.

A table's key joins one band of a first collection with one of a second: SIDE bands of HALF minhashes in each collection
give SIDE * SIDE tables of 2 * HALF minhashes, for 2 * SIDE * HALF minhashes computed instead of 2 * SIDE * SIDE * HALF.
Every candidate is verified with the exact Jaccard similarity of the two texts' word shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, keep_chosen, one_per_group, release, small, small_batches, table, text_key, type_of
from turnstone.llm.textbatch import MOST_ROWS, SLICE_BYTES, U64, distinct, flat, mix, reduce_by_doc, shingles, slices

#: Words of a shingle, least Jaccard similarity of near copies, bands of a collection, minhashes of a band.
WIDTH, THRESHOLD, SIDE, HALF, SEED = 3, 0.5, 11, 2, 0x5EED


def _sketch(batches, width: int, side: int, half: int):
    """(rid, doc_id, key, text) to (rid, doc_id, key, fp, left, right): fp names the shingle set, 16 bytes, left and right are
    the bands of the two collections; all three are null without words."""
    draws = np.random.default_rng(SEED).integers(1, 1 << 63, (2, 2 * side * half), dtype=np.int64).astype(U64)
    scale, shift = draws[0] * U64(2) + U64(1), draws[1]
    for rows, data, at in slices(batches, lower=True):
        s, doc = shingles(data, at, width)
        n = rows.num_rows
        some = np.bincount(doc, minlength=n) > 0
        least = np.empty((2 * side * half, n), U64)
        for k in range(2 * side * half):
            least[k] = reduce_by_doc(np.minimum, s * scale[k] + shift[k], doc, n, U64(0))
        bands = np.empty((n, 2 * side), U64)
        for b in range(2 * side):
            x = np.full(n, b + 1, U64)
            for k in range(b * half, (b + 1) * half):
                x = mix(x * U64(0x9E3779B97F4A7C15) + least[k])
            bands[:, b] = x
        # the set of shingles, each counted once, as two sums of 64 bits
        s, doc = distinct(s, doc)
        fp = np.stack([reduce_by_doc(np.add, mix(s + U64(c)), doc, n, U64(0)) for c in (11, 22)], 1)
        raw = np.ascontiguousarray(fp).tobytes()
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * side, mask=np.append(~some, False))
        sides = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).astype(np.int64).ravel())) for x in (bands[:, :side], bands[:, side:])]
        fps = pa.array([raw[16 * r : 16 * r + 16] if some[r] else None for r in range(n)], pa.binary())
        yield pa.record_batch([*[rows.column(c) for c in ("rid", "doc_id", "key")], fps, *sides], names=["rid", "doc_id", "key", "fp", "left", "right"])


def _jaccard(batches, width: int):
    """(a, b, a_text, b_text) to (a, b, jaccard), by the whole texts' sets of shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
    for rows in _pieces(batches):
        n = rows.num_rows
        sides = []
        for side in ("a_text", "b_text"):
            s, doc = shingles(*flat(pc.utf8_lower(rows.column(side))), width)
            s, doc = distinct(s, doc)
            sides.append((doc.astype(U64) << U64(48)) | s)
        # what both sets of a row hold lies twice in the sorted whole
        whole = np.sort(np.concatenate(sides))
        doc = (whole >> U64(48)).astype(np.int64)
        both = np.bincount(doc[1:][whole[1:] == whole[:-1]], minlength=n)
        total = np.bincount(doc, minlength=n) - both
        yield pa.record_batch([rows.column("a"), rows.column("b"), pa.array(both / np.maximum(total, 1))], schema=schema)


def _pieces(batches):
    """Batches cut so that both texts of their rows have at most SLICE_BYTES together, or one row."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a_text", "b_text"))
        ends, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            hi = min(lo + MOST_ROWS, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) but the roots: root is the component's smallest node.

    Large and small stars in turn (Kiveris et al.), each round a written table, until nothing changes: a number of rounds
    that grows with the logarithm of the longest chain.
    """
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
        star = least.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        after = cut(star)
        now = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        release(edges)
        edges = after
        if mark == now:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes at or over the threshold, written.

    Only texts of documents in a pair travel: one document a node, first narrowed to those (by a broadcast when the list
    is small), then joined to both ends.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(ends.join(nodes.select("node", "doc_id", "key"), "node"))
    known = small(wanted.select("node", F.col("doc_id").alias("d"), F.col("key").alias("k")))
    texts = cut(docs.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).dropDuplicates(["node"]).select("node", "text"))
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text").mapInArrow(lambda it: _jaccard(it, width), "a long, b long, jaccard double")
    out = cut(found.filter(F.col("jaccard") >= threshold))
    release(wanted, texts)
    return out


def near_groups(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, side: int = SIDE, half: int = HALF, unnamed: bool = False) -> DataFrame:
    """(rid, doc_id, key, gid): one line for each row of docs, with a number of its own; gid names its group, null if it has
    no words or, unless rows without a doc_id take part (unnamed), no doc_id.

    Groups are the connected components of all candidate pairs whose Jaccard similarity reaches the threshold. Documents
    with one set of shingles are one node from the start, known by the rid of one of them. Candidates are verified in two
    rounds: every member of a bucket with its smallest node, then all pairs of a bucket that are still in different
    components, so no pair is left out that could change a component, and a bucket of thousands of copies costs its
    length, not its square.
    """
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", "text").withColumn("key", text_key())
    numbered = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "key", "text")
    schema = f"rid long, doc_id {type_of(docs, 'doc_id')}, key struct<a: long, b: long>, fp binary, left array<long>, right array<long>"
    sketch = cut(numbered.mapInArrow(lambda it: _sketch(it, width, side, half), schema))
    taking_part = F.col("fp").isNotNull() & (F.lit(unnamed) | F.col("doc_id").isNotNull())
    nodes = cut(sketch.filter(taking_part).groupBy("fp").agg(F.min(F.struct("rid", "doc_id", "key", "left", "right")).alias("x")).select("fp", F.col("x.rid").alias("node"), "x.doc_id", "x.key", "x.left", "x.right"))
    # a table's key joins a band of the one collection with one of the other
    crossed = nodes.select("node", F.explode("left").alias("a"), "right").select("node", "a", F.explode("right").alias("b")).select("node", F.xxhash64("a", "b").alias("table_key"))
    bucket = Window.partitionBy("table_key")
    buckets = cut(crossed.withColumn("least", F.min("node").over(bucket)).withColumn("n", F.count(F.lit(1)).over(bucket)).filter("n > 1"))
    texts = base.select("doc_id", "key", "text")
    stars = cut(buckets.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    first = _verified(stars, nodes, texts, width, threshold)
    roots = components(first)
    # pairs of one bucket that are still apart
    apart = buckets.filter("n > 2").select("table_key", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left").select("table_key", "own", F.coalesce("root", "own").alias("root"))
    several = apart.withColumn("lo", F.min("root").over(bucket)).withColumn("hi", F.max("root").over(bucket)).filter("lo < hi").select("table_key", "own", "root")
    other = several.select("table_key", F.col("own").alias("b"), F.col("root").alias("b_root"))
    more = several.join(other, "table_key").filter("root < b_root").select(F.least("own", "b").alias("a"), F.greatest("own", "b").alias("b")).distinct()
    second = _verified(cut(more.join(stars, ["a", "b"], "left_anti")), nodes, texts, width, threshold)
    groups = components(first.select("a", "b").unionByName(second.select("a", "b")))
    release(buckets, stars)
    # nodes that are with no other keep the name of their set
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    named = nodes.select("fp", "node").join(groups, "node").select("fp", F.concat(F.lit("n"), F.col("root")).alias("of"))
    gid = F.when(taking_part, F.coalesce("of", F.hex("fp")))
    return sketch.select("rid", "doc_id", "key", "fp").join(named, "fp", "left").select("rid", "doc_id", "key", gid.alias("gid"))


def near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, keep_id, keep) for every row of docs.

    keep_id is the smallest doc_id of the row's group of near copies, and exactly one row of a group is kept. Words are
    runs of letters and digits in lower case; a text of fewer than `width` words is one shingle. Rows with a null or
    wordless text (empty, blank, signs only) are kept and in no group, and so are rows with a null doc_id, unless
    `unnamed` (as in the query and the pipeline) lets them take part; keep_id is null in a group of such rows only. Repeated rows and
    ties are one group with one kept row. doc_id may be of any type that has an order. Further columns are ignored; no
    rows give no rows. Candidates are found with a
    probability of (1 - (1 - J^half)^side)^2 at similarity J: 0.92 at 0.5, 0.96 at 0.55, 0.99 at 0.62.
    """
    return one_per_group(near_groups(docs, **parameters), "key").select("doc_id", "keep_id", "keep")


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each group of near copies, with all its columns; decided as in near_copies()."""
    return keep_chosen(docs, one_per_group(near_groups(docs, **parameters), "key"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), unnamed=True)


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLES: dict[str, str] = {}
