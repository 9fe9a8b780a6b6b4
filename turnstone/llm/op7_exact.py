"""Operator 7, exact dedup by deterministic block naming.

Texts are cut into blocks of BLOCK bytes. Sorting gives equal blocks one integer name; each pass then names the pairs of
adjacent names anew, until every document has a single name. Names come from comparing content, never from a hash alone, so
two documents have one identity exactly when their texts are equal byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, one_per_group, release, small, table, tucked

#: Bytes of a block. Most documents are one block; longer ones take log2(length / BLOCK) passes over names alone.
BLOCK = 4096
#: Sort ranges. A name is rank * RANGES + range, which needs no global offsets.
RANGES = 1 << 20
#: Copies over which a content is named once and joined back, so that no sort gets all its copies.
MANY = 10_000


def _named(rows: DataFrame, content: list[str], many: int = MANY) -> DataFrame:
    """Give equal `content` one integer, `name`: within its range of the sort, its dense rank. One shuffle, of the content.

    Content met more than `many` times is combined on the map side, named like the rest (below zero) and joined back, by a
    broadcast or a join that adaptive execution splits.
    """
    code = F.xxhash64(*content)
    met = cut(rows.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many).select("code"))

    def ranked(part: DataFrame) -> DataFrame:
        rank = F.dense_rank().over(Window.partitionBy("range").orderBy(*content))
        return part.withColumn("range", F.pmod(F.xxhash64(*content), F.lit(RANGES))).withColumn("name", rank.cast("long") * RANGES + F.col("range")).drop("range")

    if met.isEmpty():
        release(met)
        return ranked(rows)
    held = small(met)
    often = rows.join(held, code == held["code"], "left_semi")
    names = cut(ranked(often.select(*content).distinct()).withColumn("name", -F.col("name")))
    # contents are up to a block each, so few of them may be broadcast
    return ranked(rows.join(held, code == held["code"], "left_anti")).unionByName(often.join(small(names, 4096), content).select(*rows.columns, "name"))


def _blocks(text: Column, block: int) -> Column:
    last = F.greatest(F.octet_length(text) - 1, F.lit(0))
    places = F.sequence(F.lit(0), F.floor(last / block).cast("int"))
    # the bytes are a lambda's variable, so that a text is turned into bytes once, not once a block
    return F.transform(F.array(text.cast("binary")), lambda raw: F.transform(places, lambda i: F.substring(raw, i * block + 1, F.lit(block))))[0]


def identities(docs: DataFrame, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """(rid, doc_id, gid) of docs (rid, doc_id, text): one line for each row; gid is the text's identity, null for a null text.

    Blocks are put together by rid, which is the row's own, so rows may share a doc_id or lack one. Any number of blocks is
    carried as one array of names a document between passes; documents already of one name rest. An empty text is one
    empty block, so empty texts are equal. No rows give no rows.
    """
    there = docs.filter("text is not null")
    cutup = there.select("rid", "doc_id", F.posexplode(_blocks(F.col("text"), block)).alias("pos", "block"), F.octet_length("text").alias("bytes"))
    # from here on, rid is read from written tables
    named = cut(_named(cutup, ["block"], many).select("rid", "doc_id", "pos", "name", "bytes"))
    whole = lambda names: F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias(names)
    out = named.filter(F.col("bytes") <= block).select("rid", "doc_id", F.concat(F.lit("0:"), F.col("name").cast("string")).alias("gid"))
    out = out.unionByName(docs.filter("text is null").select("rid", "doc_id", F.lit(None).cast("string").alias("gid")))
    longer, level = cut(named.filter(F.col("bytes") > block).groupBy("rid", "doc_id").agg(whole("names"))), 0
    while not longer.isEmpty():
        level += 1
        halves = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(F.element_at("names", i * 2 + 1).alias("a"), F.when(i * 2 + 2 <= F.size("names"), F.get("names", i * 2 + 1)).otherwise(F.lit(-1)).alias("b")))
        pairs = longer.select("rid", "doc_id", F.posexplode(halves).alias("pos", "pair")).select("rid", "doc_id", "pos", "pair.a", "pair.b")
        longer = cut(_named(pairs, ["a", "b"], many).groupBy("rid", "doc_id").agg(whole("names")))
        out = out.unionByName(longer.filter(F.size("names") == 1).select("rid", "doc_id", F.concat(F.lit(f"{level}:"), F.col("names")[0].cast("string")).alias("gid")))
        longer = longer.filter(F.size("names") > 1)
    return out


def exact_copies(docs: DataFrame, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """(doc_id, keep_id, keep) for every row of docs.

    keep_id is the smallest doc_id among the rows with the same text, and keep is true for exactly one of them (the
    smallest doc_id, null last). A null text equals no other: it is kept, keep_id is its own doc_id. Empty texts are equal.
    Of repeated rows one is kept. doc_id may be of any type that has an order. Further columns, whatever their names, are
    ignored; no rows give no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return one_per_group(identities(rows, block, many)).select("doc_id", "keep_id", "keep")


def drop_exact_copies(docs: DataFrame, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """docs without all but one row of each text, with all its columns; decided as in exact_copies().

    Rows are numbered in a written table, so what goes is known by its number, and not by a hash of the text.
    """
    tuck, back = tucked(docs)
    rows = cut(docs.select(*tuck, F.monotonically_increasing_id().alias("rid")))
    at = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    found = one_per_group(identities(rows.select("rid", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), block, many))
    gone = cut(found.filter("not keep").select("rid"))
    return rows.join(small(gone), "rid", "left_anti").select(back)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
               text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS keep
        FROM documents"""
}
