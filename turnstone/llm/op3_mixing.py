"""Operator 3, mixing sources to target weights by Pareto order sampling.

The budget is dealt to the sources by weight. Within a source a document of size measure x is to be drawn share * x / sum(x)
times: the whole part is certain, and the fraction p is the inclusion probability of a sample of fixed size, taken as the
documents with the smallest [u / (1 - u)] / [p / (1 - p)], u uniform from a hash of doc_id.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, repeated, small, table, tucked

SEED = "mix-1"
#: Order classes of the Pareto ranks by source: whole classes are taken or left, only the one at the border is sorted.
CLASSES = 4096


def _rank(u, p):
    return (u / (1 - u)) / (p / (1 - p))


def whole_weights(weights: dict[str, float], other: float) -> tuple[dict[str, int], int]:
    """The weights, which may be fractions, in whole numbers of the same ratios; ValueError for a negative or odd one."""
    exact = {}
    for name, w in [*weights.items(), (None, other)]:
        try:
            exact[name] = Fraction(str(w))
        except ValueError as e:
            raise ValueError(f"the weight {w!r} is no number") from e
        if exact[name] < 0:
            raise ValueError(f"the weight {w!r} is negative")
    unit = math.lcm(*[x.denominator for x in exact.values()])
    whole = {name: int(x * unit) for name, x in exact.items()}
    return {name: w for name, w in whole.items() if name is not None}, whole[None]


def allocation(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, other: float = 1) -> DataFrame:
    """(source, size, share): integer shares of the budget by weight; remainders go to the first sources by name.

    `weights` holds any numbers of 0 or more, of which the ratios count (0.7 and 0.3 are 7 and 3); `other` is the weight of
    a source that it doesn't name. A null source is a source of its own, written as ''. The budget is the number of rows
    unless given. A source of weight 0 gets nothing.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(_size()).alias("size"), F.count(F.lit(1)).alias("n"))
    named, rest = whole_weights(weights or {}, other)
    weight = F.lit(rest).cast("decimal(38,0)")
    for name, w in named.items():
        weight = F.when(F.col("source") == name, F.lit(w).cast("decimal(38,0)")).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight").alias("w"), (F.lit(budget) if budget is not None else F.sum("n")).cast("decimal(38,0)").alias("b"))
    floor = sizes.crossJoin(F.broadcast(total)).withColumn("base", F.when(F.col("w") > 0, F.floor(F.expr("(b * weight) div w"))).otherwise(F.lit(0)).cast("long"))
    given = floor.agg(F.sum("base").alias("dealt"))
    nth = F.row_number().over(Window.orderBy(F.col("weight") > 0, "source"))  # one line a source
    ranked = floor.crossJoin(F.broadcast(given)).filter("weight > 0").withColumn("nth", nth)
    return ranked.select("source", "size", (F.col("base") + (F.col("nth") <= F.col("b") - F.col("dealt")).cast("long")).alias("share"))


def _size() -> Column:
    """The measure of size: the bit length of n_chars, so 1 for null, none or fewer, 12 for 3,000 characters."""
    return F.length(F.bin(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)))).cast("long")


def _marked(rows: DataFrame, shares: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, source, n_chars, ...) with s source, whole certain copies, q Pareto rank of the fraction (null where
    there is none), instead of source and n_chars."""
    held = shares.select(F.col("source").alias("s"), "size", "share")
    out = rows.withColumn("s", F.coalesce("source", F.lit(""))).join(small(held), "s", "left")
    product = F.coalesce("share", F.lit(0)).cast("decimal(20,0)") * _size().cast("decimal(10,0)")
    out = out.withColumn("product", product).withColumn("whole", F.coalesce(F.expr("product div size"), F.lit(0)).cast("long"))
    out = out.withColumn("left", (F.col("product") - F.col("whole").cast("decimal(20,0)") * F.col("size")).cast("long"))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    out = out.withColumn("q", F.when(F.col("left") > 0, _rank(u, F.col("left").cast("double") / F.col("size").cast("double"))))
    return out.drop("product", "left", "size", "share", "source", "n_chars")


def _draws(rows: DataFrame, weights: dict[str, float] | None, budget: int | None, seed: str, tie: Column) -> DataFrame:
    """rows (doc_id, source, n_chars and others) with s, the source, and copies, 0 or more, that add up to each source's share.

    The border of each source is found on (source, doc_id, n_chars) alone; then one pass over rows applies it, and no
    text is shuffled.
    """
    shares = cut(allocation(rows.select("source", "n_chars"), weights, budget))
    narrow = _marked(rows.select("doc_id", "source", "n_chars"), shares, seed)
    # order classes are monotone in q: q / (1 + q) lies in 0..1
    narrow = narrow.withColumn("class", F.floor(F.col("q") / (1 + F.col("q")) * CLASSES))
    counts = cut(narrow.groupBy("s", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")))
    need = counts.groupBy("s").agg(F.sum("whole").alias("whole")).join(shares.select(F.col("source").alias("s"), "share"), "s").select("s", (F.col("share") - F.col("whole")).alias("need"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("class"))
    border = counts.filter("class is not null").withColumn("upto", upto).join(need, "s").filter("need > 0 and upto >= need and upto - n < need").select("s", "class", (F.col("need") - F.col("upto") + F.col("n")).alias("take"))
    border = cut(border)  # one class a source
    close = narrow.join(small(border), ["s", "class"])
    order = Window.partitionBy("s").orderBy("q", F.col("doc_id").asc_nulls_last())
    close = close.withColumn("nth", F.row_number().over(order)).withColumn("tie", F.dense_rank().over(order))
    place = lambda doc: F.struct(doc.isNull().alias("none"), doc.alias("doc"))  # noqa: E731  nulls last
    ties = close.groupBy("s", "tie", "take").agg(F.min("q").alias("edge"), F.min(place(F.col("doc_id"))).alias("edge_doc"), F.count(F.lit(1)).alias("ties"), F.min("nth").alias("lo"), F.max("nth").alias("hi"))
    edge = cut(ties.filter("lo <= take and take <= hi").select("s", "edge", "edge_doc", "ties", (F.col("take") - F.col("lo") + 1).alias("taken")))
    marked = _marked(rows, shares, seed).join(small(edge), "s", "left")
    mine = place(F.col("doc_id"))
    below = (F.col("q") < F.col("edge")) | ((F.col("q") == F.col("edge")) & (mine <= F.col("edge_doc")))
    marked = marked.withColumn("copies", F.col("whole") + F.coalesce(below, F.lit(False)).cast("long"))
    out = [c for c in rows.columns if c not in ("source", "n_chars")] + ["s", "copies"]
    if edge.filter("taken < ties").isEmpty():
        return marked.select(out)
    # rows of one source, rank and doc_id at the border, of which only some are taken
    tied = F.coalesce((F.col("q") == F.col("edge")) & (mine == F.col("edge_doc")) & (F.col("taken") < F.col("ties")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("s").orderBy(tie))
    some = marked.filter(tied).withColumn("copies", F.col("whole") + (nth <= F.col("taken")).cast("long"))
    return marked.filter(~tied).select(out).unionByName(some.select(out))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, copies) of every row that is drawn at least once.

    All sources weigh the same unless `weights` says otherwise (see allocation()), and the budget is the number of rows. A
    null source is a source of its own, ''. A null or negative n_chars counts as 0, of the smallest measure. doc_id may be
    of any type that has an order. Null doc_ids share one u; repeated rows each take part, and ties go to the smaller
    doc_id, null last. Texts, null or not, are not read. No rows give no rows; further columns are ignored.
    """
    drawn = _draws(docs.select("doc_id", "source", "n_chars"), weights, budget, seed, F.col("doc_id"))
    return drawn.filter("copies > 0").select("doc_id", F.col("s").alias("source"), "copies")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """The drawn rows of docs, each as often as drawn, with all its columns, whatever their names; drawn as in mixture().

    Rows that tie in source, rank and doc_id at the border go by their text.
    """
    tuck, back = tucked(docs)
    rows = docs.select(*tuck, "doc_id", "source", "n_chars")
    tie = F.xxhash64(f"in_{docs.columns.index('text')}") if "text" in docs.columns else F.col("doc_id")
    return repeated(_draws(rows, weights, budget, seed, tie).filter("copies > 0"), "copies").select(back)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
#: The same in SQL over a relation {docs}; {columns} are the columns to return.
MIX_SQL = """
    WITH rows_ AS (
        SELECT *, coalesce(source, '') AS s_, length(bin(greatest(coalesce(n_chars, 0), 0)))::HUGEINT AS x_, row_number() OVER () AS r_ FROM {docs}
    ), sizes_ AS (
        SELECT s_, sum(x_)::HUGEINT AS size_, count(*)::HUGEINT AS n_, row_number() OVER (ORDER BY s_) AS nth_ FROM rows_ GROUP BY s_
    ), total_ AS (SELECT sum(n_)::HUGEINT AS b_, count(*)::HUGEINT AS w_ FROM sizes_
    ), shares_ AS (
        SELECT s_, size_, b_ // w_ + (CASE WHEN nth_ <= b_ - w_ * (b_ // w_) THEN 1 ELSE 0 END) AS share_ FROM sizes_, total_
    ), parts_ AS (
        SELECT *, share_ * x_ // size_ AS whole_, (share_ * x_) % size_ AS left_,
               (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u_
        FROM rows_ JOIN shares_ USING (s_)
    ), ranks_ AS (
        SELECT *, share_ - sum(whole_) OVER (PARTITION BY s_) AS need_,
               CASE WHEN left_ > 0 THEN (u_ / (1 - u_)) / ((left_::DOUBLE / size_::DOUBLE) / (1 - left_::DOUBLE / size_::DOUBLE)) END AS q_
        FROM parts_
    ), drawn_ AS (
        SELECT *, (whole_ + CASE WHEN q_ IS NOT NULL AND row_number() OVER (PARTITION BY s_ ORDER BY q_ NULLS LAST, doc_id NULLS LAST) <= need_ THEN 1 ELSE 0 END)::BIGINT AS copies_
        FROM ranks_
    )
    SELECT {columns} FROM drawn_ WHERE copies_ > 0"""
ORACLES = {"op3_mix_sources": MIX_SQL.format(docs="documents", columns="doc_id, s_ AS source, copies_ AS copies")}
