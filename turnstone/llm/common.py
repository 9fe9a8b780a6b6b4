"""What the operators share: the shared folder, lineage cuts, size-checked broadcasts, keeping one row a group."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which one side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else (in tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnstone-"))
    return context.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_written: dict[str, SparkSession] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows, even when the session has ended."""
    jvm, context = SparkContext._jvm, spark.sparkContext._jsc
    conf = context.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
    jvm_path = jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(conf).delete(jvm_path, True)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again; without arguments, all that are left."""
    paths = [t._written for t in tables if hasattr(t, "_written")] if tables else list(_written)
    for path in paths:
        spark = _written.pop(path, None)
        try:
            if spark is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM is gone
            pass


atexit.register(release)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder, which outlives any executor, and read that.

    Unlike checkpoint(), which runs the last stage twice, this computes df once. release() deletes the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when df, which must be cut or cheap to count, has at most so many (narrow) rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of an Arrow batch on the way to Python; rows hold whole texts, so batches are bounded by size.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES unless the session's own bound is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or "-1"
    try:
        lower = 0 < int(now.rstrip("b")) <= BATCH_BYTES
    except ValueError:
        lower = True  # set by hand, with a unit
    if not lower:
        spark.conf.set(name, str(BATCH_BYTES))


def text_key(text: str = "text") -> Column:
    """128 bits that tell texts apart, as two independent hashes; null for a null text."""
    return F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def tucked(docs: DataFrame) -> tuple[list[Column], list[Column]]:
    """The columns of docs under names that no operator uses inside, and back under their own."""
    own = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return [c.alias(f"in_{k}") for k, c in enumerate(own)], [F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)]


def type_of(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def known_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of labels with both, one line a doc_id, of the type that docs has; of several the largest counts."""
    typed = labels.select(F.col("doc_id").try_cast(type_of(docs, "doc_id")).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return typed.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def repeated(df: DataFrame, times: str, block: int = 4096) -> DataFrame:
    """Each row so many times, without the column `times`; in blocks, so that no array grows with the number."""
    outer = df.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block)))).filter(F.col(times) > 0)
    inner = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col(times) - F.col("block_") * block)))
    return outer.withColumn("nth_", inner).drop(times, "block_", "nth_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_group(rows: DataFrame, *ties: str) -> DataFrame:
    """rows, which have rid (a number of their own), doc_id and gid, with keep_id and keep instead of gid; a null gid is a
    group of its own. keep_id is the group's smallest doc_id and exactly one row a group is kept: of the smallest doc_id
    (nulls last), then of the smallest `ties`, then rid.

    The group's choice is a partially aggregated minimum, so a group of any size is combined on the map side.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), *ties, F.col("rid").alias("rid"))
    first = rows.filter("gid is not null").groupBy("gid").agg(F.min(order).alias("first"))
    names = [c for c in rows.columns if c != "gid"]
    grouped = rows.filter("gid is not null").join(first, "gid").select(*names, F.col("first.doc_id").alias("keep_id"), (F.col("first.rid") == F.col("rid")).alias("keep"))
    return grouped.unionByName(rows.filter("gid is null").select(*names, F.col("doc_id").alias("keep_id"), F.lit(True).alias("keep")))


def keep_chosen(docs: DataFrame, chosen: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that `chosen` (doc_id, key, keep; one line a row of docs) keeps, with all columns of docs, whatever
    their names.

    What is dropped goes by an anti join on (doc_id, key). Equal rows of which only some stay are few: they are
    taken out, numbered and put back, and only where there are any.
    """
    tuck, back = tucked(docs)
    chosen = cut(chosen.groupBy("doc_id", "key").agg(F.sum(F.col("keep").cast("long")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept < n"))
    gone, partly = small(chosen.filter("kept = 0").select("doc_id", "key")), chosen.filter("kept > 0")
    rows = docs.select(*tuck, F.col("doc_id").alias("doc_id"), text_key(text).alias("key"))
    match = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & rows["key"].eqNullSafe(other["key"])
    stay = rows.join(gone, match(gone), "left_anti")
    if partly.isEmpty():
        return stay.select(back)
    part = small(partly.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "kept"))
    stay = stay.join(part, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(0)))
    some = stay.filter("kept is not null").withColumn("nth", nth).filter("nth <= kept")
    return stay.filter("kept is null").select(back).unionByName(some.select(back))
