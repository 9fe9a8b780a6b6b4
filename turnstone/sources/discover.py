"""Discovery S1-S6, S14 and filters P1, P2: which files are sessions. Nothing is read but the listing.

refs: harness, session_id, path, kind (main or subagent), parent_id, cwd, mtime, size_bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions.text import decode_slug

REFS = "harness string, session_id string, path string, kind string, parent_id string, cwd string, mtime timestamp, size_bytes long"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def exists(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def listing(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """(path, root, mtime, size_bytes) of files below the roots; S6: a missing root has none."""
    out = None
    for root in roots:
        if not exists(spark, root):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        # as Spark writes it, with its scheme
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
        one = files.select("path", F.lit(full).alias("root"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "path string, root string, mtime timestamp, size_bytes long")


def one_file(spark: SparkSession, path: str) -> DataFrame | None:
    """The ref of an existing file, wherever it lies, with a null harness; None for anything but a file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isFile():
        return None
    files = spark.read.format("binaryFile").load(system.makeQualified(where).toString())
    null, stem = F.lit(None).cast("string"), F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1)
    found = F.regexp_extract(stem, f"({_UUID})$", 1)
    child = F.regexp_extract("path", r"([^/]+)/subagents/(?:.*/)?agent-[^/]*$", 1)
    return files.select(
        null.alias("harness"), F.when(found != "", found).otherwise(stem).alias("session_id"), "path", F.when(child != "", "subagent").otherwise("main").alias("kind"),
        F.when(child != "", child).alias("parent_id"), null.alias("cwd"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"),
    )


def _inner(files: DataFrame) -> DataFrame:
    """inner: the path below its root."""
    return files.withColumn("inner", F.expr("substring(path, length(root) + 2)"))


def _refs(files: DataFrame, harness: str, session_id: Column, kind: Column, parent_id: Column, cwd: Column) -> DataFrame:
    return files.select(F.lit(harness).alias("harness"), session_id.alias("session_id"), "path", kind.alias("kind"), parent_id.alias("parent_id"), cwd.alias("cwd"), "mtime", "size_bytes")


def claude(spark: SparkSession, roots: list[str]) -> DataFrame:
    """<slug>/<id>.jsonl are main, <slug>/<id>/subagents/**/agent-*.jsonl are its subagents; nothing else is a session."""
    main, child = r"^([^/]+)/([^/]+)\.jsonl$", r"^([^/]+)/([^/]+)/subagents/(?:.*/)?(agent-[^/]*)\.jsonl$"
    files = _inner(listing(spark, roots)).filter(F.col("inner").rlike(main) | F.col("inner").rlike(child))
    is_main = F.col("inner").rlike(main)
    part = lambda pattern, k: F.regexp_extract("inner", pattern, k)
    return _refs(
        files, "claude-code", F.when(is_main, part(main, 2)).otherwise(part(child, 3)), F.when(is_main, "main").otherwise("subagent"),
        F.when(~is_main, part(child, 2)), decode_slug(F.regexp_extract("inner", "^([^/]+)/", 1)),
    )


def codex(spark: SparkSession, roots: list[str]) -> DataFrame:
    """S3: every file is a main session, named by the UUID at the end of its name, else by the name."""
    files = _inner(listing(spark, roots))
    stem = F.regexp_extract("inner", r"([^/]+)\.jsonl$", 1)
    found = F.regexp_extract(stem, f"({_UUID})$", 1)
    return _refs(files, "codex", F.when(found != "", found).otherwise(stem), F.lit("main"), F.lit(None).cast("string"), F.lit(None).cast("string"))


def pi(spark: SparkSession, roots: list[str]) -> DataFrame:
    """<time>_<uuid>.jsonl; the directory --slug-- gives the cwd."""
    files = _inner(listing(spark, roots)).filter(F.col("inner").rlike(f"(^|/)[^/_]+_{_UUID}\\.jsonl$"))
    slug = F.regexp_extract("inner", r"(?:^|/)--([^/]+)--/[^/]+$", 1)
    return _refs(files, "pi", F.regexp_extract("inner", f"_({_UUID})\\.jsonl$", 1), F.lit("main"), F.lit(None).cast("string"), F.when(slug != "", F.concat(F.lit("/"), decode_slug(slug))))


def everything(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """S5, U1."""
    return claude(spark, roots.get("claude-code", [])).unionByName(codex(spark, roots.get("codex", []))).unionByName(pi(spark, roots.get("pi", [])))


def filtered(refs: DataFrame, harness: str | None = None, cwd: str | None = None, since: str | None = None, subagents: bool = False) -> DataFrame:
    """By harness, cwd (unknown ones stay) and time of change, before any file is read."""
    if harness:
        refs = refs.filter(F.col("harness") == harness)
    if cwd:
        refs = refs.filter(F.col("cwd").isNull() | (F.col("cwd") == cwd))
    if since:
        refs = refs.filter(F.col("mtime") >= F.lit(since).cast("timestamp"))
    return refs if subagents else refs.filter("kind = 'main'")


def families(refs: DataFrame) -> DataFrame:
    """(family_id, member_ordinal) of each ref: the parent is 0, its children follow by path.

    family_id is the path without .jsonl that parent and children share; a child without its parent's file starts at 1.
    """
    trunk = F.when(F.col("kind") == "subagent", F.regexp_extract("path", r"^(.*)/subagents/", 1)).otherwise(F.regexp_replace("path", r"\.jsonl$", ""))
    rows = refs.withColumn("family_id", trunk)
    order = F.row_number().over(Window.partitionBy("family_id", "kind").orderBy("path"))
    return rows.withColumn("member_ordinal", F.when(F.col("kind") == "main", 0).otherwise(order).cast("long"))


def offloaded(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(family_id, tool_use_id) of results kept beside a session; names only."""
    files = listing(spark, roots, "*.{txt,pdf}").filter(F.col("path").rlike("/tool-results/[^/]+$"))
    return files.select(F.regexp_extract("path", "^(.*)/tool-results/", 1).alias("family_id"), F.regexp_extract("path", r"/tool-results/([^/]+)\.[^./]+$", 1).alias("tool_use_id")).distinct()
