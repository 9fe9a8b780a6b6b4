"""A training corpus from documents: known languages, no copies, near copies once, sources at their weights, packs.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of docs. run() writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm.common import release, remove, shared_path
from turnstone.llm.op2_language import keep_identified
from turnstone.llm.op3_mixing import mix_sources
from turnstone.llm.op4_packing import pack
from turnstone.llm.op7_exact import drop_exact_copies
from turnstone.llm.op9_minhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is accepted, with their columns.

    Null, empty, blank and letterless texts have no language and go. A null lang or source is a value of its own; rows that
    repeat or lack a doc_id are judged like others. Long texts count whole. No rows give no rows.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest doc_id (null last), with its columns.

    A null text equals no other; empty texts are equal. Of repeated rows one stays. No rows give no rows.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (null last), with its columns.

    Texts that are null or without words are in no group and stay; rows without a doc_id take part. Of repeated rows one
    stays. No rows give no rows.
    """
    return drop_near_copies(docs, unnamed=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as there are, drawn in equal shares of the sources, a document as often as drawn.

    A null source is a source of its own. A null n_chars has the smallest measure of size. Ties go to the smaller doc_id,
    null last; repeated rows each take part. No rows give no rows.
    """
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, pack_id, offset): where each piece of each document lies in which pack.

    An empty or null text is its end token alone. A document that was drawn several times is packed as often. Ties of
    length go by doc_id, null last, and start. No rows give no rows.
    """
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the trained language model nor MinHash candidates nor the packing loop; tests compare what
#: run() gives on sf0.001 with all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        release()
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
