"""Operator 5, a deterministic sharded WARC writer.

Records are ordered by (url, page_id, digest). A file's place in that order is cut where the compressed bytes before it
reach the next multiple of the target, so the files depend on the pages alone: not on partitions, executors or retries.
Files appear under their names by a rename of a complete temporary file, and count once the manifest names them.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm import common
from turnstone.llm.common import cut, release, shared_path, small_batches, table

#: Compressed bytes at which a file is rolled; the date that headers carry, as pages have none.
TARGET, DATE = 64 << 20, "2024-01-01T00:00:00Z"
ORDER = ("url", "page_id", "digest")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record; the same bytes for the same record always."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[str, bytes]:
    """(payload digest, gzip member) of a page, with headers made anew.

    A null page_id or url leaves its header out (an address that would break the header's line is percent-encoded), a null
    html is an empty body marked by a WARC-Truncated header, so reading tells it from an empty one.
    """
    body = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    payload = _digest(body)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{payload}|{html is None}")
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head += [("WARC-Block-Digest", _digest(block)), ("WARC-Payload-Digest", payload), ("Content-Type", "application/http; msgtype=response")]
    if html is None:
        head.append(("WARC-Truncated", "unspecified"))
    return payload, _member(head, block)


def _key(url, page_id, digest):
    """Orders as Spark does: nulls first, strings by their bytes."""
    return (url is not None, url or "", page_id is not None, page_id or 0, digest)


def _sizes(batches, date: str):
    for batch in batches:
        out = [record(*row, date) for row in zip(*[c.to_pylist() for c in batch.columns])]
        yield pa.record_batch([batch.column(1), batch.column(0), pa.array([d for d, _ in out], pa.string()), pa.array([len(b) for _, b in out], pa.int64())], names=["url", "page_id", "digest", "bytes"])


def _blobs(batches, date: str, borders: list[tuple]):
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            pages = list(zip(*[c.to_pylist() for c in part.columns]))
            out = [record(*row, date) for row in pages]
            shard = [bisect.bisect_right(borders, _key(u, p, d)) - 1 for (p, u, _), (d, _) in zip(pages, out)]
            yield pa.record_batch(
                [pa.array(shard, pa.int32()), part.column(1), part.column(0), pa.array([d for d, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())],
                names=["shard", "url", "page_id", "digest", "blob"],
            )


FILES = "kind string, file string, page_id long, url string, offset long, length long, digest string"
_ARROW = pa.schema([("kind", pa.string()), ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])


def file_name(shard: int) -> str:
    return f"pages-{shard:06d}.warc.gz"


def _write(batches, folder: str, date: str):
    """Rows of whole shards, in order, to files; gives one line a record and one a file (records, bytes, SHA-256)."""
    fs, root = pafs.FileSystem.from_uri(folder)
    sink, shard, rows = None, None, []

    def close():
        sink.close()
        fs.move(temporary, f"{root}/{file_name(shard)}")  # a retried task moves the same bytes over the same name
        rows.append(("file", file_name(shard), None, None, records, at, sha.hexdigest()))

    def flushed():
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for batch in batches:
        for number, url, page_id, digest, blob in zip(*[c.to_pylist() for c in batch.columns]):
            if number != shard:
                if sink is not None:
                    close()
                shard, at, records, sha = number, 0, 0, hashlib.sha256()
                temporary = f"{root}/.{file_name(shard)}.{uuid.uuid4().hex}"
                sink = fs.open_output_stream(temporary)
                info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file_name(shard))}>"), ("WARC-Date", date), ("WARC-Filename", file_name(shard)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                sink.write(info)
                sha.update(info)
                at += len(info)
            sink.write(blob)
            sha.update(blob)
            rows.append(("record", file_name(shard), page_id, url, at, len(blob), digest))
            at, records = at + len(blob), records + 1
            if len(rows) >= 8192:
                yield flushed()
                rows.clear()
    if sink is not None:
        close()
    if rows:
        yield flushed()


def borders(pages: DataFrame, target: int = TARGET, date: str = DATE) -> list[tuple]:
    """The first key of each file. One line a file comes to the driver; records with one key share a file."""
    sizes = pages.select("page_id", "url", "html").mapInArrow(lambda it: _sizes(it, date), "url string, page_id long, digest string, bytes long")
    units = sizes.groupBy(*ORDER).agg(F.sum("bytes").alias("bytes"))
    ranges = cut(units.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()))
    totals = {r["part"]: r["bytes"] for r in ranges.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}
    base, at = [], 0
    for part in sorted(totals):
        base.append((part, at))
        at += totals[part]
    if not base:
        release(ranges)
        return []
    starts = F.broadcast(pages.sparkSession.createDataFrame(base, "part int, base long"))
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranges.join(starts, "part").withColumn("file", F.floor((F.col("base") + F.coalesce(before, F.lit(0))) / target))
    first = placed.groupBy("file").agg(F.min(F.struct(*ORDER)).alias("k")).orderBy("file").collect()
    release(ranges)
    return [_key(*r["k"]) for r in first]


def write_warc(pages: DataFrame, folder: str, target: int = TARGET, date: str = DATE) -> DataFrame:
    """Write pages as WARC files below folder, which must not hold an index yet (else AnalysisException), and give (page_id, url, file, offset, length, digest), one line a record.

    Every row is written, repeated ones too, next to each other and in one file. Null page_ids, urls and html are written
    as record() says; so are empty and very long pages, of which one larger than the target has a file almost alone. No
    rows make no files and an empty manifest. Other columns are ignored. manifest.json comes last, by a rename, and names
    the files with records, bytes and SHA-256.
    """
    spark = pages.sparkSession
    small_batches(spark)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    cuts = borders(pages, target, date)
    held = spark.sparkContext.broadcast(cuts)
    blobs = pages.select("page_id", "url", "html").mapInArrow(lambda it: _blobs(it, date, held.value), "shard int, url string, page_id long, digest string, blob binary")
    # a task a file, so the largest task holds what a file holds
    together = blobs.repartitionById(max(1, len(cuts)), "shard").sortWithinPartitions("shard", *ORDER)
    written = together.mapInArrow(lambda it: _write(it, folder, date), FILES)
    written.write.parquet(f"{folder}/index")
    index = spark.read.schema(FILES).parquet(f"{folder}/index")
    files = [{"file": r["file"], "records": r["offset"], "bytes": r["length"], "sha256": r["digest"]} for r in index.filter("kind = 'file'").orderBy("file").collect()]
    temporary = f"{root}/.manifest.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as sink:
        sink.write(json.dumps({"target": target, "date": date, "files": files}, indent=1).encode())
    fs.move(temporary, f"{root}/manifest.json")
    return index.filter("kind = 'record'").select("page_id", "url", "file", "offset", "length", "digest")


def read_warc(folder: str):
    """(file, headers, block) of every record of the files that the manifest names; the files' SHA-256 are verified."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as source:
        manifest = json.loads(source.read())
    for entry in manifest["files"]:
        with fs.open_input_stream(f"{root}/{entry['file']}", compression=None) as source:
            data = source.read()
        if hashlib.sha256(data).hexdigest() != entry["sha256"]:
            raise ValueError(f"{entry['file']} isn't what the manifest says")
        while data:
            member = zlib.decompressobj(31)
            raw = member.decompress(data)
            data = member.unused_data
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield entry["file"], fields, rest[: int(fields["Content-Length"])]


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    common._written[folder] = spark
    return write_warc(table(spark, sf_dir, "pages"), folder)


QUERIES = {"op5_warc_writer": op5_warc_writer}
ORACLES: dict[str, str] = {}
