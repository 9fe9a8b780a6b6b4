"""Operator 8, sharding by size-tiered compaction.

Arrivals become small immutable Parquet shards. Shards of one tier (sizes within a factor of FAN) are merged, in order of
arrival, into larger ones until they reach the target. Each step is a new manifest version, committed by an exclusive
rename; readers see one version, and files that no kept version names are swept. A version says what it added and removed;
every FULL-th lists all shards. Writers announce what they are about to write, so that a sweep leaves it alone, and a
commit that another writer forestalled is made again on top of the other's.
"""

from __future__ import annotations

import json
import math
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstone.llm import common
from turnstone.llm.common import shared_path, table

#: Bytes of a full shard; shards of a tier that make a merge; smallest tier's bytes; arrivals that op8 makes of a table.
TARGET, FAN, LEAST, ARRIVALS = 128 << 20, 4, 1 << 20, 4
#: Versions from one full list of shards to the next; seconds after which an announcement is that of a dead writer.
FULL, STALE = 16, 7 * 86400
_SHARD = "file string, rows long, bytes long"


def _uri(path: str) -> str:
    return path if path.split("/")[0].endswith(":") else f"file://{path}"


def _footers(batches, root: str):
    """Rows and bytes of each file, by the executors."""
    fs, base = pafs.FileSystem.from_uri(root)
    for batch in batches:
        files = batch.column(0).to_pylist()
        infos = fs.get_file_info([f"{base}/{f}" for f in files])
        rows = []
        for info in infos:
            with fs.open_input_file(info.path) as source:
                rows.append(pq.ParquetFile(source).metadata.num_rows)
        yield pa.record_batch([pa.array(files), pa.array(rows, pa.int64()), pa.array([i.size for i in infos], pa.int64())], names=["file", "rows", "bytes"])


def _merge(batches, root: str):
    """(target, files) to one file each, streamed row group by row group in bounded memory; a retry writes its own name."""
    fs, base = pafs.FileSystem.from_uri(root)
    for batch in batches:
        for target, files in zip(*[c.to_pylist() for c in batch.columns]):
            sources = [pq.ParquetFile(fs.open_input_file(f"{base}/{f}")) for f in files]
            # schemas may have grown: the union of columns, in order of arrival
            schema = pa.unify_schemas([s.schema_arrow.remove_metadata() for s in sources])
            name = f"data/{target}-{uuid.uuid4().hex[:8]}.parquet"
            fs.create_dir(f"{base}/data", recursive=True)
            rows = 0
            with fs.open_output_stream(f"{base}/{name}") as sink, pq.ParquetWriter(sink, schema, compression="zstd") as writer:
                held, size = [], 0
                for source in sources:
                    for part in source.iter_batches(batch_size=1024):
                        held.append(pa.Table.from_batches([part]))
                        size, rows = size + part.nbytes, rows + part.num_rows
                        if size >= 32 << 20:
                            writer.write_table(_aligned(held, schema))
                            held, size = [], 0
                if held:
                    writer.write_table(_aligned(held, schema))
            yield pa.record_batch([pa.array([name]), pa.array([rows], pa.int64()), pa.array([fs.get_file_info(f"{base}/{name}").size], pa.int64())], names=["file", "rows", "bytes"])


def _aligned(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    """One table of the schema; a column that a shard lacks is null."""
    return pa.concat_tables([pa.table([t.column(f.name).cast(f.type) if f.name in t.schema.names else pa.nulls(len(t), f.type) for f in schema], schema=schema) for t in tables])


def plan(shards: list[dict], target: int = TARGET, fan: int = FAN) -> list[list[dict]]:
    """Runs to merge: FAN or more shards of one tier, in order of arrival, up to the target's size; full shards rest."""
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if s["bytes"] < target * 0.75:
            tiers.setdefault(int(math.log(max(s["bytes"], LEAST) / LEAST, fan)), []).append(s)
    runs = []
    for _, held in sorted(tiers.items()):
        run, size = [], 0
        for s in sorted(held, key=lambda s: (s["born"], s["file"])):
            if run and size + s["bytes"] > target * 1.25:
                runs.append(run)
                run, size = [], 0
            run.append(s)
            size += s["bytes"]
        # a run that fills a file is merged, and one of FAN shards; a shorter one waits for more
        runs += [run] if len(run) >= fan or size >= target * 0.75 else []
    return [r for r in runs if len(r) > 1]


def grown(schema: dict | None, new: StructType) -> dict:
    """The schema with new's further columns at its end. ValueError for a known column of another type, or for one whose
    name differs from a known one by case only, as Spark can't tell those apart."""
    fields = {f["name"]: f for f in (schema or {"fields": []})["fields"]}
    by_case = {name.lower(): name for name in fields}
    for f in json.loads(new.json())["fields"]:
        was = by_case.setdefault(f["name"].lower(), f["name"])
        if was != f["name"]:
            raise ValueError(f"the columns {was} and {f['name']} differ by case only")
        if f["name"] in fields and fields[was]["type"] != f["type"]:
            raise ValueError(f"the column {was} is {fields[was]['type']}, not {f['type']}")
        fields.setdefault(f["name"], f | {"nullable": True})
    return {"type": "struct", "fields": list(fields.values())}


class Store:
    """A sharded table below `root` (a path of any file system that Spark and Arrow both know)."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, _uri(root), target, fan
        self.fs, self.base = pafs.FileSystem.from_uri(self.root)
        for folder in ("data", "manifests", "pending"):
            self.fs.create_dir(f"{self.base}/{folder}", recursive=True)

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.base}/manifests"))
        return sorted(int(i.base_name[1:-5]) for i in found if i.base_name.startswith("v") and i.base_name.endswith(".json"))

    def _stored(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.base}/manifests/v{version:08d}.json") as source:
            return json.loads(source.read())

    def manifest(self, version: int | None = None) -> dict:
        """The named version, else the newest, with all its shards; version 0, before any, has none."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "rows": 0, "schema": None, "shards": []}
        last = self._stored(version)
        # from the newest full list on, what each version added and removed
        steps = [last]
        while "shards" not in steps[-1]:
            at = steps[-1]["version"] - 1
            if at == 0:
                break
            steps.append(self._stored(at))
        shards = {s["file"]: s for s in steps[-1].get("shards", [])}
        for step in reversed(steps):
            if "shards" not in step:
                for file in step["removed"]:
                    del shards[file]
                shards |= {s["file"]: s for s in step["added"]}
        return {k: last[k] for k in ("version", "what", "rows", "schema")} | {"shards": sorted(shards.values(), key=lambda s: (s["born"], s["file"]))}

    def _commit(self, before: dict, added: list[dict], removed: list[str], what: str, schema: dict | None = None) -> dict:
        """The version after `before`, or FileExistsError if another writer was first: then nothing changed."""
        gone = set(removed)
        shards = sorted([s for s in before["shards"] if s["file"] not in gone] + added, key=lambda s: (s["born"], s["file"]))
        after = {"version": before["version"] + 1, "what": what, "rows": sum(s["rows"] for s in shards), "schema": schema or before["schema"]}
        stored = after | ({"shards": shards} if after["version"] % FULL == 0 else {"added": added, "removed": sorted(gone)})
        name = f"manifests/v{after['version']:08d}.json"
        temporary = f"manifests/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(f"{self.base}/{temporary}") as sink:
            sink.write(json.dumps(stored).encode())
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self.root), self.spark.sparkContext._jsc.hadoopConfiguration())
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}") for p in (temporary, name)]
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(*paths, none)
        except Exception as e:
            self.fs.delete_file(f"{self.base}/{temporary}")
            if after["version"] in self.versions():
                raise FileExistsError(name) from e
            raise
        return after | {"shards": shards}

    def _announce(self) -> str:
        """A new name that data files will begin with; sweep() spares them until it is withdrawn."""
        token = uuid.uuid4().hex
        with self.fs.open_output_stream(f"{self.base}/pending/{token}"):
            pass
        return token

    def _withdraw(self, token: str) -> None:
        self.fs.delete_file(f"{self.base}/pending/{token}")

    def append(self, df: DataFrame, arrivals: int = 1) -> dict:
        """Write df's partitions as shards, with no shuffle, and commit them as so many arrivals, in one version each.

        Rows go in as they are: nulls, empty and long texts, repeated rows. A partition without rows makes no shard, and
        an empty df no version. Appends of several writers all get in, whoever commits first. df may lack columns or bring
        new ones, but see grown() for what it must not.
        """
        grown(self.manifest()["schema"], df.schema)  # before any work
        token, root = self._announce(), self.root
        df.write.option("compression", "zstd").parquet(f"{root}/data/{token}")
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.base}/data/{token}"))
        files = self.spark.createDataFrame([(f"data/{token}/{i.base_name}",) for i in found if i.base_name.endswith(".parquet")], "file string")
        new = [r.asDict() for r in files.repartition(max(1, min(len(found), 64))).mapInArrow(lambda it: _footers(it, root), _SHARD).collect() if r["rows"]]
        new.sort(key=lambda s: s["file"])
        now = self.manifest()
        for k in range(arrivals):
            held = new[k * len(new) // arrivals : (k + 1) * len(new) // arrivals]
            while held:
                try:
                    now = self._commit(now, [s | {"born": now["version"] + 1} for s in held], [], "append", grown(now["schema"], df.schema))
                    break
                except FileExistsError:
                    now = self.manifest()
        self._withdraw(token)
        return now

    def compact(self) -> dict:
        """Merge until no tier holds a run; one Spark job and one version for each round, each run one task.

        If another writer commits meanwhile, the merge is committed on top, unless the other merged some of its shards:
        then what this one wrote is left to sweep(), and it starts anew.
        """
        now, root = self.manifest(), self.root
        while runs := plan(now["shards"], self.target, self.fan):
            token = self._announce()
            jobs = self.spark.createDataFrame([(f"{token}-{k:06d}", [s["file"] for s in r]) for k, r in enumerate(runs)], "target string, files array<string>")
            merged = {r["file"].split("/")[1][: -len("-xxxxxxxx.parquet")]: r.asDict() for r in jobs.repartition(len(runs), "target").mapInArrow(lambda it: _merge(it, root), _SHARD).collect()}
            gone = [s["file"] for r in runs for s in r]
            added = [merged[f"{token}-{k:06d}"] | {"born": min(s["born"] for s in r)} for k, r in enumerate(runs)]
            while set(gone) <= {s["file"] for s in now["shards"]}:
                try:
                    now = self._commit(now, added, gone, "merge")
                    break
                except FileExistsError:
                    now = self.manifest()
            self._withdraw(token)
        return now

    def sweep(self, keep: int = 1, stale: float = STALE) -> int:
        """Delete shards that none of the last `keep` versions names; gives their number.

        What a writer announced is spared until it has committed, or for `stale` seconds if it died. The order matters: a
        file that is listed here was announced before, so that either the announcement is still there or the manifest,
        which is read last, names it.
        """
        found = [i for i in self.fs.get_file_info(pafs.FileSelector(f"{self.base}/data", recursive=True)) if i.type == pafs.FileType.File]
        pending = self.fs.get_file_info(pafs.FileSelector(f"{self.base}/pending"))
        alive = tuple(f"data/{i.base_name}" for i in pending if time.time() - i.mtime.timestamp() < stale)
        for i in pending:
            if f"data/{i.base_name}" not in alive:
                self.fs.delete_file(i.path)
        kept = {s["file"] for v in self.versions()[-keep:] for s in self.manifest(v)["shards"]}
        inside = lambda path: path[len(self.base) + 1 :]
        gone = [i for i in found if i.base_name.endswith(".parquet") and inside(i.path) not in kept and not inside(i.path).startswith(alive)]
        there = {i.path for i in found}
        for i in gone:
            checksum = i.path[: -len(i.base_name)] + f".{i.base_name}.crc"
            for path in [i.path, *({checksum} & there)]:
                self.fs.delete_file(path)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the schema that its manifest has, so that no footers are read to find it."""
        now = self.manifest(version)
        if not now["shards"]:
            raise ValueError("this version holds no rows, and so no columns")
        return self.spark.read.schema(StructType.fromJson(now["schema"])).parquet(*[f"{self.root}/{s['file']}" for s in now["shards"]])


def reshard(df: DataFrame, root: str, target: int = TARGET, fan: int = FAN, arrivals: int = ARRIVALS) -> DataFrame:
    """df read back from a store below root, after its partitions arrived, tiers were merged and old files swept.

    Every row comes back once with all its columns, of whatever names and types Parquet knows; an empty df comes back as it
    is. Nulls, empty and long texts, ties and repeated rows are rows like others.
    """
    store = Store(df.sparkSession, root, target, fan)
    if not store.append(df, arrivals)["shards"]:
        return df
    store.compact()
    store.sweep()
    return store.read()


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _uri(shared_path(spark, "shards"))
    common._written[root] = spark
    stored = reshard(table(spark, sf_dir, "documents"), root)
    return stored.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES = {"op8_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"}
