"""Sharding: a store of immutable shards with size-tiered compaction and versioned manifests.

``append`` writes arrivals as small shards without a shuffle. ``compact`` merges ``fanout`` runs of one tier (sizes within
a factor of ``fanout``) into files of about ``target_bytes``; the groups that are due are written side by side and
committed together. Inputs are only read, so a lost executor's tasks run again.

A version is one JSON file that names all files of the store; it is written aside and renamed to its number, which
fails if another writer took the number, and then the change is made again on the newer version. That needs a file system
whose rename is atomic and spares an existing target, as HDFS and local ones do; for data in an object store,
``manifest_root`` puts the manifests on such a file system. Readers see whole versions.

Edge cases: an empty arrival is a run without files; a null arrival number counts as 0, any other number is a run; nulls,
empty and very long texts are stored as they are; repeated rows stay repeated; extra columns are stored under their names,
and a run without one of the store's columns reads as null there, while one whose column has another type or differs in
case only is refused; where a stored column is named shard, tier or version, the store's own gets underscores after it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import free_name


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, small_bytes: int = 1 << 20, manifest_root: str | None = None):
        self.spark, self.root, self.target_bytes, self.fanout, self.small_bytes = spark, root.rstrip("/"), target_bytes, fanout, small_bytes
        self.manifests = (manifest_root or f"{self.root}/_manifest").rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._manifest_fs = self._manifest("").getFileSystem(self._conf)
        self._manifest_fs.mkdirs(self._manifest(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _manifest(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.manifests}/{name}" if name else self.manifests)

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._manifest_fs.listStatus(self._manifest(""))]
        return sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v\d+\.json", n))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "next_run", "schema", "runs": [{"run", "tier", "bytes", "files": [[path under root, bytes]]}]}"""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "next_run": 0, "schema": None, "runs": []}
        stream = self._manifest_fs.open(self._manifest(f"v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, change, tries: int = 20) -> dict:
        """change(manifest) -> manifest, against the newest version; None gives up."""
        fs = self._manifest_fs
        for _ in range(tries):
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old
            new["version"] = old["version"] + 1
            aside = self._manifest(f".aside-{uuid.uuid4().hex}")
            stream = fs.create(aside, False)
            stream.write(bytearray(json.dumps(new).encode()))
            stream.close()
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(fs.makeQualified(aside), fs.makeQualified(self._manifest(f"v{new['version']:08d}.json")), none)
                return new
            except Exception as x:
                fs.delete(aside, False)
                if "FileAlreadyExists" not in str(x):
                    raise
        raise RuntimeError("other writers kept taking the next version")

    def _files(self, folder: str) -> list[list]:
        if not self._fs.exists(self._path(folder)):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(folder))]
        return [[f"{folder}/{name}", size] for name, size in sorted(found) if name.startswith("part-")]

    def tier(self, size: int) -> int:
        """0 below small_bytes x fanout, then one for each factor of fanout."""
        out, limit = 0, self.small_bytes * self.fanout
        while size >= limit:
            out, limit = out + 1, limit * self.fanout
        return out

    def append(self, df: DataFrame, arrival: Column | None = None, arrivals: int = 1) -> dict:
        """Writes each arrival (a number) as a run of small shards, in one pass, and commits them together. Arrivals below
        ``arrivals`` that have no rows become empty runs."""
        name, folder = free_name("__arrival", df.columns), f"data/{uuid.uuid4().hex}"
        number = F.coalesce(arrival.cast("int"), F.lit(0)) if arrival is not None else F.lit(0)
        df.withColumn(name, number).write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        found = {f"{name}={k}" for k in range(arrivals)} | {s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()}
        numbers = sorted(int(n.rpartition("=")[2]) for n in found if n.startswith(f"{name}="))
        fresh = [self._files(f"{folder}/{name}={k}") for k in numbers]

        def change(m: dict) -> dict:
            m["schema"] = merged_schema(m["schema"], df.schema)
            for files in fresh:
                size = sum(n for _, n in files)
                m["runs"].append({"run": m["next_run"], "tier": self.tier(size), "bytes": size, "files": files})
                m["next_run"] += 1
            return m

        return self._commit(change)

    def _rows(self, files: list[list], schema: str) -> DataFrame:
        """The files with the store's columns; the manifest holds the schema, so no footer is opened for it."""
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{p}" for p, _ in files])

    def due(self, manifest: dict) -> list[list[dict]]:
        """The groups of ``fanout`` runs of one tier, oldest first, that can be merged side by side."""
        tiers: dict[int, list[dict]] = {}
        for run in sorted(manifest["runs"], key=lambda r: r["run"]):
            tiers.setdefault(run["tier"], []).append(run)
        return [runs[i : i + self.fanout] for _, runs in sorted(tiers.items()) for i in range(0, len(runs) - self.fanout + 1, self.fanout)]

    def compact(self, jobs: int = 8) -> dict:
        """Merges until no tier has ``fanout`` runs; ``jobs`` groups are written at a time."""
        while True:
            m = self.manifest()
            groups = self.due(m)
            if not groups:
                return m

            def merge(group: list[dict], schema: str = m["schema"]) -> list[list]:
                files = [f for r in group for f in r["files"]]
                folder, size = f"data/{uuid.uuid4().hex}", sum(n for _, n in files)
                if files:
                    self._rows(files, schema).coalesce(max(1, round(size / self.target_bytes))).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
                return self._files(folder)

            with ThreadPoolExecutor(jobs) as pool:
                merged = list(pool.map(merge, groups))

            def change(new: dict, done=tuple(zip(groups, merged))) -> dict | None:
                there, touched = {r["run"] for r in new["runs"]}, False
                for group, files in done:
                    gone = {r["run"] for r in group}
                    if gone <= there:  # else another compaction was first
                        size, touched = sum(n for _, n in files), True
                        new["runs"] = [r for r in new["runs"] if r["run"] not in gone]
                        new["runs"].append({"run": new["next_run"], "tier": max(group[0]["tier"] + 1, self.tier(size)), "bytes": size, "files": files})
                        new["next_run"] += 1
                return new if touched else None

            self._commit(change)

    def _every_file(self, folder: str) -> Iterator[tuple[str, int]]:
        """(path under root, age in seconds) of all files under the folder."""
        if self._fs.exists(self._path(folder)):
            top, now = self._fs.makeQualified(self._path("")).toString().rstrip("/"), time.time()
            each = self._fs.listFiles(self._path(folder), True)
            while each.hasNext():
                s = each.next()
                yield s.getPath().toString().removeprefix(f"{top}/"), now - s.getModificationTime() / 1000

    def vacuum(self, keep: int = 1, orphan_seconds: float = 86_400) -> int:
        """Deletes the shards that the newest ``keep`` versions don't name, and their number.

        Shards of older versions go at once. What no version names may belong to an append or merge that isn't committed
        yet; it goes, with manifests left aside, once it is older than ``orphan_seconds``.
        """
        versions = self._versions()
        kept, old = versions[-keep:], versions[:-keep]
        shards = lambda vs: {p for v in vs for r in self.manifest(v)["runs"] for p, _ in r["files"]}
        named, past = shards(kept), shards(old)
        gone = 0
        for path, age in list(self._every_file("data")):
            if path not in named and (path in past or age > orphan_seconds):
                self._fs.delete(self._path(path), False)
                gone += path.rpartition("/")[2].startswith("part-")
        for v in old:
            self._manifest_fs.delete(self._manifest(f"v{v:08d}.json"), False)
        for s in self._manifest_fs.listStatus(self._manifest("")):
            if s.getPath().getName().startswith(".aside-") and time.time() - s.getModificationTime() / 1000 > orphan_seconds:
                self._manifest_fs.delete(s.getPath(), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with their shard (run and place in it), its tier, and the version."""
        m = self.manifest(version)
        stored = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType()
        shard, tier, number, path = (free_name(n, stored.names) for n in ("shard", "tier", "version", "__file"))
        names = [(p.removeprefix("data/"), f"r{r['run']:04d}-{i:05d}", r["tier"]) for r in m["runs"] for i, (p, _) in enumerate(r["files"])]
        if not names:
            return self.spark.createDataFrame([], stored).withColumns({shard: F.lit(""), tier: F.lit(0), number: F.lit(m["version"])})
        table = self.spark.createDataFrame(names, f"`{path}` string, `{shard}` string, `{tier}` int")  # a row a file
        rows = self._rows([f for r in m["runs"] for f in r["files"]], m["schema"])
        # by path under data/: the runs of one append share the base names of their files
        out = rows.withColumn(path, F.substring_index("_metadata.file_path", "/data/", -1)).join(F.broadcast(table) if len(names) <= 100_000 else table, path)
        return out.select(*[F.col(f"`{c}`") for c in stored.names], shard, tier, F.lit(m["version"]).alias(number))


def merged_schema(old: str | None, new: T.StructType) -> str:
    """The store's columns and the arrival's new ones, as JSON. All are nullable."""
    fields = {f.name: f for f in T.StructType.fromJson(json.loads(old))} if old else {}
    lower = {n.lower(): n for n in fields}
    for f in new:
        known = lower.get(f.name.lower())
        if known is None:
            fields[f.name] = T.StructField(f.name, f.dataType, True)
        elif known != f.name or fields[known].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} is {known} {fields[known].dataType.simpleString()} in the store")
    return T.StructType(list(fields.values())).json()


def shard_documents(docs: DataFrame, root: str, arrivals: int = 8, id_col: str = "doc_id", **options) -> ShardStore:
    """Appends ``docs`` in ``arrivals`` runs dealt by a hash of the id, compacts and drops what was merged away."""
    store = ShardStore(docs.sparkSession, root, **options)
    store.append(docs, F.pmod(F.xxhash64(id_col), F.lit(arrivals)), arrivals)
    store.compact()
    store.vacuum()
    return store
