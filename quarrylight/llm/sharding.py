"""A table of immutable shards under versioned manifests, kept in shape by size-tiered compaction."""

from __future__ import annotations

import json
import math
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Shard(NamedTuple):
    """One immutable Parquet file, by its path below the store."""

    file: str
    rows: int
    size: int


def _file() -> Column:
    """The shard that a row is read from, by its path below the store; names alone repeat between folders."""
    return F.regexp_extract(F.input_file_name(), r"(data/[0-9a-f]{32}/.*)$", 1)


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Append-only shards with an atomically committed manifest per version.

    ``append`` adds each file that Spark writes as a small shard. ``compact`` merges shards of like
    size into files of about ``target`` bytes. Readers see one version whole; a job that fails, or
    loses executors for good, leaves files that no manifest names and ``vacuum`` deletes them once
    they are old enough not to be another writer's. Two writers can't commit one version: the later
    one starts again from the version that the other has made.
    The manifest has a line for each file, so it grows with the files and not with the rows.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = 256 << 20, fan: int = 4, smallest: int = 1 << 20):
        self.spark, self.path, self.target, self.fan, self.smallest = spark, path.rstrip("/"), target, fan, smallest
        self._conf = spark._jsc.hadoopConfiguration()

    # -- files ---------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path("data").getFileSystem(self._conf)

    def _names(self, folder: str) -> dict[str, int]:
        at, fs = self._path(folder), self._fs()
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(at)} if fs.exists(at) else {}

    # -- manifests -----------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version; 0 for a store without one."""
        return max((int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[T.StructType | None, list[Shard]]:
        """Schema and shards of a version, the newest if none is named."""
        version = self.version() if version is None else version
        if not version:
            return None, []
        stream = self._fs().open(self._path("manifests", f"v{version:012d}.json"))
        try:
            lines = bytes(stream.readAllBytes()).decode().splitlines()
        finally:
            stream.close()
        return T.StructType.fromJson(json.loads(lines[0])), [Shard(*json.loads(line)) for line in lines[1:]]

    def _commit(self, after: int, schema: T.StructType, shards: list[Shard]) -> int:
        """Write version ``after + 1`` whole under another name, then rename it; no second writer can."""
        jvm, fs = self.spark._jvm, self._fs()
        hidden, named = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"v{after + 1:012d}.json")
        text = "\n".join([json.dumps(schema.jsonValue()), *(json.dumps(s) for s in sorted(shards))])
        stream = fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(named.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hidden, named, options)
        except Exception as error:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {after + 1} exists") from error
            raise
        return after + 1

    # -- shards --------------------------------------------------------------------------------

    def _write(self, df: DataFrame, by: str | None = None) -> dict[str | None, list[Shard]]:
        """Write a new folder of files, with one below it for each value of ``by``; those with rows are shards.

        Their rows are counted by a scan without columns, which reads the files' footers only.
        """
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{folder}")
        values = [n for n in self._names(folder) if n.startswith(f"{by}=")] if by else [None]
        out: dict[str | None, list[Shard]] = {}
        places = {}
        for value in values:
            at = folder if value is None else f"{folder}/{value}"
            places |= {f"{at}/{n}": (value, size) for n, size in self._names(at).items() if n.endswith(".parquet")}
        if not places:
            return out
        paths = sorted({f"{self.path}/{file.rsplit('/', 1)[0]}" for file in places})
        fields = T.StructType([f for f in df.schema if f.name != by])
        files = self.spark.read.schema(fields).parquet(*paths).select(_file().alias("file")).groupBy("file").count()
        for file, rows in files.collect():  # a row for each file
            value, size = places[file]
            out.setdefault(None if value is None else value.split("=", 1)[1], []).append(Shard(file, rows, size))
        return out

    def _add(self, schema: T.StructType, shards: list[Shard]) -> int:
        """Commit shards on top of the newest version, whichever that is by now."""
        while True:
            version = self.version()
            known, old = self.manifest(version)
            if known is not None and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"columns {schema.simpleString()} differ from the store's {known.simpleString()}")
            try:
                return self._commit(version, known or schema, old + shards)
            except Conflict:
                continue

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df``; the files that Spark writes become shards of the next version."""
        known, _ = self.manifest()
        if known is not None and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"columns {df.schema.simpleString()} differ from the store's {known.simpleString()}")
        return self._add(df.schema, self._write(df).get(None, []))

    def tier(self, size: int) -> int:
        return 0 if size <= self.smallest else int(math.log(size / self.smallest, self.fan)) + 1

    def merges(self, shards: list[Shard]) -> list[list[Shard]]:
        """What to merge: within a tier of ``fan`` shards or more, runs of like size up to the target."""
        tiers: dict[int, list[Shard]] = {}
        for shard in shards:
            if shard.size < self.target * 3 // 4:
                tiers.setdefault(self.tier(shard.size), []).append(shard)
        out = []
        for of_tier in tiers.values():
            if len(of_tier) < self.fan:
                continue
            run: list[Shard] = []
            for shard in sorted(of_tier, key=lambda s: (s.size, s.file)):
                if run and sum(s.size for s in run) + shard.size > self.target:
                    out.append(run)
                    run = []
                run.append(shard)
            out.append(run)
        return [run for run in out if len(run) > 1]

    def compact(self) -> int:
        """Merge until no tier has ``fan`` shards to merge; each round is one job and one version.

        The rows of a run, which are at most about the target, go to one task that writes one file,
        so a round uses as many tasks as there are runs. If another writer commits meanwhile, the
        round is done again from that writer's version.
        """
        while True:
            version = self.version()
            schema, shards = self.manifest(version)
            runs = self.merges(shards)
            if not runs:
                return version
            of = [(s.file, k) for k, run in enumerate(runs) for s in run]
            name, run = "_shard_file", "_shard_run"
            numbers = F.broadcast(self.spark.createDataFrame(of, f"{name} string, {run} int"))  # a row for each file
            read = self._read(schema, [s for run in runs for s in run]).withColumn(name, _file())
            merged = self._write(read.join(numbers, name).drop(name).repartition(len(runs), run), run)
            gone = {s.file: s.rows for run in runs for s in run}
            if sum(gone.values()) != sum(s.rows for new in merged.values() for s in new):
                raise RuntimeError("a merge has not written the rows that it read; nothing is committed")
            try:
                self._commit(version, schema, [s for s in shards if s.file not in gone] + [s for new in merged.values() for s in new])
            except Conflict:
                for s in (s for new in merged.values() for s in new):
                    self._fs().delete(self._path(s.file), False)

    def vacuum(self, keep: int = 1, older: float = 86_400) -> None:
        """Delete manifests but the newest ``keep``, and the files that none of these names and that
        are ``older`` seconds old: younger ones may be a running writer's, or be read still."""
        newest, fs, before = self.version(), self._fs(), (time.time() - older) * 1000
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {s.file for v in kept for s in self.manifest(v)[1]}
        for status in fs.listStatus(self._path("manifests")) if fs.exists(self._path("manifests")) else []:
            name = status.getPath().getName()
            if status.getModificationTime() <= before and (not name.startswith("v") or int(name[1:-5]) not in kept):
                fs.delete(status.getPath(), False)

        def clear(folder: str) -> bool:
            """Whether nothing is left in a folder after its old, unnamed files have gone."""
            left = False
            for status in fs.listStatus(self._path(folder)):
                at = f"{folder}/{status.getPath().getName()}"
                if status.isDirectory():
                    left |= not clear(at)
                elif at in named or status.getModificationTime() > before:
                    left = True
            if not left:
                fs.delete(self._path(folder), True)
            else:
                for status in fs.listStatus(self._path(folder)):
                    at = f"{folder}/{status.getPath().getName()}"
                    if not status.isDirectory() and at.endswith(".parquet") and at not in named and status.getModificationTime() <= before:
                        fs.delete(status.getPath(), False)
            return not left

        for folder in self._names("data"):
            clear(f"data/{folder}")

    def _read(self, schema: T.StructType, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.file}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("the store has no version yet")
        return self._read(schema, shards) if shards else self.spark.createDataFrame([], schema)


def compacted(docs: DataFrame, path: str, id_col: str = "doc_id", arrivals: int = 4, target: int = 64 << 20) -> ShardStore:
    """Write ``docs`` as ``arrivals`` batches by id hash in one job, and commit and compact one after the other.

    All columns and rows are kept as they are: nulls, empty and long texts, repeated rows. An empty
    table gives a store with a schema and no shards. Null ids arrive together with one of the hash
    classes.
    """
    store = ShardStore(docs.sparkSession, path, target)
    batch = "_arrival"
    arrived = store._write(docs.withColumn(batch, F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals))), batch)  # one scan
    for k in range(arrivals):
        store._add(docs.schema, arrived.get(str(k), []))
        store.compact()
    store.vacuum(older=0)  # nobody else writes to this store
    return store
