"""A kept inverted index, partitioned by source, that is brought up to date source by source."""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.python_udfs import term_counts_of
from quarrylight.operators import search as S

BLOCKS = "term string, keys array<string>, tfs array<bigint>, n long, total long, source string"
#: A task writes its lists of keys as soon as they hold so many.
HELD = 1_000_000
NODES = "key string, kind string, name string, source string"
LEDGER = "source string, content_hash string, batch long, state string, message string"


def posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (source, key, text) in, a row for each term of a source out: the keys that have it, how often, and both summed up.

    A source has many rows for a term, one for each time that what is held is written.
    """
    codes, number = {}, itertools.count()  # by source, a number for each of its terms
    keys, sizes, ids, tfs = [], [], array("q"), array("q")

    def block() -> pa.RecordBatch:
        given = np.concatenate([np.fromiter(of.values(), np.int64, len(of)) for of in codes.values()])
        owners = np.repeat(np.arange(len(codes)), [len(of) for of in codes.values()])
        by_code, flat, often = np.argsort(given), np.asarray(ids), np.asarray(tfs)
        together = np.argsort(flat, kind="stable")
        n = np.bincount(flat)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        of_row = np.repeat(np.arange(len(keys)), sizes)[together]
        total = np.add.reduceat(often[together], np.cumsum(n) - n)
        columns = [
            pa.array([t for of in codes.values() for t in of], pa.string()).take(pa.array(by_code)), pa.ListArray.from_arrays(ends, pa.array(keys, pa.string()).take(pa.array(of_row))),
            pa.ListArray.from_arrays(ends, pa.array(often[together])), pa.array(n), pa.array(total), pa.array(list(codes), pa.string()).take(pa.array(owners[by_code])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "keys", "tfs", "n", "total", "source"])

    for batch in batches:
        for source, key, text in zip(*(batch.column(c).to_pylist() for c in ("source", "key", "text")), strict=True):
            if not (counts := term_counts_of(text or "")):
                continue
            if source not in codes:
                codes[source] = defaultdict(number.__next__)
            keys.append(key)
            sizes.append(len(counts))
            ids.extend(map(codes[source].__getitem__, counts))
            tfs.extend(counts.values())
            if len(ids) >= HELD:
                yield block()
                codes, number = {}, itertools.count()
                keys, sizes, ids, tfs = [], [], array("q"), array("q")
    if keys:
        yield block()


class KeptIndex:
    """Tables below one folder: postings and nodes by source, and a ledger of what was indexed.

    The ledger gets its rows last, so an update that was cut short is done again by the next one.
    Postings are blocks: a row holds many keys of a term, so few rows move, sort and are read. They are
    sorted by term within a source, so a search reads the row groups of its terms only. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, path, fs.exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        # files are listed anew on each call, as an update changes them
        if not self._there(name)[2] or not self._sources(name) and name != "ledger":
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _sources(self, name: str) -> dict[str, str]:
        """Folder name of each source's partition."""
        fs, path, there = self._there(name)
        found = [s.getPath().getName() for s in fs.listStatus(path)] if there else []
        return {unquote(f.removeprefix("source=")): f for f in found if f.startswith("source=")}

    def postings(self) -> DataFrame:
        """(key, term, tf, source), a row for each key and term."""
        each = self._read("postings", BLOCKS).select("term", "source", F.explode(F.arrays_zip("keys", "tfs")).alias("x"))
        return each.select(F.col("x.keys").alias("key"), "term", F.col("x.tfs").alias("tf"), "source")

    def terms(self) -> DataFrame:
        """(term, df, tf) over all sources, from the blocks' own counts."""
        return self._read("postings", BLOCKS).groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("tf"))

    def nodes(self) -> DataFrame:
        return self._read("nodes", NODES)

    def ledger(self) -> DataFrame:
        """The last row of each source."""
        rows = self._read("ledger", LEDGER)
        last = rows.groupBy("source").agg(F.max_by(F.struct("content_hash", "batch", "state", "message"), "batch").alias("r"))
        return last.select("source", "r.*")

    def _note(self, rows: list[tuple]) -> None:
        batch = (self._read("ledger", LEDGER).agg(F.max("batch")).first()[0] or 0) + 1
        noted = self.spark.createDataFrame([(s, h, batch, state, message) for s, h, state, message in rows], LEDGER)
        noted.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def changed(self, files: DataFrame) -> DataFrame:
        """Of files (source, content_hash) those that the ledger doesn't hold as they are."""
        known = self.ledger().where("state = 'indexed'").select("source", "content_hash")
        return files.join(known, ["source", "content_hash"], "left_anti")

    def replace(self, rows: DataFrame, sources: list[str], hashes: dict[str, str] | None = None) -> None:
        """The given sources hold exactly ``rows`` (source, key, kind, name, text) from now on.

        Rows of other sources are not taken. A key counts once in a source, by its greatest row; null
        keys are left out, a null text has no terms. A source without rows loses its partition.
        """
        mine = rows.where(F.col("source").isin(sources) & F.col("key").isNotNull())
        # the greatest kind and name are those of the greatest row, so nodes need no texts
        nodes = mine.groupBy("source", "key").agg(F.max(F.struct("kind", "name")).alias("r")).select("key", "r.*", "source")
        one = mine.groupBy("source", "key").agg(F.max(F.struct("kind", "name", "text")).alias("r")).select("source", "key", "r.text")
        held = {r[0] for r in self._write(nodes, "nodes", "key")}
        filled = {r[0] for r in self._write(one.mapInArrow(posting_blocks, BLOCKS), "postings", "term")}
        for source in sources:
            for name, written in (("nodes", held), ("postings", filled)):
                if source not in written:
                    self._drop(name, source)
        self._note([(s, (hashes or {}).get(s), "indexed", None) for s in sources])

    def _write(self, rows: DataFrame, name: str, order: str) -> list:
        """Overwrites the partitions that ``rows`` have, and names them. A hot source spans many tasks."""
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        # written before they are ranged: ranges are found by a pass of their own
        rows.write.parquet(staged)
        again = self.spark.read.schema(rows.schema).parquet(staged)
        found = again.select("source").distinct().collect()
        if found:
            again.repartitionByRange("source", order).sortWithinPartitions("source", order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.path}/{name}")
        fs, path, _ = self._there(staged.removeprefix(f"{self.path}/"))
        fs.delete(path, True)
        return found

    def _drop(self, name: str, source: str) -> None:
        if folder := self._sources(name).get(source):
            fs, path, _ = self._there(f"{name}/{folder}")
            fs.delete(path, True)

    def update(self, files: list[tuple[str, str]], load: Callable[[str], DataFrame]) -> dict[str, str]:
        """Index the sources of (source, content_hash) that changed, and say what became of each.

        All go in one job. If that fails, each goes by itself, so that one bad source holds up no
        other; its old rows stay, and its ledger row says why. ``load`` gives a source's rows.
        """
        if not files:
            return {}
        table = self.spark.createDataFrame(files, "source string, content_hash string")
        todo = {r.source: r.content_hash for r in self.changed(table).collect()}
        said = {s: "unchanged" for s, _ in files if s not in todo}
        try:
            if todo:
                self.replace(reduce(DataFrame.unionByName, [load(s).withColumn("source", F.lit(s)) for s in todo]), list(todo), todo)
            return said | dict.fromkeys(todo, "indexed")
        except Exception:  # noqa: BLE001  whatever it is, it is noted for the source that has it
            for source, digest in todo.items():
                try:
                    self.replace(load(source).withColumn("source", F.lit(source)), [source], {source: digest})
                    said[source] = "indexed"
                except Exception as error:  # noqa: BLE001
                    self._note([(source, digest, "failed", str(error)[:500])])
                    said[source] = "failed"
            return said

    def delete(self, prefix: str) -> list[str]:
        """Take out all sources of a name or of the names below it (``prefix:...``)."""
        gone = sorted(s for s in {*self._sources("nodes"), *self._sources("postings")} if s == prefix or s.startswith(f"{prefix}:"))
        for source in gone:
            self._drop("postings", source)
            self._drop("nodes", source)
        if gone:
            self._note([(s, None, "deleted", None) for s in gone])
        return gone

    def reset(self) -> None:
        """Nothing is indexed, and nothing remembered."""
        for name in ("postings", "nodes", "ledger"):
            fs, path, there = self._there(name)
            if there:
                fs.delete(path, True)

    def search(self, terms: list[str], limit: int = 300) -> DataFrame:
        """(key, score, matched) of the best nodes; only the postings of the terms are read."""
        hits = self.postings().where(F.col("term").isin(terms))
        return S.search(hits, terms, self.nodes().agg(F.count("*").alias("n")), "key", limit)
