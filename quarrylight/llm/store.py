"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only if its counted rows, by their width, stay below this.
BROADCAST_BYTES = 32 << 20
#: Without this, a finished job's shuffle files stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may lack one and gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quarrylight-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table this run has written and no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet and read it back: cuts lineage and outlives lost executors.

    The shuffle files of the write go as soon as it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = work_dir(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``save`` for callers that keep the table to the end of the query."""
    return save(df, name)[0]


class Scratch:
    """The intermediate tables of one run, by name: a name written again, or freed, loses its old table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        table, path = save(df, name)
        self.free(name)
        self.paths[name] = path
        return table

    def free(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop(self.spark, path)


def light(df: DataFrame, width: int) -> bool:
    """Whether the table's rows of about ``width`` bytes, counted, may be broadcast."""
    return df.count() * width <= BROADCAST_BYTES


def apart(taken: set[str], name: str) -> str:
    """``name``, longer where a column already has it, so that own columns never clash with those of the input."""
    while name in taken:
        name += "_"
    return name
