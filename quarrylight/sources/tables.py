"""Scans that tolerate missing columns and tables, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may lack one and gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quarrylight-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over at least two tasks a core, before work that is heavy for each row.

    Files of few bytes can hold many rows, and their bytes alone decide how many tasks read them.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


class Scratch:
    """The written tables of one run, by name: a name that is written again, or freed, loses its old table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.free(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the schema's columns, cast to its types; absent ones are NULL."""
    present = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name.lower() in present else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table by schema; an empty one where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return with_columns(spark.read.parquet(path), schema)


def files_of(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified) of a folder's files, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"))


def newest_first(files: DataFrame, by: str) -> DataFrame:
    """(by, path) of the newest file of each, of equal times the last by name; one grouped maximum."""
    return files.groupBy(by).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def select_sources(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (name, path) whose name or root is wanted, whatever its case, and the wanted names without one."""
    keyed = files.select("name", "path", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("root")))).alias("key"))
    asked = wanted.select(F.btrim("name").alias("selector"), F.lower(F.btrim("name")).alias("key")).where("key <> ''").dropDuplicates(["key"])
    found = keyed.join(asked, "key").select("name", "path").distinct()
    return found, asked.join(keyed, "key", "left_anti").select("selector")


def changed_sources(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (path, content) whose hash the ledger (path, content_hash) doesn't hold."""
    hashed = files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.join(ledger.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
