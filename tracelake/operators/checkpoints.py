"""Intermediate tables in the shared folder, so that loops start each round from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session takes a temporary folder of its own; on a
    cluster that is an error, as no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracelake-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table, written once as Parquet and read back: later stages start from files, not from its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Levels:
    """A table that grows by one level a round: each is written once, in a folder of its own, and all are read as one table."""

    def __init__(self, spark: SparkSession, path: str, number: str):
        self.spark, self.path, self.number, self.schema, self.n = spark, path, number, None, 0

    def add(self, level: DataFrame, **sums: Column) -> dict[str, int]:
        """Writes the next level; how many rows it has (`rows`) and the sums of columns over them come with the write, without a job of their own."""
        seen = Observation()
        self.schema = level.schema
        level.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(n) for n, c in sums.items())).write.mode("overwrite").parquet(f"{self.path}/{self.number}={self.n}")
        self.n += 1
        return {k: int(v or 0) for k, v in seen.get.items()}

    def last(self, k: int = 1) -> DataFrame:
        """The last k levels, with their numbers."""
        held = range(max(0, self.n - k), self.n)
        read = self.spark.read.schema(StructType([*self.schema.fields, StructField(self.number, IntegerType())]))
        return read.option("basePath", self.path).parquet(*(f"{self.path}/{self.number}={i}" for i in held))

    def all(self) -> DataFrame:
        return self.last(self.n)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later round reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
