"""Streams: only changed sources, only the latest revision, freshness against a manifest.

State is kept by Structured Streaming in its own checkpoints; every function
takes a streaming or a static DataFrame alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_stream(spark: SparkSession, folder: str, pattern: str = "*.bsv") -> DataFrame:
    """path, revision, content and at (when it was changed) of files as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    text = F.col("content").cast("string")
    return rows.select("path", F.sha2(text, 256).alias("revision"), text.alias("content"), F.col("modificationTime").alias("at"))


def changed(sources: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (path, revision) once; those older than the delay are forgotten."""
    once = sources.withWatermark("at", delay)
    return once.dropDuplicatesWithinWatermark(["path", "revision"]) if sources.isStreaming else sources.dropDuplicates(["path", "revision"])


def latest(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the highest revision per key; with ties, of the greatest row."""
    rest = [c for c in rows.columns if c not in (key, revision)]
    return rows.groupBy(key).agg(F.max(F.struct(revision, *rest)).alias("x")).select(key, "x.*")


def publish_latest(rows: DataFrame, key: str, revision: str, path: str, checkpoint: str):
    """A query that keeps a table with the latest valid row per key; older revisions that arrive late change nothing.

    A batch is joined with what is published and written beside it; the table's
    newest folder counts, so a batch that runs again gives the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = published(spark, path, number)
        both = batch if before is None else batch.unionByName(before)
        latest(both, key, revision).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def published(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What is published, or was before a batch; None if nothing is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return None
    numbers = [int(s.getPath().getName().partition("=")[2]) for s in store.listStatus(hadoop) if s.getPath().getName().startswith("batch=") and store.exists(s.getPath().suffix("/_SUCCESS"))]
    done = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={max(done)}") if done else None


def with_freshness(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """A stream of (path, revision) against a static manifest: current, stale or unknown."""
    known = manifest.select("path", F.col("revision").alias("expected"))
    state = F.when(F.col("expected").isNull(), "unknown").when(F.col("expected") == F.col("revision"), "current").otherwise("stale")
    return rows.join(known, "path", "left").withColumn("state", state).drop("expected")


def run_until_done(writer, seconds: int = 60, interrupt: Callable[[], bool] | None = None) -> bool:
    """Runs what is there now and stops at a deadline or when told to; False if it did not finish."""
    query = writer.trigger(availableNow=True).start()
    for _ in range(seconds * 2):
        if query.awaitTermination(0.5):
            return True
        if interrupt is not None and interrupt():
            break
    query.stop()
    return False
