"""A published table that streams keep up to date: rows in hash buckets, of which a batch rewrites those that it touches.

A batch's buckets are written beside the others, then a log entry of the batch says which folder
each bucket has from now on.  Readers take the newest entry, so they see a batch
as a whole or not at all, and a batch that runs again starts from the entry before it and
gives the same.  Folders that none of the last entries names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.checkpoints import discard
from tracelake.streaming.incremental import latest

KEPT = 3


class Published:
    """path: the table's folder; key, revision: columns; buckets: how many parts, fixed when the table begins."""

    def __init__(self, spark: SparkSession, path: str, key: str, revision: str, buckets: int = 64):
        self.spark, self.path, self.key, self.revision = spark, path.rstrip("/"), key, revision
        self.store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        held = self.entry()
        self.buckets = held["buckets"] if held else buckets

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _batches(self) -> list[int]:
        if not self.store.exists(self._at("log")):
            return []
        names = [s.getPath().getName() for s in self.store.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def entry(self, before: int | None = None) -> dict | None:
        """The newest log entry, or the newest before a batch: batch, buckets, schema, folders (bucket: batch that wrote it)."""
        held = [b for b in self._batches() if before is None or b < before]
        return json.loads(self.spark.read.text(f"{self.path}/log/{held[-1]}.json", wholetext=True).first()[0]) if held else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The published rows, of all buckets or of some; None if nothing is published."""
        held = self.entry(before)
        if held is None:
            return None
        folders = [f"{self.path}/data/batch={b}/bucket={k}" for k, b in sorted(held["folders"].items()) if only is None or int(k) in only]
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, number: int, valid: Column | None = None) -> None:
        """Publishes a batch: of each key the row with the highest revision, old or new.

        Rows that are not valid, and those without key or revision, are written to
        rejected/ and change nothing.  Only touched buckets are read and written; which
        these are comes to the driver, at most as many numbers as there are buckets.
        """
        sound = F.col(self.key).isNotNull() & F.col(self.revision).isNotNull()
        sound = F.coalesce(sound if valid is None else sound & valid, F.lit(False))
        rows = batch.withColumn("__sound", sound)
        rows.where("not __sound").drop("__sound").write.mode("overwrite").parquet(f"{self.path}/rejected/batch={number}")
        staged = f"{self.path}/staged/batch={number}"
        new = latest(rows.where("__sound").drop("__sound"), self.key, self.revision)
        new.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        held = self.entry(before=number)
        touched = [int(s.getPath().getName()[7:]) for s in self.store.listStatus(self._at(f"staged/batch={number}")) if s.getPath().getName().startswith("bucket=")]
        if touched:
            fresh = self.spark.read.schema(new.schema).parquet(*(f"{staged}/bucket={k}" for k in touched))
            old = self.read(before=number, only=touched) if held else None
            both = fresh if old is None else fresh.unionByName(old)
            merged = latest(both, self.key, self.revision).withColumn("bucket", self.bucket())
            merged.repartition(min(self.buckets, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        folders = (held["folders"] if held else {}) | {str(k): number for k in touched}
        self._log(number, {"batch": number, "buckets": self.buckets, "schema": json.loads(new.schema.json()), "folders": folders})
        discard(self.spark, staged)
        self._clear()

    def _log(self, number: int, entry: dict) -> None:
        beside, there = self._at(f"log/.{number}.tmp"), self._at(f"log/{number}.json")
        out = self.store.create(beside, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self.store.delete(there, False)
        self.store.rename(beside, there)

    def _clear(self) -> None:
        """Deletes bucket folders that none of the last entries names, and older entries."""
        batches = self._batches()
        gone = batches[:-KEPT]
        if not gone:
            return
        named = {(int(k), b) for n in batches[-KEPT:] for k, b in self.entry(before=n + 1)["folders"].items()}
        old = {(int(k), b) for n in gone for k, b in self.entry(before=n + 1)["folders"].items()}
        for k, b in old - named:
            discard(self.spark, f"{self.path}/data/batch={b}/bucket={k}")
        for n in gone:
            self.store.delete(self._at(f"log/{n}.json"), False)

    def stream(self, rows: DataFrame, checkpoint: str, valid: Column | None = None):
        """A writer that publishes every batch of a stream."""
        return rows.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number, valid)).option("checkpointLocation", checkpoint).outputMode("append")
