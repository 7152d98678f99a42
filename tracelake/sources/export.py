"""A sink for whole models: parts that tasks write, and a manifest that alone makes them an export.

``df.write.format("model_export")`` takes (section, value): a section's name and a
record as JSON.  A part is written under a name of its own by each attempt of a
task; the manifest names the parts of the attempts that Spark committed, with their
sizes, rows and hashes, and is moved into place at the end.  An export is there as a whole or not at all,
whichever executors are lost, and a folder never holds two.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from dataclasses import dataclass
from functools import reduce

import pyarrow.fs as fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
VERSION = 1


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    bytes: int
    sha256: str


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _there(store: fs.FileSystem, file: str) -> bool:
    return store.get_file_info(file).type != fs.FileType.NotFound


class ModelWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows) -> Part:
        store, folder = _store(self.path)
        store.create_dir(f"{folder}/parts", recursive=True)
        name, n, size, seen = f"parts/{uuid.uuid4().hex}.jsonl", 0, 0, hashlib.sha256()
        with store.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                line = json.dumps([row["section"], row["value"]], ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
                out.write(line)
                seen.update(line)
                n, size = n + 1, size + len(line)
        return Part(name, n, size, seen.hexdigest())

    def commit(self, messages) -> None:
        store, folder = _store(self.path)
        if not self.overwrite and _there(store, f"{folder}/{MANIFEST}"):
            self.abort(messages)
            raise FileExistsError(f"{self.path} has an export")
        parts = sorted((vars(m) for m in messages if m is not None and m.rows), key=lambda p: p["name"])
        told = json.dumps({"version": VERSION, "parts": parts}, sort_keys=True, separators=(",", ":"))
        body = json.dumps({"version": VERSION, "parts": parts, "sha256": hashlib.sha256(told.encode()).hexdigest()}, sort_keys=True)
        store.create_dir(folder, recursive=True)
        beside = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as out:
            out.write(body.encode())
        store.move(beside, f"{folder}/{MANIFEST}")
        self._clear(store, folder, {p["name"] for p in parts})

    def abort(self, messages) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None and _there(store, f"{folder}/{m.name}"):
                store.delete_file(f"{folder}/{m.name}")

    def _clear(self, store: fs.FileSystem, folder: str, kept: set[str]) -> None:
        """Deletes parts of lost attempts and of an export that was replaced."""
        for info in store.get_file_info(fs.FileSelector(f"{folder}/parts", allow_not_found=True)):
            if f"parts/{info.base_name}" not in kept:
                store.delete_file(info.path)


class ModelExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "model_export"

    def writer(self, schema: StructType, overwrite: bool) -> ModelWriter:
        if not {"section", "value"} <= set(schema.names):
            raise ValueError("an export takes the columns section and value")
        return ModelWriter(self.options["path"], overwrite)


def write_model(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Writes every row of every table as a record of its section; nulls are kept."""
    spark = next(iter(tables.values())).sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's own workers for sinks need not have this package
    spark.dataSource.register(ModelExport)
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) for name, df in tables.items()]
    reduce(DataFrame.union, rows).write.format("model_export").option("path", path).mode("overwrite" if overwrite else "append").save()


def manifest_of(path: str) -> dict:
    """The export's manifest; an error if there is none or if it was changed."""
    store, folder = _store(path)
    if not _there(store, f"{folder}/{MANIFEST}"):
        raise FileNotFoundError(f"{path} has no complete export")
    with store.open_input_stream(f"{folder}/{MANIFEST}") as stream:
        told = json.loads(stream.read())
    body = json.dumps({"version": told["version"], "parts": told["parts"]}, sort_keys=True, separators=(",", ":"))
    if hashlib.sha256(body.encode()).hexdigest() != told["sha256"]:
        raise ValueError(f"the manifest of {path} is not what was written")
    return told


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """section, value of the parts that the manifest names; other files in the folder are not read."""
    parts = manifest_of(path)["parts"]
    if not parts:
        return spark.createDataFrame([], "section string, value string")
    lines = spark.read.text([f"{path}/{p['name']}" for p in parts], lineSep="\n")
    pair = F.from_json("value", "array<string>")
    return lines.select(pair[0].alias("section"), pair[1].alias("value"))


def table_of(model: DataFrame, section: str, schema: StructType | str) -> DataFrame:
    """A section's records as a table."""
    return model.where(F.col("section") == section).select(F.from_json("value", schema).alias("x")).select("x.*")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """name, problem of parts that are not what the manifest says: 'missing' or 'altered'.  Executors hash them, a file at a time."""
    parts = manifest_of(path)["parts"]
    listed = spark.createDataFrame([(p["name"], p["sha256"]) for p in parts], "name string, sha256 string").repartition(max(1, len(parts)))

    def check(batches):
        import pandas as pd

        store, folder = _store(path)
        for batch in batches:
            rows = []
            for name, told in zip(batch["name"], batch["sha256"]):
                if not _there(store, f"{folder}/{name}"):
                    rows.append((name, "missing"))
                    continue
                seen = hashlib.sha256()
                with store.open_input_stream(f"{folder}/{name}") as stream:
                    while block := stream.read(1 << 20):
                        seen.update(block)
                if seen.hexdigest() != told:
                    rows.append((name, "altered"))
            yield pd.DataFrame(rows, columns=["name", "problem"], dtype="object")

    return listed.mapInPandas(check, "name string, problem string")
