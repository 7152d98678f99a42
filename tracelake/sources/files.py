"""Source files as tables: scans, discovery that says why, registries by content hash, bindings and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.scalars import glob

#: In this order the first folder that exists is the source root.
SOURCE_ROOTS = ["hw/bsv/src/", "bsv/src/", "src/"]


def scan(spark: SparkSession, roots: list[str], pattern: str = "*.bsv", exclude: tuple[str, ...] = (), max_files: int = 750, max_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """documents (path, content, revision) and what was left out (path, reason).

    The listing carries sizes and is classified without contents; the contents are
    then read with a filter on the size, which reaches the reader, so files that are
    too large are never opened.  The limit on files is a feature: the first by path,
    and the rest are told.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(roots)
    told = classify(listed.select("path", F.col("length").alias("bytes")), exclude, max_files, max_bytes)
    small = listed.where(F.col("length") <= max_bytes).select("path", "content")
    return taken(small, told), told.where("reason is not null")


def classified_documents(listed: DataFrame, exclude: tuple[str, ...], max_files: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The same for files (path, bytes, content) that are a table already."""
    told = classify(listed.select("path", "bytes"), exclude, max_files, max_bytes)
    return taken(listed, told), told.where("reason is not null")


def taken(contents: DataFrame, told: DataFrame) -> DataFrame:
    kept = contents.join(told.where("reason is null").select("path"), "path", "left_semi").withColumn("content", F.col("content").cast("string"))
    return kept.select("path", "content", F.sha2("content", 256).alias("revision"))


def classify(files: DataFrame, exclude: tuple[str, ...] = (), max_files: int = 750, max_bytes: int = 4 << 20, max_total: int | None = None) -> DataFrame:
    """path, bytes and reason: null for a file that is taken, else 'excluded', 'too-large', 'file-limit' or 'byte-limit'.

    Files over a limit are told in the order of their paths.  The order is global,
    so positions come from counts per folder and not from one sorted partition.
    """
    banned = F.lit(False)
    for pattern in exclude:
        banned = banned | F.col("path").rlike(glob(pattern))
    first = files.select("path", "bytes", F.when(banned, "excluded").when(F.col("bytes") > max_bytes, "too-large").alias("reason")).withColumn("folder", F.regexp_extract("path", "^(.*/)", 1))
    taken = first.where("reason is null")
    folders = taken.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("size"))
    earlier = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)  # one row a folder
    offsets = folders.select("folder", F.coalesce(F.sum("files").over(earlier), F.lit(0)).alias("files_before"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("folder").orderBy("path")
    placed = taken.join(offsets, "folder").select("path", (F.col("files_before") + F.row_number().over(inside)).alias("nth"), (F.col("bytes_before") + F.sum("bytes").over(inside)).alias("so_far"))
    over = F.when(F.col("nth") > max_files, "file-limit")
    if max_total is not None:
        over = F.coalesce(over, F.when(F.col("so_far") > max_total, "byte-limit"))
    return first.join(placed, "path", "left").select("path", "bytes", F.coalesce("reason", F.when(F.col("nth").isNotNull(), over)).alias("reason"))


def source_root(paths: DataFrame) -> str:
    """The first of SOURCE_ROOTS below which there is a file, else '.'."""
    ranks = F.coalesce(*(F.when(F.col("path").contains(r), i) for i, r in enumerate(SOURCE_ROOTS)))
    best = paths.agg(F.min(ranks)).first()[0]
    return "." if best is None else SOURCE_ROOTS[best].rstrip("/")


def netlist_candidates(files: DataFrame) -> DataFrame:
    """path, format and declared tops of files (path, content) that hold a netlist; others are no candidates."""
    j = F.from_json(F.col("content").cast("string"), "creator string, modules map<string, struct<attributes: map<string,string>>>")
    marked = F.map_keys(F.map_filter("j.modules", lambda _, m: F.coalesce(m["attributes"]["top"].rlike("^0*1$"), F.lit(False))))
    return files.withColumn("j", j).where("size(j.modules) > 0").select("path", F.lit("netlist-json").alias("format"), F.array_sort(marked).alias("tops"))


def freshness(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """path and state of every file of a manifest (path, revision) against what is there now: current, stale or unavailable."""
    now = current.select("path", F.col("revision").alias("now"))
    state = F.when(F.col("now").isNull(), "unavailable").when(F.col("now") == F.col("revision"), "current").otherwise("stale")
    return manifest.join(now, "path", "left").select("path", "revision", state.alias("state"))


def bound_by_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_path, right_path, status: files of equal content; exact if that holds for one file on either side, else ambiguous."""
    once = lambda df, name: df.groupBy("revision").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("path").alias(f"{name}_path"))
    both = once(left, "left").join(once(right, "right"), "revision")
    exact = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    return both.select("revision", F.when(exact, F.col("left_path")).alias("left_path"), F.when(exact, F.col("right_path")).alias("right_path"), F.when(exact, "exact").otherwise("ambiguous").alias("status"))


def unseen(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents whose (path, revision) the cache does not have: only these need to be parsed."""
    return documents.join(cache.select("path", "revision"), ["path", "revision"], "left_anti")


def snapshot(fields: dict[str, Column]) -> Column:
    """The fingerprint of a build's inputs."""
    from tracelake.functions.scalars import fingerprint

    return fingerprint(fields)
