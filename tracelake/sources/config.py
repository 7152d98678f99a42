"""Configuration files: JSON with comments, as rows with every default filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """version int, title string, sourceRoots array<string>, exclude array<string>, entrypoints array<string>,
  groups array<struct<match: string, id: string, order: int>>,
  view struct<direction: string, showImports: boolean, showPackages: boolean, showPrimitives: boolean>"""
# A string, kept; or a comment to the end of its line, or up to its end or that of the text.
COMMENTS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)'
# What a configuration says that does not say otherwise.
VERSION, TITLE, DIRECTION = 1, "BSV Architecture", "LR"


def without_comments(text: Column) -> Column:
    """Text without // and /* */ comments; what looks like one inside a string stays."""
    return F.regexp_replace(text, COMMENTS, "$1")


def names(values: Column) -> Column:
    """Values trimmed, without empty and repeated ones, in order; an empty list for none."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def configured(texts: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """path, problem and the settings of configurations (path, value): version, title, source_roots, exclude, entrypoints, groups, direction, imports, packages, primitives.

    problem is 'unparsable' for a text that is no JSON object once its comments are
    gone; its settings are the defaults.  excluded comes before what a file
    excludes.  Groups without a pattern are left out, one without a name has its
    pattern as name, one without an order its place; they come in their order.
    """
    plain = without_comments(F.coalesce("value", F.lit("")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    parsed = texts.select("path", F.from_json(plain, f"{SCHEMA}, bad string", options).alias("c"))
    c = lambda name: F.col(f"c.{name}")
    filled = F.transform(F.coalesce(c("groups"), F.array().cast("array<struct<match: string, id: string, order: int>>")), lambda g, i: F.struct(F.coalesce(g["order"], i).alias("order"), i.alias("at"), g["match"].alias("match"), F.coalesce(F.nullif(F.trim(g["id"]), F.lit("")), g["match"]).alias("id")))
    groups = F.transform(F.array_sort(F.filter(filled, lambda g: F.trim(g["match"]) != "")), lambda g: F.struct(g["match"], g["id"], g["order"]))
    view = lambda name: F.coalesce(F.col(f"c.view.{name}"), F.lit(False))
    return parsed.select(
        "path",
        F.when(F.col("c").isNull() | c("bad").isNotNull(), "unparsable").alias("problem"),
        F.coalesce(c("version"), F.lit(VERSION)).alias("version"),
        F.coalesce(F.nullif(F.trim(c("title")), F.lit("")), F.lit(TITLE)).alias("title"),
        names(c("sourceRoots")).alias("source_roots"),
        names(F.concat(F.array(*map(F.lit, excluded or [])).cast("array<string>"), F.coalesce(c("exclude"), F.array().cast("array<string>")))).alias("exclude"),
        names(c("entrypoints")).alias("entrypoints"),
        groups.alias("groups"),
        F.when(F.col("c.view.direction") == "TB", "TB").otherwise(DIRECTION).alias("direction"),
        view("showImports").alias("imports"), view("showPackages").alias("packages"), view("showPrimitives").alias("primitives"),
    )


def read_configurations(spark: SparkSession, path: str, excluded: list[str] | None = None) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return configured(whole, excluded)
