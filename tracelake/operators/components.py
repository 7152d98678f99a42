"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.checkpoints import discard, written

#: A round's edges are written in files of so many or fewer: small tables are not spread over files of a few rows.
PER_FILE = 100_000


def components(edges: DataFrame, folder: str, max_rounds: int = 100) -> DataFrame:
    """node, class: for each node of the edges (a, b) the smallest node that it is connected with.

    Each star is a grouped minimum and a join, so a node with very many edges is
    never gathered in one place.  Every round is written to the shared folder and
    the one before it deleted; the number of rounds grows with the logarithm of
    the longest chain.  More than max_rounds of them are an error.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    k, n = 0, now.count()
    while n and not (k and stars(now)):
        if (k := k + 1) > max_rounds:
            raise RuntimeError(f"components are not complete after {max_rounds} rounds")
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = written(edges.coalesce(1 + n // PER_FILE), f"{folder}/{k}")  # not many more than there were
        discard(spark, f"{folder}/{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("class"))


def stars(edges: DataFrame) -> bool:
    """Does every edge lead from a node with no other edge to one that leads nowhere?"""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("met")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out + met > 1 and out > 0").isEmpty()
