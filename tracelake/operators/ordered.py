"""Running sums over a total order of a whole table, without one task for all rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.operators.checkpoints import written


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], folder: str) -> DataFrame:
    """The rows with, for each name, the sum of its column over all rows before in the order.

    Rows are dealt by ranges of the order; within a range a window sums, and what
    lies in the ranges before is added from a table with a row for each range.
    Rows that the order does not tell apart stand in any order.
    """
    spark = rows.sparkSession
    rows = written(rows.select("*", *(c.cast("decimal(38,0)").alias(f"__{n}") for n, c in sums.items())), f"{folder}/rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), f"{folder}/dealt")
    totals = {r["__range"]: r for r in dealt.groupBy("__range").agg(*(F.sum(f"__{n}").alias(n) for n in sums)).collect()}
    so_far, before = {n: 0 for n in sums}, []
    for k in sorted(totals):
        before.append((k, *map(Decimal, so_far.values())))
        so_far = {n: so_far[n] + int(totals[k][n] or 0) for n in sums}
    offsets = spark.createDataFrame(before, "__range int" + "".join(f", __before_{n} decimal(38,0)" for n in sums))
    earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(F.broadcast(offsets), "__range")
    added = {n: (F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)) + F.col(f"__before_{n}")).cast("long") for n in sums}
    return summed.withColumns(added).drop("__range", *(f"__{n}" for n in sums), *(f"__before_{n}" for n in sums))
