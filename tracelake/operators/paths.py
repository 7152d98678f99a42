"""Shortest paths between many pairs of nodes, counted without being listed.

A search runs backwards from all goals at once: its frontier has a row for each
goal and node, with how many shortest paths lead from the node to the goal.  A
node that no origin reaches is never in it.  Counts add up along the edges that
lower the distance by one, parallel edges each; so the first paths in order can be
unranked, prefix by prefix, and a graph with 2**40 paths costs what its edges
cost.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.operators.checkpoints import Levels, scratch, written
from tracelake.operators.graph import reach

EXACT, NO_PATH, SEARCH_LIMIT, UNRESOLVED = "exact", "no-path", "search-limit", "unresolved"
COUNT = "decimal(38,0)"


class Traces(NamedTuple):
    """status: origin, goal, status, depth, n_paths (null beyond 38 digits); paths: origin, goal, nth (from 1), nodes, edges."""

    status: DataFrame
    paths: DataFrame


def distances(edges: DataFrame, goals: DataFrame, allowed: DataFrame | None, max_depth: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """goal, node, dist, n of all nodes that lead to a goal within max_depth edges, and the goals whose search the depth cut off.

    edges: src, dst, n (parallel edges); goals: node; allowed: the only nodes (node)
    that may be passed.  Each level is written once; a node met in an earlier level
    of its goal is dropped.
    """
    level = goals.select(F.col("node").alias("goal"), "node").distinct().withColumn("n", F.lit(1).cast(COUNT))
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("node").alias("src")), "src", "left_semi")
    spark = goals.sparkSession
    levels = Levels(spark, f"{folder}/levels", "dist")
    back = edges.select(F.col("src").alias("next"), F.col("dst").alias("node"), F.col("n").alias("times"))
    size = levels.add(level)["rows"]
    while size:
        seen = levels.all().select("goal", F.col("node").alias("next"))
        onward = levels.last().join(back, "node").join(seen, ["goal", "next"], "left_anti")
        if levels.n > max_depth:
            return levels.all(), written(onward.select("goal").distinct(), f"{folder}/cut")
        following = onward.groupBy("goal", "next").agg(F.try_sum(F.col("n") * F.col("times").cast("decimal(10,0)")).cast(COUNT).alias("n"))
        size = levels.add(following.select("goal", F.col("next").alias("node"), "n"))["rows"]
    return levels.all(), spark.createDataFrame([], level.select("goal").schema)


def unranked(steps: DataFrame, pairs: DataFrame, max_paths: int, folder: str) -> DataFrame:
    """origin, goal, nth, nodes, edges: the first max_paths paths of each pair (origin, goal, depth), in order of their nodes and then edges, step by step.

    steps: goal, src, dst, id, n, the edges that lower the distance to the goal,
    with the number of paths from dst on.  A prefix stands for all paths that
    begin with it; of those of a pair at most max_paths are kept, as each leads to
    a path, so hot nodes and very many paths cost no more.
    """
    now = pairs.select("origin", "goal", "depth", F.col("origin").alias("at"), F.lit(0).cast(COUNT).alias("before"), F.array("origin").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    now, done, k = written(now, f"{folder}/prefix0"), [], 0
    while True:
        done.append(now.where(F.col("depth") == k))
        going = now.where(F.col("depth") > k)
        if going.isEmpty():
            break
        k += 1
        onward = going.join(steps.withColumnsRenamed({"src": "at", "dst": "to"}), ["goal", "at"])
        own = Window.partitionBy("origin", "goal", "nodes", "edges").orderBy("to", "id")
        few = onward.withColumn("__nth", F.row_number().over(own)).where(F.col("__nth") <= max_paths)
        earlier = F.try_sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1))
        placed = few.withColumn("__before", F.when(F.col("__nth") == 1, F.lit(0).cast(COUNT)).otherwise(F.coalesce(earlier, F.lit(max_paths).cast(COUNT))) + F.col("before"))
        following = placed.where(F.col("__before") < max_paths).select("origin", "goal", "depth", F.col("to").alias("at"), F.col("__before").cast(COUNT).alias("before"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("id")).alias("edges"))
        now = written(following, f"{folder}/prefix{k}")
    found = reduce(DataFrame.unionAll, done)
    return found.select("origin", "goal", (F.col("before") + 1).cast("long").alias("nth"), "nodes", "edges")


def between(edges: DataFrame, pairs: DataFrame, entities: DataFrame | None = None, max_depth: int = 32, max_paths: int = 50, stored: bool = False) -> Traces:
    """The shortest paths of every pair (origin, goal) over directed edges (src, dst, id); parallel edges make different paths.

    entities (node): what may be an end; a pair with another, or with a null, is
    'unresolved'.  'search-limit' says that edges led on beyond max_depth and no
    path was found.  An origin that is its own goal has one path without edges.
    Repeated pairs are answered once.  Nodes and ids are strings.  Only edges from what
    the origins reach are merged and searched.  stored: the edges are files already and
    are not written again.
    """
    spark = edges.sparkSession
    folder = scratch(spark)
    asked = written(pairs.select("origin", "goal").distinct(), f"{folder}/pairs")
    good = asked.where("origin is not null and goal is not null")
    if entities is not None:
        known = entities.select("node").where("node is not null").distinct()
        for end in ("origin", "goal"):
            good = good.join(known.withColumnRenamed("node", end), end, "left_semi")
    edges = edges.select("src", "dst", "id").where("src is not null and dst is not null")
    edges = edges if stored else written(edges, f"{folder}/edges")
    ahead = written(reach(edges, good.select(F.col("origin").alias("node")), max_depth=max_depth, stored=True).select("node"), f"{folder}/ahead")
    # a goal's search passes only nodes that an origin reaches, so other edges are never looked at
    edges = written(edges.join(ahead.select(F.col("node").alias("src")), "src", "left_semi"), f"{folder}/inside")
    merged = written(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), f"{folder}/merged")
    found, cut = distances(merged, good.select(F.col("goal").alias("node")), None, max_depth, f"{folder}/levels")
    met = good.join(found.withColumnRenamed("node", "origin"), ["origin", "goal"])
    answered = asked.join(met.select("origin", "goal", F.col("dist").alias("depth"), F.col("n").alias("n_paths")), ["origin", "goal"], "left")
    answered = answered.join(good.withColumn("__good", F.lit(True)), ["origin", "goal"], "left").join(cut.distinct().withColumn("__cut", F.lit(True)), "goal", "left")
    status = F.when(F.col("depth").isNotNull(), EXACT).when(F.col("__good").isNull(), UNRESOLVED).when(F.col("__cut"), SEARCH_LIMIT).otherwise(NO_PATH)
    answered = written(answered.select("origin", "goal", status.alias("status"), "depth", "n_paths"), f"{folder}/status")
    low = found.select("goal", F.col("node").alias("dst"), "dist", "n")
    high = found.select("goal", F.col("node").alias("src"), (F.col("dist") - 1).alias("dist"))
    steps = written(edges.join(low, "dst").join(high, ["goal", "src", "dist"]).select("goal", "src", "dst", "id", "n"), f"{folder}/steps")
    return Traces(answered, unranked(steps, answered.where(F.col("status") == EXACT), max_paths, folder))


def between_instances(edges: DataFrame, composition: DataFrame, pairs: DataFrame, entities: DataFrame | None = None, max_depth: int = 32, max_paths: int = 50) -> Traces:
    """Traces between instances: an instance's own path if it has one, else those of all pairs of their endpoints.

    composition: instance, endpoint; pairs: origin, goal (instances).  The answer
    tells the instances as origin and goal; depth is that of the shortest path
    of any pair of endpoints, n_paths counts the paths of all of them.  Endpoints
    are searched only where the instances themselves have no path.
    """
    folder = scratch(edges.sparkSession)
    edges = written(edges.select("src", "dst", "id"), f"{folder}/edges")
    direct = between(edges, pairs, entities, max_depth, max_paths, stored=True)
    open_ = direct.status.where(~F.col("status").isin(EXACT, SEARCH_LIMIT)).select("origin", "goal", F.col("status").alias("own"))
    ends = composition.select("instance", "endpoint").distinct()
    inner = open_.join(ends.toDF("origin", "from"), "origin").join(ends.toDF("goal", "to"), "goal")
    inner = written(inner.select("origin", "goal", "from", "to"), f"{folder}/inner")
    traced = between(edges, inner.select(F.col("from").alias("origin"), F.col("to").alias("goal")), entities, max_depth, max_paths, stored=True)
    told = inner.join(traced.status.withColumnsRenamed({"origin": "from", "goal": "to"}), ["from", "to"])
    rolled = told.groupBy("origin", "goal").agg(F.bool_or(F.col("status") == EXACT).alias("exact"), F.bool_or(F.col("status") == SEARCH_LIMIT).alias("cut"), F.min("depth").alias("depth"), F.try_sum("n_paths").cast(COUNT).alias("n_paths"))
    # an instance without endpoints has no composition, and its own answer stays
    below = open_.join(rolled, ["origin", "goal"], "left").select(
        "origin", "goal", F.when(F.col("exact").isNull(), F.col("own")).when(F.col("exact"), EXACT).when(F.col("cut"), SEARCH_LIMIT).otherwise(NO_PATH).alias("status"), "depth", "n_paths"
    )
    status = direct.status.join(open_, ["origin", "goal"], "left_anti").unionByName(below)
    listed = inner.join(traced.paths.withColumnsRenamed({"origin": "from", "goal": "to"}), ["from", "to"])
    first = Window.partitionBy("origin", "goal").orderBy(F.size("edges"), "nodes", "edges")
    paths = listed.withColumn("nth", F.row_number().over(first).cast("long")).where(F.col("nth") <= max_paths).select("origin", "goal", "nth", "nodes", "edges")
    return Traces(status, direct.paths.unionByName(paths))
