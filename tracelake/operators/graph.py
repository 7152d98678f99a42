"""Graph questions over edge tables (src, dst): traversal, paths, hierarchies, cones and cycles.

A traversal keeps its frontier and what it has visited in tables and advances by
joins, one level a round; each round is written to the shared folder.  Every
bounded question says where it stopped: a frontier row per node at which a limit
cut it off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.checkpoints import Levels, scratch, written
from tracelake.operators.ordered import running

COMPLETE, PARTIAL, EMPTY = "complete", "partial", "empty"


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, stop: DataFrame | None = None, undirected: bool = False, until: str | None = None, stored: bool = False) -> DataFrame:
    """node, depth, reason of every node that is reached from the seeds (node); depth is the least number of edges.

    stop: nodes that are reached but not left.  until: no level after that of this
    node is looked at.  allowed nodes are a matter of the
    edges passed in.  reason is null for a node whose edges were followed, and
    says otherwise why they were not: 'stop', 'depth', or 'budget' when the next
    level would exceed max_nodes.  A node without edges has reason null.  stored: the
    edges are files already and are not written again.  Parallel edges do no harm, as a
    level has each node once.
    """
    spark = edges.sparkSession
    folder = scratch(spark)
    edges = edges.select("src", "dst") if stored else written(edges.select("src", "dst"), f"{folder}/edges")
    if undirected:
        edges = edges.union(edges.select("dst", "src"))
    stop = None if stop is None else stop.select("node").distinct()
    levels, reason, count = Levels(spark, f"{folder}/levels", "depth"), None, 0
    level = seeds.select("node").distinct()
    while True:
        size = levels.add(level)["rows"]
        if max_nodes is not None and levels.n > 1 and count + size > max_nodes or not size and levels.n > 1:
            reason = "budget" if size else None
            levels.n -= 1
            break
        count += size
        if max_depth is not None and levels.n > max_depth:
            reason = "depth"
            break
        now = levels.last()
        if until is not None and not now.where(F.col("node") == until).isEmpty():
            break
        open_ = now if stop is None else now.join(stop, "node", "left_anti")
        following = open_.join(edges, open_["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        # both ways, an edge from a level ends in it or in one beside it
        level = following.join(levels.last(2 if undirected else levels.n).select("node"), "node", "left_anti")
    visited, last = levels.all(), levels.n - 1
    stopped = F.lit(None).cast("string")
    if stop is not None:
        visited = visited.join(stop.withColumn("__stop", F.lit(True)), "node", "left")
        stopped = F.when(F.col("__stop"), "stop")
    if reason:  # only nodes with a way on were cut off
        cut = levels.last().select("node").join(edges.select(F.col("src").alias("node")), "node", "left_semi").distinct().withColumn("__onward", F.lit(True))
        visited = visited.join(cut, "node", "left")
        stopped = F.coalesce(stopped, F.when((F.col("depth") == last) & F.col("__onward"), reason))
    return visited.select("node", "depth", stopped.alias("reason"))


def within_budgets(edges: DataFrame, seeds: DataFrame, costs: DataFrame, budgets: dict[str, int], max_depth: int | None = None) -> DataFrame:
    """node, depth, taken, reason: a traversal whose nodes cost something, until a budget is used up.

    costs: node and a column for each budget, as pins, edges or bytes; a node
    without a row, or with a null, costs nothing.  Nodes are taken by levels, within a level in their order,
    each with its costs; from the first that a budget does not cover none is taken.
    Those of its level are frontier rows (taken is false), as are taken nodes with
    a way on: their reason is the first budget that ran out, or 'depth'.
    """
    spark = edges.sparkSession
    folder, names = scratch(spark), list(budgets)
    edges = written(edges.select("src", "dst").distinct(), f"{folder}/edges")
    costs = costs.groupBy("node").agg(*(F.sum(n).cast("long").alias(n) for n in names))
    priced = lambda x: x.select("node").distinct().join(costs, "node", "left").select("node", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    levels, spent, reason, left = Levels(spark, f"{folder}/levels", "depth"), {n: 0 for n in names}, None, None
    level = priced(seeds)
    while True:
        total = levels.add(level, **{f"sum_{n}": F.col(n) for n in names})
        if not total["rows"] and levels.n > 1:
            levels.n -= 1
            break
        over = [n for n in names if spent[n] + total[f"sum_{n}"] > budgets[n]]
        if over:
            placed = running(levels.last().drop("depth"), [F.col("node")], {f"before_{n}": F.col(n) for n in names}, f"{folder}/cut")
            out = F.coalesce(*(F.when(F.col(f"before_{n}") + F.col(n) + spent[n] > budgets[n], n) for n in names))
            placed = written(placed.withColumn("__out", out), f"{folder}/placed")
            first = placed.where("__out is not null").orderBy("node").limit(1).select("node", "__out").first()
            reason, levels.n = first["__out"], levels.n - 1
            left = placed.where(F.col("node") >= first["node"]).select("node", F.lit(levels.n).alias("depth"))
            levels.add(placed.where(F.col("node") < first["node"]).select("node", *names))
            break
        spent = {n: spent[n] + total[f"sum_{n}"] for n in names}
        if max_depth is not None and levels.n > max_depth:
            reason = "depth"
            break
        now = levels.last()
        following = now.join(edges, now["node"] == edges["src"]).select(F.col("dst").alias("node"))
        level = priced(following.join(levels.all().select("node"), "node", "left_anti"))
    taken = levels.all().select("node", "depth", F.lit(True).alias("taken"))
    if reason is None:
        return taken.withColumn("reason", F.lit(None).cast("string"))
    # what was not taken is a way on; of the taken ones only the last two levels can have one
    seen = taken.select(F.col("node").alias("dst"))
    onward = levels.last(2).select("node").join(edges.join(seen, "dst", "left_anti").select(F.col("src").alias("node")), "node", "left_semi").distinct()
    cut = taken.join(onward.withColumn("__onward", F.lit(True)), "node", "left")
    taken = cut.select("node", "depth", "taken", F.when(F.col("__onward"), reason).alias("reason"))
    return taken if left is None else taken.unionByName(left.select("node", "depth", F.lit(False).alias("taken"), F.lit(reason).alias("reason")))


def completeness(visited: DataFrame) -> DataFrame:
    """One row: status, and how many nodes a limit cut off.  Stops that are asked for do not make a result partial."""
    cut = F.count_if(F.col("reason").isin("depth", "budget"))
    return visited.agg(F.when(F.count(F.lit(1)) == 0, EMPTY).when(cut > 0, PARTIAL).otherwise(COMPLETE).alias("status"), cut.alias("frontier"))


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int | None, stored: bool = False) -> DataFrame:
    """node and depth of all within so many undirected hops; stored as in reach."""
    return reach(edges, seeds, max_depth=hops, undirected=True, stored=stored).select("node", "depth")


def focus_neighborhood(edges: DataFrame, focus: DataFrame, children: DataFrame, hops: int | None) -> DataFrame:
    """A neighbourhood; if the focus has no other node in it, that of its children (parent, node) with a hop less."""
    own = neighborhood(edges, focus, hops)
    if own.count() > 1:
        return own
    inner = children.join(focus.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
    below = neighborhood(edges, inner, None if hops is None else hops - 1).withColumn("depth", F.col("depth") + 1)
    return own.unionByName(below.join(focus.select("node"), "node", "left_anti"))


def shortest_paths(edges: DataFrame, source: str, target: str, max_paths: int = 50, max_nodes: int | None = None, undirected: bool = True, stored: bool = False) -> DataFrame:
    """path (array of nodes) of the shortest paths, the first max_paths in order; columns depth and n_paths tell the whole.

    stored: the edges are files already.  Distances come from one traversal; the paths are counted back from the target
    and only the first ones spelled out.  A row of nulls says that max_nodes ended
    the search before the target.
    """
    from tracelake.operators import paths as P

    spark = edges.sparkSession
    edges = edges.select("src", "dst") if stored else written(edges.select("src", "dst"), scratch(spark))
    seen = reach(edges, spark.createDataFrame([(source,)], "node string"), max_nodes=max_nodes, until=target, undirected=undirected, stored=True)
    at = written(seen, scratch(spark))
    found = at.where(F.col("node") == target).first()
    if found is None:
        cut = not at.where("reason = 'budget'").isEmpty()
        return spark.createDataFrame([(None, None, None)] if cut else [], "path array<string>, depth int, n_paths long")
    ends = edges.union(edges.select("dst", "src")) if undirected else edges
    inside = ends.join(at.select(F.col("node").alias("src")), "src", "left_semi").join(at.select(F.col("node").alias("dst")), "dst", "left_semi").distinct()
    pair = spark.createDataFrame([(source, target)], "origin string, goal string")
    told = P.between(inside.withColumn("id", F.lit("")), pair, max_depth=found["depth"], max_paths=max_paths)
    return told.paths.join(told.status, ["origin", "goal"]).orderBy("nth").select(F.col("nodes").alias("path"), "depth", F.col("n_paths").cast("long").alias("n_paths"))


def flow_trace(edges: DataFrame, source: str, target: str, kinds: tuple[str, ...] = ("payload",), scope: Column | None = None, entities: DataFrame | None = None, max_paths: int = 50, max_nodes: int | None = None, max_depth: int = 32, stored: bool = False) -> DataFrame:
    """status, n_paths and the first paths (path, depth, edges) over edges (src, dst, kind, id) of some kinds; parallel edges are different paths, told by their ids.

    scope: a condition on edges.  'unresolved' where an end is not among the
    entities (node); 'search-limit' where max_nodes or max_depth ended the search,
    or where there are more paths than max_paths.  stored: the edges are files already and are not written again.
    """
    from tracelake.operators import paths as P

    spark = edges.sparkSession
    edges = edges.where(F.col("kind").isin(*kinds))
    edges = (edges if scope is None else edges.where(scope)).select("src", "dst", "id")
    cut = False
    if max_nodes is not None:
        seen = written(reach(edges, spark.createDataFrame([(source,)], "node string"), max_nodes=max_nodes, until=target), scratch(spark))
        cut = not seen.where("reason = 'budget'").isEmpty()
        edges, stored = edges.join(seen.select(F.col("node").alias("src")), "src", "left_semi").join(seen.select(F.col("node").alias("dst")), "dst", "left_semi"), False
    told = P.between(edges, spark.createDataFrame([(source, target)], "origin string, goal string"), entities, max_depth, max_paths, stored)
    limited = (F.col("status") == P.EXACT) & (F.coalesce(F.col("n_paths") > max_paths, F.lit(True)) | F.lit(cut)) | (F.col("status") == P.NO_PATH) & F.lit(cut)
    status = told.status.withColumn("status", F.when(limited, P.SEARCH_LIMIT).otherwise(F.col("status")))
    listed = status.join(told.paths, ["origin", "goal"], "left")
    return listed.orderBy("nth").select("status", "n_paths", F.col("nodes").alias("path"), "depth", "edges")


def expand(children: DataFrame, roots: DataFrame, max_depth: int = 64, max_breadth: int | None = None, separator: str = "/", budget: int | None = None) -> DataFrame:
    """Every occurrence below the roots (node): node, parent_path, path, root, depth, ancestors, status, omitted.

    children: parent, node, name.  One row per path, so what two parents hold
    occurs twice.  A node that is its own ancestor is given once more as
    'cycle-cut' and not expanded, one at max_depth as 'depth-cut'.  What a limit
    leaves out is told by a row of its own at the parent, with the number of
    children `omitted`: 'breadth-cut' beyond the first max_breadth in order of name
    and node; 'budget' where the occurrences reached the budget.  These come level by
    level, in a level in order of their paths; the level in which the budget
    ends is cut at that place, and no further one is begun.
    """
    from pyspark.sql import Window

    spark = children.sparkSession
    folder = scratch(spark)
    order = Window.partitionBy("parent").orderBy("name", "node")
    omitted = None
    if max_breadth is not None:
        numbered = children.withColumn("__nth", F.row_number().over(order))
        omitted = written(numbered.where(F.col("__nth") > max_breadth).groupBy("parent").agg(F.count(F.lit(1)).alias("omitted")), f"{folder}/omitted")
        children = numbered.where(F.col("__nth") <= max_breadth).drop("__nth")
    none = F.lit(None).cast("string")
    level = roots.select("node", none.alias("parent_path"), F.col("node").cast("string").alias("path"), F.col("node").alias("root"), F.array("node").alias("ancestors"), F.lit("expanded").alias("status"))
    levels, count, cuts = Levels(spark, f"{folder}/levels", "depth"), 0, []
    columns = ["node", "parent_path", "path", "root", "depth", "ancestors", "status", "omitted"]

    def told(rows: DataFrame, status: str) -> DataFrame:
        return rows.withColumns({"status": F.lit(status)}).select(columns)

    while True:
        size = levels.add(level)["rows"]
        if not size and levels.n > 1:
            levels.n -= 1
            break
        if budget is not None and count + size > budget:
            placed = written(running(levels.last(), [F.col("path"), F.col("node")], {"__at": F.lit(1)}, f"{folder}/running"), f"{folder}/placed")
            levels.n -= 1
            over = placed.where(F.col("__at") >= budget - count)
            if levels.n:
                parents = levels.last().select("node", "parent_path", "path", "root", "ancestors", "depth")
                n = over.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("omitted"))
                cuts.append(told(parents.join(n, "path"), "budget"))
            else:  # roots that the budget leaves out
                cuts.append(told(over.withColumn("omitted", F.lit(1).cast("long")), "budget"))
            levels.add(placed.where(F.col("__at") < budget - count).drop("__at", "depth"))
            break
        count += size
        if levels.n > max_depth:
            break
        now = levels.last()
        if omitted is not None:
            cuts.append(told(now.where("status = 'expanded'").join(omitted.withColumnRenamed("parent", "node"), "node"), "breadth-cut"))
        up = now.where("status = 'expanded'").select(F.col("node").alias("parent"), F.col("path").alias("parent_path"), "root", "ancestors")
        cut = F.when(F.array_contains("ancestors", F.col("node")), "cycle-cut").when(F.lit(levels.n >= max_depth), "depth-cut").otherwise("expanded")
        level = up.join(children, "parent").select(
            "node", "parent_path", F.concat_ws(separator, "parent_path", "name").alias("path"), "root", F.concat("ancestors", F.array("node")).alias("ancestors"), cut.alias("status")
        )
    found = levels.all().withColumn("omitted", F.lit(None).cast("long")).select(columns)
    return reduce(DataFrame.unionAll, [found, *cuts])


def ancestors(occurrences: DataFrame) -> DataFrame:
    """node path and each ancestor with its distance, the node itself at 0; takes what expand() returns."""
    return occurrences.select("path", F.posexplode(F.reverse("ancestors")).alias("distance", "ancestor"))


def inside(occurrences: DataFrame, scope: str) -> DataFrame:
    """The occurrences in the subtree of a node."""
    return occurrences.where(F.array_contains("ancestors", scope))


def roots_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges; all nodes if there is none such."""
    top = nodes.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return nodes.select("node") if top.isEmpty() else top


def component_roots(nodes: DataFrame, edges: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """node, reason: from these roots everything is reached, and no two of them reach each other.

    'uninstantiated' are nodes without incoming edges.  A cycle that nothing outside
    leads into has one root, its smallest node, 'cycle-fallback'.  With configured
    (node) these alone are roots, if they are among the nodes.
    """
    if configured is not None:
        return nodes.select("node").distinct().join(configured.select("node").distinct(), "node", "left_semi").select("node", F.lit("configured").alias("reason"))
    cycles = cycle_members(edges)
    component = nodes.select("node").distinct().join(cycles, "node", "left").select("node", F.coalesce("cycle", "node").alias("top"), F.col("cycle").isNotNull().alias("cyclic"))
    ends = edges.join(component.select(F.col("node").alias("src"), F.col("top").alias("src_top")), "src").join(component.select(F.col("node").alias("dst"), F.col("top").alias("dst_top")), "dst")
    entered = ends.where("src_top <> dst_top").select(F.col("dst_top").alias("top")).distinct()
    tops = component.where("node = top").join(entered, "top", "left_anti")
    return tops.select("node", F.when(F.col("cyclic"), "cycle-fallback").otherwise("uninstantiated").alias("reason"))


def nearest_with(occurrences: DataFrame, attributes: DataFrame) -> DataFrame:
    """For each path the attribute (node, value) of its nearest ancestor that has one."""
    held = ancestors(occurrences).join(attributes.withColumnRenamed("node", "ancestor"), "ancestor")
    return held.groupBy("path").agg(F.min_by("value", "distance").alias("value"), F.min("distance").alias("distance"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """node, cycle: the nodes on directed cycles, with the smallest node of their strongly connected component.

    Rounds of colouring: nodes without a way in or out are trimmed; every other
    takes the smallest node that reaches it; what a colour's own node is reached
    from, within the colour, is one component.
    """
    spark = edges.sparkSession
    folder, k, parts = scratch(spark), 0, []
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left = written(edges.where("src <> dst").select("src", "dst").distinct(), f"{folder}/edges0")
    while True:
        before = -1
        while (now := left.count()) != before:  # trim
            before, k = now, k + 1
            ends = left.select(F.col("src").alias("n")).intersect(left.select(F.col("dst").alias("n")))
            kept = left.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi")
            left = written(kept.select("src", "dst"), f"{folder}/trim{k}")
        if not before:
            break
        colour = left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node"))
        colour, mark = written(colour, f"{folder}/colour{k}"), None
        while True:  # the smallest node that reaches each
            k += 1
            given = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            colour = written(colour.union(given).groupBy("node").agg(F.min("colour").alias("colour")), f"{folder}/colour{k}")
            if (new := colour.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]) == mark:
                break
            mark = new
        same = left.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other")
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour"))
        found = written(back.select("node").join(colour, "node").withColumnRenamed("colour", "cycle"), f"{folder}/found{k}")
        parts.append(found.join(found.groupBy("cycle").count().where("count > 1"), "cycle", "left_semi").select("node", "cycle"))
        left = written(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"), f"{folder}/edges{k}")
    schema = spark.createDataFrame([], loops.schema).withColumn("cycle", F.col("node"))
    found = reduce(DataFrame.unionByName, parts, schema)
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("cycle")))


def one_hop(edges: DataFrame, node: Column | str, direction: str, kinds: tuple[str, ...]) -> DataFrame:
    """Callers and readers come in, callees and writers go out: the edges of some kinds at one end of a node."""
    end = "dst" if direction == "in" else "src"
    return edges.where((F.col(end) == node) & F.col("kind").isin(*kinds))


def without_dangling(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes and edges in a fixed order, preferred ones first; edges that lose an end go before edges are counted.

    nodes: node, preferred; edges: src, dst, kind.
    """
    kept = nodes.orderBy(F.desc("preferred"), "node").limit(max_nodes)
    ends = kept.select("node")
    held = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, held.select("src", "dst", "kind").orderBy("src", "dst", "kind").limit(max_edges)
