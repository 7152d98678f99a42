"""Views of a hierarchy: which ancestor stands for a node, edges lifted to what is shown, and what a level, mode and focus show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import edge_mode
from tracelake.operators.checkpoints import Levels, discard, scratch, written
from tracelake.operators.graph import focus_neighborhood

# Levels and the kinds of nodes that each is about.
LEVELS = ["system", "module", "behavior"]
OVERVIEW = ["module", "interface", "package"]
BEHAVIOR = ["rule", "method", "function"]
STATE = ["register", "fifo", "memory", "wire", "vector"]
#: Buckets of a module's members: kinds, and whether a view shows the bucket alone.
BUCKETS = {
    "interfaces": (["interface"], False),
    "methods": (["method"], True),
    "rules": (["rule"], True),
    "local-functions": (["function"], True),
    "state": (STATE, True),
    "child-instances": (["instance"], False),
    "types": (["type", "enum", "struct", "union"], False),
}


def standing(parents: DataFrame, shown: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, stands, distance: the nearest of a node and its ancestors that is shown; null where none is.

    parents: node, parent (null at the top), a row for each node; shown: node.
    Each round doubles how far a pointer has gone, so the rounds grow with the
    logarithm of the depth.  A node below a cycle without a shown node has none.
    """
    spark = parents.sparkSession
    folder = scratch(spark)
    held = shown.select("node").distinct().withColumn("__shown", F.lit(True))
    base = parents.select("node", "parent").join(held, "node", "left")
    now = written(base.select("node", F.when(F.col("__shown"), F.col("node")).otherwise(F.col("parent")).alias("up"), F.when(F.col("__shown"), 0).otherwise(1).alias("far"), (F.coalesce("__shown", F.lit(False)) | F.col("parent").isNull()).alias("done")), f"{folder}/0")
    k = 0
    while k < max_rounds and not now.where("not done").isEmpty():
        k += 1
        further = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("done").alias("end"))
        moved = now.where("not done").join(further, "up", "left").select("node", F.col("next").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("end", F.lit(True)).alias("done"))
        now = written(now.where("done").union(moved), f"{folder}/{k}")
        discard(spark, f"{folder}/{k - 1}")
    return now.select("node", F.when(F.col("done"), F.col("up")).alias("stands"), F.when(F.col("done") & F.col("up").isNotNull(), F.col("far")).alias("distance"))


def lifted(edges: DataFrame, parents: DataFrame, shown: DataFrame) -> DataFrame:
    """src, dst, kind, n, first: the edges between what is shown, each end replaced by what stands for it, equal ones folded.

    edges: src, dst, kind, id.  n counts the edges that an edge stands for, first is
    the least of their ids.  Edges inside one shown node, and those with an end
    that nothing stands for, are left out.
    """
    stands = standing(parents, shown).where("stands is not null").select("node", "stands")
    ends = edges.join(stands.toDF("src", "__src"), "src").join(stands.toDF("dst", "__dst"), "dst").where("__src <> __dst")
    return ends.groupBy(F.col("__src").alias("src"), F.col("__dst").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def scoped(nodes: DataFrame, file: str | None) -> DataFrame:
    """The nodes that are not hidden, of one file or of all."""
    out = nodes.where("not coalesce(hidden, false)")
    return out if file is None else out.where(F.col("path") == file)


def buckets_of(members: DataFrame) -> DataFrame:
    """node, parent, kind, bucket, collapsed of members by their kind; a kind of no bucket is left out."""
    name = F.coalesce(*(F.when(F.col("kind").isin(kinds), b) for b, (kinds, _) in BUCKETS.items()))
    collapsed = F.coalesce(*(F.when(F.col("kind").isin(kinds), c) for kinds, c in BUCKETS.values()))
    return members.withColumns({"bucket": name, "collapsed": collapsed}).where("bucket is not null")


def visible(nodes: DataFrame, edges: DataFrame, level: str, mode: str, owner: str | None = None, file: str | None = None, focus: str | None = None, hops: int | None = None, packages: bool = True, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What a view shows: nodes (node, parent, kind) and edges (src, dst, kind).

    nodes: node, parent, kind, path, hidden; edges: src, dst, kind, mode (may be null).
    The system level has modules, interfaces and packages; the module level an
    owner, a `member-group` for each bucket of its members and the members of those
    that are not collapsed; the behavior level an owner and its rules, methods,
    functions and state; in scheduling with an owner only its rules and methods.
    file keeps one file's nodes, focus those within so many hops (None: any number) over edges of
    the mode (groups stay if a member does), kinds nodes of these kinds.  Edges are
    those of the mode between shown nodes; at the module level structure has the
    owner's edges to groups and members.
    """
    if level not in LEVELS:
        raise ValueError(f"no level {level}")
    held = scoped(nodes, file)
    active = edges.where(edge_mode(F.col("kind"), F.col("mode")) == mode).select("src", "dst", "kind")
    own, members = held.where(F.col("node") == owner), held.where(F.col("parent") == owner)
    groups = None
    if mode == "scheduling" and owner is not None:
        out = members.where(F.col("kind").isin("rule", "method"))
    elif level == "system":
        out = held.where(F.col("kind").isin(OVERVIEW))
        out = out if packages else out.where("kind <> 'package'")
    elif level == "behavior":
        out = own.unionByName(members.where(F.col("kind").isin(BEHAVIOR + STATE)))
    else:
        dealt = buckets_of(members)
        groups = dealt.select(F.concat(F.lit("member-group:"), F.lit(owner), F.lit(":"), "bucket").alias("node"), F.lit(owner).alias("parent"), F.lit("member-group").alias("kind"), F.col("node").alias("member"))
        out = own.unionByName(dealt.where("not collapsed").select(own.columns))
    out = out.select("node", "parent", "kind")
    if focus is not None:
        spark = nodes.sparkSession
        inside = active.join(held.select(F.col("node").alias("src")), "src", "left_semi").join(held.select(F.col("node").alias("dst")), "dst", "left_semi")
        near = written(focus_neighborhood(inside, spark.createDataFrame([(focus,)], "node string"), held.select("parent", "node"), hops).select("node"), scratch(spark))
        out = out.join(near, "node", "left_semi")
        groups = None if groups is None else groups.join(near.withColumnRenamed("node", "member"), "member", "left_semi")
    if kinds is not None:
        out = out.where(F.col("kind").isin(kinds))
    if groups is not None:
        out = out.unionByName(groups.select("node", "parent", "kind").distinct())
    if groups is not None and mode == "structure":
        return out, out.where(F.col("node") != owner).select(F.lit(owner).alias("src"), F.col("node").alias("dst"), F.lit("contains").alias("kind"))
    ends = out.select("node").distinct()
    shown = active.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return out, shown


def common_ancestors(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, common, up_a, up_b: the lowest node that both of a pair are or are below, and how far above each; null where there is none.

    parents: node, parent (null at the top), a row for each node, without cycles;
    pairs: a, b.  Tables of the 1st, 2nd, 4th, ... ancestors are written once; a
    pair's deeper node is lifted to the other's depth, then both as far as they
    differ, so the joins grow with the logarithm of the depth, whatever the pairs.
    """
    spark = parents.sparkSession
    folder = scratch(spark)
    jumps = [written(parents.select("node", F.col("parent").alias("up")), f"{folder}/jump0")]
    depth = written(jumps[0].select("node", F.col("up").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), f"{folder}/depth0")
    while not depth.where("at is not null").isEmpty():
        k, jump = len(jumps), jumps[-1]
        if k > 60:
            raise ValueError("the parents have a cycle")
        beyond = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        more = depth.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        depth = written(depth.join(more, "at", "left").select("node", F.col("next").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"{folder}/depth{k}")
        jumps.append(written(jump.join(beyond, "up", "left").select("node", F.col("next").alias("up")), f"{folder}/jump{k}"))
    depths = depth.select("node", "depth")

    def step(rows: DataFrame, jump: DataFrame, column: str) -> DataFrame:
        return rows.join(jump.select(F.col("node").alias(column), F.col("up").alias(f"__{column}")), column, "left")

    asked = pairs.select("a", "b").distinct()
    rows = asked.join(depths.toDF("a", "__da"), "a").join(depths.toDF("b", "__db"), "b")
    rows = rows.select("a", "b", "__da", "__db", F.when(F.col("__da") >= F.col("__db"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("__da") >= F.col("__db"), F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("__da") - F.col("__db")).alias("gap"))
    rows = rows.withColumn("lifted", F.lit(0))
    for k in range(len(jumps) - 1, -1, -1):
        rows = written(step(rows, jumps[k], "x").withColumn("x", F.when(F.col("gap") >= 1 << k, F.col("__x")).otherwise(F.col("x"))).withColumn("gap", F.when(F.col("gap") >= 1 << k, F.col("gap") - (1 << k)).otherwise(F.col("gap"))).drop("__x"), f"{folder}/even{k}")
    for k in range(len(jumps) - 1, -1, -1):
        both = step(step(rows, jumps[k], "x"), jumps[k], "y")
        apart = F.coalesce((F.col("x") != F.col("y")) & (F.col("__x") != F.col("__y")), F.lit(False))
        rows = written(both.withColumns({"x": F.when(apart, F.col("__x")).otherwise(F.col("x")), "y": F.when(apart, F.col("__y")).otherwise(F.col("y")), "lifted": F.col("lifted") + F.when(apart, 1 << k).otherwise(0)}).drop("__x", "__y"), f"{folder}/apart{k}")
    ends = step(step(rows, jumps[0], "x"), jumps[0], "y")
    same = F.col("x") == F.col("y")
    common = F.when(same, F.col("x")).when(F.col("__x") == F.col("__y"), F.col("__x"))
    up = F.col("lifted") + F.when(same, 0).otherwise(1)
    far = lambda own, other: F.when(common.isNotNull(), up + F.greatest(F.col(own) - F.col(other), F.lit(0)))
    return ends.select("a", "b", common.alias("common"), far("__da", "__db").alias("up_a"), far("__db", "__da").alias("up_b"))


def closure(parents: DataFrame, starts: DataFrame, max_depth: int = 1000) -> DataFrame:
    """node, ancestor, distance of the starts (node), each its own ancestor at 0; a row for each step up, levels are files of one table."""
    spark = parents.sparkSession
    folder = scratch(spark)
    up = written(parents.where("parent is not null").select(F.col("node").alias("ancestor"), F.col("parent").alias("next")), f"{folder}/up")
    levels = Levels(spark, f"{folder}/levels", "distance")
    level = starts.select("node").distinct().join(parents.select("node"), "node", "left_semi").select("node", F.col("node").alias("ancestor"))
    while levels.add(level)["rows"]:
        if levels.n > max_depth:
            raise ValueError("the parents have a cycle, or are too deep")
        level = levels.last().drop("distance").join(up, "ancestor").select("node", F.col("next").alias("ancestor"))
    return levels.all().select("node", "ancestor", "distance")


def revealed(owners: DataFrame, contexts: DataFrame, occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """request, status, owner, anchor: who may show a target - the nearest of an owner and its ancestors whose anchor the target is or lies below.

    owners, occurrences: node, parent; contexts: owner, anchor (an occurrence); requests: request, owner,
    root (null: the owner), target (an occurrence).  'owner-preserved' for the owner
    itself, 'owner-broadened' for one above it, 'unavailable' for none;
    'unknown-owner', 'unknown-target' and 'foreign-root' (no ancestor of the owner) for
    what cannot be asked.  Anchor and target meet on the target's ancestors, so no two hierarchies are held against each other.
    """
    spark = owners.sparkSession
    folder = scratch(spark)
    asked = written(requests.select("request", "owner", F.coalesce("root", "owner").alias("root"), "target"), f"{folder}/asked")
    # what an owner and a target are below is gathered once for each of them; a request meets both lists
    over = closure(owners, asked.select(F.col("owner").alias("node"))).withColumnRenamed("ancestor", "owner")
    over = over.join(contexts.groupBy("owner").agg(F.sort_array(F.collect_set("anchor")).alias("anchors")), "owner", "left")
    step = F.struct("distance", F.col("owner").alias("by"), "anchors")
    over = written(over.groupBy("node").agg(F.sort_array(F.collect_list(step)).alias("over")).withColumnRenamed("node", "owner"), f"{folder}/over")
    around = closure(occurrences, asked.select(F.col("target").alias("node"))).groupBy("node").agg(F.collect_set("ancestor").alias("around")).withColumnRenamed("node", "target")
    met = asked.join(over, "owner", "left").withColumn("rooted", F.exists("over", lambda x: x["by"] == F.col("root")))
    met = met.join(written(around, f"{folder}/around"), "target", "left")
    within = F.transform("over", lambda x: F.struct(x["distance"].alias("distance"), F.array_min(F.array_intersect(x["anchors"], F.col("around"))).alias("anchor"), x["by"].alias("by")))
    all_ = met.withColumn("best", F.array_min(F.filter(within, lambda x: x["anchor"].isNotNull())))
    status = F.when(F.col("over").isNull(), "unknown-owner").when(F.col("around").isNull(), "unknown-target").when(~F.coalesce("rooted", F.lit(False)), "foreign-root").when(F.col("best").isNull(), "unavailable").when(F.col("best.distance") == 0, "owner-preserved").otherwise("owner-broadened")
    clear = status.startswith("owner-")
    return all_.select("request", status.alias("status"), F.when(clear, F.col("best.by")).alias("owner"), F.when(clear, F.col("best.anchor")).alias("anchor"))


def scenes(members: DataFrame, relations: DataFrame, selected: DataFrame | None = None, many: int = 16) -> DataFrame:
    """owner, relation, fate, src, dst, kind: what an owner's scene does with each of its relations.

    members: owner, node, shown (what stands for the node in the owner's scene), kind, outside (beyond the owner);
    relations: owner, relation, src, dst, kind; selected: owner, node.  'folded' where both
    ends are one shown node; 'on-selection' for reads and writes of registers of an
    owner with more than `many` registers, unless an end is selected;
    'continuation' where an end is outside, else 'connection'.
    """
    crowded = members.groupBy("owner").agg((F.count_if(F.col("kind") == "register") > many).alias("crowded"))
    end = lambda e: members.select("owner", F.col("node").alias(e), F.col("shown").alias(f"{e}_shown"), (F.col("kind") == "register").alias(f"{e}_register"), F.col("outside").alias(f"{e}_out"))
    met = relations.join(end("src"), ["owner", "src"]).join(end("dst"), ["owner", "dst"]).join(crowded, "owner")
    chosen = F.lit(False)
    if selected is not None:
        pick = selected.select("owner", "node").distinct()
        met = met.join(pick.toDF("owner", "src").withColumn("__a", F.lit(True)), ["owner", "src"], "left").join(pick.toDF("owner", "dst").withColumn("__b", F.lit(True)), ["owner", "dst"], "left")
        chosen = F.coalesce("__a", "__b", F.lit(False))
    state = F.col("kind").isin("state-read", "state-write") & (F.col("src_register") | F.col("dst_register")) & F.col("crowded") & ~chosen
    fate = F.when(state, "on-selection").when(F.col("src_shown") == F.col("dst_shown"), "folded").when(F.col("src_out") | F.col("dst_out"), "continuation").otherwise("connection")
    kept = fate.isin("connection", "continuation")
    return met.select("owner", "relation", fate.alias("fate"), F.when(kept, F.col("src_shown")).alias("src"), F.when(kept, F.col("dst_shown")).alias("dst"), "kind")
