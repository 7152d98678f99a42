"""A semantic model as one graph of nodes and edges, what belongs to which presentation, and provenance where records have none."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.checkpoints import scratch, written

INWARD, OUTWARD = "inbound", "outbound"


@dataclass
class Model:
    """A semantic model's tables.

    instances: node, parent, definition, primitive (its kind, null for a module);
    behaviours: node, owner, kind; channels: node, owner; channel_methods: channel,
    endpoint; endpoints: node, owner; members: definition, member, kind ('function' or
    a type's); roots: root; exposures: root, channel, direction; flows: id, src, dst,
    kind, link (tells only how something is implemented); forwards: id, owner, outer,
    inner, status; schedules: id, src, dst, kind.
    """

    instances: DataFrame
    behaviours: DataFrame
    channels: DataFrame
    channel_methods: DataFrame
    endpoints: DataFrame
    members: DataFrame
    roots: DataFrame
    exposures: DataFrame
    flows: DataFrame
    forwards: DataFrame
    schedules: DataFrame


def boundary_node(root: Column, direction: Column) -> Column:
    return F.concat_ws(":", F.lit("boundary"), root, direction)


def projected(model: Model) -> tuple[DataFrame, DataFrame]:
    """nodes (node, parent, kind) and edges (src, dst, kind, role, id) of a model.

    Endpoints are nodes only where a flow or an exact forward uses them; functions
    and types of a definition are nodes below each of its instances; a root has
    a boundary for each direction.  Payload between different owners is there
    twice: between its ends, and as role `aggregate` between their owners, also where
    it only links an implementation.  An end that is no node takes its edge with it.
    """
    spark = model.instances.sparkSession
    folder, none = scratch(spark), F.lit(None).cast("string")
    channel_of = model.channel_methods.groupBy("endpoint").agg(F.min("channel").alias("channel"))
    exact = model.forwards.where("status = 'exact'")
    used = model.flows.where("not link").select(F.col("src").alias("node")).union(model.flows.where("not link").select("dst")).union(exact.select("outer")).union(exact.select("inner"))
    whole = model.instances.where("primitive is null")
    sides = F.explode(F.array(F.lit(INWARD), F.lit(OUTWARD)))
    nodes = reduce(DataFrame.union, [
        model.instances.select("node", "parent", F.coalesce("primitive", F.lit("instance")).alias("kind")),
        model.behaviours.select("node", "owner", "kind"),
        model.channels.select("node", "owner", F.lit("protocol-channel")),
        model.endpoints.join(used.distinct(), "node", "left_semi").select("node", "owner", F.lit("endpoint")),
        whole.join(model.members, "definition").select(F.concat_ws(":", "node", "member"), "node", "kind"),
        model.roots.select("root", sides.alias("side")).select(boundary_node(F.col("root"), F.col("side")), none, F.lit("root-boundary")),
    ])
    nodes = written(nodes, f"{folder}/nodes")
    shown = nodes.select("node").hint("shuffle_hash")  # nodes are hashed where they meet edges, so no task sorts the edges of a node that has many

    below = model.instances.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.when(F.col("primitive").isNull(), "instance-child").otherwise("contains").alias("kind"))
    others = nodes.join(model.instances.select("node").hint("shuffle_hash"), "node", "left_anti").where("parent is not null").select("parent", "node", F.lit("contains"))
    held = below.union(others).select("src", "dst", "kind", F.lit("containment").alias("role"), none.alias("id"))

    plain = model.flows.where("not link").select("src", "dst", "kind", F.lit("flow"), "id")
    owner = model.endpoints.select("node", "owner")
    payload = model.flows.where("kind = 'payload'").join(owner.toDF("src", "a").hint("shuffle_hash"), "src").join(owner.toDF("dst", "b").hint("shuffle_hash"), "dst").where("a <> b")
    aggregate = payload.select("a", "b", "kind", F.lit("aggregate"), "id")

    edge, inward = boundary_node(F.col("root"), F.col("direction")), F.col("direction") == INWARD
    exposed = model.exposures.select(F.when(inward, edge).otherwise(F.col("channel")), F.when(inward, F.col("channel")).otherwise(edge), F.when(inward, "boundary-input").otherwise("boundary-output"), F.lit("boundary"), F.concat_ws(":", "root", "channel", "direction"))

    of = lambda end: owner.toDF(end, f"{end}_owner").join(channel_of.toDF(end, f"{end}_channel"), end, "left")
    ends = exact.join(of("outer"), "outer", "left").join(of("inner"), "inner")
    there = F.when(F.col("inner_owner") == F.col("owner"), F.coalesce("inner_channel", "inner_owner")).otherwise(F.col("inner_owner"))
    forwarded = ends.select(F.coalesce("outer_channel", "outer_owner"), there, F.lit("interface-forward"), F.lit("forward"), "id")
    scheduled = model.schedules.select("src", "dst", "kind", F.lit("schedule"), "id")

    edges = reduce(DataFrame.union, [held, plain, aggregate, exposed, forwarded, scheduled])
    return nodes, edges.join(shown.withColumnRenamed("node", "src"), "src", "left_semi").join(shown.withColumnRenamed("node", "dst"), "dst", "left_semi")


# The first of these roles counts where a reference has several presentations of one node.
ROLES = ["exact", "occurrence", "member", "container"]


def presentations(references: DataFrame, candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """reference, nth, node, role, status: the shown nodes that may stand for a source reference, the best role first.

    references: reference; candidates: reference, node, role; shown: node.  A node
    that has several roles for a reference keeps its first; status is 'exact' where one node has the reference's
    best role, 'ambiguous' where several have it, and 'none', without a node,
    where nothing shown stands for it.
    """
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    met = candidates.join(shown.select("node").distinct().hint("shuffle_hash"), "node", "left_semi").withColumn("rank", rank).where("rank > 0")
    best = met.groupBy("reference", "node").agg(F.min("rank").alias("rank"))
    of = Window.partitionBy("reference")
    told = best.withColumns({"nth": F.row_number().over(of.orderBy("rank", "node")), "first": F.min("rank").over(of)})
    told = told.withColumn("status", F.when(F.count_if(F.col("rank") == F.col("first")).over(of) > 1, "ambiguous").otherwise("exact"))
    out = references.select("reference").distinct().join(told, "reference", "left")
    return out.select("reference", F.coalesce("nth", F.lit(1)).alias("nth"), "node", F.get(F.array(*map(F.lit, ROLES)), (F.col("rank") - 1).cast("int")).alias("role"), F.coalesce("status", F.lit("none")).alias("status"))


def with_provenance(rows: DataFrame, confidence: Column, evidence: Column, location: Column | None = None) -> DataFrame:
    """rows with analysis_origin, confidence, evidence and location; what a row says itself stays, an empty text says nothing."""
    given = {"analysis_origin": F.lit("Source-derived"), "confidence": confidence, "evidence": evidence, "location": F.lit(None).cast("string") if location is None else location}
    said = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({c: F.coalesce(said(c), d) for c, d in given.items()})


def statement_details(statements: DataFrame, bindings: DataFrame, conditions: DataFrame) -> DataFrame:
    """callable, nth, statement, kind, binding, conditions, relation, src, dst: a callable's statements with what they bind, under which conditions, and the relation that they stand for.

    statements: statement, callable, position, kind, expression, right, status;
    bindings: binding, statement, position; conditions: statement, position, expression, negated.  Of several bindings
    the first counts.  A return leads from its expression to the callable, an
    assignment from its right side to the statement; an unsupported statement has the
    relation 'unsupported-statement' and no ends.  Negated conditions begin with !.
    """
    first = bindings.groupBy("statement").agg(F.min_by("binding", "position").alias("binding"))
    text = F.struct("position", F.concat(F.when(F.col("negated"), "!").otherwise(""), "expression").alias("text"))
    under = conditions.groupBy("statement").agg(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["text"]).alias("conditions"))
    met = statements.join(first, "statement", "left").join(under, "statement", "left")
    relation = F.when(F.col("status") == "unsupported", "unsupported-statement").when((F.col("kind") == "return") & F.col("expression").isNotNull(), "return").when(F.col("right").isNotNull(), "assignment")
    nth = F.row_number().over(Window.partitionBy("callable").orderBy("position", "statement"))
    return met.withColumn("relation", relation).select(
        "callable", nth.alias("nth"), "statement", "kind", "binding", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"), "relation",
        F.when(F.col("relation") == "return", F.col("expression")).when(F.col("relation") == "assignment", F.col("right")).alias("src"),
        F.when(F.col("relation") == "return", F.col("callable")).when(F.col("relation") == "assignment", F.col("statement")).alias("dst"),
    )
