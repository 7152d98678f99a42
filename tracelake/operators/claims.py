"""Claims that a source and its implementation correspond: built by rules, each with the premises that it rests on, and checked.

Rules are joins, taken in the order of RULES, so a premise is there before what
rests on it; only the hierarchy is gone through level by level.  A claim's id is a
hash of what it says and of its premises' ids: the same input gives the same ids,
and no claim can rest on itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.checkpoints import Levels, scratch, written
from tracelake.operators.components import components

# Kinds of claims with their scope and the kinds of premises that they need.
RULES = {
    "source-declaration": ("declaration", []),
    "source-occurrence": ("contract", []),
    "containing-context": ("context", []),
    "method-port-contract": ("contract", ["source-occurrence"]),
    "generated-port": ("contract", ["method-port-contract"]),
    "ordered-port-binding": ("connectivity", ["method-port-contract", "generated-port", "source-occurrence"]),
    "same-net-contact": ("connectivity", ["ordered-port-binding"]),
}


@dataclass
class Claims:
    """claims: id, kind, scope, source, target, premises (array of ids); unresolved: family, subject, reason; contexts: what contexts() returns."""

    claims: DataFrame
    unresolved: DataFrame
    contexts: DataFrame


def claim_id(kind: Column, source: Column, target: Column, premises: Column) -> Column:
    return F.concat(F.lit("claim-"), F.sha2(F.to_json(F.struct(kind.alias("k"), source.alias("s"), target.alias("t"), F.sort_array(premises).alias("p"))), 256))


def made(rows: DataFrame, kind: str | Column, source: str, target: str, premises: Column, *kept: str) -> DataFrame:
    """A claim for each row, with the columns that later rules need."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    scope = F.coalesce(*(F.when(name == k, s) for k, (s, _) in RULES.items()))
    held = rows.select(name.alias("kind"), scope.alias("scope"), F.col(source).alias("source"), F.col(target).alias("target"), F.sort_array(premises).alias("premises"), *kept)
    return held.withColumn("id", claim_id(F.col("kind"), F.col("source"), F.col("target"), F.col("premises")))


def contexts(instances: DataFrame, hierarchy: DataFrame, occurrences: DataFrame) -> DataFrame:
    """instance, definition, node, module, implementation, context, kind, claim, parent_claim, problem: what an instance is in the compiler's hierarchy and in the implementation.

    instances: instance, parent, name, definition; hierarchy: node, parent, name,
    module (null if it was inlined), unique; occurrences: occurrence, parent, name.
    A top is met by its definition's name, any other below its parent's node by its own name.
    context is the implementation, or that of the nearest ancestor with one.  A
    node or implementation that is there several times is no match: problem
    'ambiguous-occurrence' or 'ambiguous-implementation'; one that is not there
    'compiler-occurrence-unmapped' or 'missing-implementation'.
    """
    spark = instances.sparkSession
    levels = Levels(spark, scratch(spark), "depth")
    none = F.lit(None).cast("string")
    single = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in df.columns if c not in by))
    nodes = single(hierarchy.select(F.coalesce("parent", F.lit("")).alias("up"), F.col("name").alias("called"), "node", "module", "unique"), "up", "called")
    held = single(occurrences.select(F.coalesce("parent", F.lit("")).alias("over"), F.col("name").alias("unique"), "occurrence"), "over", "unique").withColumnRenamed("n", "m")

    def level(rows: DataFrame) -> DataFrame:
        """rows: instance, definition, called, up (the parent's node), over (the parent's implementation), inherited, parent_claim."""
        met = rows.join(nodes, ["up", "called"], "left").join(held, ["over", "unique"], "left")
        node, built = F.when(F.col("n") == 1, F.col("node")), (F.col("n") == 1) & F.col("module").isNotNull()
        implementation = F.when(built & (F.col("m") == 1), F.col("occurrence"))
        problem = F.when(F.col("n").isNull(), "compiler-occurrence-unmapped").when(F.col("n") > 1, "ambiguous-occurrence").when(built & F.col("m").isNull(), "missing-implementation").when(built & (F.col("m") > 1), "ambiguous-implementation")
        told = met.select("instance", "definition", node.alias("node"), F.when(F.col("n") == 1, F.col("module")).alias("module"), implementation.alias("implementation"), F.coalesce(implementation, "inherited").alias("context"), "parent_claim", problem.alias("problem"))
        kind = F.when(F.col("implementation").isNotNull(), "source-occurrence").when(F.col("node").isNotNull(), "containing-context")
        premises = F.array_compact(F.array("parent_claim"))
        target = F.coalesce("implementation", "context", "node")
        return told.withColumn("kind", kind).withColumn("claim", F.when(F.col("kind").isNotNull(), claim_id(F.col("kind"), F.col("instance"), target, premises)))

    now = level(instances.where("parent is null").select("instance", "definition", F.col("definition").alias("called"), F.lit("").alias("up"), F.lit("").alias("over"), none.alias("inherited"), none.alias("parent_claim")))
    while levels.add(now)["rows"]:
        above = levels.last().select(F.col("instance").alias("parent"), F.col("node").alias("up"), F.col("implementation").alias("over"), F.col("context").alias("inherited"), F.col("claim").alias("parent_claim"))
        below = instances.select("instance", "parent", "definition", F.col("name").alias("called")).join(above, "parent")
        now = level(below.drop("parent"))
    return levels.all()


def construct(references: DataFrame, instances: DataFrame, hierarchy: DataFrame, occurrences: DataFrame, methods: DataFrame, contracts: DataFrame, generated: DataFrame, ports: DataFrame, boundaries: DataFrame, pins: DataFrame) -> Claims:
    """All claims that the tables allow.

    references: source, range; instances, hierarchy, occurrences: as in contexts();
    methods: instance, method; contracts: module, method, role, port; generated:
    module, port, width; ports: occurrence, port, position, bit; boundaries:
    formal, actual bits that are one net; pins: bit, pin.  Every method of an instance that is built on its own gets a
    contract; every port of it that implementation and generated source have with
    equal widths a port claim and a binding; every pin on the nets of a bound port a contact.
    What cannot be claimed is unresolved with its reason; other claims do not suffer.
    """
    spark = instances.sparkSession
    folder = scratch(spark)
    placed = written(contexts(instances, hierarchy, occurrences), f"{folder}/contexts")
    declared = made(references.distinct(), "source-declaration", "source", "range", F.array().cast("array<string>"))
    located = placed.where("claim is not null").withColumn("__target", F.coalesce("implementation", "context", "node"))
    inside = made(located, F.col("kind"), "instance", "__target", F.array_compact(F.array("parent_claim")))

    subject = F.concat_ws(".", "instance", "method")
    owned = methods.select("instance", "method").distinct().join(placed.select("instance", "module", "implementation", F.col("claim").alias("context_claim")), "instance", "left").withColumn("subject", subject)
    known = contracts.select("module", "method").distinct().withColumn("known", F.lit(True))
    met = owned.join(known, ["module", "method"], "left").withColumn("clear", F.col("implementation").isNotNull() & F.col("known"))
    met = met.withColumn("promise", F.concat_ws(".", "module", "method"))
    contract = written(made(met.where("clear"), "method-port-contract", "subject", "promise", F.array("context_claim"), "module", "method", "implementation", "context_claim"), f"{folder}/contracts")

    widths = ports.groupBy("occurrence", "port").agg(F.count(F.lit(1)).alias("bits"))
    signals = contract.select("source", F.col("id").alias("contract"), "module", "method", F.col("implementation").alias("occurrence"), "context_claim").join(contracts.select("module", "method", "role", "port").distinct(), ["module", "method"])
    checked = signals.join(widths, ["occurrence", "port"], "left").join(generated.select("module", "port", "width"), ["module", "port"], "left")
    checked = checked.withColumns({"formal": F.concat_ws(".", "occurrence", "port"), "problem": F.when(F.col("bits").isNull(), "missing-formal").when(F.col("width").isNull(), "missing-generated-port").when(F.col("bits") != F.col("width"), "width-contradiction")})
    checked = written(checked, f"{folder}/signals")
    port = made(checked.where("problem is null"), "generated-port", "source", "formal", F.array("contract"), "contract", "occurrence", "port", "context_claim").withColumnRenamed("id", "port_claim")
    bound = written(made(port.withColumnRenamed("source", "__s").withColumnRenamed("target", "__t"), "ordered-port-binding", "__s", "__t", F.array("contract", "port_claim", "context_claim"), "occurrence", "port"), f"{folder}/bound")

    # one number for each net: the bits that boundaries join
    nets = components(boundaries.select(F.col("formal").alias("a"), F.col("actual").alias("b")), f"{folder}/nets").select(F.col("node").alias("bit"), F.col("class").alias("net"))
    net = lambda df: df.join(nets, "bit", "left").withColumn("net", F.coalesce("net", "bit"))
    reached = net(ports.select("occurrence", "port", "bit")).select("occurrence", "port", "net").distinct()
    touching = net(pins.select("bit", "pin")).select("net", "pin").distinct()
    contacts = bound.select("source", F.col("id").alias("binding"), "occurrence", "port").join(reached, ["occurrence", "port"]).join(touching, "net").select("source", "binding", "pin").distinct()
    contact = made(contacts, "same-net-contact", "source", "pin", F.array("binding"))

    columns = ["id", "kind", "scope", "source", "target", "premises"]
    all_ = [declared, inside, contract, port.withColumnRenamed("port_claim", "id"), bound, contact]
    open_ = [
        placed.where("problem is not null").select(F.lit("context").alias("family"), F.col("instance").alias("subject"), F.col("problem").alias("reason")),
        met.where("not coalesce(clear, false)").select(F.lit("contract"), "subject", F.lit("inline-or-missing-compiler-method-contract")),
        checked.where("problem is not null").select(F.lit("connectivity"), F.concat_ws(":", "source", "port"), "problem"),
    ]
    return Claims(reduce(DataFrame.union, (c.select(columns) for c in all_)), reduce(DataFrame.union, open_), placed)


def violations(claims: DataFrame) -> DataFrame:
    """id, problem of claims (id, kind, scope, source, target, premises) that do not hold up; no rows if all do.

    'unknown-kind', 'wrong-scope', 'duplicate' (an id that is there twice),
    'altered' (an id that is not of what it says), 'unknown-premise' (one that is no
    claim), and 'missing-premise' (a kind of premise that the rule needs).
    """
    rule = F.create_map(*(F.lit(x) for k, (s, _) in RULES.items() for x in (k, s)))
    scope = F.element_at(rule, F.col("kind"))
    own = F.when(scope.isNull(), "unknown-kind").when(scope != F.col("scope"), "wrong-scope").when(claim_id(F.col("kind"), F.col("source"), F.col("target"), F.col("premises")) != F.col("id"), "altered")
    out = claims.select("id", own.alias("problem")).where("problem is not null")
    twice = claims.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    rests = claims.select("id", F.explode("premises").alias("premise"))
    kinds = claims.select(F.col("id").alias("premise"), F.col("kind").alias("premise_kind")).distinct()
    met = rests.join(kinds, "premise", "left")
    loose = met.where("premise_kind is null").select("id", F.lit("unknown-premise").alias("problem")).distinct()
    needs = F.coalesce(*(F.when(F.col("kind") == k, F.array(*map(F.lit, p))) for k, (_, p) in RULES.items() if p))
    needed = claims.select("id", F.explode(needs).alias("premise_kind"))
    lacking = needed.join(met, ["id", "premise_kind"], "left_anti").select("id", F.lit("missing-premise").alias("problem")).distinct()
    return reduce(DataFrame.union, [out, twice, loose, lacking])


def origins(claims: DataFrame, sources: DataFrame, requests: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """What claims of origin (id, entity, occurrence, semantic, token, revision) say about requests: (request, resolution, n, truncated) and the first claims (request, nth, id).

    requests: request and, where they are asked for, entity, semantic, token, revision, complete;
    a null asks for any.  A revision that the sources (revision) do not have is 'stale'.
    Claims in several occurrences are 'ambiguous', in one 'resolved'; none are
    'unmapped', as is every question for complete sets, which no claim gives.  A
    request must name an entity or a semantic id, so it meets claims on equal values.
    """
    keys = ["entity", "semantic", "token", "revision"]
    asked = requests.select("request", *keys, F.coalesce("complete", F.lit(False)).alias("complete"))
    known = sources.select("revision").distinct().withColumn("known", F.lit(True))
    asked = asked.join(known, "revision", "left").withColumn("stale", F.col("revision").isNotNull() & F.col("known").isNull())
    open_ = asked.where("not stale and not complete").select("request", *(F.col(k).alias(f"q_{k}") for k in keys))
    fits = reduce(Column.__and__, (F.col(f"q_{k}").isNull() | F.col(f"q_{k}").eqNullSafe(F.col(k)) for k in keys))
    by = lambda k: open_.where(F.col(f"q_{k}").isNotNull()).join(claims, F.col(f"q_{k}") == F.col(k)).where(fits)
    met = by("entity").unionByName(by("semantic").where("q_entity is null"))
    counted = met.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("occurrence").alias("places"))
    resolution = F.when(F.col("stale"), "stale").when(F.col("n").isNull(), "unmapped").when(F.col("places") > 1, "ambiguous").otherwise("resolved")
    told = asked.join(counted, "request", "left").select("request", resolution.alias("resolution"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > limit, F.lit(False)).alias("truncated"))
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("request").orderBy("id"))).where(F.col("nth") <= limit)
    return told, first.select("request", "nth", "id")
