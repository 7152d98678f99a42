"""Calls, seeds and statuses of a hardware model, as joins over tables of what was found in its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.checkpoints import Levels, scratch, written
from tracelake.operators.resolve import EXACT, UNRESOLVED

UNSUPPORTED = "unsupported"


def resolved_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """call, n (candidates), target, status, reason of every call.

    calls: call, name, package, owner, n_arguments; functions: function, name,
    package, owner (null for one of the package itself), n_parameters, dispatched;
    imports: package, imported.  A function of the caller's package is a candidate
    if it has no owner or the caller's; one of an imported package if it has none.
    A call is exact with one candidate that takes as many arguments and is not
    dispatched by type.  Candidates are counted by name and place before the join,
    so no call is listed with each of them.
    """
    one = [F.count(F.lit(1)).alias("n"), F.min("function").alias("target"), F.min("n_parameters").alias("takes"), F.max("dispatched").alias("dispatched")]
    free, owned = functions.where("owner is null"), functions.where("owner is not null")
    seen = imports.select("package", "imported").where("package <> imported").distinct().union(free.select("package", F.col("package").alias("imported")).distinct()).distinct()
    reach = free.withColumnRenamed("package", "imported").join(seen, "imported").groupBy("package", "name").agg(*one)
    inner = owned.groupBy("package", "owner", "name").agg(*one)
    own = lambda df, p: df.select(*(c for c in df.columns if c in ("package", "owner", "name")), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "target", "takes", "dispatched")))
    met = calls.join(own(reach, "a"), ["package", "name"], "left").join(own(inner, "b"), ["package", "owner", "name"], "left")
    n = F.coalesce("a_n", F.lit(0)) + F.coalesce("b_n", F.lit(0))
    pick = lambda c: F.coalesce(f"a_{c}", f"b_{c}")
    dispatched = F.coalesce("a_dispatched", F.lit(False)) | F.coalesce("b_dispatched", F.lit(False))
    exact = (n == 1) & ~dispatched & (pick("takes") == F.col("n_arguments"))
    reason = F.when(dispatched, "dispatched").when(n == 0, "no-candidate").when(n > 1, "several").when(~exact, "arity")
    return met.select("call", n.alias("n"), F.when(exact, pick("target")).alias("target"), F.when(exact, EXACT).otherwise(UNRESOLVED).alias("status"), reason.alias("reason"))


def settled(nodes: DataFrame, operands: DataFrame) -> DataFrame:
    """node and status of every node when statuses have gone up from operands until nothing changes.

    nodes: node, status; operands: node, operand.  A node over an unsupported operand
    is unsupported, else over one that is not exact unresolved.  Only what changed in
    a round is looked at in the next, along the edges to what can change at all; the
    nodes themselves are read once, at the end.
    """
    spark = nodes.sparkSession
    folder = scratch(spark)
    rank = F.when(F.col("status") == UNSUPPORTED, 2).when(F.col("status") == EXACT, 0).otherwise(1)
    nodes = written(nodes.select("node", "status"), f"{folder}/nodes")
    up = written(operands.select("node", "operand"), f"{folder}/up")
    # an operand without operands keeps its status, so its edges count in the first round alone
    first = nodes.select(F.col("node").alias("operand"), rank.alias("rank"), F.lit(False).alias("inner")).where("rank > 0")
    within = up.select("node").distinct().join(nodes.select("node"), "node", "left_semi").select("node", F.lit(None).cast("int"), F.lit(True))
    told = first.union(within).groupBy("operand").agg(F.max("rank").alias("rank"), F.max("inner").alias("inner"))
    edges = written(up.join(told, "operand"), f"{folder}/edges")
    levels, moved = Levels(spark, f"{folder}/levels", "round"), None
    while True:
        met = edges.where("rank is not null") if moved is None else edges.where("inner").select("node", "operand").join(moved, "operand")
        higher = met.groupBy("node").agg(F.max("rank").alias("rank"))
        if levels.n:
            before = levels.all().groupBy("node").agg(F.max("rank").alias("had"))
            higher = higher.join(before, "node", "left").where("had is null or had < rank").select("node", "rank")
        if not levels.add(higher)["rows"]:
            break
        moved = levels.last().select(F.col("node").alias("operand"), "rank")
    least = levels.all().groupBy("node").agg(F.max("rank").alias("least"))
    told = nodes.join(least, "node", "left")
    return told.select("node", F.when(F.col("least") > rank, F.when(F.col("least") == 2, UNSUPPORTED).otherwise(UNRESOLVED)).otherwise(F.col("status")).alias("status"))


def seed_positions(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """entity, position, index, bit, status: the bits that each seed names, in its order and with its repeats.

    vectors: entity, index, bit; seeds: entity, indices (array), first, last.  A seed
    with neither indices nor a slice [first, last) is the whole vector.  An index
    that the vector does not have is 'invalid', a seed with both is 'conflicting'
    and has no position.
    """
    size = vectors.groupBy("entity").agg((F.max("index") + 1).alias("size"))
    both = F.col("indices").isNotNull() & F.col("first").isNotNull()
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    wanted = F.coalesce("indices", F.when(F.col("first").isNotNull(), span(F.col("first"), F.col("last"))), span(F.lit(0), F.col("size")), F.array().cast("array<int>"))
    asked = seeds.join(size, "entity", "left").select("entity", both.alias("both"), F.posexplode_outer(F.when(~both, wanted)).alias("position", "index"))
    met = asked.join(vectors, ["entity", "index"], "left")
    return met.select("entity", "position", "index", "bit", F.when(F.col("both"), "conflicting").when(F.col("bit").isNull(), "invalid").otherwise(EXACT).alias("status"))


def implementations(endpoints: DataFrame, behaviours: DataFrame) -> DataFrame:
    """endpoint, behaviour, status: the behaviour of the same owner and definition; several are ambiguous, none is unresolved."""
    one = behaviours.groupBy("owner", "definition").agg(F.count(F.lit(1)).alias("n"), F.min("behaviour").alias("behaviour"))
    met = endpoints.join(one, ["owner", "definition"], "left")
    return met.select("endpoint", F.when(F.col("n") == 1, F.col("behaviour")).alias("behaviour"), F.when(F.col("n") == 1, EXACT).when(F.col("n") > 1, "ambiguous").otherwise(UNRESOLVED).alias("status"))


def at_instances(relations: DataFrame, instances: DataFrame, behaviours: DataFrame) -> DataFrame:
    """Relations of a definition (module, src, dst, kind) at each of its instances (instance, module) whose behaviours (instance, name, behaviour) have both names once."""
    once = behaviours.groupBy("instance", "name").agg(F.count(F.lit(1)).alias("n"), F.min("behaviour").alias("behaviour")).where("n = 1").drop("n")
    of = lambda end: once.select("instance", F.col("name").alias(end), F.col("behaviour").alias(f"{end}_behaviour"))
    met = relations.join(instances, "module").join(of("src"), ["instance", "src"]).join(of("dst"), ["instance", "dst"])
    return met.select("instance", "kind", F.col("src_behaviour").alias("src"), F.col("dst_behaviour").alias("dst"))


def schedule_badge(edges: DataFrame, group: list[str]) -> DataFrame:
    """Per group how its scheduling edges (origin: compiler, attribute or heuristic) are known."""
    has = lambda o: F.coalesce(F.bool_or(F.col("origin") == o), F.lit(False))
    compiler, attribute, heuristic = has("compiler"), has("attribute"), has("heuristic")
    badge = F.when((compiler & (attribute | heuristic)) | (attribute & heuristic), "mixed").when(compiler, "compiler").when(heuristic, "heuristic").otherwise("source")
    return edges.groupBy(*group).agg(badge.alias("badge"), F.count(F.lit(1)).alias("n"), compiler.alias("authoritative"))


def coverage(population: DataFrame, matched: DataFrame) -> DataFrame:
    """category, total, resolved, unmapped and a fingerprint of the ids (category, id) that a population has."""
    ids = population.select("category", "id").distinct().join(matched.select("category", "id").distinct().withColumn("hit", F.lit(1)), ["category", "id"], "left")
    digest = F.sum(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)"))  # order does not matter, and no list is gathered
    return ids.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("resolved"), F.count_if(F.col("hit").isNull()).alias("unmapped"), digest.cast("string").alias("fingerprint"))


def in_mode(edges: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    """The edges (src, dst, kind) of a mode of which neither end (node, hidden) is hidden; an end that is no node is not."""
    from tracelake.functions.scalars import edge_mode

    hidden = nodes.where("hidden").select("node")
    own = edges.where(edge_mode(F.col("kind")) == mode)
    return own.join(hidden.withColumnRenamed("node", "src"), "src", "left_anti").join(hidden.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "kind")


def shown(nodes: DataFrame, packages: bool = True, rules: bool = True, primitives: bool = False, mode: str = "structure") -> DataFrame:
    """The nodes (node, kind, hidden, primitive) that the filters leave; primitives that are not asked for show with data flow only."""
    left = nodes.where(~F.col("hidden"))
    if not packages:
        left = left.where("kind <> 'package'")
    if not rules:
        left = left.where(~F.col("kind").isin("rule", "method"))
    return left if primitives or mode == "data-flow" else left.where(~F.col("primitive"))


def cell_seeds(pins: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, pin, status: the pins that a seed at a cell may mean, as a cell alone names no bits.

    pins: cell, occurrence, pin; seeds: seed, cell, occurrence, indices (array or
    null).  A cell with one pin is 'exact', with several each is 'ambiguous'; a seed with indices, or whose
    occurrence does not have the cell, is 'invalid' and has no pin.
    """
    held = pins.select("cell", "occurrence", "pin").distinct()
    n = held.groupBy("cell", "occurrence").agg(F.count(F.lit(1)).alias("n"))
    asked = seeds.join(n, ["cell", "occurrence"], "left").withColumn("clear", F.col("n").isNotNull() & F.col("indices").isNull())
    met = asked.where("clear").join(held, ["cell", "occurrence"]).select("seed", "pin", F.when(F.col("n") == 1, EXACT).otherwise("ambiguous").alias("status"))
    return met.union(asked.where("not clear").select("seed", F.lit(None).cast("string"), F.lit("invalid")))


def producers(arguments: DataFrame, parts: DataFrame, references: DataFrame, bindings: DataFrame, max_depth: int = 1000) -> DataFrame:
    """call, position, expression, binding, endpoint, status: which bindings produce what a call passes on.

    arguments: call, position, expression, caller (a behaviour); parts: expression, part (an operand,
    argument or definition of it); references: expression, statement, place - the members that
    expressions name; bindings: binding, behaviour, statement, place, endpoint.
    From each argument every part is followed, however deep, cycles too; a reference
    that it comes to meets the bindings of the caller at the same statement and
    place.  One is 'exact'; of several each is an 'ambiguous' candidate; none gives no row.
    What parts lead to is found once for each that an argument has, not for each argument.
    """
    spark = arguments.sparkSession
    folder = scratch(spark)
    parts = parts.select(F.col("expression").alias("at"), F.col("part").alias("next"))
    passed = arguments.select("call", "position", F.col("expression").alias("argument"), F.col("caller").alias("behaviour"))
    # one pass over the parts tells which are of an argument and which are of a part; equal rows may stay, as what they lead to is made distinct
    marks = arguments.select(F.col("expression").alias("at"), F.lit(True).alias("passed"), F.lit(False).alias("inner")).union(parts.select("next", F.lit(False), F.lit(True)))
    marked = written(parts.join(marks.groupBy("at").agg(F.max("passed").alias("passed"), F.max("inner").alias("inner")), "at"), f"{folder}/parts")
    first = marked.where("passed").select(F.col("at").alias("argument"), F.col("next").alias("first"))
    inner = marked.where("inner").select("at", "next")
    levels = Levels(spark, f"{folder}/levels", "depth")
    level = first.select("first", F.col("first").alias("at")).distinct()
    while levels.add(level)["rows"]:
        if levels.n >= max_depth:
            raise ValueError(f"expressions are over {max_depth} deep")
        following = levels.last().join(inner, "at").select("first", F.col("next").alias("at")).distinct()
        level = following.join(levels.all().select("first", "at"), ["first", "at"], "left_anti")
    references = references.groupBy("expression", "statement", "place").agg(F.count(F.lit(1)).cast("int").alias("repeats"))
    named = levels.all().select("first", F.col("at").alias("expression")).join(references, "expression")
    own = references.select(F.col("expression").alias("argument"), *references.columns)
    below = first.join(named, "first").select(own.columns)
    # dealt by argument, so what is distinct lies where the arguments meet it
    met = passed.join(below.union(own).repartition("argument").distinct(), "argument").withColumn("repeats", F.explode(F.array_repeat(F.lit(0), F.col("repeats"))))
    met = met.join(bindings.select("binding", "behaviour", "statement", "place", "endpoint"), ["behaviour", "statement", "place"])
    several = F.count(F.lit(1)).over(Window.partitionBy("call", "position", "expression")) > 1
    return met.select("call", "position", "expression", "binding", "endpoint", F.when(several, "ambiguous").otherwise(EXACT).alias("status"))
