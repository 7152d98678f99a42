"""Questions about a model: what belongs to a root, a behaviour, a call or an instance, and which sources an entry needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import arguments
from tracelake.operators.checkpoints import scratch, written
from tracelake.operators.graph import reach
from tracelake.operators.relations import first_of_each, paired
from tracelake.operators.resolve import EXACT, UNRESOLVED


def topology(instances: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, depth of the instances (node, parent) below or at a root (node, nth); of several roots the first by nth has a node.

    Parents are followed by doubling: each round a node learns what the one twice as
    far up knows, so the rounds grow with the logarithm of the depth.  Parents in a
    ring end after as many rounds as would reach past every node.
    """
    spark = instances.sparkSession
    folder, k = scratch(spark), 0
    first = roots.groupBy("node").agg(F.min("nth").alias("nth"))
    known = instances.select(F.col("node").alias("up"))
    up = instances.select("node", F.col("parent").alias("up")).where("up <> node").join(known, "up", "left_semi")
    state = instances.select("node").join(up, "node", "left").join(first, "node", "left")
    best = F.when(F.col("nth").isNotNull(), F.struct("nth", F.lit(0).cast("long").alias("depth"), F.col("node").alias("root")))
    state = written(state.select("node", "up", F.lit(1).cast("long").alias("step"), best.alias("best")), f"{folder}/0")
    rounds, done = state.count().bit_length() + 1, [state.where("up is null")]
    moving = state.where("up is not null")
    while k < rounds and not moving.isEmpty():
        k += 1
        # what has arrived stays where it was written: as a row without a key it would be joined in one task with all others such
        above = reduce(DataFrame.unionByName, [*done, moving]).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("step").alias("further"), F.col("best").alias("held"))
        held = F.when(F.col("held").isNotNull(), F.struct(F.col("held.nth").alias("nth"), (F.col("held.depth") + F.col("step")).alias("depth"), F.col("held.root").alias("root")))
        moved = moving.join(above, "up").select("node", F.col("next").alias("up"), (F.col("step") + F.col("further")).alias("step"), F.least("best", held).alias("best"))
        state = written(moved, f"{folder}/{k}")
        done.append(state.where("up is null"))
        moving = state.where("up is not null")
    state = reduce(DataFrame.unionByName, [*done, moving])
    return state.where("best is not null").select("node", "best.root", "best.depth")


def root_headers(placed: DataFrame, channels: DataFrame) -> DataFrame:
    """root, descendants, channels: how many nodes are below each root of a topology, and how many channels (node, channel) in all."""
    held = channels.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(held, "node", "left").groupBy("root").agg(F.count_if(F.col("depth") > 0).alias("descendants"), F.coalesce(F.sum("n"), F.lit(0)).alias("channels"))


def expression_edges(expressions: DataFrame) -> DataFrame:
    """src, dst: what each expression (expression, operands, definitions, arguments: arrays) is made of, where that is an expression too."""
    lists = F.array(*(F.coalesce(c, F.array().cast(expressions.schema[c].dataType)) for c in ("operands", "definitions", "arguments")))
    pairs = expressions.select(F.explode(F.array_distinct(F.flatten(lists))).alias("src"), F.col("expression").alias("dst"))
    return pairs.join(expressions.select(F.col("expression").alias("src")), "src", "left_semi").distinct()


def source_dependencies(expressions: DataFrame, seeds: DataFrame, direction: str = "backward", max_depth: int | None = None) -> DataFrame:
    """node, depth, reason of the expressions that the seeds (node) depend on, or that depend on them; reason 'depth' tells where the limit cut."""
    edges = expression_edges(expressions)
    if direction == "backward":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edges, seeds, max_depth=max_depth)


def behaviour_slices(behaviours: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """behaviour, part, id: what belongs to each behaviour (behaviour, definition).

    parts: tables of id with either a behaviour (bindings, schedules) or a
    definition (statements, expressions, calls), which all its behaviours share;
    as every behaviour gets a row for each of those, they are paired in blocks.
    """
    own = behaviours.select("behaviour")
    shared = [rows.select("definition", "id", F.lit(part).alias("part")) for part, rows in parts.items() if "behaviour" not in rows.columns]
    each = [rows.join(own, "behaviour").select("behaviour", F.lit(part).alias("part"), "id") for part, rows in parts.items() if "behaviour" in rows.columns]
    if shared:
        each.append(paired(behaviours.select("behaviour", "definition"), reduce(DataFrame.union, shared), "definition").select("behaviour", "part", "id"))
    return reduce(DataFrame.unionByName, each)


def call_mappings(calls: DataFrame, actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """call, position, expression, formal, status, reason: the formal of each actual argument.

    calls: call, target (null if unresolved); actuals: call, position, expression;
    formals: target, position, formal.  Arguments are mapped only where a call has as
    many as its target takes.
    """
    given = actuals.groupBy("call").agg(F.count(F.lit(1)).alias("n_given"))
    taken = formals.groupBy("target").agg(F.count(F.lit(1)).alias("n_taken"))
    sized = calls.join(given, "call", "left").join(taken, "target", "left")
    fits = F.col("target").isNotNull() & (F.coalesce("n_given", F.lit(0)) == F.coalesce("n_taken", F.lit(0)))
    told = sized.select("call", "target", fits.alias("fits"), F.when(F.col("target").isNull(), "unresolved-call-target").when(~fits, "arity").alias("reason"))
    named = formals.select("target", "position", "formal")
    met = told.join(actuals, "call", "left").join(named, ["target", "position"], "left")
    return met.select("call", "position", "expression", F.when(F.col("fits"), F.col("formal")).alias("formal"), F.when(F.col("fits"), EXACT).otherwise(UNRESOLVED).alias("status"), "reason")


def composition(instances: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """instance, role, id: the children, members and relations of every instance.

    instances: instance, parent; members: instance, role, id; relations: id, role,
    src, dst, of which an end is the instance, a child or a member.
    """
    children = instances.where("parent is not null").select(F.col("parent").alias("instance"), F.lit("child").alias("role"), F.col("instance").alias("id"))
    held = children.unionByName(members.select("instance", "role", "id"))
    related = held.select("instance", F.col("id").alias("end")).union(instances.select("instance", F.col("instance").alias("end"))).distinct()
    ends = relations.select("id", "role", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
    return held.unionByName(ends.join(related, "end").select("instance", "role", "id").distinct())


def channel_members(channels: DataFrame, endpoints: DataFrame) -> DataFrame:
    """channel, role, endpoint of the methods (map of role to endpoint) that are known endpoints."""
    return channels.select("channel", F.explode("methods").alias("role", "endpoint")).join(endpoints.select("endpoint"), "endpoint", "left_semi").select("channel", "role", "endpoint")


def source_scope(files: DataFrame, imports: DataFrame, constructors: DataFrame, modules: DataFrame, entry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (path, included) that an entry (path) needs, over imported packages and constructed modules; and its unresolved imports (path, imported).

    files: path, package; imports: path, imported; constructors: path, name;
    modules: path, name.  A name that several files have leads to all of them.  Packages
    and names are nodes of their own between the files, so there are as many edges
    as rows, however many files share one.
    """
    wanted = imports.select("path", F.col("imported").alias("package")).distinct()
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    leads = lambda rows, kind, c: rows.select(node("file", "path").alias("src"), node(kind, c).alias("dst"))
    comes = lambda rows, kind, c: rows.select(node(kind, c).alias("src"), node("file", "path").alias("dst"))
    edges = leads(wanted, "package", "package").union(comes(files, "package", "package")).union(leads(constructors, "name", "name")).union(comes(modules, "name", "name"))
    found = reach(edges.where("src is not null and dst is not null"), entry.select(node("file", "path").alias("node")))
    path = F.substr("node", F.lit(len("file:") + 1)).cast(files.schema["path"].dataType)
    needed = written(found.where("node like 'file:%'").select(path.alias("path")), scratch(files.sparkSession))
    missing = wanted.join(files.select("package"), "package", "left_anti").join(needed, "path", "left_semi")
    scope = files.select("path").distinct().join(needed.withColumn("hit", F.lit(True)), "path", "left")
    return scope.select("path", F.coalesce("hit", F.lit(False)).alias("included")), missing.select("path", F.col("package").alias("imported"))


def location_key() -> list[Column]:
    """A range by its own ends; an end that is missing is its start, a start that is missing 0."""
    or_zero = lambda *c: F.coalesce(*c, F.lit(0))
    return [F.col("uri"), or_zero("line").alias("line"), or_zero("col").alias("col"), or_zero("end_line", "line").alias("end_line"), or_zero("end_col", "col").alias("end_col")]


def owned(targets: DataFrame, collections: list[DataFrame]) -> DataFrame:
    """The target ranges (uri, line, col, end_line, end_col), each once, and whether an item of any collection has exactly that range."""
    ranges = reduce(DataFrame.union, (c.select(*location_key()) for c in collections)).distinct().withColumn("hit", F.lit(True))
    asked = targets.select(*location_key()).distinct()
    return asked.join(ranges, asked.columns, "left").withColumn("owned", F.coalesce("hit", F.lit(False))).drop("hit")


def forwarded(provided: DataFrame, children: DataFrame, endpoints: DataFrame) -> DataFrame:
    """owner, outer, inner, status: which endpoint of a child an interface that an instance provides is.

    provided: owner, path, target (array: the child's name, then a path in it);
    children: parent, name, instance; endpoints: instance, path, endpoint; paths are
    joined by dots.  A name that several children have resolves to none.
    """
    only = children.groupBy(F.col("parent").alias("owner"), F.col("name").alias("child_name")).agg(F.count(F.lit(1)).alias("n"), F.min("instance").alias("child")).where("n = 1").drop("n")
    at = lambda instance, path, endpoint: endpoints.select(F.col("instance").alias(instance), F.col("path").alias(path), F.col("endpoint").alias(endpoint))
    rest = F.array_join(F.slice("target", 2, F.greatest(F.size("target") - 1, F.lit(0))), ".")
    asked = provided.select("owner", "path", F.get("target", F.lit(0)).alias("child_name"), F.when(F.size("target") > 0, rest).alias("inner_path"))
    met = asked.join(only, ["owner", "child_name"], "left").join(at("owner", "path", "outer"), ["owner", "path"], "left").join(at("child", "inner_path", "inner"), ["child", "inner_path"], "left")
    return met.select("owner", "path", "outer", "inner", F.when(F.col("outer").isNotNull() & F.col("inner").isNotNull(), EXACT).otherwise(UNRESOLVED).alias("status"))


def merged_accesses(accesses: DataFrame, order: list[str]) -> DataFrame:
    """Accesses of guard and body as one set: of those at one place the first in order stays."""
    keys = ["behaviour", "instance", "member", "kind", "operation", "line", "col"]
    return first_of_each(accesses.withColumn("member", F.coalesce("member", F.lit(""))), keys, order)


def distinct_relations(relations: DataFrame, order: list[str]) -> DataFrame:
    """Relations that look alike (direction, other, kind, evidence) are shown once, by the first in order."""
    return first_of_each(relations, ["direction", "other", "kind", "evidence"], order)


def distinct_paths(paths: DataFrame, order: list[str]) -> DataFrame:
    """Paths of the same steps (array) are one."""
    return first_of_each(paths, ["steps"], order)


def configured(nodes: DataFrame, overrides: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """node, label, kind, grp, description, hidden, entry, where an override goes before an annotation, that before the node's own.

    nodes: node, name, package, label, kind, grp, description, hidden, annotations
    (map); overrides: key, label, kind, grp, description, hide, entry, one per key,
    which is a node's id, else its name, else package.name: the first that exists
    counts as a whole.  Empty text counts as none; entrypoints: name.
    """
    rule = overrides.select(F.col("key"), F.struct("label", "kind", "grp", "description", "hide", "entry").alias("o"))
    at = lambda key, name: rule.select(F.col("key").alias(key), F.col("o").alias(name))
    keyed = nodes.withColumns({"k1": F.col("node").cast("string"), "k2": F.col("name"), "k3": F.concat("package", F.lit("."), "name")})
    keyed = keyed.join(at("k1", "o1"), "k1", "left").join(at("k2", "o2"), "k2", "left").join(at("k3", "o3"), "k3", "left")
    keyed = keyed.join(entrypoints.select("name", F.lit(True).alias("listed")).distinct(), "name", "left").withColumn("o", F.coalesce("o1", "o2", "o3"))
    text = lambda c: F.nullif(c, F.lit(""))
    of = lambda c, *last: F.coalesce(text(F.col(f"o.{c}")), text(F.get_json_object("a", f"$.{c}")), *last)
    said = lambda c, *more: reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in (F.col(f"o.{'hide' if c == 'hidden' else c}"), F.get_json_object("a", f"$.{'hide' if c == 'hidden' else c}") == "true", *more)))
    keyed = keyed.withColumn("a", F.to_json("annotations"))
    return keyed.select(
        "node",
        of("label", text(F.col("label")), F.col("name")).alias("label"),
        of("kind", F.col("kind")).alias("kind"),
        of("grp", F.col("grp")).alias("grp"),
        of("description", F.col("description"), F.lit("")).alias("description"),
        said("hidden", F.col("hidden")).alias("hidden"),
        said("entry", F.col("listed")).alias("entry"),
    )


def transition_sentences(callables: DataFrame, transitions: DataFrame) -> DataFrame:
    """behaviour, summary: what each behaviour (behaviour, kind, name, invocations) does to the states of its transitions (behaviour, effect, state, nth)."""
    verb = F.when(F.col("effect").isin("update", "write"), "updates").when(F.col("effect") == "enqueue", "enqueues").when(F.col("effect") == "dequeue", "dequeues")
    told = transitions.withColumn("verb", verb).where("verb is not null").groupBy("behaviour", "verb", "state").agg(F.min("nth").alias("nth"))
    lists = told.groupBy("behaviour").pivot("verb", ["updates", "enqueues", "dequeues"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "state"))), lambda x: x["state"]), ", "))
    said = lambda verb, word: F.concat(F.lit(f"{word} "), F.nullif(F.col(verb), F.lit("")))
    parts = F.concat_ws(" and ", said("updates", "Updates"), said("enqueues", "enqueues"), said("dequeues", "dequeues"))
    called = F.when(F.size("invocations") > 0, F.concat(F.lit("Invokes "), F.array_join("invocations", ", "), F.lit(".")))
    plain = F.concat(F.when(F.col("kind") == "rule", "Rule ").otherwise("Method "), "name", F.lit("."))
    summary = F.coalesce(F.when(parts != "", F.concat(parts, F.lit("."))), called, plain)
    return callables.join(lists, "behaviour", "left").select("behaviour", summary.alias("summary"))


def visibility(results: DataFrame, presentations: DataFrame, displayed: DataFrame) -> DataFrame:
    """entity, n_displays, visibility of each result (entity): visible if one of its presentations (display, entity) is displayed (display), hidden if it has others, else off-scene."""
    shown = presentations.select("display", "entity").distinct().join(displayed.select("display", F.lit(1).alias("on")).distinct(), "display", "left")
    per = shown.groupBy("entity").agg(F.count(F.lit(1)).alias("n_displays"), F.count("on").alias("on"))
    word = F.when(F.col("on") > 0, "visible").when(F.col("on") == 0, "hidden").otherwise("off-scene")
    return results.join(per, "entity", "left").select("entity", F.coalesce("n_displays", F.lit(0)).alias("n_displays"), word.alias("visibility"))


def storage_type(type_text: Column, kind: Column) -> Column:
    """What a storage holds: the first argument of its type, of a memory the last; null for a type without arguments, but for a register of Bool."""
    inner = F.nullif(F.regexp_extract(type_text, r"(?s)^[A-Za-z_$][\w$]*\s*#\s*\((.*)\)$", 1), F.lit(""))
    inner = F.when(F.regexp_count(inner, F.lit(r"\(")) == F.regexp_count(inner, F.lit(r"\)")), inner)
    of = F.transform(arguments(inner), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    taken = F.when(kind == "memory", F.element_at(of, -1)).otherwise(F.get(of, F.lit(0)))
    return F.when(kind.isNotNull(), F.coalesce(F.when(inner.isNotNull(), taken), F.when((kind == "register") & (type_text == "Bool"), "Bool")))


def element_reference(selector: Column, dimensions: Column) -> Column:
    """status of [i][j]… on a family of dimensions (array of status, lower, upper): exact within concrete ones, symbolic, else unresolved."""
    texts = F.transform(F.regexp_extract_all(selector, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))

    def one(text: Column, k: Column) -> Column:
        value, dim = F.when(text.rlike(r"^\d{1,15}$"), text.cast("long")), F.get(dimensions, k)
        inside = (dim["status"] == "concrete") & (value >= dim["lower"]) & (value < dim["upper"])
        return F.when(F.coalesce(inside, F.lit(False)), EXACT).when(value.isNotNull() & (dim["status"] == "symbolic"), "symbolic").otherwise(UNRESOLVED)

    each = F.transform(texts, one)
    whole = (F.size(each) == F.size(dimensions)) & F.forall(each, lambda s: s == EXACT)
    return F.when(selector.isNotNull() & (selector != "") & dimensions.isNotNull(), F.when(whole, EXACT).when(F.array_contains(each, UNRESOLVED), UNRESOLVED).otherwise("symbolic"))
