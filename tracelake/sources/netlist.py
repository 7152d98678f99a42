"""Netlist JSON as tables, and electrical questions about it.

A vector is kept long: one row per position of a port, pin or alias.  Signal bits
are shared within an occurrence of a module; a constant belongs to its own place
only.  What crosses a level of hierarchy is a pair of bits that are one net, so
nets are connected components of bits; dependencies run between nets, over cells.
In the JSON, bits 0, 1, x and z are constants and other numbers are signals.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import binary_parameter
from tracelake.operators import graph as G
from tracelake.operators.checkpoints import scratch, written
from tracelake.operators.components import components

SCHEMA = """modules map<string, struct<
  attributes: map<string,string>, parameter_default_values: map<string,string>, processes: map<string,string>,
  ports: map<string, struct<direction: string, bits: array<string>>>,
  netnames: map<string, struct<bits: array<string>>>,
  memories: map<string,string>,
  cells: map<string, struct<type: string, parameters: map<string,string>, attributes: map<string,string>,
    port_directions: map<string,string>, connections: map<string,array<string>>>>>>"""

# The cell types whose dependencies are known, by how outputs depend on inputs.
ARITHMETIC = ["$add", "$sub"]
BOOLEAN = ["$eq", "$ne", "$lt", "$logic_and", "$logic_or", "$logic_not"]
SELECTING = ["$mux", "$pmux"]
# Public names of cells that hold state.
SEQUENTIAL = "$sr $ff $dff $dffe $adff $adffe $aldff $aldffe $sdff $sdffe $sdffce $dffsr $dffsre $dlatch $adlatch $dlatchsr".split()
SEQUENTIAL_GATES = "$_DFF_ $_DFFE_ $_SDFF_ $_SDFFE_ $_SDFFCE_ $_DFFSR_ $_DFFSRE_ $_DLATCH_ $_DLATCHSR_ $_SR_".split()
MEMORY = "$mem $mem_v2 $memory $memrd $memrd_v2 $memwr $memwr_v2 $meminit $meminit_v2".split()


class Netlist(NamedTuple):
    """definitions: module, blackbox, top; occurrences as graph.expand() gives them, node being the module;
    cells: occurrence, cell, type, is_module, blackbox, parameters; vectors: occurrence, kind, cell, name, direction, index, value, bit;
    boundaries: a, b (bits of one net on two levels); problems: code, subject."""

    definitions: DataFrame
    occurrences: DataFrame
    cells: DataFrame
    vectors: DataFrame
    boundaries: DataFrame
    problems: DataFrame


def flag(value: Column) -> Column:
    return F.coalesce(value.rlike("^0*1$"), F.lit(False))


def read_netlist(spark: SparkSession, path: str, tops: list[str] | None = None) -> Netlist:
    return netlist_of(spark.read.text(path, wholetext=True).select("value"), tops)


def netlist_of(texts: DataFrame, tops: list[str] | None = None) -> Netlist:
    """All tables of the netlists in texts (value).  Modules that are wrong are in problems; ask validated() to raise."""
    spark = texts.sparkSession
    parsed = texts.select(F.from_json("value", SCHEMA).alias("j")).select(F.explode_outer("j.modules").alias("module", "m"))
    modules = written(parsed, f"{scratch(spark)}/modules")
    definitions = modules.where("module is not null").select("module", (flag(F.col("m.attributes")["blackbox"]) | flag(F.col("m.attributes")["whitebox"])).alias("blackbox"), flag(F.col("m.attributes")["top"]).alias("top"))
    cells = modules.select("module", F.explode("m.cells").alias("cell", "c")).select("module", "cell", F.col("c.type").alias("type"), F.col("c.parameters").alias("parameters"), F.col("c.attributes").alias("attributes"), F.col("c.port_directions").alias("directions"), F.col("c.connections").alias("connections"))
    inner = cells.join(definitions.select(F.col("module").alias("type"), F.col("blackbox").alias("target_blackbox")), "type", "left").withColumn("is_module", F.col("target_blackbox").isNotNull())

    children = inner.where("is_module").select(F.col("module").alias("parent"), F.col("type").alias("node"), F.col("cell").alias("name"))
    if tops:
        roots = spark.createDataFrame([(x,) for x in tops], "node string")
    else:
        marked = definitions.where("top").select(F.col("module").alias("node"))
        free = definitions.select(F.col("module").alias("node")).join(children.select("node"), "node", "left_anti")
        roots = free if marked.isEmpty() else marked
    occurrences = G.expand(children, roots)
    placed = occurrences.where("status = 'expanded'").select(F.col("path").alias("occurrence"), F.col("node").alias("module"))

    def long(df: DataFrame, kind: str) -> DataFrame:
        return df.select("module", F.lit(kind).alias("kind"), "cell", "name", "direction", F.posexplode("bits").alias("index", "value"))

    ports = modules.select("module", F.explode("m.ports").alias("name", "p")).select("module", F.lit(None).cast("string").alias("cell"), "name", F.col("p.direction").alias("direction"), F.col("p.bits").alias("bits"))
    aliases = modules.select("module", F.explode("m.netnames").alias("name", "p")).select("module", F.lit(None).cast("string").alias("cell"), "name", F.lit(None).cast("string").alias("direction"), F.col("p.bits").alias("bits"))
    pins = cells.select("module", "cell", "directions", F.explode("connections").alias("name", "bits")).select("module", "cell", "name", F.col("directions")[F.col("name")].alias("direction"), "bits")
    rows = long(ports, "port").union(long(aliases, "alias")).union(long(pins, "pin"))
    constant = F.col("value").isin("0", "1", "x", "z")
    own = F.concat_ws("|", "occurrence", "kind", F.coalesce("cell", F.lit("")), "name", F.col("index").cast("string"))
    bit = F.when(constant, F.concat(F.lit("constant|"), own)).otherwise(F.concat_ws("|", F.lit("bit"), "occurrence", "value"))
    vectors = written(placed.join(rows, "module").select("occurrence", "module", "kind", "cell", "name", "direction", "index", "value", bit.alias("bit")), f"{scratch(spark)}/vectors")

    below = placed.join(inner.where("is_module").select("module", "cell"), "module").select("occurrence", "cell", F.concat_ws("/", "occurrence", "cell").alias("child"))
    outside = vectors.where("kind = 'pin'").join(below, ["occurrence", "cell"]).select("child", "name", "index", F.col("bit").alias("a"))
    formal = vectors.where("kind = 'port'").select(F.col("occurrence").alias("child"), "name", "index", F.col("bit").alias("b"))
    boundaries = outside.join(formal, ["child", "name", "index"]).select("child", "name", "index", "a", "b")

    known = placed.join(inner, "module").select("occurrence", "cell", "type", "is_module", F.coalesce("target_blackbox", flag(F.col("attributes")["blackbox"]) | flag(F.col("attributes")["whitebox"]), F.lit(False)).alias("blackbox"), "parameters")
    return Netlist(definitions, occurrences, known, vectors, boundaries, problems_of(modules, inner, occurrences))


def problems_of(modules: DataFrame, cells: DataFrame, occurrences: DataFrame) -> DataFrame:
    """code and subject of what makes a netlist invalid."""
    name = lambda *c: F.concat_ws("/", *c)
    pins = cells.where("is_module").select("module", "cell", "directions", F.col("type").alias("target"), F.explode("connections").alias("port", "bits"))
    formal = modules.select(F.col("module").alias("target"), F.explode("m.ports").alias("port", "p"))
    met = pins.join(formal, ["target", "port"], "left")
    said = F.col("directions")[F.col("port")]
    both = said.isin("input", "output", "inout") & F.col("p.direction").isin("input", "output", "inout")
    vectors = modules.select("module", F.explode(F.map_values("m.ports")).alias("p")).select("module", F.explode("p.bits").alias("bit"))
    vectors = vectors.union(cells.select("module", F.explode("connections").alias("port", "bits")).select("module", F.explode("bits").alias("bit")))
    found = [
        modules.where("module is null").select(F.lit("not-a-netlist"), F.lit("")),
        modules.where(F.size("m.processes") > 0).select(F.lit("unsupported-processes"), "module"),
        met.where("p is null").select(F.lit("missing-formal-port"), name("module", "cell", "port")),
        met.where((F.size("bits") > 0) & (F.size("bits") != F.size("p.bits"))).select(F.lit("width-mismatch"), name("module", "cell", "port")),
        met.where(both & (said != F.col("p.direction"))).select(F.lit("direction-mismatch"), name("module", "cell", "port")),
        vectors.where(F.col("bit").isNull() | ~F.col("bit").rlike("^(?:[0-9]+|x|z)$")).select(F.lit("malformed-bit"), "module"),
        occurrences.where("status = 'cycle-cut'").select(F.lit("recursive-hierarchy"), "path"),
        occurrences.where("status = 'depth-cut'").select(F.lit("hierarchy-depth"), "path"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.toDF("code", "subject").distinct()


def validated(netlist: Netlist) -> Netlist:
    """The netlist; raises with the first problems if it has any."""
    if bad := netlist.problems.orderBy("code", "subject").limit(20).collect():
        raise ValueError("; ".join(f"{r['code']}: {r['subject']}" for r in bad))
    return netlist


def nets(netlist: Netlist) -> DataFrame:
    """bit and net, the smallest bit that is electrically the same."""
    pairs = netlist.boundaries.select("a", "b")
    found = components(pairs, scratch(pairs.sparkSession))
    bits = netlist.vectors.select(F.col("bit").alias("node")).distinct()
    return bits.join(found, "node", "left").select(F.col("node").alias("bit"), F.coalesce("class", "node").alias("net"))


def contacts(netlist: Netlist, named: DataFrame) -> DataFrame:
    """Every place at which a net is touched, with its role and whether it drives or loads the net there.

    A port of a top drives the net if it is an input; a pin of a cell does if it
    is an output.  Pins of instances and ports inside them only pass through.
    """
    tops = netlist.occurrences.where("parent_path is null").select(F.col("path").alias("occurrence"), F.lit(True).alias("top"))
    boxes = netlist.occurrences.join(netlist.definitions.where("blackbox").select(F.col("module").alias("node")), "node").select(F.col("path").alias("occurrence"), F.lit(True).alias("box"))
    cells = netlist.cells.select("occurrence", "cell", "type", "is_module")
    rows = netlist.vectors.join(named, "bit").join(tops, "occurrence", "left").join(boxes, "occurrence", "left").join(cells, ["occurrence", "cell"], "left")
    role = (
        F.when(F.col("kind") == "alias", "alias")
        .when(F.col("is_module"), "hierarchy-pass-through")
        .when((F.col("kind") == "port") & F.col("box"), "opaque-contract")
        .when((F.col("kind") == "port") & F.col("top").isNull(), "hierarchy-pass-through")
        .when(F.col("kind") == "port", "external-contact")
        .otherwise("leaf-terminal")
    )
    out = rows.withColumn("role", role)
    drives = F.col("direction") == F.when(F.col("role") == "external-contact", "input").otherwise("output")
    side = (
        F.when(F.col("role") == "alias", "alias")
        .when(F.col("direction").isNull() | ~F.col("direction").isin("input", "output"), "unknown")
        .when(F.col("role") == "hierarchy-pass-through", "boundary")
        .when(drives, "driver")
        .otherwise("load")
    )
    return out.select("net", "bit", "occurrence", "kind", "cell", "type", "name", "index", "direction", "role", side.alias("side"))


def same_net(netlist: Netlist, seeds: DataFrame) -> DataFrame:
    """position and the contacts of each seed's net; seeds (position, bit) may repeat a bit."""
    named = nets(netlist)
    return seeds.join(named, "bit").select("position", "net").join(contacts(netlist, named), "net")


def cell_kinds(netlist: Netlist) -> DataFrame:
    """occurrence, cell, class and reason: what a dependency question does at the cell.

    combinational cells that have the parameters their widths need are followed,
    every other is a boundary for the given reason; no value is ever folded away.
    """
    pins = netlist.vectors.where("kind = 'pin'").groupBy("occurrence", "cell", "name").agg(F.count(F.lit(1)).alias("width"), F.min("direction").alias("direction"))
    shape = pins.groupBy("occurrence", "cell").agg(F.map_from_entries(F.collect_list(F.struct("name", "width"))).alias("widths"), F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("direction", F.lit("")).alias("d")))).alias("directions"))
    p = lambda name: binary_parameter(F.col("parameters")[name])
    w = lambda name: F.col("widths")[name]
    is_ = lambda *types: F.col("type").isin(*types)
    fits = (
        F.when(is_("$logic_not"), (w("A") == p("A_WIDTH")) & (w("Y") == p("Y_WIDTH")))
        .when(is_(*ARITHMETIC, *BOOLEAN), (w("A") == p("A_WIDTH")) & (w("B") == p("B_WIDTH")) & (w("Y") == p("Y_WIDTH")))
        .when(is_("$mux"), (w("A") == p("WIDTH")) & (w("B") == p("WIDTH")) & (w("Y") == p("WIDTH")) & (w("S") == 1))
        .when(is_("$pmux"), (w("A") == p("WIDTH")) & (w("B") == p("WIDTH") * p("S_WIDTH")) & (w("Y") == p("WIDTH")) & (w("S") == p("S_WIDTH")))
        .when(is_("$dff"), (w("D") == p("WIDTH")) & (w("Q") == p("WIDTH")) & (w("CLK") == 1))
    )
    signs = ~is_(*ARITHMETIC, "$eq", "$ne", "$lt") | (p("A_SIGNED") == p("B_SIGNED"))
    flow = F.forall(F.map_entries("directions"), lambda e: e["value"] == F.when(e["key"].isin("Y", "Q"), "output").otherwise("input"))
    class_ = (
        F.when(F.col("is_module") & F.col("blackbox"), "blackbox")
        .when(F.col("is_module"), "hierarchy")
        .when(F.col("blackbox"), "blackbox")
        .when(is_(*MEMORY), "memory")
        .when(is_(*SEQUENTIAL) | reduce(lambda x, y: x | y, [F.col("type").startswith(g) for g in SEQUENTIAL_GATES]), "sequential")
        .when(is_(*ARITHMETIC, *BOOLEAN, *SELECTING), "combinational")
        .otherwise("unsupported")
    )
    out = netlist.cells.join(shape, ["occurrence", "cell"], "left").withColumn("class", class_)
    reason = (
        F.when(F.col("class") == "hierarchy", None)
        .when((F.col("class") == "combinational") & ~F.coalesce(fits & signs, F.lit(False)), "unsupported-parameters")
        .when((F.col("class") == "combinational") & ~F.coalesce(flow, F.lit(False)), "unsupported-ports")
        .when(F.col("class") == "combinational", None)
        .when(F.col("class") == "unsupported", "unsupported-cell")
        .otherwise(F.col("class"))
    )
    return out.select("occurrence", "cell", "type", "class", reason.alias("reason"), binary_parameter(F.col("parameters")["WIDTH"]).alias("width"))


def cell_edges(netlist: Netlist, kinds: DataFrame) -> DataFrame:
    """src and dst bits of every dependency over a supported cell, with kind data or control.

    Arithmetic outputs depend on all operand bits; boolean results on all, at
    their first bit; selected data on the bit of the same place in each branch,
    and on every select bit, which is control.
    """
    followed = kinds.where("class = 'combinational' and reason is null")
    pins = netlist.vectors.where("kind = 'pin'").join(followed, ["occurrence", "cell"])
    outs = pins.where("name = 'Y'").select("occurrence", "cell", F.col("bit").alias("dst"), F.col("index").alias("y"))
    ins = pins.where("name <> 'Y'").select("occurrence", "cell", "type", "width", "name", "index", F.col("bit").alias("src"))
    any_ = ins.where(F.col("type").isin(*ARITHMETIC) | (F.col("name") == "S")).join(outs, ["occurrence", "cell"])
    placed = ins.where(~F.col("type").isin(*ARITHMETIC) & (F.col("name") != "S")).withColumn("y", F.when(F.col("type").isin(*BOOLEAN), 0).otherwise(F.col("index") % F.col("width")).cast("int"))
    same = placed.join(outs, ["occurrence", "cell", "y"])
    kind = F.when((F.col("name") == "S") & F.col("type").isin(*SELECTING), "control").otherwise("data").alias("kind")
    columns = ["occurrence", "cell", "src", "dst", kind]
    return any_.select(*columns).union(same.select(*columns))


def dependencies(netlist: Netlist, seeds: DataFrame, direction: str = "backward", max_depth: int | None = None, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nets a seed (bit) depends on, or that depend on it: node, depth, reason; and the boundaries met: net, reason, occurrence, cell.

    Nets with several drivers, or touched where a direction is unknown, are
    reached and not left.  Only limits, several drivers and unknown things make
    a result partial; state, outside and missing drivers are where a cone ends.
    """
    named = written(nets(netlist), scratch(seeds.sparkSession))
    kinds = written(cell_kinds(netlist), scratch(seeds.sparkSession))
    touched = written(contacts(netlist, named), scratch(seeds.sparkSession))
    edges = cell_edges(netlist, kinds)
    ends = edges.join(named.select(F.col("bit").alias("src"), F.col("net").alias("from")), "src").join(named.select(F.col("bit").alias("dst"), F.col("net").alias("to")), "dst")
    a, b = ("to", "from") if direction == "backward" else ("from", "to")
    sides = touched.groupBy("net").agg(F.count_if(F.col("side") == "driver").alias("drivers"), F.count_if(F.col("side") == "unknown").alias("unknown"), F.max(F.col("bit").startswith("constant|")).alias("constant"))
    held = sides.where("drivers > 1 or unknown > 0").select(F.col("net").alias("node"))
    start = seeds.join(named, "bit").select(F.col("net").alias("node")).distinct()
    reached = written(G.reach(ends.select(F.col(a).alias("src"), F.col(b).alias("dst")), start, max_depth=max_depth, max_nodes=max_nodes, stop=held), scratch(seeds.sparkSession))
    open_ = reached.select(F.col("node").alias("net"))
    at_net = open_.join(sides, "net").select(
        "net", F.when(F.col("drivers") > 1, "multiple-drivers").when(F.col("unknown") > 0, "unknown-direction").when(F.col("constant"), "constant").when(F.col("drivers") == 0, "dangling").alias("reason"), F.lit(None).cast("string").alias("occurrence"), F.lit(None).cast("string").alias("cell")
    )
    side = "output" if direction == "backward" else "input"
    at_cell = open_.join(touched.where((F.col("role") == "leaf-terminal") & (F.col("direction") == side)), "net").join(kinds.where("reason is not null").select("occurrence", "cell", "reason"), ["occurrence", "cell"]).select("net", "reason", "occurrence", "cell")
    at_port = open_.join(touched.where(F.col("role").isin("external-contact", "opaque-contract")), "net").select("net", F.when(F.col("role") == "opaque-contract", "blackbox").otherwise("external-contact"), "occurrence", "cell")
    return reached, at_net.where("reason is not null").union(at_cell).union(at_port).distinct()


def combinational_cycles(netlist: Netlist) -> DataFrame:
    """Nets on cycles of combinational cells; crossing a level of hierarchy is no step."""
    named = nets(netlist)
    edges = cell_edges(netlist, cell_kinds(netlist))
    ends = edges.join(named.select(F.col("bit").alias("src"), F.col("net").alias("a")), "src").join(named.select(F.col("bit").alias("dst"), F.col("net").alias("b")), "dst")
    return G.cycle_members(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))
