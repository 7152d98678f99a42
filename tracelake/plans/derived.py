"""Queries of the netlist, schedule and source readers over designs that Spark writes from the driver's tables.

The suppliers of a nation are a module: each a cell on a chain from the module's
input to its output, every fifth a register, and every fourth has a loop of two
inverters beside it.  The nations of a region are the instances of a top, one
behind another.  Blocks of 200 supplier numbers keep modules small at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import text as X
from tracelake.functions.scalars import primitive_kind
from tracelake.operators import graph as G
from tracelake.operators.checkpoints import scratch, written
from tracelake.plans.relational import t, text_key
from tracelake.plans.structures import FLOWS_SQL, flows
from tracelake.sources import netlist as N
from tracelake.sources import schedules

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


CHAIN_SQL = """s AS (SELECT s_suppkey AS k, n_nationkey AS nation, 'r' || n_regionkey || '_' || s_suppkey // 200 AS top, 'n' || n_nationkey || '_' || s_suppkey // 200 AS module,
row_number() OVER (PARTITION BY n_nationkey, s_suppkey // 200 ORDER BY s_suppkey) - 1 AS i, row_number() OVER (PARTITION BY n_regionkey, s_suppkey // 200 ORDER BY n_nationkey DESC, s_suppkey DESC) - 1 AS back
FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT DISTINCT top, nation, module, top || '/u' || nation AS occurrence FROM s),
cone AS (SELECT *, top || '/u' || nation AS occurrence, min(CASE WHEN k % 5 = 0 THEN back END) OVER (PARTITION BY top) AS state FROM s)"""


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def chained(spark, d) -> DataFrame:
    """k, nation, top, module and i: a supplier's place on its module's chain."""
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey")
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.expr("s_suppkey div 200").alias("block")).join(F.broadcast(nation), "nation")
    place = F.row_number().over(Window.partitionBy("nation", "block").orderBy("k")) - 1
    return rows.select("k", "nation", text("r", F.col("n_regionkey"), "_", F.col("block")).alias("top"), text("n", F.col("nation"), "_", F.col("block")).alias("module"), place.alias("i"))


def cell(name: Column, type_: Column | str, parameters: dict[str, int], outputs: list[str], **pins: Column) -> Column:
    """An entry of a module's cells; pins of one bit."""
    table = lambda x: F.create_map(*(F.lit(y) if not isinstance(y, Column) else y for pair in x.items() for y in pair))
    bits = table({p: F.array(b.cast("string")) for p, b in pins.items()})
    body = F.struct(
        (F.lit(type_) if isinstance(type_, str) else type_).alias("type"), table({p: str(v) for p, v in parameters.items()}).alias("parameters"),
        table({p: "output" if p in outputs else "input" for p in pins}).alias("port_directions"), bits.alias("connections"),
    )
    return F.struct(name.alias("key"), body.alias("value"))


def module_text(rows: DataFrame, name: str, output: Column) -> DataFrame:
    """value: a netlist of one module, of rows with a list `cells` of entries each; the input is net 2."""
    port = lambda direction, bit: F.struct(F.lit(direction).alias("direction"), F.array(bit.cast("string")).alias("bits"))
    made = rows.groupBy(name).agg(F.map_from_entries(F.flatten(F.collect_list("cells"))).alias("cells"), output.alias("out"))
    ports = F.create_map(F.lit("a"), port("input", F.lit(2)), F.lit("y"), port("output", F.col("out")))
    return made.select(F.to_json(F.struct(F.create_map(F.col(name), F.struct(ports.alias("ports"), "cells")).alias("modules"))).alias("value"))


def design(spark, d) -> N.Netlist:
    rows = written(chained(spark, d), scratch(spark))
    one = {"A_WIDTH": 1, "Y_WIDTH": 1, "A_SIGNED": 0}
    here, i = text("s", F.col("k")), F.col("i")
    register = cell(here, "$dff", {"WIDTH": 1}, ["Q"], D=2 + i, CLK=F.lit(1), Q=3 + i)
    inverter = lambda name, a, y: cell(name, "$logic_not", one, ["Y"], A=a, Y=y)
    loop = F.array(inverter(text("l", F.col("k"), "a"), 5000 + 2 * i, 5001 + 2 * i), inverter(text("l", F.col("k"), "b"), 5001 + 2 * i, 5000 + 2 * i))
    own = F.array(F.when(F.col("k") % 5 == 0, register).otherwise(inverter(here, 2 + i, 3 + i)))
    inner = rows.select("module", "i", F.when(F.col("k") % 4 == 3, F.concat(own, loop)).otherwise(own).alias("cells"))
    nth = F.row_number().over(Window.partitionBy("top").orderBy("nation")) - 1
    uses = rows.select("top", "nation", "module").distinct().withColumn("j", nth)
    outer = uses.select("top", "j", F.array(cell(text("u", F.col("nation")), F.col("module"), {"NATION": 0}, ["y"], a=2 + F.col("j"), y=3 + F.col("j"))).alias("cells"))
    texts = module_text(inner, "module", F.max("i") + 3).union(module_text(outer, "top", F.max("j") + 3))
    return N.validated(N.netlist_of(texts))


def outputs(netlist: N.Netlist) -> DataFrame:
    """bit: the output of every top."""
    tops = netlist.occurrences.where("parent_path is null").select(F.col("path").alias("occurrence"))
    return netlist.vectors.where("kind = 'port' and name = 'y'").join(tops, "occurrence", "left_semi").select("bit")


@query(f"WITH {CHAIN_SQL} SELECT DISTINCT top AS path, top AS module, 0 AS depth FROM s UNION ALL SELECT occurrence, module, 1 FROM u")
def netlist_occurrences(spark, d):
    return design(spark, d).occurrences.select("path", F.col("node").alias("module"), "depth")


@query(f"WITH {CHAIN_SQL} SELECT top AS occurrence, 'u' || nation AS cell, 'hierarchy' AS class, NULL AS reason FROM u UNION ALL SELECT top || '/u' || nation, 's' || k, CASE WHEN k % 5 = 0 THEN 'sequential' ELSE 'combinational' END, CASE WHEN k % 5 = 0 THEN 'sequential' END FROM s UNION ALL SELECT top || '/u' || nation, 'l' || k || side, 'combinational', NULL FROM s, (VALUES ('a'), ('b')) AS v(side) WHERE k % 4 = 3")
def netlist_cell_kinds(spark, d):
    return N.cell_kinds(design(spark, d)).select("occurrence", "cell", "class", "reason")


@query(f"WITH {CHAIN_SQL}, f AS (SELECT top, min(nation) AS nation FROM u GROUP BY top), g AS (SELECT s.* FROM s JOIN f USING (top, nation) WHERE i = 0) SELECT top AS occurrence, 'port' AS kind, NULL AS cell, 'a' AS name, 'driver' AS side FROM f UNION ALL SELECT top, 'pin', 'u' || nation, 'a', 'boundary' FROM f UNION ALL SELECT top || '/u' || nation, 'port', NULL, 'a', 'boundary' FROM f UNION ALL SELECT top || '/u' || nation, 'pin', 's' || k, CASE WHEN k % 5 = 0 THEN 'D' ELSE 'A' END, 'load' FROM g")
def netlist_same_net(spark, d):
    """What the input of every top is joined with."""
    netlist = design(spark, d)
    tops = netlist.occurrences.where("parent_path is null").select(F.lit(0).alias("position"), text("bit|", F.col("path"), "|2").alias("bit"))
    return N.same_net(netlist, tops).select("occurrence", "kind", "cell", "name", "side")


@query(f"WITH {CHAIN_SQL} SELECT occurrence, 's' || k AS cell, CAST(back AS INT) AS depth FROM cone WHERE back <= coalesce(state, back)")
def netlist_dependencies(spark, d):
    """The suppliers' cells whose nets each top's output depends on, back to the last register."""
    netlist = design(spark, d)
    reached = N.dependencies(netlist, outputs(netlist))[0]
    driven = netlist.vectors.where("kind = 'pin' and name in ('Y', 'Q') and cell like 's%'").join(N.nets(netlist), "bit")
    return driven.join(reached, driven["net"] == reached["node"]).select("occurrence", "cell", "depth")


@query(f"WITH {CHAIN_SQL} SELECT occurrence, 's' || k AS cell, 'sequential' AS reason FROM cone WHERE back = state UNION ALL SELECT DISTINCT top, NULL, 'external-contact' FROM s UNION ALL SELECT DISTINCT top, NULL, 'external-contact' FROM cone WHERE state IS NULL")
def netlist_boundaries(spark, d):
    """Where these cones end: at a register, or at the top's own ports."""
    netlist = design(spark, d)
    return N.dependencies(netlist, outputs(netlist))[1].select("occurrence", "cell", "reason")


@query(f"WITH {CHAIN_SQL} SELECT 'bit|' || top || '/u' || nation || '|' || (5000 + 2 * i + side) AS net FROM s, (VALUES (0), (1)) AS v(side) WHERE k % 4 = 3")
def netlist_cycles(spark, d):
    return N.combinational_cycles(design(spark, d)).select(F.col("node").alias("net"))


@query("WITH p AS (SELECT p_brand AS module, p_partkey AS k FROM part) SELECT module, 'r' || k AS src, 'r' || (k + 1) AS dst, 'conflict' AS kind, true AS bidirectional FROM p UNION ALL SELECT module, 'r' || k, 'r' || (k + n), 'sequential-before', false FROM p, (VALUES (2), (3)) AS v(n) UNION ALL SELECT module, 'r' || (k + 4), 'r' || k, 'sequential-before', false FROM p")
def schedule_report(spark, d):
    """Reports with a section for every part, 500 part numbers each."""
    rule = lambda n: text("r", F.col("p_partkey") + n)
    section = text("Rule: ", rule(0), "\nConflicts: ", rule(1), "\nSequenced before: ", rule(2), ", ", rule(3), "\nSequenced after: ", rule(4), "\n")
    parts = t(spark, d, "part").groupBy("p_brand", F.expr("p_partkey div 500").alias("block")).agg(F.array_join(F.collect_list(section), "").alias("sections"))
    reports = parts.select(F.concat_ws("/", "p_brand", "block").alias("report"), text("=== Generated schedule for ", F.col("p_brand"), " ===\n", F.col("sections")).alias("value"))
    return schedules.relations(reports).select("module", "src", "dst", "kind", "bidirectional")


MODULES_SQL = "c AS (SELECT c_custkey AS k, 'N' || c_nationkey || '_' || c_custkey // 200 AS name FROM customer)"


def sources(spark, d) -> DataFrame:
    """path, content: a package for each nation and 200 customer numbers, with a register or queue and a rule for each customer."""
    key, queue = F.col("c_custkey"), F.col("c_custkey") % 3 == 0
    state = F.when(queue, text("  FIFO#(Bit#(8)) c", key, " <- mkFIFO;\n")).otherwise(text("  Reg#(Bit#(8)) c", key, " <- mkReg(0); // Reg#(Fake) f <- mkReg(0);\n"))
    rule = text("  rule r", key, " (ready", key % 7, ");\n    ", F.when(queue, text("c", key, ".enq(1)")).otherwise(text("c", key, " <= c", key, " + 1")), ";\n  endrule\n")
    lists = t(spark, d, "customer").groupBy("c_nationkey", F.expr("c_custkey div 200").alias("block")).agg(F.array_join(F.collect_list(state), "").alias("states"), F.array_join(F.collect_list(rule), "").alias("rules"))
    name = text("N", F.col("c_nationkey"), "_", F.col("block"))
    return lists.select(text(name, ".bsv").alias("path"), text("package ", name, ";\nimport FIFO :: *; /* import Fake :: *; */\nmodule mk", name, "(Ifc);\n", F.col("states"), F.col("rules"), "endmodule\nendpackage\n").alias("content"))


@query(f"WITH {MODULES_SQL} SELECT DISTINCT 'package' AS kind, name, NULL AS detail FROM c UNION ALL SELECT 'import', 'FIFO', '*' FROM (SELECT DISTINCT name FROM c) UNION ALL SELECT DISTINCT 'module', 'mk' || name, 'Ifc' FROM c UNION ALL SELECT 'rule', 'r' || k, 'ready' || k % 7 FROM c UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'fifo' ELSE 'register' END, 'c' || k, CASE WHEN k % 3 = 0 THEN 'mkFIFO' ELSE 'mkReg' END FROM c")
def source_declarations(spark, d):
    docs = X.with_masked(sources(spark, d))
    row = lambda df, kind, name, detail: df.select((kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), F.col(name).alias("name"), detail.cast("string").alias("detail"))
    return (
        row(X.packages(docs), "package", "name", F.lit(None))
        .union(row(X.imports(docs), "import", "package", F.col("names")))
        .union(row(X.modules(docs), "module", "name", F.col("interface")))
        .union(row(X.rules(docs), "rule", "name", F.col("guard")))
        .union(row(X.instances(docs), primitive_kind(F.col("type"), F.col("constructor")), "name", F.col("constructor")))
    )


@query(f"WITH {MODULES_SQL} SELECT 'r' || k AS owner, 'c' || k AS instance, unnest(CASE WHEN k % 3 = 0 THEN ['enqueue'] ELSE ['read', 'write'] END) AS operation FROM c")
def state_accesses(spark, d):
    docs = X.with_masked(sources(spark, d))
    kinds = X.instances(docs).select("path", "name", primitive_kind(F.col("type"), F.col("constructor")).alias("kind"))
    return X.accesses(X.rules(docs), kinds).select("owner", "instance", "operation")


@query(f"WITH {FLOWS_SQL}, a AS (SELECT 'o' || min(o_orderkey) AS src FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), b AS (SELECT min(s.dst) AS dst FROM a JOIN o USING (src) JOIN s ON s.src = o.dst), p AS (SELECT o.id AS x, s.id AS y, o.dst AS via FROM a JOIN o USING (src) JOIN s ON s.src = o.dst JOIN b ON b.dst = s.dst), n AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY via, x, y) AS nth FROM p) SELECT CASE WHEN n > 50 THEN 'search-limit' ELSE 'exact' END AS status, x || '>' || y AS steps FROM n WHERE nth <= 50")
def flow_trace(spark, d):
    """From the first order to the first supplier that its parts lead to, every line an edge; ends joined directly by control do not count."""
    edges = written(flows(spark, d), scratch(spark))
    first = t(spark, d, "orders").join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").agg(F.min("o_orderkey")).first()[0]
    parts = edges.where(F.col("src") == f"o{first}").select(F.col("dst").alias("src")).distinct()
    goal = edges.join(parts, "src").agg(F.min("dst")).first()[0]
    direct = t(spark, d, "lineitem").select(text_key("o", "l_orderkey"), text_key("s", "l_suppkey"), F.lit("control"), F.lit("x"))
    kinds = edges.select("src", "dst", F.lit("payload").alias("kind"), "id").union(direct)
    return G.flow_trace(kinds, f"o{first}", goal, stored=True).select("status", F.array_join("edges", ">").alias("steps"))
