"""A small hardware design that is written here: a netlist, a schedule report and source text, with the rows that follow from it by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions.scalars import method_class, primitive_kind
from tracelake.operators import graph as G
from tracelake.operators import semantic as M
from tracelake.sources import netlist as N
from tracelake.sources import schedules

CASES = {}


def query(columns: str, *rows: tuple):
    """Keeps a question and the rows expected."""

    def keep(f):
        CASES[f.__name__] = (f, [c.strip() for c in columns.split(",")], sorted(map(repr, rows)))
        return f

    return keep


def _cell(type_: str, parameters: dict, outputs: str, **connections: list) -> dict:
    return {"type": type_, "parameters": parameters, "port_directions": {p: "output" if p in outputs.split() else "input" for p in connections}, "connections": connections}


_ONE = {"A_WIDTH": 1, "Y_WIDTH": 1, "A_SIGNED": 0}
_ADD = {"A_WIDTH": 2, "B_WIDTH": "10", "Y_WIDTH": 2, "A_SIGNED": 0, "B_SIGNED": 0}
#: top holds two inverters in a row (instances of inv), an adder, a register on a bit of its sum, and a loop.
DESIGN = {
    "modules": {
        "inv": {"ports": {"i": {"direction": "input", "bits": [2]}, "o": {"direction": "output", "bits": [3]}}, "cells": {"n": _cell("$logic_not", _ONE, "Y", A=[2], Y=[3])}},
        "top": {
            "attributes": {"top": "1"},
            "ports": {"a": {"direction": "input", "bits": [2]}, "clk": {"direction": "input", "bits": [20]}, "q": {"direction": "output", "bits": [9]}},
            "netnames": {"mid": {"bits": [3]}},
            "cells": {
                "u1": _cell("inv", {}, "o", i=[2], o=[3]),
                "u2": _cell("inv", {}, "o", i=[3], o=[4]),
                "sum": _cell("$add", _ADD, "Y", A=[4, "0"], B=[3, 5], Y=[7, 8]),
                "ff": _cell("$dff", {"WIDTH": 1, "CLK_POLARITY": 1}, "Q", D=[7], CLK=[20], Q=[9]),
                "l1": _cell("$logic_not", _ONE, "Y", A=[11], Y=[12]),
                "l2": _cell("$logic_not", _ONE, "Y", A=[12], Y=[11]),
            },
        },
    }
}
REPORT = """=== Generated schedule for mkTop ===
Method: get
Sequenced before: put, RL_step
Rule: step
Conflicts: drain
Logical execution order: a, b, c
x: CF [y, z]; SB w
p conflicts with q.
"""
SOURCE = """package Top;
import FIFO :: *; // import Fake :: *;
interface Out;
  method Action put(Bit#(8) x);
  method Bit#(8) get;
  method Bool putReady;
endinterface
module mkTop(Out);
  Reg#(Bit#(8)) count <- mkReg(0);
  FIFO#(Bit#(8)) q <- mkFIFO;
  rule step (count < 3);
    count <= count + 1;
    q.enq(count);
  endrule
  /* rule gone; endrule */
  rule drain;
    q.deq;
  endrule
endmodule
"""


def design(spark: SparkSession) -> N.Netlist:
    return N.validated(N.netlist_of(spark.createDataFrame([(json.dumps(DESIGN),)], "value string")))


def documents(spark: SparkSession) -> DataFrame:
    return X.with_masked(spark.createDataFrame([("Top.bsv", SOURCE)], "path string, content string"))


def bit(spark: SparkSession, number: int) -> DataFrame:
    return spark.createDataFrame([(f"bit|top|{number}",)], "bit string")


@query("path, module, depth", ("top", "top", 0), ("top/u1", "inv", 1), ("top/u2", "inv", 1))
def netlist_occurrences(spark, d):
    return design(spark).occurrences.select("path", F.col("node").alias("module"), "depth")


@query("cell, class, reason", ("u1", "hierarchy", None), ("u2", "hierarchy", None), ("sum", "combinational", None), ("ff", "sequential", "sequential"), ("l1", "combinational", None), ("l2", "combinational", None))
def netlist_cell_kinds(spark, d):
    return N.cell_kinds(design(spark)).where("occurrence = 'top'").select("cell", "class", "reason")


@query("occurrence, kind, cell, name, side", ("top", "alias", None, "mid", "alias"), ("top", "pin", "u1", "o", "boundary"), ("top", "pin", "u2", "i", "boundary"), ("top", "pin", "sum", "B", "load"), ("top/u1", "port", None, "o", "boundary"), ("top/u1", "pin", "n", "Y", "driver"), ("top/u2", "port", None, "i", "boundary"), ("top/u2", "pin", "n", "A", "load"))
def netlist_same_net(spark, d):
    return N.same_net(design(spark), bit(spark, 3).withColumn("position", F.lit(0))).select("occurrence", "kind", "cell", "name", "side")


@query("net, depth", ("bit|top|7", 0), ("bit|top/u2|3", 1), ("constant|top|pin|sum|A|1", 1), ("bit|top/u1|3", 1), ("bit|top|5", 1), ("bit|top/u1|2", 2))
def netlist_dependencies(spark, d):
    """What the sum's first bit depends on, through both instances.  A net has the name of its smallest bit."""
    return N.dependencies(design(spark), bit(spark, 7))[0].select(F.col("node").alias("net"), "depth")


@query("net, reason", ("bit|top|5", "dangling"), ("constant|top|pin|sum|A|1", "constant"), ("bit|top/u1|2", "external-contact"))
def netlist_boundaries(spark, d):
    return N.dependencies(design(spark), bit(spark, 7))[1].select("net", "reason")


@query("net", ("bit|top|11",), ("bit|top|12",))
def netlist_cycles(spark, d):
    return N.combinational_cycles(design(spark)).select(F.col("node").alias("net"))


@query("src, dst, kind, bidirectional", ("get", "put", "sequential-before", False), ("get", "step", "sequential-before", False), ("step", "drain", "conflict", True), ("a", "b", "execution-order", False), ("b", "c", "execution-order", False), ("x", "y", "conflict-free", True), ("x", "z", "conflict-free", True), ("x", "w", "sequential-before", False), ("p", "q", "conflict", True))
def schedule_report(spark, d):
    return schedules.relations(spark.createDataFrame([("r", REPORT)], "report string, value string")).select("src", "dst", "kind", "bidirectional")


@query("kind, name, detail", ("package", "Top", None), ("import", "FIFO", "*"), ("module", "mkTop", "Out"), ("rule", "step", "count < 3"), ("rule", "drain", None), ("register", "count", "mkReg"), ("fifo", "q", "mkFIFO"), ("input", "put", "Action"), ("output", "get", "Bit#(8)"), ("output", "putReady", "Bool"))
def source_declarations(spark, d):
    docs = documents(spark)
    row = lambda df, kind, name, detail: df.select((kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), F.col(name).alias("name"), detail.cast("string").alias("detail"))
    return (
        row(X.packages(docs), "package", "name", F.lit(None))
        .union(row(X.imports(docs), "import", "package", F.col("names")))
        .union(row(X.modules(docs), "module", "name", F.col("interface")))
        .union(row(X.rules(docs), "rule", "name", F.col("guard")))
        .union(row(X.instances(docs), primitive_kind(F.col("type"), F.col("constructor")), "name", F.col("constructor")))
        .union(row(X.interface_methods(docs), method_class(F.col("returns")), "method", F.col("returns")))
    )


@query("owner, instance, operation", ("step", "count", "read"), ("step", "count", "write"), ("step", "q", "enqueue"), ("drain", "q", "dequeue"))
def state_accesses(spark, d):
    docs = documents(spark)
    kinds = X.instances(docs).select("path", "name", primitive_kind(F.col("type"), F.col("constructor")).alias("kind"))
    return X.accesses(X.rules(docs), kinds).select("owner", "instance", "operation")


@query("base, direction, payload", ("put", "input", "Bit#(8)"))
def protocol_channels(spark, d):
    methods = X.interface_methods(documents(spark)).select(F.col("interface").alias("owner"), "method", method_class(F.col("returns")).alias("category"), "returns", F.when(F.col("method") == "put", F.array(F.lit("Bit#(8)"))).otherwise(F.array().cast("array<string>")).alias("parameters"))
    return M.channels(methods)[0].select("base", "direction", "payload")


@query("status, steps", ("exact", "1>3"), ("exact", "2>3"))
def flow_trace(spark, d):
    edges = spark.createDataFrame([("a", "b", "payload", "1"), ("a", "b", "payload", "2"), ("b", "c", "payload", "3"), ("a", "c", "control", "4")], "src string, dst string, kind string, id string")
    return G.flow_trace(edges, "a", "c").select("status", F.array_join("edges", ">").alias("steps"))
