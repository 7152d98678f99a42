import json

import pytest
from pyspark.sql import functions as F

from tracelake.sources import netlist as N


def cell(type_, parameters, connections, out=("Y", "Q")):
    return {"type": type_, "parameters": parameters, "port_directions": {p: "output" if p in out else "input" for p in connections}, "connections": connections}


def design(spark, modules, tops=None):
    text = json.dumps({"modules": modules})
    return N.netlist_of(spark.createDataFrame([(text,)], "value string"), tops)


ADD = {"A_WIDTH": 2, "B_WIDTH": 2, "Y_WIDTH": 2, "A_SIGNED": 0, "B_SIGNED": 0}


def top(cells, ports=None):
    return {"attributes": {"top": "1"}, "ports": ports or {}, "cells": cells, "netnames": {}}


def bits(df):
    return {r[0].split("|")[-1] for r in df.collect()}


def seed(spark, *numbers):
    return spark.createDataFrame([(f"bit|t|{n}",) for n in numbers], "bit string")


def test_an_adder_depends_on_all_operand_bits(spark):
    n = design(spark, {"t": top({"a": cell("$add", ADD, {"A": [2, 3], "B": [4, 5], "Y": [6, 7]})})})
    reached, met = N.dependencies(n, seed(spark, 6))
    assert bits(reached.select("node")) == {"6", "2", "3", "4", "5"}
    assert {r["reason"] for r in met.collect()} == {"dangling"}


def test_a_mux_selects_by_position_and_its_select_is_control(spark):
    n = design(spark, {"t": top({"m": cell("$mux", {"WIDTH": "10"}, {"A": [2, 3], "B": [4, 5], "S": ["x"], "Y": [6, 7]})})})
    edges = {(r["src"].split("|")[-1], r["dst"].split("|")[-1], r["kind"]) for r in N.cell_edges(n, N.cell_kinds(n)).collect()}
    assert {(s, d) for s, d, k in edges if k == "data"} == {("2", "6"), ("3", "7"), ("4", "6"), ("5", "7")}
    assert len([e for e in edges if e[2] == "control"]) == 2


def test_a_boolean_result_is_its_first_bit(spark):
    n = design(spark, {"t": top({"e": cell("$eq", ADD, {"A": [2, 3], "B": [4, 5], "Y": [6, 7]})})})
    assert {r["dst"].split("|")[-1] for r in N.cell_edges(n, N.cell_kinds(n)).collect()} == {"6"}


def test_state_unknown_cells_and_wrong_parameters_are_boundaries(spark):
    cells = {
        "d": cell("$dff", {"WIDTH": 1, "CLK_POLARITY": 1}, {"D": [2], "CLK": [3], "Q": [4]}),
        "m": cell("$mem_v2", {}, {"Y": [5]}),
        "u": cell("$mystery", {}, {"Y": [6]}),
        "w": cell("$add", ADD | {"B_SIGNED": 1}, {"A": [2, 3], "B": [4, 5], "Y": [8, 9]}),
        "l": cell("$logic_not", {"A_WIDTH": 1, "Y_WIDTH": 1, "A_SIGNED": 0}, {"A": [4], "Y": [7]}),
    }
    n = design(spark, {"t": top(cells)})
    reasons = {r["cell"]: r["reason"] for r in N.cell_kinds(n).collect()}
    assert reasons == {"d": "sequential", "m": "memory", "u": "unsupported-cell", "w": "unsupported-parameters", "l": None}
    reached, met = N.dependencies(n, seed(spark, 7))
    assert bits(reached.select("node")) == {"7", "4"}
    assert ("sequential", "d") in {(r["reason"], r["cell"]) for r in met.collect()}


def test_instances_of_one_module_stay_apart_and_join_their_parent(spark):
    child = {"ports": {"i": {"direction": "input", "bits": [2]}, "o": {"direction": "output", "bits": [3]}}, "cells": {"n": cell("$logic_not", {"A_WIDTH": 1, "Y_WIDTH": 1, "A_SIGNED": 0}, {"A": [2], "Y": [3]})}, "netnames": {}}
    parent = top({"x": cell("c", {}, {"i": [2], "o": [3]}, out=("o",)), "y": cell("c", {}, {"i": [3], "o": [4]}, out=("o",))}, {"p": {"direction": "input", "bits": [2]}})
    n = N.validated(design(spark, {"t": parent, "c": child}))
    assert {r["path"] for r in n.occurrences.collect()} == {"t", "t/x", "t/y"}
    nets = {r["bit"]: r["net"] for r in N.nets(n).collect()}
    assert nets["bit|t/x|2"] == nets["bit|t|2"] and nets["bit|t/x|3"] == nets["bit|t/y|2"] == nets["bit|t|3"]
    assert len(set(nets.values())) == 3
    reached, met = N.dependencies(n, seed(spark, 4))
    assert reached.count() == 3
    assert "external-contact" in {r["reason"] for r in met.collect()}
    assert N.combinational_cycles(n).count() == 0


def test_sides_of_a_net_and_repeated_seeds(spark):
    n = design(spark, {"t": top({"a": cell("$add", ADD, {"A": [2, 3], "B": [2, 3], "Y": [6, 7]})}, {"p": {"direction": "input", "bits": [2]}})})
    seeds = spark.createDataFrame([(0, "bit|t|2"), (1, "bit|t|7"), (2, "bit|t|2")], "position int, bit string")
    got = N.same_net(n, seeds).groupBy("position").agg(F.count_if(F.col("side") == "driver").alias("d"), F.count_if(F.col("side") == "load").alias("l"))
    assert {tuple(r) for r in got.collect()} == {(0, 1, 2), (1, 1, 0), (2, 1, 2)}


def test_two_drivers_stop_and_loops_are_found(spark):
    no = {"A_WIDTH": 1, "Y_WIDTH": 1, "A_SIGNED": 0}
    n = design(spark, {"t": top({"a": cell("$logic_not", no, {"A": [2], "Y": [3]}), "b": cell("$logic_not", no, {"A": [3], "Y": [2]}), "c": cell("$logic_not", no, {"A": [2], "Y": [4]}), "d": cell("$logic_not", no, {"A": [5], "Y": [4]})})})
    assert bits(N.combinational_cycles(n).select("node")) == {"2", "3"}
    reached, met = N.dependencies(n, seed(spark, 4))
    assert bits(reached.select("node")) == {"4"}
    assert "multiple-drivers" in {r["reason"] for r in met.collect()}


@pytest.mark.parametrize(
    "modules, code",
    [
        ({"t": top({"x": cell("c", {}, {"q": [2]})}), "c": {"ports": {}}}, "missing-formal-port"),
        ({"t": top({"x": cell("c", {}, {"i": [2, 3]})}), "c": {"ports": {"i": {"direction": "input", "bits": [2]}}}}, "width-mismatch"),
        ({"t": top({"x": cell("c", {}, {"i": [2]})}), "c": {"ports": {"i": {"direction": "output", "bits": [2]}}}}, "direction-mismatch"),
        ({"t": top({"x": cell("t", {}, {})})}, "recursive-hierarchy"),
        ({"t": {"ports": {"p": {"direction": "input", "bits": ["w"]}}}}, "malformed-bit"),
        ({"t": {"processes": {"p": "x"}}}, "unsupported-processes"),
    ],
)
def test_wrong_netlists_are_rejected(spark, modules, code):
    n = design(spark, modules)
    assert code in {r["code"] for r in n.problems.collect()}
    with pytest.raises(ValueError, match=code):
        N.validated(n)


def test_a_limit_makes_a_cone_partial(spark):
    from tracelake.operators.graph import completeness

    no = {"A_WIDTH": 1, "Y_WIDTH": 1, "A_SIGNED": 0}
    n = design(spark, {"t": top({f"n{k}": cell("$logic_not", no, {"A": [k], "Y": [k + 1]}) for k in range(2, 8)})})
    assert completeness(N.dependencies(n, seed(spark, 8))[0]).first()["status"] == "complete"
    assert completeness(N.dependencies(n, seed(spark, 8), max_depth=2)[0]).first()["status"] == "partial"
    assert completeness(N.dependencies(n, seed(spark, 8), max_nodes=2)[0]).first()["status"] == "partial"
