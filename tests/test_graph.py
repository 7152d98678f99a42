from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators.checkpoints import scratch
from tracelake.operators.components import components


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_reach_by_levels_and_limits(spark):
    e = edges(spark, "ab", "bc", "cd", "bd", "da")
    full = G.reach(e, nodes(spark, "a"))
    assert {(r["node"], r["depth"]) for r in full.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert G.completeness(full).first()["status"] == "complete"
    near = G.reach(e, nodes(spark, "a"), max_depth=1)
    assert {(r["node"], r["reason"]) for r in near.collect()} == {("a", None), ("b", "depth")}
    assert G.completeness(near).first()["frontier"] == 1
    assert G.completeness(G.reach(e, nodes(spark, "a"), max_nodes=2)).first()["status"] == "partial"
    assert G.completeness(G.reach(e, nodes(spark))).first()["status"] == "empty"


def test_stops_are_reached_and_not_left(spark):
    got = G.reach(edges(spark, "ab", "bc"), nodes(spark, "a"), stop=nodes(spark, "b"))
    assert {(r["node"], r["reason"]) for r in got.collect()} == {("a", None), ("b", "stop")}


def test_focus_falls_back_to_children(spark):
    children = spark.createDataFrame([("m", "x")], "parent string, node string")
    got = G.focus_neighborhood(edges(spark, "xy", "yz"), nodes(spark, "m"), children, 2)
    assert {(r["node"], r["depth"]) for r in got.collect()} == {("m", 0), ("x", 1), ("y", 2)}


def test_all_shortest_paths(spark):
    e = edges(spark, "ab", "ac", "bd", "cd", "de", "ax", "xy", "ye", "ez")
    got = G.shortest_paths(e, "a", "d")
    assert {"".join(r["path"]) for r in got.collect()} == {"abd", "acd"}
    assert {"".join(r["path"]) for r in G.shortest_paths(e, "a", "e").collect()} == {"abde", "acde", "axye"}
    assert G.shortest_paths(e, "z", "a", undirected=False).count() == 0
    assert G.shortest_paths(e, "a", "a").first()["depth"] == 0
    assert G.shortest_paths(e, "a", "d", max_paths=1).first()["n_paths"] == 2


def test_flow_traces_tell_parallel_edges_apart(spark):
    e = spark.createDataFrame([("a", "b", "payload", "1"), ("a", "b", "payload", "2"), ("b", "c", "payload", "3"), ("a", "c", "control", "4")], "src string, dst string, kind string, id string")
    got = G.flow_trace(e, "a", "c").collect()
    assert {tuple(r["edges"]) for r in got} == {("1", "3"), ("2", "3")} and {r["status"] for r in got} == {"exact"}
    assert G.flow_trace(e, "c", "a").first()["status"] == "no-path"


def test_paths_tell_of_limits(spark):
    wide = edges(spark, *(("a", f"b{k}") for k in range(10_001)), ("b7", "c"))
    assert [r["path"] for r in G.shortest_paths(wide, "a", "c").collect()] == [["a", "b7", "c"]]
    e = spark.createDataFrame([("a", "b", "payload", "1"), ("a", "x", "payload", "2"), ("b", "c", "payload", "3"), ("x", "c", "payload", "4")], "src string, dst string, kind string, id string")
    assert [tuple(r) for r in G.shortest_paths(e, "a", "c", max_nodes=2).collect()] == [(None, None, None)]
    assert [(r["status"], r["edges"]) for r in G.flow_trace(e, "a", "c", max_nodes=2).collect()] == [("search-limit", None)]
    assert [(r["status"], r["n_paths"], r["edges"]) for r in G.flow_trace(e, "a", "c", max_paths=1).collect()] == [("search-limit", 2, ["1", "3"])]


def test_hierarchies_cut_cycles_and_limits(spark):
    c = spark.createDataFrame([("t", "a", "x"), ("t", "a", "y"), ("a", "b", "z"), ("b", "a", "w")], "parent string, node string, name string")
    got = {r["path"]: r["status"] for r in G.expand(c, nodes(spark, "t")).collect()}
    assert got == {"t": "expanded", "t/x": "expanded", "t/y": "expanded", "t/x/z": "expanded", "t/y/z": "expanded", "t/x/z/w": "cycle-cut", "t/y/z/w": "cycle-cut"}
    assert G.expand(c, nodes(spark, "t"), max_breadth=1).where("depth = 1 and status = 'expanded'").count() == 1
    assert {r["status"] for r in G.expand(c, nodes(spark, "t"), max_depth=1).where("depth = 1").collect()} == {"depth-cut"}


def test_nearest_ancestor_with_an_attribute(spark):
    c = spark.createDataFrame([("t", "a", "x"), ("a", "b", "y")], "parent string, node string, name string")
    values = spark.createDataFrame([("t", "far"), ("a", "near")], "node string, value string")
    got = {r["path"]: (r["value"], r["distance"]) for r in G.nearest_with(G.expand(c, nodes(spark, "t")), values).collect()}
    assert got == {"t": ("far", 0), "t/x": ("near", 0), "t/x/y": ("near", 1)}


def test_components_and_cycles(spark):
    pairs = [(str(i), str(i + 1)) for i in range(30) if i % 10 != 9]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(pairs, "a string, b string"), scratch(spark)).collect()}
    assert all(got[n] == min((str(k) for k in range(int(n) // 10 * 10, int(n) // 10 * 10 + 10))) for n in got)
    e = edges(spark, "ab", "bc", "ca", "cd", "de", "ef", "fe", "gg", "hi")
    assert {(r["node"], r["cycle"]) for r in G.cycle_members(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e"), ("g", "g")}
    assert G.cycle_members(edges(spark, "ab", "bc")).count() == 0


def test_roots_hops_and_truncation(spark):
    e = edges(spark, "ab", "bc").withColumn("kind", F.lit("call"))
    assert {r["node"] for r in G.roots_of(nodes(spark, "a", "b", "c"), e).collect()} == {"a"}
    assert G.roots_of(nodes(spark, "a", "b"), edges(spark, "ab", "ba")).count() == 2
    assert G.one_hop(e, "b", "in", ("call",)).first()["src"] == "a"
    n = nodes(spark, "a", "b", "c").withColumn("preferred", F.col("node") == "c")
    kept, held = G.without_dangling(n, e, 2, 10)
    assert {r["node"] for r in kept.collect()} == {"c", "a"} and held.count() == 0


def test_budgets_cut_inside_a_level(spark):
    e = edges(spark, "ab", "ac", "ad", "be", "cf", "dg")
    costs = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 2, 50), ("d", 2, 5), ("e", 1, None)], "node string, pins long, bytes long")
    rows = lambda **b: {r["node"]: (r["depth"], r["taken"], r["reason"]) for r in G.within_budgets(e, nodes(spark, "a"), costs, b).collect()}
    assert rows(pins=100, bytes=1000) == {n: (0 if n == "a" else 1 if n in "bcd" else 2, True, None) for n in "abcdefg"}
    assert rows(pins=3, bytes=1000) == {"a": (0, True, "pins"), "b": (1, True, "pins"), "c": (1, False, "pins"), "d": (1, False, "pins")}
    assert rows(pins=100, bytes=20) == {"a": (0, True, "bytes"), "b": (1, True, "bytes"), "c": (1, False, "bytes"), "d": (1, False, "bytes")}
    deep = G.within_budgets(e, nodes(spark, "a"), costs, {"pins": 100}, max_depth=1)
    assert {r["node"]: r["reason"] for r in deep.collect()} == {"a": None, "b": "depth", "c": "depth", "d": "depth"}


def test_hierarchies_tell_what_they_omit(spark):
    c = spark.createDataFrame([("t", x, x) for x in "abc"] + [("a", x, x) for x in "de"] + [("b", "f", "f")], "parent string, node string, name string")
    got = {(r["path"], r["status"]): r["omitted"] for r in G.expand(c, nodes(spark, "t"), max_breadth=1).collect()}
    assert got == {("t", "expanded"): None, ("t/a", "expanded"): None, ("t/a/d", "expanded"): None, ("t", "breadth-cut"): 2, ("t/a", "breadth-cut"): 1}
    got = {(r["path"], r["status"]): r["omitted"] for r in G.expand(c, nodes(spark, "t"), budget=5).collect()}
    assert got == {("t", "expanded"): None, ("t/a", "expanded"): None, ("t/b", "expanded"): None, ("t/c", "expanded"): None, ("t/a/d", "expanded"): None, ("t/a", "budget"): 1, ("t/b", "budget"): 1}
    got = {(r["path"], r["status"]): r["omitted"] for r in G.expand(c, nodes(spark, "a", "b", "t"), budget=2).collect()}
    assert got == {("a", "expanded"): None, ("b", "expanded"): None, ("t", "budget"): 1}


def test_one_root_per_source_component(spark):
    e = edges(spark, "ab", "bc", "cb", "de", "ed", "ef", "gg")
    got = {(r["node"], r["reason"]) for r in G.component_roots(nodes(spark, *"abcdefgh"), e).collect()}
    assert got == {("a", "uninstantiated"), ("d", "cycle-fallback"), ("g", "cycle-fallback"), ("h", "uninstantiated")}
    assert {tuple(r) for r in G.component_roots(nodes(spark, *"ab"), e, nodes(spark, "b", "z")).collect()} == {("b", "configured")}
