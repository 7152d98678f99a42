from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators import paths as P
from tracelake.operators.checkpoints import scratch
from tracelake.operators.ordered import running


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, f"{k:03}") for k, (a, b) in enumerate(pairs)], "src string, dst string, id string")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "origin string, goal string")


def diamonds(n):
    for k in range(n):
        for side in "xy":
            yield from ((f"a{k:03}", f"{side}{k:03}"), (f"{side}{k:03}", f"a{k + 1:03}"))


def test_very_many_paths_are_counted_and_the_first_ones_listed(spark):
    n = 7
    told = P.between(edges(spark, *diamonds(n)), pairs(spark, ("a000", f"a{n:03}")), max_paths=5)
    row = told.status.first()
    assert (row["status"], row["depth"], int(row["n_paths"])) == ("exact", 2 * n, 2**n)
    got = [(r["nth"], r["nodes"]) for r in told.paths.orderBy("nth").collect()]
    assert [k for k, _ in got] == [1, 2, 3, 4, 5]
    sides = ["".join(n[0] for n in nodes[1::2]) for _, nodes in got]
    assert sides == ["x" * n, "x" * (n - 1) + "y", "x" * (n - 2) + "yx", "x" * (n - 2) + "yy", "x" * (n - 3) + "yxx"]


def test_parallel_edges_multiply(spark):
    e = edges(spark, *[("a", "b")] * 3, *[("b", "c")] * 4, ("a", "x"), ("x", "y"))
    told = P.between(e, pairs(spark, ("a", "c"), ("a", "y"), ("c", "a"), ("b", "b")), max_paths=7)
    got = {(r["origin"], r["goal"]): (r["status"], r["depth"], r["n_paths"] and int(r["n_paths"])) for r in told.status.collect()}
    assert got == {("a", "c"): ("exact", 2, 12), ("a", "y"): ("exact", 2, 1), ("c", "a"): ("no-path", None, None), ("b", "b"): ("exact", 0, 1)}
    ids = [tuple(r["edges"]) for r in told.paths.where("goal = 'c'").orderBy("nth").collect()]
    assert ids == [(a, b) for a in ("000", "001") for b in ("003", "004", "005", "006")][:7]
    assert told.paths.where("origin = 'b'").first()["edges"] == []


def test_statuses_of_limits_and_unknown_ends(spark):
    e = edges(spark, *((f"n{k}", f"n{k + 1}") for k in range(6)))
    entities = spark.createDataFrame([(f"n{k}",) for k in range(7)], "node string")
    told = P.between(e, pairs(spark, ("n0", "n6"), ("n0", "n3"), ("n0", "zz"), (None, "n1"), ("n3", "n0")), entities, max_depth=3)
    got = {(r["origin"], r["goal"]): r["status"] for r in told.status.collect()}
    assert got == {("n0", "n6"): "search-limit", ("n0", "n3"): "exact", ("n0", "zz"): "unresolved", (None, "n1"): "unresolved", ("n3", "n0"): "no-path"}
    assert P.between(edges(spark), pairs(spark)).status.count() == 0


def test_instances_meet_by_their_endpoints(spark):
    e = edges(spark, ("a1", "m"), ("a2", "m"), ("m", "b1"), ("A", "C"), ("b2", "a2"))
    ends = spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b1"), ("B", "b2"), ("C", "a1")], "instance string, endpoint string")
    told = P.between_instances(e, ends, pairs(spark, ("A", "B"), ("B", "A"), ("A", "C"), ("C", "Z")))
    got = {(r["origin"], r["goal"]): (r["status"], r["depth"], r["n_paths"] and int(r["n_paths"])) for r in told.status.collect()}
    assert got == {("A", "B"): ("exact", 2, 2), ("B", "A"): ("exact", 1, 1), ("A", "C"): ("exact", 1, 1), ("C", "Z"): ("no-path", None, None)}
    assert [r["nodes"] for r in told.paths.where("goal = 'B'").orderBy("nth").collect()] == [["a1", "m", "b1"], ["a2", "m", "b1"]]


def test_flow_trace_scope_and_unknown_ends(spark):
    e = spark.createDataFrame([("a", "b", "payload", "1", "r"), ("b", "c", "payload", "2", "s")], "src string, dst string, kind string, id string, root string")
    assert G.flow_trace(e, "a", "c").first()["status"] == "exact"
    assert G.flow_trace(e, "a", "c", scope=F.col("root") == "r").first()["status"] == "no-path"
    assert G.flow_trace(e, "a", "q", entities=spark.createDataFrame([("a",), ("c",)], "node string")).first()["status"] == "unresolved"
    assert G.flow_trace(e, "a", "c", max_depth=1).first()["status"] == "search-limit"


def test_running_sums_over_all_rows(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as v")
    got = running(rows, [F.desc("v"), F.col("id")], {"n": F.lit(1), "total": F.col("v")}, scratch(spark)).collect()
    want, n, total = {}, 0, 0
    for v, i in sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1])):
        want[i] = (n, total)
        n, total = n + 1, total + v
    assert {r["id"]: (r["n"], r["total"]) for r in got} == want
