"""Small cases of the question operators that the tables do not hold: rings, repeats, nulls, empty tables."""

from pyspark.sql import functions as F

from tracelake.operators import questions as Q


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_topology_of_rings_and_nested_roots(spark):
    instances = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("s", "s"), ("lost", "gone"), ("d", "c")], "node string, parent string")
    roots = spark.createDataFrame([("c", 1), ("a", 2), ("x", 3), ("s", 4), ("s", 5)], "node string, nth int")
    assert rows(Q.topology(instances, roots)) == [("a", "a", 0), ("b", "a", 1), ("c", "c", 0), ("d", "c", 1), ("s", "s", 0), ("x", "x", 0), ("y", "x", 1)]
    assert rows(Q.topology(instances.limit(0), roots)) == []
    assert rows(Q.topology(instances, roots.limit(0))) == []


def test_topology_of_a_long_chain(spark):
    n = 300
    instances = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    placed = rows(Q.topology(instances, spark.createDataFrame([(0, 1)], "node long, nth int")))
    assert placed == [(i, 0, i) for i in range(n)]


def test_dependencies_with_cycles_and_limits(spark):
    e = spark.createDataFrame([("a", ["b", "b"], ["c"], None), ("b", ["a"], None, ["none"]), ("c", None, None, ["d"]), ("d", [], [], [])], "expression string, operands array<string>, definitions array<string>, arguments array<string>")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(Q.source_dependencies(e, seeds)) == [("a", 0, None), ("b", 1, None), ("c", 1, None), ("d", 2, None)]
    assert [r[0] for r in rows(Q.source_dependencies(e, spark.createDataFrame([("d",)], "node string"), "forward"))] == ["a", "b", "c", "d"]
    assert ("c", 1, "depth") in rows(Q.source_dependencies(e, seeds, max_depth=1))


def test_calls_without_arguments(spark):
    calls = spark.createDataFrame([("x", "f"), ("y", "g"), ("z", None)], "call string, target string")
    actuals = spark.createDataFrame([("z", 0, "e")], "call string, position int, expression string")
    formals = spark.createDataFrame([("g", 0, "p")], "target string, position int, formal string")
    assert rows(Q.call_mappings(calls, actuals, formals)) == [("x", None, None, None, "exact", None), ("y", None, None, None, "unresolved", "arity"), ("z", 0, "e", None, "unresolved", "unresolved-call-target")]


def test_forwarding_needs_one_child_and_both_ends(spark):
    provided = spark.createDataFrame([("m", "out", ["c", "put"]), ("m", "two", ["d", "put"]), ("m", "none", None)], "owner string, path string, target array<string>")
    children = spark.createDataFrame([("m", "c", "m.c"), ("m", "d", "m.d1"), ("m", "d", "m.d2")], "parent string, name string, instance string")
    endpoints = spark.createDataFrame([("m", "out", "1"), ("m", "two", "2"), ("m.c", "put", "3"), ("m.d1", "put", "4")], "instance string, path string, endpoint string")
    got = {r.path: (r.outer, r.inner, r.status) for r in Q.forwarded(provided, children, endpoints).collect()}
    assert got == {"out": ("1", "3", "exact"), "two": ("2", None, "unresolved"), "none": (None, None, "unresolved")}


def test_sentences_and_types(spark):
    callables = spark.createDataFrame([("a", "rule", "r", None), ("b", "method", "m", []), ("c", "rule", "q", ["f.put"])], "behaviour string, kind string, name string, invocations array<string>")
    moves = spark.createDataFrame([("a", "write", "x", 2), ("a", "update", "y", 1), ("a", "write", "y", 3), ("a", "dequeue", "q", 4), ("b", "read", "z", 1)], "behaviour string, effect string, state string, nth int")
    assert rows(Q.transition_sentences(callables, moves)) == [("a", "Updates y, x and dequeues q."), ("b", "Method m."), ("c", "Invokes f.put.")]
    types = spark.createDataFrame([("Reg#()", "register"), (None, "memory"), ("Fifo#(T)", "fifo"), ("Bool", "fifo")], "t string, k string")
    assert [r[0] for r in types.select(Q.storage_type(F.col("t"), F.col("k"))).collect()] == [None, None, "T", None]
    dims = F.array(F.struct(F.lit("concrete").alias("status"), F.lit(0).alias("lower"), F.lit(4).alias("upper")))
    picks = spark.createDataFrame([("[3]",), ("[4]",), ("[3][0]",), ("",), (None,)], "s string")
    assert [r[0] for r in picks.select(Q.element_reference(F.col("s"), dims)).collect()] == ["exact", "unresolved", "unresolved", None, None]
