from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.operators import relations as R
from tracelake.operators import resolve as V


def test_tiers_stop_at_the_first_with_candidates(spark):
    refs = spark.createDataFrame([(1, "n", "p"), (2, "m", "p"), (3, "n", "q"), (4, "k", "z")], "id int, name string, pkg string")
    cands = spark.createDataFrame([("a", "n", "p"), ("b", "n", "p"), ("c", "m", "q"), ("d", "n", "q")], "t string, name string, pkg string")
    got = {r["id"]: (r["tier"], r["n"], r["target"], r["status"]) for r in V.resolve(refs, cands, [["name", "pkg"], ["name"]], "id", "t").collect()}
    assert got == {1: (0, 2, None, "ambiguous"), 2: (1, 1, "c", "exact"), 3: (0, 1, "d", "exact"), 4: (None, 0, None, "unresolved")}
    through = {r["id"]: r["status"] for r in V.resolve(refs, cands, [["name", "pkg"], ["name"]], "id", "t", fall_through=True).collect()}
    assert through[1] == "unresolved" and through[3] == "exact"


def test_contracts(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "k string, v string")
    a = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "x"), ("d", "x"), ("e", "x")], "k string, v string")
    assert {r["k"]: r["status"] for r in V.compare(e, a, ["k"], "v").collect()} == {"a": "exact", "b": "mismatch", "c": "missing", "d": "duplicate", "e": "unexpected"}
    types = spark.createDataFrame([("Bit#  (8)", " Bit# (8)"), ("Bit#(n)", "Bit#(8)"), ("Bool", "Int#(8)"), ("Bit#(8)", "Bit#( 8 )"), ("T", "Bool"), ("Bool", None), ("FIFO#(Packet)", "FIFO#(Bool)"), ("inferred", "Bool")], "x string, y string")
    assert [r[0] for r in types.select(V.type_agreement(F.col("x"), F.col("y"))).collect()] == ["exact", "unresolved", "mismatch", "mismatch", "unresolved", "unresolved", "unresolved", "unresolved"]


def test_smallest_range_keeps_ties_and_misses(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, 10.0)], "point_id int, at double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 100.0), ("c", 1.0, 11.0), ("d", 0.0, 50.0)], "range_id string, low double, high double")
    got = {(r[0], r[1]) for r in V.smallest_enclosing(points, ranges.where("range_id <> 'b'")).collect()}
    assert got == {(1, "a"), (1, "c"), (2, None), (3, "c")}


def test_statuses(spark):
    rows = spark.createDataFrame([(["exact"],), ([],), (["exact", "unresolved"],), (["unresolved", "unsupported"],)], "s array<string>")
    assert [r[0] for r in rows.select(V.combined_status(F.col("s"))).collect()] == ["exact", "exact", "unresolved", "unsupported"]
    order = ["stale", "unknown", "fresh"]
    assert spark.createDataFrame([("fresh",), ("unknown",)], "f string").agg(V.worst("f", order)).first()[0] == "unknown"


def test_pairs_islands_and_names(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 3, "c")], "g string, k int, x string")
    assert R.ordered_pairs(rows, ["g"], ["k"], "x").count() == 3
    assert R.ordered_pairs(rows, ["g"], ["k"], "x", first_only=True).count() == 2
    assert R.adjacent_pairs(rows, ["g"], ["k"], "x").count() == 2
    spans = spark.createDataFrame([("u", 0, 2), ("u", 1, 3), ("u", 3, 4), ("u", 6, 7), ("u", 9, 9)], "g string, low int, high int")
    assert {tuple(r) for r in R.islands(spans, ["g"], "low", "high").collect()} == {("u", 0, 4), ("u", 6, 7)}
    assert [tuple(r) for r in R.gaps(spans, ["g"], "low", "high").collect()] == [("u", 4, 6)]
    named = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, name string").withColumn("s", F.lit("s"))
    assert {r["unique_name"] for r in R.unique_names(named, ["s"], "name", ["k"]).collect()} == {"p", "p~2", "q"}


def test_evidence_either_way(spark):
    certain = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    guessed = spark.createDataFrame([("b", "a"), ("x", "y")], "src string, dst string")
    told, alone = R.with_evidence(certain, guessed)
    assert {(r["src"], r["n_support"]) for r in told.collect()} == {("a", 1), ("c", 0)} and [r["src"] for r in alone.collect()] == ["x"]


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    r = F.struct(F.lit(1).alias("line"), F.lit(2).alias("col"), F.lit(1).alias("end_line"), F.lit(5).alias("end_col"))
    assert v(S.in_range(F.lit(1), F.lit(4), r)) and not v(S.in_range(F.lit(1), F.lit(5), r)) and v(S.in_range(F.lit(1), F.lit(5), r, inclusive_end=True))
    assert v(S.range_weight(r)) == 3 and v(S.edge_mode(F.lit("payload"))) == "data-flow"
    assert v(F.lit("a/b/c.bsv").rlike(S.glob("**/*.bsv"))) and not v(F.lit("a/b/c.bsv").rlike(S.glob("*.bsv")))
    assert v(S.path_group(F.lit("hw/src/core/x.bsv"), [("hw/src/io/**", "io")])) == "core"
    groups = {"a/src/b/src/c/d.bsv": "c", "hw/lib/x.bsv": "lib", "x.bsv": "root", "hw/src/x.bsv": "src", "hw\\\\src\\\\io\\\\x.bsv": "io", "src/a/b/x.bsv": "a"}
    assert {k: v(S.path_group(F.lit(k), [])) for k in groups} == groups
    assert v(F.lit("a/x").rlike(S.glob("**/x"))) and not v(F.lit("x").rlike(S.glob("**/x")))
    kinds = {("MyFifoCtl", "mkMyFifoCtl"): None, ("ROM#(a)", "mkThing"): "memory", ("X", "mkROMCore"): "memory", ("Reg #(Bool)", "mkA"): "register", ("X", "mkDReg"): "register", ("X", "mkDRegs"): "register", ("", "mkBypassFIFOF"): "fifo", ("PulseWire", "x"): "wire", ("X", "mkBypassWire"): "wire", ("RegFile#(a)", "mkRegFileFull"): "memory", ("Regulator", "mkRegulator"): "register", ("Vector#(2, Reg#(a))", "replicateM"): None}
    assert {k: v(S.primitive_kind(F.lit(k[0]), F.lit(k[1]))) for k in kinds} == kinds
    classes = {"Action": "input", " action ": "input", "ActionValue #(Bool)": "request-response", "ActionValue": "output", "Bool": "output", "": "unknown", None: "unknown"}
    assert {k: v(S.method_class(F.lit(k).cast("string"))) for k in classes} == classes
    every = ["instantiate", "import", "instance-child", "sequential-before", "descending-urgency", "state-read", "interface-forward", "potential-state-dependency", "binds", "before"]
    assert [v(S.edge_mode(F.lit(k))) for k in every] == ["structure"] * 3 + ["scheduling"] * 2 + ["data-flow"] * 2 + ["scheduling"] + [None] * 2
    assert v(S.primitive_kind(F.lit("FIFO#(Bit#(8))"), F.lit("mkFIFO"))) == "fifo" and v(S.method_class(F.lit("ActionValue#(Bool)"))) == "request-response"
    assert v(S.binary_parameter(F.lit("0110"))) == 6 and v(S.binary_parameter(F.lit("7"))) == 7 and v(S.binary_parameter(F.lit("q"))) is None
    assert tuple(v(S.multiplicity(F.array(F.lit("2"), F.lit("3"))))) == ("exact", 6) and v(S.multiplicity(F.array(F.lit("n"))))[0] == "parameterized"
    assert v(S.shortened(F.lit("abcdef"), 4)) == "abc…" and v(S.squeezed(F.lit(" a \n b "))) == "a b"
