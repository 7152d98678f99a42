"""Claims, projections, scenes, symbols, exports and publication on small tables made by hand."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions import spans, symbols
from tracelake.operators import calls
from tracelake.operators import claims as C
from tracelake.operators import projection as P
from tracelake.operators import views
from tracelake.sources import export
from tracelake.streaming.publication import Published


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts(spark, *given):
    return spark.createDataFrame(list(enumerate(given)), "id int, text string")


def test_provided_interfaces_nest(spark):
    given = texts(spark, "interface A#(B#(C)) a; interface b = c.d(e); interface d; interface e; endinterface endinterface endinterface interface f;", None, "", "endinterface interface X y; interface Z z; endinterface interface w = v;", "x" * 200_000)
    got = symbols.provided_interfaces(given)
    assert rows(got, "id", "path", "depth", "type", "form", "target", "complete") == [
        (0, "a", 1, "A#(B#(C))", "block", None, True), (0, "a.b", 2, "inferred", "alias", "c.d(e)", True), (0, "a.d", 2, "inferred", "block", None, True),
        (0, "a.d.e", 3, "inferred", "block", None, True), (0, "f", 1, "inferred", "block", None, False), (3, "y", 1, "X", "block", None, False),
    ]


def test_symbols_of_documents(spark):
    text = """package P;
typedef struct {Bit#(8) a; Bool b;} S deriving (Bits);
interface Ifc#(type t);
  method ActionValue#(t) get();
  interface Get#(t) g;
endinterface
module mkP#(Integer n)(Ifc#(Bit#(8)));
  Vector#(4, Reg#(Bool)) v <- replicateM(mkReg(False));
  function Bool own(Bit#(8) x); return True; endfunction
  interface Get g;
    method Bit#(8) hidden; return 1; endmethod
  endinterface
  method ActionValue#(Bit#(8)) get() if (ready); return 1; endmethod
endmodule
"""
    got = symbols.document_symbols(texts(spark, text, "", None))
    assert [tuple(r) for r in got.where("id = 0").orderBy("nth").select("kind", "name", "detail", "parent").collect()] == [
        ("package", "P", None, None), ("type", "S", "struct", "P"), ("interface", "Ifc", None, "P"), ("method", "get", "ActionValue#(t)", "Ifc"), ("module", "mkP", "Ifc#(Bit#(8))", "P"),
        ("instance", "v", "Vector#(4, Reg#(Bool)) <- mkReg", "mkP"), ("function", "own", "Bool", "mkP"), ("method", "get", "ActionValue#(Bit#(8))", "mkP"),
    ]
    assert rows(got.where("id <> 0"), "id", "kind", "name") == [(1, "package", "")]


def test_long_text_without_marks_is_read_once(spark):
    got = spans.matched(texts(spark, "(" + "x" * 2_000_000 + ")" + "y" * 2_000_000))
    assert rows(got, "start", "end") == [(0, 2_000_001)]


def test_violations(spark):
    id_ = C.claim_id(F.col("kind"), F.col("source"), F.col("target"), F.col("premises"))
    base = spark.createDataFrame([("source-occurrence", "contract", "a", "i", []), ("source-occurrence", "context", "b", "j", []), ("no-kind", "x", "c", "k", [])], "kind string, scope string, source string, target string, premises array<string>").withColumn("id", id_)
    first = base.where("source = 'a'").first()["id"]
    more = spark.createDataFrame([("method-port-contract", "contract", "a.m", "t", [first]), ("generated-port", "contract", "a.m", "p", [first]), ("generated-port", "contract", "a.n", "p", ["claim-none"])], "kind string, scope string, source string, target string, premises array<string>").withColumn("id", id_)
    all_ = base.unionByName(more)
    forged = all_.where("source = 'a.m' and kind = 'method-port-contract'").withColumn("target", F.lit("other"))
    wrong = C.violations(all_.unionByName(forged)).join(all_, "id")
    assert rows(wrong, "kind", "source", "problem") == [
        ("generated-port", "a.m", "missing-premise"), ("generated-port", "a.n", "missing-premise"), ("generated-port", "a.n", "unknown-premise"),
        ("method-port-contract", "a.m", "altered"), ("method-port-contract", "a.m", "duplicate"), ("no-kind", "c", "unknown-kind"), ("source-occurrence", "b", "wrong-scope"),
    ]


def test_contexts_go_down_the_hierarchy(spark):
    instances = spark.createDataFrame([("t", None, "t", "mkT"), ("t.a", "t", "a", "mkA"), ("t.a.b", "t.a", "b", "mkB"), ("t.c", "t", "c", "mkC"), ("t.d", "t", "d", "mkD")], "instance string, parent string, name string, definition string")
    hierarchy = spark.createDataFrame([("1", None, "mkT", "mkT", "top"), ("2", "1", "a", None, "a"), ("3", "2", "b", "mkB", "b"), ("4", "1", "c", "mkC", "c"), ("5", "1", "c", "mkC", "c")], "node string, parent string, name string, module string, unique string")
    occurrences = spark.createDataFrame([("o", None, "top"), ("o.c", "o", "c")], "occurrence string, parent string, name string")
    got = C.contexts(instances, hierarchy, occurrences)
    assert rows(got, "instance", "context", "kind", "problem") == [
        ("t", "o", "source-occurrence", None), ("t.a", "o", "containing-context", None), ("t.a.b", "o", "containing-context", "missing-implementation"), ("t.c", "o", None, "ambiguous-occurrence"), ("t.d", "o", None, "compiler-occurrence-unmapped"),
    ]
    assert C.contexts(instances.limit(0), hierarchy, occurrences).count() == 0


def test_origins(spark):
    claims = spark.createDataFrame([("1", "e", "o1", "s", "t", "r"), ("2", "e", "o2", "s", "t", "r"), ("3", "f", "o1", "s2", "t", "r2")], "id string, entity string, occurrence string, semantic string, token string, revision string")
    asked = spark.createDataFrame([(1, "e", None, None, None, False), (2, None, "s2", None, None, None), (3, "e", None, None, "gone", False), (4, "e", None, None, None, True), (5, "e", "s", "t", "r", False), (6, "x", None, None, None, False)], "request int, entity string, semantic string, token string, revision string, complete boolean")
    told, first = C.origins(claims, claims.select("revision"), asked, limit=1)
    assert rows(told, "request", "resolution", "n", "truncated") == [(1, "ambiguous", 2, True), (2, "resolved", 1, False), (3, "stale", 0, False), (4, "unmapped", 0, False), (5, "ambiguous", 2, True), (6, "unmapped", 0, False)]
    assert rows(first, "request", "id") == [(1, "1"), (2, "3"), (5, "1")]


def test_reveal(spark):
    tree = lambda *pairs: spark.createDataFrame(list(pairs), "node string, parent string")
    owners, occurrences = tree(("t", None), ("a", "t"), ("b", "a"), ("z", "t")), tree(("O", None), ("O.a", "O"), ("O.a.x", "O.a"), ("O.z", "O"))
    contexts = spark.createDataFrame([("t", "O"), ("a", "O.a"), ("z", "O.z")], "owner string, anchor string")
    asked = spark.createDataFrame([(1, "b", None, "O.a.x"), (2, "a", "t", "O.a"), (3, "b", "z", "O.a"), (4, "b", "t", "O.z"), (5, "q", None, "O"), (6, "a", None, "nothing")], "request int, owner string, root string, target string")
    assert rows(views.revealed(owners, contexts, occurrences, asked), "request", "status", "owner", "anchor") == [
        (1, "owner-broadened", "a", "O.a"), (2, "owner-preserved", "a", "O.a"), (3, "foreign-root", None, None), (4, "owner-broadened", "t", "O"), (5, "unknown-owner", None, None), (6, "unknown-target", None, None),
    ]
    with pytest.raises(ValueError):
        views.closure(tree(("a", "b"), ("b", "a")), tree(("a", None)), max_depth=5)


def test_provenance_keeps_what_is_said(spark):
    given = spark.createDataFrame([(1, "explicit", None), (2, None, ""), (3, "", "e")], "id int, confidence string, evidence string")
    got = P.with_provenance(given, F.lit("exact"), F.lit("default"))
    assert rows(got, "id", "analysis_origin", "confidence", "evidence", "location") == [(1, "Source-derived", "explicit", "default", None), (2, "Source-derived", "exact", "default", None), (3, "Source-derived", "exact", "e", None)]


def test_exports_are_whole(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        export.manifest_of(path)
    tables = {"a": spark.range(100).select("id", F.when(F.col("id") % 2 == 0, 'line\n"ü').alias("x")), "b": spark.createDataFrame([], "id long")}
    export.write_model(tables, path)
    assert rows(export.table_of(export.read_model(spark, path), "a", "id long, x string"), "id", "x") == rows(tables["a"], "id", "x")
    assert export.read_model(spark, path).where("section = 'b'").count() == 0
    with pytest.raises(Exception, match="has an export"):
        export.write_model(tables, path)
    assert export.read_model(spark, path).count() == 100 and export.damaged(spark, path).count() == 0
    failing = {"a": tables["a"].withColumn("x", F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise("new"))}
    with pytest.raises(Exception):
        export.write_model(failing, path, overwrite=True)
    assert export.read_model(spark, path).count() == 100 and export.damaged(spark, path).count() == 0
    export.write_model({"a": tables["a"].limit(3)}, path, overwrite=True)
    assert export.read_model(spark, path).count() == 3
    part = export.manifest_of(path)["parts"][0]["name"]
    (tmp_path / "model" / part).write_text("[]")
    assert rows(export.damaged(spark, path), "name", "problem") == [(part, "altered")]
    manifest = tmp_path / "model" / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"rows": ', '"rows": 1'))
    with pytest.raises(ValueError):
        export.manifest_of(path)


def test_publication_rewrites_touched_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/published"
    make = lambda *r: spark.createDataFrame(list(r), "k int, rev int, v string")
    table = Published(spark, path, "k", "rev", buckets=8)
    assert table.read() is None
    table.apply(make((1, 1, "a"), (2, 5, "b"), (3, 1, "c")), 0)
    table.apply(make((1, 2, "a2"), (2, 4, "late"), (4, 1, "bad"), (None, 9, "x"), (5, None, "y")), 1, F.col("v") != "bad")
    want = [(1, 2, "a2"), (2, 5, "b"), (3, 1, "c")]
    assert rows(table.read(), "k", "rev", "v") == want
    assert rows(spark.read.parquet(f"{path}/rejected/batch=1"), "v") == [("bad",), ("x",), ("y",)]
    before = table.entry()
    assert before["folders"][str(make((3, 1, "")).select(table.bucket()).first()[0])] in (0, 1)
    table.apply(make((1, 2, "a2"), (2, 4, "late"), (4, 1, "bad")), 1, F.col("v") != "bad")  # the same batch again
    assert rows(table.read(), "k", "rev", "v") == want and table.entry() == before
    table.apply(make((9, 9, "bad")), 2, F.col("v") != "bad")  # nothing valid
    assert rows(table.read(), "k", "rev", "v") == want
    for n in range(3, 9):
        table.apply(make((1, n, f"n{n}")), n)
    assert rows(Published(spark, path, "k", "rev", buckets=3).read(), "k", "rev", "v") == [(1, 8, "n8"), (2, 5, "b"), (3, 1, "c")]
    assert len(list((tmp_path / "published" / "log").glob("*.json"))) == 3


def test_cell_seeds(spark):
    pins = spark.createDataFrame([("c", "o", "p2"), ("c", "o", "p1"), ("c", "o", "p1"), ("d", "o", "q")], "cell string, occurrence string, pin string")
    seeds = spark.createDataFrame([(1, "c", "o", None), (2, "d", "o", None), (3, "c", "other", None), (4, "c", "o", [0])], "seed int, cell string, occurrence string, indices array<int>")
    assert rows(calls.cell_seeds(pins, seeds), "seed", "pin", "status") == [(1, "p1", "ambiguous"), (1, "p2", "ambiguous"), (2, "q", "exact"), (3, None, "invalid"), (4, None, "invalid")]


def test_producers_follow_parts_and_cycles(spark):
    arguments = spark.createDataFrame([("k", 0, "a", "rule"), ("k", 1, "lone", "rule"), ("k2", 0, "a", "other")], "call string, position int, expression string, caller string")
    parts = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "m"), ("c", "n")], "expression string, part string")
    references = spark.createDataFrame([("m", "s1", "1:0"), ("n", "s2", "2:0"), ("n2", "s2", "2:0")], "expression string, statement string, place string")
    bindings = spark.createDataFrame([("b1", "rule", "s1", "1:0", "e1"), ("b2", "rule", "s1", "1:4", "e2"), ("b3", "rule", "s2", "2:0", "e3"), ("b4", "rule", "s2", "2:0", "e4")], "binding string, behaviour string, statement string, place string, endpoint string")
    got = calls.producers(arguments, parts, references, bindings)
    assert rows(got, "call", "position", "binding", "status") == [("k", 0, "b1", "exact"), ("k", 0, "b3", "ambiguous"), ("k", 0, "b4", "ambiguous")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "node string, parent string, owner string, kind string")
    assert views.closure(none, none).count() == 0
    assert symbols.document_symbols(spark.createDataFrame([], "id int, text string")).count() == 0
    assert C.violations(spark.createDataFrame([], "id string, kind string, scope string, source string, target string, premises array<string>")).count() == 0
    assert P.presentations(spark.createDataFrame([("r",)], "reference string"), spark.createDataFrame([], "reference string, node string, role string"), none).first()["status"] == "none"
