from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.sources import files
from tracelake.streaming import incremental as I

SOURCE = '''package Top;
import FIFO :: *; // import Fake :: *;
import Reg :: a, b;
typedef enum { Red, Green } Colour deriving (Bits);
typedef Bit#(8) Byte;
interface Out;
  method Action put(Bit#(8) x);
  method Bit#(8) get;
endinterface
(* synthesize, descending_urgency = "b, a" *)
module mkTop#(parameter Bit#(4) w, Reg#(Bit#(8)) r)(Out);
  Reg#(Bit#(8)) count <- mkReg(0);
  FIFO#(Bit#(8)) q <- mkFIFO;
  Vector#(4, Reg#(Bool)) flags <- replicateM(mkReg(False));
  String s = "rule fake; endrule";
  rule step (count < 3);
    count <= count + 1;
    q.enq(count);
  endrule
  /* rule gone; endrule */
  rule drain;
    q.deq;
  endrule
endmodule
'''


def documents(spark):
    return X.with_masked(spark.createDataFrame([("t", SOURCE)], "path string, content string"))


def test_masking_keeps_offsets(spark):
    got = documents(spark).first()
    assert len(got.masked) == len(SOURCE) and got.masked.count("\n") == SOURCE.count("\n")
    assert "fake" not in got.masked and "Fake" not in got.masked and "gone" not in got.masked
    odd = spark.createDataFrame([('a "x\\"y" b // c\n/* d',), ("",), (None,)], "content string")
    assert [r[0] for r in odd.select(X.masked("content")).collect()] == ['a ' + " " * 6 + ' b ' + " " * 4 + "\n" + " " * 4, "", None]


def test_declarations(spark):
    d = documents(spark)
    assert [r.name for r in X.packages(d).collect()] == ["Top"]
    assert {r.package for r in X.imports(d).collect()} == {"FIFO", "Reg"}
    m = X.modules(d).first()
    assert (m.name, m.interface, m.parameters) == ("mkTop", "Out", ["parameter Bit#(4) w", "Reg#(Bit#(8)) r"])
    assert {(r.method, r.returns) for r in X.interface_methods(d).collect()} == {("put", "Action"), ("get", "Bit#(8)")}
    assert {(r.name, r.constructor, r.family) for r in X.instances(d).collect()} == {("count", "mkReg", None), ("q", "mkFIFO", None), ("flags", "mkReg", "replicateM")}
    assert {(r.name, r.guard) for r in X.rules(d).collect()} == {("step", "count < 3"), ("drain", None)}
    assert {(r.kind, r.name) for r in X.typedefs(d).collect()} == {("enum", "Colour"), ("alias", "Byte")}
    assert {(r.key, r.value) for r in X.attributes(d).collect()} == {("synthesize", None), ("descending_urgency", "b, a")}


def test_accesses(spark):
    kinds = spark.createDataFrame([("t", "count", "register"), ("t", "q", "fifo")], "path string, name string, kind string")
    got = {(r.owner, r.instance, r.operation) for r in X.accesses(X.rules(documents(spark)), kinds).collect()}
    assert got == {("step", "count", "write"), ("step", "count", "read"), ("step", "q", "enqueue"), ("drain", "q", "dequeue")}


def test_positions_and_offsets(spark):
    row = spark.createDataFrame([("é\n😀b", 2, 4)], "t string, a int, b int")
    assert tuple(row.select(X.position(F.col("t"), F.col("a"))).first()[0]) == (1, 0)
    assert tuple(row.select(X.offsets("t", "a", "b")).first()[0]) == (2, 5, 3, 8)
    assert row.select(X.arguments(F.lit("a, f(b, g[c, d]), e"))).first()[0] == ["a", "f(b, g[c, d])", "e"]
    assert row.select(X.statements(F.lit("a; b ; tail"))).first()[0] == ["a", "b"]


def test_widths(spark):
    members = spark.createDataFrame([("P", "Byte"), ("P", "Bool"), ("Q", "P"), ("R", "S"), ("S", "R"), ("U", "Nope")], "owner string, member_type string")
    basic = spark.createDataFrame([("Byte", 8), ("Bool", 1)], "name string, bits int")
    assert {tuple(r) for r in X.type_width(members, basic).collect()} == {("P", 9, "exact"), ("Q", 9, "exact"), ("R", None, "cycle"), ("S", None, "cycle"), ("U", None, "unknown")}


def test_discovery_says_why(spark):
    rows = spark.createDataFrame([("a/1.bsv", 5), ("a/2.bsv", 500), ("b/3.bsv", 5), ("b/skip/4.bsv", 5), ("c/5.bsv", 5), ("c/6.bsv", 5)], "path string, bytes long")
    got = {r.path: r.reason for r in files.classify(rows, ("**/skip/**",), max_files=3, max_bytes=100, max_total=12).collect()}
    assert got == {"a/1.bsv": None, "a/2.bsv": "too-large", "b/3.bsv": None, "b/skip/4.bsv": "excluded", "c/5.bsv": "byte-limit", "c/6.bsv": "file-limit"}


def test_scan_bind_and_freshness(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.bsv").write_text("package X;")
    (tmp_path / "src/y.txt").write_text("no")
    docs, _ = files.scan(spark, [str(tmp_path)])
    assert docs.count() == 1 and files.source_root(docs) == "src"
    assert files.unseen(docs, docs).count() == 0
    table = lambda *r: spark.createDataFrame(list(r), "path string, revision string")
    got = {r.revision: r.status for r in files.bound_by_content(table(("a", "1"), ("b", "2"), ("c", "2")), table(("x", "1"), ("y", "2"))).collect()}
    assert got == {"1": "exact", "2": "ambiguous"}
    states = {r.path: r.state for r in files.freshness(table(("a", "1"), ("b", "2"), ("c", "3")), table(("a", "1"), ("b", "9"))).collect()}
    assert states == {"a": "current", "b": "stale", "c": "unavailable"}
    nets = spark.createDataFrame([("n.json", '{"modules":{"t":{"attributes":{"top":"1"}}}}'), ("m.json", "{}"), ("z", "junk")], "path string, content string")
    assert [(r.path, r.tops) for r in files.netlist_candidates(nets).collect()] == [("n.json", ["t"])]


def test_a_stream_publishes_the_latest(spark, tmp_path):
    schema = "k string, revision long, v string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(([("a", 1, "old"), ("b", 5, "b5")], [("a", 2, "new")], [("a", 1, "late"), ("b", 4, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        writer = I.publish_latest(spark.readStream.schema(schema).json(source), "k", "revision", out, str(tmp_path / "ck"))
        assert I.run_until_done(writer)
    assert {tuple(r) for r in I.published(spark, out).collect()} == {("a", 2, "new"), ("b", 5, "b5")}
    same = spark.createDataFrame([("p", "1"), ("p", "1"), ("q", "2")], "path string, revision string")
    assert I.changed(same.withColumn("at", F.current_timestamp()).select("path", "revision", "at")).count() == 2
    assert {r.state for r in I.with_freshness(same, spark.createDataFrame([("p", "0")], "path string, revision string")).collect()} == {"stale", "unknown"}


def test_a_scan_of_files_leaves_large_ones_unread(spark, tmp_path):
    from tracelake.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.bsv").write_text("package One;")
    (tmp_path / "a" / "big.bsv").write_text("x" * 500)
    (tmp_path / "a" / "old.bsv").write_text("gone")
    (tmp_path / "a" / "other.txt").write_text("no source")
    documents, left = files.scan(spark, [str(tmp_path)], exclude=("**/old.bsv",), max_bytes=100)
    assert [(r["path"].rpartition("/")[2], r["content"]) for r in documents.collect()] == [("one.bsv", "package One;")]
    assert {(r["path"].rpartition("/")[2], r["reason"]) for r in left.collect()} == {("big.bsv", "too-large"), ("old.bsv", "excluded")}
