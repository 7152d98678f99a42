import pytest

from tracelake.functions import spans
from tracelake.operators import views
from tracelake.sources import config


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def tree(spark):
    return table(spark, "node string, parent string", ("r", None), ("a", "r"), ("b", "r"), ("a1", "a"), ("a2", "a"), ("x", "a1"), ("y", "x"), ("b1", "b"), ("lone", None))


def test_the_nearest_shown_ancestor_stands_for_a_node(spark):
    shown = table(spark, "node string", ("r",), ("a1",), ("b",))
    got = {r["node"]: (r["stands"], r["distance"]) for r in views.standing(tree(spark), shown).collect()}
    assert got == {"r": ("r", 0), "a": ("r", 1), "b": ("b", 0), "a1": ("a1", 0), "a2": ("r", 2), "x": ("a1", 1), "y": ("a1", 2), "b1": ("b", 1), "lone": (None, None)}
    loop = table(spark, "node string, parent string", ("p", "q"), ("q", "p"))
    assert {r["stands"] for r in views.standing(loop, shown, max_rounds=3).collect()} == {None}


def test_lifted_edges_are_folded_and_counted(spark):
    e = table(spark, "src string, dst string, kind string, id string", ("x", "b1", "call", "3"), ("y", "b", "call", "1"), ("x", "y", "call", "2"), ("a2", "b1", "call", "4"), ("x", "b1", "read", "5"), ("x", "lone", "call", "6"))
    got = {tuple(r) for r in views.lifted(e, tree(spark), table(spark, "node string", ("r",), ("a1",), ("b",))).collect()}
    assert got == {("a1", "b", "call", 2, "1"), ("r", "b", "call", 1, "4"), ("a1", "b", "read", 1, "5")}


def test_lowest_common_ancestors(spark):
    pairs = [("y", "a2"), ("y", "b1"), ("y", "x"), ("x", "y"), ("y", "y"), ("r", "y"), ("lone", "y"), ("a2", "a1")]
    got = {(r["a"], r["b"]): (r["common"], r["up_a"], r["up_b"]) for r in views.common_ancestors(tree(spark), table(spark, "a string, b string", *pairs)).collect()}
    assert got == {("y", "a2"): ("a", 3, 1), ("y", "b1"): ("r", 4, 2), ("y", "x"): ("x", 1, 0), ("x", "y"): ("x", 0, 1), ("y", "y"): ("y", 0, 0), ("r", "y"): ("r", 0, 4), ("lone", "y"): (None, None, None), ("a2", "a1"): ("a", 1, 1)}


def test_views_have_levels_buckets_files_and_filters(spark):
    nodes = table(
        spark, "node string, parent string, kind string, path string, hidden boolean",
        ("p", None, "package", "f", None), ("m", "p", "module", "f", False), ("n", "p", "module", "g", False), ("r1", "m", "rule", "f", False), ("r2", "m", "rule", "f", True), ("s", "m", "register", "f", False), ("t", "m", "type", "f", False),
    )
    edges = table(spark, "src string, dst string, kind string, mode string", ("r1", "s", "read", None), ("r2", "s", "write", None), ("m", "n", "instantiate", None), ("r1", "s", "odd", "scheduling"))
    show = lambda *a, **k: tuple({r["node"] for r in views.visible(nodes, edges, *a, **k)[0].collect()} if j == 0 else {(r["src"], r["dst"]) for r in views.visible(nodes, edges, *a, **k)[1].collect()} for j in (0, 1))
    assert show("system", "structure") == ({"p", "m", "n"}, {("m", "n")})
    assert show("system", "structure", packages=False, file="f") == ({"m"}, set())
    assert show("module", "structure", owner="m") == ({"m", "t", "member-group:m:rules", "member-group:m:state", "member-group:m:types"}, {("m", x) for x in ("t", "member-group:m:rules", "member-group:m:state", "member-group:m:types")})
    assert show("behavior", "data-flow", owner="m") == ({"m", "r1", "s"}, {("r1", "s")})
    assert show("behavior", "data-flow", owner="m", kinds=["rule"]) == ({"r1"}, set())
    assert show("behavior", "scheduling", owner="m") == ({"r1"}, set())
    assert show("behavior", "data-flow", owner="m", focus="r1", hops=1) == ({"r1", "s"}, {("r1", "s")})
    with pytest.raises(ValueError):
        views.visible(nodes, edges, "city", "structure")


def test_brackets_statements_and_annotations(spark):
    texts = table(spark, "id long, text string", (1, "a(b[c)d]; {e; (f} g;"), (2, None), (3, ""), (4, "é)(x); y;)) z;("))
    pairs = {(r["id"], r["kind"], r["start"], r["end"]) for r in spans.matched(texts).collect()}
    assert pairs == {(1, "()", 1, 5), (1, "[]", 3, 7), (1, "{}", 10, 16), (1, "()", 14, None), (4, "()", 2, 4), (4, "()", 14, None)}
    ends = {(r["id"], r["nth"], r["start"], r["end"]) for r in spans.statement_ends(texts).collect()}
    assert ends == {(1, 1, 0, 9), (4, 1, 0, 6), (4, 2, 6, 9), (4, 3, 9, 14)}
    code = "// @arch.label \"One\"\n// @arch label two\n\n//@arch hide=false\nmodule a;\n// @arch.entry\n" + "\n" * 8 + "module b;\n// @arch.kind x\n"
    got = {(r["line"], r["key"], r["value"]) for r in spans.annotations(table(spark, "id long, text string", (1, code))).collect()}
    assert got == {(4, "label", "One"), (4, "hide", "false")}


def test_a_forest_of_ranges(spark):
    ranges = table(spark, "id long, key string, start long, end long", (1, "a", 0, 100), (1, "b", 0, 50), (1, "c", 0, 50), (1, "d", 10, 20), (1, "e", 20, 50), (1, "f", 50, 60), (1, "g", 200, 201), (2, "h", 5, 6))
    got = {r["key"]: (r["depth"], r["parent"]) for r in spans.forest(ranges).collect()}
    assert got == {"a": (1, None), "b": (2, "a"), "c": (3, "b"), "d": (4, "c"), "e": (4, "c"), "f": (2, "a"), "g": (1, None), "h": (1, None)}


def test_configurations_fill_in_what_is_missing(spark):
    texts = [("a", '{"title": " T // no ", /* x */ "exclude": ["q", "q", " "], "groups": [{"match": "z", "order": 9}, {"match": "y"}]} // end'), ("b", "{"), ("c", None), ("d", "{}"), ("e", '{"title": "\\\\" /* \\"", "view": {"showImports": true}} /* open')]
    got = {r["path"]: r for r in config.configured(table(spark, "path string, value string", *texts), ["p"]).collect()}
    assert (got["a"]["title"], got["a"]["exclude"], [g["id"] for g in got["a"]["groups"]]) == ("T // no", ["p", "q"], ["y", "z"])
    assert [got[k]["problem"] for k in "abcde"] == [None, "unparsable", "unparsable", None, "unparsable"]
    assert (got["d"]["version"], got["d"]["direction"], got["d"]["groups"], got["b"]["exclude"]) == (1, "LR", [], ["p"])
