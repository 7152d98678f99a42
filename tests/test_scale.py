"""What has to stay bounded or dealt out when tables grow."""

import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators import calls as C
from tracelake.operators import questions as Q
from tracelake.operators import relations as R
from tracelake.operators import semantic as M
from tracelake.operators import views as V


def largest_share(rows) -> float:
    n = [r[0] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    return max(n) / sum(n)


def test_pairs_of_one_key_are_dealt_out_whole(spark):
    left = spark.range(700).select(F.lit("k").alias("key"), F.col("id").alias("a")).union(spark.createDataFrame([("only left", 1), ("k", None)], "key string, a long"))
    right = spark.range(90).select(F.lit("k").alias("key"), (F.col("id") % 80).alias("b")).union(spark.createDataFrame([("only right", 1), ("k", None)], "key string, b long"))
    found = R.paired(left, right, "key", block=4, per_task=10_000)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, left.join(right, "key").collect()))
    assert R.paired(left.where("a < 0"), right, "key").count() == 0


def test_pairs_of_blocks_are_made_in_pieces(spark):
    left = spark.createDataFrame([(f"k{n}", a) for n in (1, 15, 16, 17, 33) for a in range(n)], "key string, a long")
    right = spark.createDataFrame([(f"k{n}", b) for n in (1, 16, 17) for b in range(n + 2)], "key string, b long")
    found = R.paired(left, right, "key")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, left.join(right, "key").collect()))
    # a block of the left comes in slices, so the rows of two whole blocks are never held at once
    assert "slice(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_slices_of_one_definition_are_dealt_out(spark):
    behaviours = spark.range(4000).coalesce(1).select(F.col("id").alias("behaviour"), F.lit(1).alias("definition"))
    parts = {"statement": spark.range(500).coalesce(1).select(F.lit(1).alias("definition"), "id"), "binding": spark.range(3).select(F.col("id").alias("behaviour"), "id")}
    found = Q.behaviour_slices(behaviours, parts)
    assert found.count() == found.distinct().count() == 4000 * 500 + 3
    assert largest_share(found) < 0.8


def test_endpoints_of_one_interface_are_dealt_out(spark):
    owners = spark.range(4000).coalesce(1).select(F.col("id").alias("owner"), F.lit("I").alias("interface"))
    members = spark.range(500).coalesce(1).select(F.lit("I").alias("interface"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("nested"))
    found = M.endpoints(owners, members.union(spark.createDataFrame([("I", "self", "I")], members.schema)))
    assert found.count() == found.distinct().count() == 4000 * 501
    assert found.where("status = 'cycle-cut' and path = 'self'").count() == 4000
    assert largest_share(found) < 0.8


def test_states_shared_between_many_groups(spark):
    rows = [(b, f"s{(b * k) % 7}", (b + k) % 3 == 0) for b in range(25) for k in range(4)] + [(1, None, True), (None, "s1", True)]
    access = spark.createDataFrame(rows, "behaviour long, state string, writes boolean")
    held = {}
    for b, s, w in rows:
        if b is not None and s is not None:
            held[b, s] = held.get((b, s), False) or w
    want = {}
    for (a, s), x in held.items():
        for (b, r), y in held.items():
            if a < b and s == r and (x or y):
                want.setdefault((a, b), []).append(s)
    for per_cell in (20, 10**9):
        got = R.shared_state_pairs(access, per_cell=per_cell)
        assert sorted((r["a"], r["b"], r["n_states"], r["states"]) for r in got.collect()) == sorted((a, b, len(v), sorted(v)) for (a, b), v in want.items())


def test_pairs_of_a_cell_are_made_in_pieces(spark):
    access = spark.range(400).select((F.col("id") % 40).alias("behaviour"), F.concat(F.lit("s"), F.expr("id div 40").cast("string")).alias("state"), (F.col("id") % 3 == 0).alias("writes"))
    found = R.shared_state_pairs(access, per_cell=1000, per_group=150, chunk=30)
    x, y = access.alias("x"), access.alias("y")
    want = x.join(y, F.expr("x.state = y.state and x.behaviour < y.behaviour and (x.writes or y.writes)")).groupBy("x.behaviour", "y.behaviour").agg(F.count(F.lit(1)), F.sort_array(F.collect_list("x.state")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # pairs and their states are no rows that Spark groups: only the places of a state are told row by row
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    rows = pa.table({"i": [0] * 3, "j": [1] * 3, "g": [0, 1, 1], "state": ["s", "s", "t"], "writers": pa.array([[5], [4], []], pa.list_(pa.int64())), "readers": pa.array([[7], [9, 3], [3]], pa.list_(pa.int64()))})
    for numbers in (0, 1 << 63):
        pieces = list(R._pairs_of_cell(2, numbers)(iter(rows.to_batches())))
        assert sorted((r["a"], r["b"], r["n_states"], r["states"]) for x in pieces for r in x.to_pylist()) == [(3, 5, 1, ["s"]), (4, 5, 1, ["s"]), (4, 7, 1, ["s"]), (5, 9, 1, ["s"])]
        assert len(pieces) == 2


def test_scope_has_edges_as_rows(spark, monkeypatch):
    n, seen = 300, []
    files = spark.range(n).select(F.col("id").alias("path"), F.lit(1).alias("package"))
    own = files.select("path", F.lit("top").alias("name"))
    imports = files.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("imported"))
    real = Q.reach
    monkeypatch.setattr(Q, "reach", lambda edges, *a, **k: (seen.append(edges.count()), real(edges, *a, **k))[1])
    scope, missing = Q.source_scope(files, imports, own, own, files.where("path = 5").select("path"))
    assert seen[0] <= 6 * n
    assert scope.where("included").count() == n and missing.where("imported = 2").count() == n == missing.count()


def test_a_request_meets_its_lists_once(spark):
    tree = spark.createDataFrame([("r", None), ("n", "r"), ("s", "n")], "node string, parent string")
    contexts = spark.createDataFrame([("r", "r"), ("s", "s")], "owner string, anchor string")
    requests = spark.createDataFrame([(1, "s", None, "n"), (2, "s", None, "s"), (3, "x", None, "s"), (4, "s", "q", "s"), (5, "n", "r", "z")], "request int, owner string, root string, target string")
    found = V.revealed(tree, contexts, tree, requests)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {1: ("owner-broadened", "r", "r"), 2: ("owner-preserved", "s", "s"), 3: ("unknown-owner", None, None), 4: ("foreign-root", None, None), 5: ("unknown-target", None, None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_statuses_go_up_without_writing_all_nodes_again(spark, monkeypatch):
    n, rows, real = 8, [], C.written
    monkeypatch.setattr(C, "written", lambda df, path: (rows.append((x := real(df, path)).count()), x)[1])
    nodes = spark.range(n).select("id", F.when(F.col("id") == 0, "unsupported").otherwise("exact")).toDF("node", "status")
    operands = spark.createDataFrame([*((k + 1, k) for k in range(n - 1)), (99, 0), (7, 99)], "node long, operand long")
    assert {r[1] for r in C.settled(nodes, operands).collect()} == {"unsupported"}
    assert C.settled(nodes, operands).where("node = 99").isEmpty()
    assert sum(rows) <= 2 * (n + 2 * (n + 1))


def test_parts_of_many_arguments_are_followed_once(spark, monkeypatch):
    rows, real = [], C.Levels.add
    monkeypatch.setattr(C.Levels, "add", lambda self, level, **k: (rows.append((x := real(self, level, **k))["rows"]), x)[1])
    arguments = spark.range(200).select(F.col("id").alias("call"), F.lit(0).alias("position"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("expression"), F.lit("b").alias("caller"))
    parts = arguments.select("expression", F.lit("p").alias("part")).union(spark.createDataFrame([("p", "m"), ("m", "p")], "expression string, part string"))
    references = spark.createDataFrame([("m", "s", "0"), ("x7", "s", "0")], "expression string, statement string, place string")
    bindings = spark.createDataFrame([("k", "b", "s", "0", "e")], "binding string, behaviour string, statement string, place string, endpoint string")
    assert C.producers(arguments, parts, references, bindings).count() == 201
    assert sum(rows) < 10


def test_producers_are_dealt_by_argument_once(spark, monkeypatch):
    paths, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df, path: (paths.append(path.rpartition("/")[2]), real(df, path))[1])
    arguments = [("c1", 0, "x", "b"), ("c1", 0, "x", "b"), ("c2", 1, "p", "b"), ("c3", 0, "lone", "b"), ("c4", 0, "m", "other"), ("c5", 0, None, "b")]
    parts = [("x", "p"), ("x", "p"), ("x", "q"), ("p", "m"), ("q", "m"), ("m", "p"), ("p", "m"), ("unasked", "m"), ("x", None)]
    references = [("m", "s", "0"), ("m", "s", "0"), ("p", "s", "1"), ("lone", "t", "0")]
    bindings = [("k", "b", "s", "0", "e"), ("j", "b", "s", "1", "f"), ("i", "b", "t", "0", "g"), ("h", "other", "s", "1", "e")]
    want = []
    for call, position, at, caller in arguments:
        seen = {at}
        while (more := seen | {b for a, b in parts if a in seen}) != seen:
            seen = more
        want += [(call, position, e, k[0], k[4]) for e, statement, place in references if e in seen for k in bindings if k[1:4] == (caller, statement, place)]
    n = {}
    for r in want:
        n[r[:3]] = n.get(r[:3], 0) + 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.producers(
            spark.createDataFrame(arguments, "call string, position int, expression string, caller string"), spark.createDataFrame(parts, "expression string, part string"),
            spark.createDataFrame(references, "expression string, statement string, place string"), spark.createDataFrame(bindings, "binding string, behaviour string, statement string, place string, endpoint string"),
        )
        assert sorted(map(tuple, found.collect())) == sorted((*r, "ambiguous" if n[r[:3]] > 1 else "exact") for r in want)
        plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the arguments and what they come to are shuffled once each, and parts are written once
    assert plan.count("hashpartitioning(argument#") == 2
    assert paths == ["parts"]


def test_widths_read_members_once(spark, monkeypatch):
    paths, real = [], X.written
    monkeypatch.setattr(X, "written", lambda df, path: (paths.append(path), real(df, path))[1])
    members = spark.createDataFrame([("a", "b"), ("a", "q"), ("b", "q"), ("c", "c"), ("d", "zz")], "owner string, member_type string")
    assert {tuple(r) for r in X.type_width(members, spark.createDataFrame([("q", 3)], "name string, bits int")).collect()} == {("a", 6, "exact"), ("b", 3, "exact"), ("c", None, "cycle"), ("d", None, "unknown")}
    assert any(p.endswith("/members") for p in paths)


def rows_written(monkeypatch, module) -> dict:
    """How many rows each table has that a module writes from now on, by the last part of its path."""
    seen, write = {}, module.written

    def counted(df, path):
        out = write(df, path)
        seen[path.rpartition("/")[2]] = out.count()
        return out

    monkeypatch.setattr(module, "written", counted)
    return seen


def test_instances_that_have_arrived_are_not_joined_again(spark, monkeypatch):
    seen = rows_written(monkeypatch, Q)
    chain = [(k, k - 1 if k else None) for k in range(9)]
    flat = [(100 + k, None) for k in range(500)]
    roots = spark.createDataFrame([(0, 1), (4, 2)], "node long, nth long")
    found = Q.topology(spark.createDataFrame(chain + flat, "node long, parent long"), roots)
    assert sorted(tuple(r) for r in found.collect()) == [(k, 0, k) for k in range(9)]
    assert seen["0"] == 509 and all(n <= 8 for k, n in seen.items() if k != "0") and len(seen) > 3


def test_traces_merge_only_edges_that_an_origin_reaches(spark, monkeypatch):
    from tracelake.operators import paths as P

    seen = rows_written(monkeypatch, P)
    far = spark.range(400).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("src"), F.lit("z").alias("dst"), F.lit("i").alias("id"))
    near = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2"), ("b", "z", "3")], "src string, dst string, id string")
    found = P.between(near.union(far), spark.createDataFrame([("a", "z"), ("x1", "a")], "origin string, goal string"))
    assert sorted((r["origin"], r["status"], r["n_paths"] and int(r["n_paths"])) for r in found.status.collect()) == [("a", "exact", 2), ("x1", "no-path", None)]
    assert seen["merged"] == 3 and seen["edges"] == 403


def test_trade_edges_are_made_once_and_grouped_as_numbers(spark, monkeypatch):
    from tracelake.operators import graph as G
    from tracelake.plans import relational

    joined, given, find = [], [], relational.components
    pairs = relational.trade_pairs
    monkeypatch.setattr(relational, "trade_pairs", lambda *a: joined.append(1) or pairs(*a))
    monkeypatch.setattr(relational, "components", lambda edges, folder: given.append(dict(edges.dtypes)) or find(edges, folder))
    monkeypatch.setattr(G, "written", lambda *a: 1 / 0)  # the edges are files already
    assert relational.khop_neighborhood(spark, "/root/testdata/sf0.001").count() and len(joined) == 1
    relational.connected_components(spark, "/root/testdata/sf0.001")
    assert given == [{"a": "bigint", "b": "bigint"}]


def plan_without_broadcasts(spark, make) -> str:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_of_a_model_are_not_sorted_where_they_meet_nodes(spark):
    from tracelake.plans import evidence

    plan = plan_without_broadcasts(spark, lambda: evidence.projected_model(spark, "/root/testdata/sf0.001"))
    assert "ShuffledHashJoin [dst" in plan and "SortMergeJoin [dst" not in plan and "SortMergeJoin [src" not in plan


def test_candidates_are_not_sorted_where_they_meet_what_is_shown(spark):
    from tracelake.plans import evidence

    plan = plan_without_broadcasts(spark, lambda: evidence.source_presentations(spark, "/root/testdata/sf0.001"))
    assert "ShuffledHashJoin [node" in plan and "SortMergeJoin [node" not in plan


def exchanges(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_channels_of_small_owners_are_shuffled_once(spark, monkeypatch):
    from tracelake.plans import structures

    monkeypatch.setattr(structures, "written", lambda *a: 1 / 0)
    found = exchanges(structures.protocol_channels(spark, "/root/testdata/sf0.001"))
    assert len(found) == 1 and "hashpartitioning(owner" in found[0]


def test_channels_of_one_owner_are_dealt_out_by_names(spark):
    import random
    from itertools import product

    deal = random.Random(5)
    words = ["", "current", "Current", "a", "A", "ly", "1", "_", "\u00df", "SS", "consume", "complete", "Valid", "Ready"]
    names = sorted({a + b + c for a, b, c in product(words, words[:-4], ["", "Valid", "Ready", "A"])})
    kinds = [("output", "Bool", []), ("output", "Int", []), ("input", "Action", ["A", "B"]), ("input", "Action", []), ("output", "Bool", ["A"]), ("input", " Action ", None), (None, "Bool", []), ("output", None, [])]
    rows = [("m", n, *(kinds[0] if n[-5:] in ("Valid", "Ready") and deal.random() < 0.8 else deal.choice(kinds))) for n in names] + [("m", "tooValid", "output", "Bool", []), ("m", "too", "output", "Int", []), ("n", "tooReady", "output", "Bool", []), ("m", None, "output", "Bool", [])]
    methods = spark.createDataFrame(rows, "owner string, method string, category string, returns string, parameters array<string>")
    exact, open_ = M.channels(methods)
    # an owner's methods do not all go to one task
    assert exchanges(exact) and all("hashpartitioning(owner" in x and ", " in x.split("hashpartitioning(")[1].split(")")[0].rpartition(", ")[0] for x in exchanges(exact))

    titled = lambda x: x[0].upper() + x[1:]
    after = lambda m, b: m == b or m.startswith(b) and m[len(b)] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$"
    rows = [(o, m, c, (r or "").strip(), p or []) for o, m, c, r, p in rows if m]
    value = [(o, m, r) for o, m, c, r, p in rows if c == "output" and not p and r]
    acts, plain = [(o, m, p) for o, m, c, r, p in rows if c == "input" and r == "Action"], [(o, m) for o, m, r in value if r != "Bool"]
    want, unclear = set(), set()

    def settle(suffix, *sides):
        anchors = [(o, m, m[: -len(suffix)]) for o, m, r in value if r == "Bool" and m.endswith(suffix) and m != suffix]
        met = [{(o, a): [m for p, m in side if p == o and fits(m, b)] for o, a, b in anchors} for side, fits in sides]
        for o, a, b in anchors:
            own = [x[o, a] for x in met]
            if any(len(c) > 1 or len(c) == 1 and sum(c[0] in v for k, v in x.items() if k[0] == o) > 1 for c, x in zip(own, met)):
                unclear.add((o, a, tuple(sorted({m for c in own for m in c}))))
            elif any(own):
                want.add((o, b, a, *(c[0] if c else None for c in own)))

    settle("Ready", ([(o, m) for o, m, p in acts if p], after))
    settle("Valid", (plain, lambda m, b: after(m, b) or m == "current" + titled(b)), ([(o, m) for o, m, p in acts if not p], lambda m, b: m in ("consume" + titled(b), "complete" + titled(b))))
    got = {(r.owner, r.base, r.ready, r.action) if r.ready else (r.owner, r.base, r.valid, r.value, r.consume) for r in exact.collect()}
    assert got == want and len({x[-1] is None for x in want}) == 2
    assert {(r.owner, r.anchor, tuple(r.candidates)) for r in open_.collect()} == unclear
    assert len(want) > 12 and len(unclear) > 12 and any(a.startswith("current") for _, a, _ in unclear)
