"""Queries of the model, text, source and stream operators over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.functions import text as X
from tracelake.operators import calls as C
from tracelake.operators import graph as G
from tracelake.operators import relations as R
from tracelake.operators import resolve as V
from tracelake.operators import semantic as M
from tracelake.operators.checkpoints import scratch, written
from tracelake.plans.relational import t, text_key
from tracelake.sources import files, schedules
from tracelake.streaming import incremental

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


MODES_SQL = """(VALUES ('instantiate', 'structure'), ('implements', 'structure'), ('contains', 'structure'), ('import', 'structure'), ('control', 'structure'), ('structure', 'structure'), ('instance-child', 'structure'),
('read', 'data-flow'), ('write', 'data-flow'), ('invoke', 'data-flow'), ('return', 'data-flow'), ('value', 'data-flow'), ('producer', 'data-flow'), ('consumer', 'data-flow'), ('access', 'data-flow'), ('call', 'data-flow'), ('data', 'data-flow'), ('payload', 'data-flow'), ('state-read', 'data-flow'), ('state-write', 'data-flow'), ('constructor-binding', 'data-flow'), ('interface-forward', 'data-flow'),
('conflict', 'scheduling'), ('conflict-free', 'scheduling'), ('sequential-before', 'scheduling'), ('sequential-before-reverse', 'scheduling'), ('mutually-exclusive', 'scheduling'), ('descending-urgency', 'scheduling'), ('execution-order', 'scheduling'), ('preempts', 'scheduling'), ('potential-state-dependency', 'scheduling'),
('binds', NULL), ('other', NULL))"""
#: All kinds that have a mode, and two that have none.
KINDS = [kind for kinds in S.EDGE_MODES.values() for kind in kinds] + ["binds", "other"]
KINDED_SQL = f"m AS (SELECT row_number() OVER () - 1 AS k, kind, mode FROM {MODES_SQL} AS v(kind, mode)), x AS (SELECT l.*, m.kind, m.mode FROM lineitem AS l JOIN m ON m.k = (l_partkey * 7 + l_linenumber) % 33)"


def kind():
    return F.get(F.array(*map(F.lit, KINDS)), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(KINDS)).cast("int"))


@query(f"WITH {KINDED_SQL} SELECT l_returnflag AS flag, kind, CASE WHEN l_returnflag = 'R' THEN 'scheduling' ELSE mode END AS mode, count(*) AS n FROM x GROUP BY ALL")
def edge_modes(spark, d):
    """A mode that is given wins if it is one; a kind that is none has no mode."""
    given = F.when(F.col("l_returnflag") == "R", "scheduling").when(F.col("l_returnflag") == "A", "no mode")
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), kind().alias("kind"), S.edge_mode(kind(), given).alias("mode"))
    return rows.groupBy("flag", "kind", "mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {KINDED_SQL} SELECT l_suppkey AS src, l_partkey AS dst, kind FROM x WHERE mode = 'data-flow' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def edges_in_mode(spark, d):
    edges = t(spark, d, "lineitem").select(text_key("s", "l_suppkey").alias("src"), text_key("p", "l_partkey").alias("dst"), kind().alias("kind"))
    nodes = t(spark, d, "part").select(text_key("p", "p_partkey").alias("node"), (F.col("p_size") > 40).alias("hidden"))
    number = lambda c: F.substr(c, F.lit(2)).cast("long").alias(c)
    return C.in_mode(edges, nodes, "data-flow").select(number("src"), number("dst"), "kind")


@query("SELECT p_partkey AS node, CASE p_size % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'rule' ELSE 'instance' END AS kind FROM part WHERE NOT (p_size > 45) AND p_size % 4 > 0 AND p_type <> 'PROMO'")
def nodes_shown(spark, d):
    size = F.col("p_size")
    nodes = t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(size % 4 == 0, "package").when(size % 4 == 1, "rule").otherwise("instance").alias("kind"), (size > 45).alias("hidden"), (F.col("p_type") == "PROMO").alias("primitive"))
    return C.shown(nodes, packages=False).select("node", "kind")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber, l_suppkey % 7) >= (2, 3) AND (l_linenumber, l_suppkey % 7) < (2 + l_partkey % 3, l_quantity) AS half_open, (l_linenumber, l_suppkey % 7) >= (2, 3) AND (l_linenumber, l_suppkey % 7) <= (2 + l_partkey % 3, l_quantity) AS closed, (l_partkey % 3) * 1000000 + CASE WHEN l_partkey % 3 = 0 THEN CAST(l_quantity AS BIGINT) - 3 ELSE CAST(l_quantity AS BIGINT) END AS weight FROM lineitem")
def points_in_ranges(spark, d):
    span = F.struct(F.lit(2).alias("line"), F.lit(3).alias("col"), (F.col("l_partkey") % 3 + 2).alias("end_line"), F.col("l_quantity").cast("long").alias("end_col"))
    at = (F.col("l_linenumber"), F.col("l_suppkey") % 7, span)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.in_range(*at).alias("half_open"), S.in_range(*at, inclusive_end=True).alias("closed"), S.range_weight(span).alias("weight"))


@query("SELECT l_partkey % 100 AS id, l_returnflag = 'R' AS negated, count(*) AS n FROM lineitem GROUP BY ALL")
def signed_conditions(spark, d):
    value = F.concat(F.when(F.col("l_returnflag") == "R", "!").otherwise(""), (F.col("l_partkey") % 100).cast("string"))
    x = t(spark, d, "lineitem").select(S.signed_condition(value).alias("x"))
    return x.groupBy(F.col("x.id").cast("long").alias("id"), F.col("x.negated").alias("negated")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size % 5 > 0 THEN 'offers' ELSE CASE p_size % 5 WHEN 0 THEN 'root' WHEN 1 THEN p_brand WHEN 2 THEN 'src' WHEN 3 THEN p_type ELSE 'core' END END AS grp FROM part")
def path_groups(spark, d):
    """Files without a folder, below src and below a second src, in src itself, and without src."""
    brand, kind, name = (F.col(c) for c in ("p_brand", "p_type", "p_name"))
    paths = [F.concat(name), F.concat(F.lit("hw/src/"), brand, F.lit("/"), kind, F.lit("/"), name), F.concat(kind, F.lit("/src/"), name), F.concat(F.lit("lib/"), brand, F.lit("/"), kind, F.lit("/"), name), F.concat(F.lit("src/a/src/core/"), kind, F.lit("/"), name)]
    path = F.concat(F.get(F.array(*paths), F.col("p_size") % 5), F.lit(".bsv"))
    return t(spark, d, "part").select("p_partkey", S.path_group(path, [("**/promo/*.bsv", "offers"), ("promo/**", "offers")]).alias("grp"))


@query("WITH x AS (SELECT ['BRAM_' || 'x', 'ROM#(' || p_brand || ')', 'Reg#(Bool)', 'Vector#(2, Reg#(a))', 'FIFOF #(a)', 'MyFifoCtl', 'PulseWire', ''][p_size % 8 + 1] AS type, ['mkThing', 'mkDReg', 'mkSizedFIFO', 'mkBypassWire', 'mkRegFileFull'][p_partkey % 5 + 1] AS constructor FROM part), k AS (SELECT *, CASE WHEN type LIKE 'ROM#%' OR constructor = 'mkRegFileFull' THEN 'memory' WHEN type = 'Reg#(Bool)' OR constructor = 'mkDReg' THEN 'register' WHEN type = 'FIFOF #(a)' OR constructor = 'mkSizedFIFO' THEN 'fifo' WHEN type = 'PulseWire' OR constructor = 'mkBypassWire' THEN 'wire' END AS kind FROM x) SELECT type, constructor, kind, count(*) AS n FROM k GROUP BY ALL")
def primitive_kinds(spark, d):
    type_ = F.get(F.array(F.lit("BRAM_x"), F.concat(F.lit("ROM#("), "p_brand", F.lit(")")), *map(F.lit, ["Reg#(Bool)", "Vector#(2, Reg#(a))", "FIFOF #(a)", "MyFifoCtl", "PulseWire", ""])), F.col("p_size") % 8)
    constructor = F.get(F.array(*map(F.lit, ["mkThing", "mkDReg", "mkSizedFIFO", "mkBypassWire", "mkRegFileFull"])), (F.col("p_partkey") % 5).cast("int"))
    rows = t(spark, d, "part").select(type_.alias("type"), constructor.alias("constructor"))
    return rows.withColumn("kind", S.primitive_kind(F.col("type"), F.col("constructor"))).groupBy("type", "constructor", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT ['Action', 'ActionValue#(' || p_brand || ')', 'ActionValue', 'Bool', '', 'action'][p_size % 6 + 1] AS returns, ['input', 'request-response', 'output', 'output', 'unknown', 'input'][p_size % 6 + 1] AS class FROM part) SELECT returns, class, count(*) AS n FROM x GROUP BY ALL")
def method_classes(spark, d):
    returns = F.get(F.array(F.lit("Action"), F.concat(F.lit("ActionValue#("), "p_brand", F.lit(")")), *map(F.lit, ["ActionValue", "Bool", "", "action"])), F.col("p_size") % 6)
    return t(spark, d, "part").select(returns.alias("returns"), S.method_class(returns).alias("class")).groupBy("returns", "class").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT p_brand AS module, 'r' || p_partkey AS a, 'r' || (p_partkey + 1) AS b, ['conflict', 'conflict-free', 'sequential-before', 'sequential-before-reverse', 'execution-order', 'conflict-free', 'sequential-before'][p_size % 7 + 1] AS kind FROM part) SELECT module, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN kind IN ('conflict', 'conflict-free') THEN '' ELSE a END AS first, kind FROM x")
def schedule_lines(spark, d):
    """Reports that Spark writes from the parts: a line for each, in every code, also those with hyphens and underscores."""
    rule = lambda k: F.concat(F.lit("r"), (F.col("p_partkey") + k).cast("string"))
    code = F.get(F.array(*map(F.lit, [" C ", " CONFLICT-FREE ", ": SEQUENTIAL-BEFORE ", " SEQUENTIAL_BEFORE_REVERSE ", ": EXECUTION-ORDER ", " CONFLICT_FREE ", " SB "])), F.col("p_size") % 7)
    lines = t(spark, d, "part").groupBy("p_brand", F.expr("p_partkey div 1000").alias("nth")).agg(F.concat_ws("\n", F.collect_list(F.concat(rule(0), code, rule(1)))).alias("lines"))
    reports = lines.select(F.concat_ws("/", "p_brand", "nth").alias("report"), F.concat(F.lit("=== Generated schedule for "), "p_brand", F.lit(" ===\n"), "lines").alias("value"))
    found = schedules.relations(reports)
    return found.select("module", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.when(F.col("bidirectional"), "").otherwise(F.col("src")).alias("first"), "kind")


@query(r"SELECT conv_id, turn, CASE WHEN length(s) > 40 THEN left(s, 39) || '…' ELSE s END AS short FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations)")
def shortened_turns(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", S.shortened(S.squeezed(F.col("text")), 40).alias("short"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, '.', ';'), ';')[:-2], lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM conversations")
def statement_parts(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.statements(F.translate("text", ".", ";")), "|").alias("parts"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 3 AS n, l_partkey || '|g(' || l_suppkey || ', [' || l_linenumber || ', 1])|x' AS parts FROM lineitem")
def argument_lists(spark, d):
    s = lambda c: F.col(c).cast("string")
    found = X.arguments(F.concat(s("l_partkey"), F.lit(", g("), s("l_suppkey"), F.lit(", ["), s("l_linenumber"), F.lit(", 1]), x")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(found).alias("n"), F.array_join(found, "|").alias("parts"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'mismatch' ELSE 'unresolved' END AS status FROM part")
def type_agreements(spark, d):
    """Types that are equal but for blanks, that differ, that have a variable, that are one, and that are not there."""
    n = F.col("p_size") % 5
    actual = F.when(n == 0, "Bit# (8)").when(n == 1, "Bit# (9)").when(n == 2, "Bit# (n)").when(n == 3, "t")
    return t(spark, d, "part").select("p_partkey", V.type_agreement(F.lit("Bit#   (8)"), actual).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'parameterized' WHEN p_size % 7 = 0 THEN 'unresolved' ELSE 'exact' END AS status, CASE WHEN p_size % 3 > 0 AND p_size % 7 > 0 THEN CAST(p_size * 4 AS BIGINT) END AS n FROM part")
def multiplicities(spark, d):
    size = F.col("p_size")
    dims = F.when(size % 3 == 0, F.array(F.lit("n"), F.lit("4"))).when(size % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(size.cast("string"), F.lit("4")))
    m = S.multiplicity(dims)
    return t(spark, d, "part").select("p_partkey", m["status"].alias("status"), m["count"].alias("n"))


@query("WITH m AS (SELECT o_custkey, l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT 'o' || l_orderkey AS name, CAST(sum(q) AS BIGINT) AS bits, 'exact' AS status FROM m GROUP BY l_orderkey UNION ALL SELECT 'c' || o_custkey, CAST(sum(q) AS BIGINT), 'exact' FROM m GROUP BY o_custkey")
def type_widths(spark, d):
    """Orders as types of their lines' widths, customers as types of their orders."""
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = written(lines.select("l_orderkey", "o_custkey", "l_quantity"), scratch(spark))
    width = F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))
    members = lines.select(text_key("o", "l_orderkey").alias("owner"), width.alias("member_type"))
    members = members.union(lines.select(text_key("c", "o_custkey"), text_key("o", "l_orderkey")).distinct())
    basic = lines.select(width.alias("name"), F.col("l_quantity").cast("int").alias("bits")).distinct()
    return X.type_width(members, basic)


@query("WITH s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT DISTINCT c_custkey AS owner, 's' || s_suppkey AS path, 'exact' AS status FROM customer JOIN s ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'region.name', 'exact' FROM customer UNION ALL SELECT c_custkey, 'region.self', 'cycle-cut' FROM customer")
def interface_endpoints(spark, d):
    """Customers have their nation's interface: its suppliers, and within it the region's, which holds itself."""
    nations = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    none = F.lit(None).cast("string")
    regions = nations.select(text_key("r", "n_regionkey").alias("interface")).distinct()
    members = t(spark, d, "supplier").select(text_key("n", "s_nationkey").alias("interface"), text_key("s", "s_suppkey").alias("name"), none.alias("nested"))
    members = members.union(nations.select(text_key("n", "n_nationkey"), F.lit("region"), text_key("r", "n_regionkey")))
    members = members.union(regions.select("interface", F.lit("name"), none)).union(regions.select("interface", F.lit("self"), "interface"))
    return M.endpoints(t(spark, d, "customer").select(F.col("c_custkey").alias("owner"), text_key("n", "c_nationkey").alias("interface")), members)


@query("SELECT l_orderkey AS behaviour, l_suppkey AS instance, l_returnflag AS member, CASE WHEN s_suppkey IS NOT NULL AND n_regionkey < 3 AND l_returnflag <> 'N' THEN s_name || ':' || l_returnflag END AS endpoint, CASE WHEN s_suppkey IS NULL THEN 'unresolved' WHEN n_regionkey < 3 AND l_returnflag <> 'N' THEN 'exact' ELSE 'unsupported' END AS status FROM lineitem LEFT JOIN (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def access_bindings(spark, d):
    accesses = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("behaviour"), F.lit("top").alias("owner"), F.col("l_suppkey").alias("instance"), F.col("l_returnflag").alias("member"))
    instances = t(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("top").alias("owner"), F.col("s_suppkey").alias("name"), F.col("s_name").alias("child"), F.col("s_nationkey").alias("target"))
    provided = t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("owner"), F.explode(F.array(F.lit("R"), F.lit("A"))).alias("path"))
    return M.bindings(accesses, instances, provided).drop("owner")


@query("SELECT DISTINCT l_orderkey AS behaviour, l_suppkey AS instance, 'read' AS operation FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey = l.l_suppkey AND x.l_returnflag = 'R')")
def synthesised_accesses(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("behaviour"), F.col("l_suppkey").alias("instance"), "l_returnflag")
    return M.synthesised(lines.where("l_returnflag = 'R'"), lines.select("behaviour", "instance", F.lit("read").alias("operation")).distinct())


@query("WITH f AS (SELECT o_orderkey AS child, unnest([1, 2, 3]) AS position FROM orders), a AS (SELECT l_orderkey AS child, l_linenumber AS position, l_partkey AS actual FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS child, l_partkey AS actual, l_suppkey AS target FROM lineitem WHERE l_returnflag = 'N') SELECT child, position, f.position AS formal, actual, target, CASE WHEN f.child IS NULL OR actual IS NULL THEN 'arity-mismatch' WHEN target IS NULL THEN 'unresolved' ELSE 'exact' END AS status FROM f FULL JOIN a USING (child, position) LEFT JOIN s USING (child, actual)")
def constructor_arguments(spark, d):
    lines = t(spark, d, "lineitem")
    formals = t(spark, d, "orders").select(F.col("o_orderkey").alias("child"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("position")).withColumn("formal", F.col("position"))
    actuals = lines.select(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("actual"))
    siblings = lines.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("child"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("instance")).distinct()
    return M.constructor_arguments(formals, actuals, siblings)


@query("WITH p AS (SELECT l_orderkey AS b, l_suppkey % 5 AS alias, l_partkey AS e, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 5) AS n FROM lineitem WHERE l_returnflag = 'R') SELECT DISTINCT e AS src, l_partkey AS dst, 'payload' AS kind, b AS behaviour FROM p JOIN lineitem ON l_orderkey = b AND l_suppkey % 5 = alias AND l_returnflag = 'N' WHERE n = 1")
def payload_flows(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("behaviour"), (F.col("l_suppkey") % 5).alias("alias"), F.col("l_partkey").alias("endpoint"), "l_returnflag")
    return M.payload_flows(lines.where("l_returnflag = 'R'").drop("l_returnflag"), lines.where("l_returnflag = 'N'").withColumnRenamed("alias", "argument"))[0]


@query("SELECT src, dst, kind, 'flow:' || kind || ':' || src || ':' || dst AS id FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'payload' ELSE 'control' END AS kind FROM lineitem)")
def flow_union(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")
    return M.flows({"payload": lines.where("l_returnflag = 'R'"), "control": lines.where("l_returnflag <> 'R'")})


@query("WITH m AS (SELECT p_brand AS owner, p_partkey AS method, ['input', 'output', 'request-response'][p_size % 3 + 1] AS category, p_type AS returns, [p_name, p_type] AS ps FROM part) SELECT owner, method, 'parameter' AS role, CAST(k - 1 AS INT) AS position, ps[k] AS type, 'in' AS direction FROM (SELECT *, unnest([1, 2]) AS k FROM m) UNION ALL SELECT owner, method, 'result', NULL, returns, 'out' FROM m WHERE category <> 'input' UNION ALL SELECT owner, method, 'control', NULL, NULL, 'in' FROM m WHERE category <> 'output'")
def boundary_legs(spark, d):
    category = F.get(F.array(F.lit("input"), F.lit("output"), F.lit("request-response")), F.col("p_size") % 3)
    return M.legs(t(spark, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("method"), category.alias("category"), F.col("p_type").alias("returns"), F.array("p_name", "p_type").alias("parameters")))


@query("WITH b AS (SELECT p_brand || p_size AS owner, p_name || p_partkey AS method, split_part(p_name, ' ', 1) AS w, count(*) OVER (PARTITION BY p_brand || p_size) AS n FROM part) SELECT owner, method, CASE WHEN n <= 4 THEN method WHEN method LIKE 'red %' OR method LIKE 'small %' THEN w ELSE method END AS shown FROM b")
def folded_boundary(spark, d):
    boundary = t(spark, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("owner"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("method"))
    groups = boundary.select("owner").distinct().withColumn("prefix", F.explode(F.array(*map(F.lit, ("red", "small", "r")))))
    return M.folded(boundary, groups.where("prefix <> 'r'"))


@query("WITH RECURSIVE c AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS premise FROM orders), top AS (SELECT max(id) AS id FROM c), r(node, depth) AS (SELECT id, 0 FROM top UNION SELECT premise, depth + 1 FROM r JOIN c ON r.node = c.id WHERE premise IS NOT NULL) SELECT node, depth FROM r")
def claim_premises(spark, d):
    """All that the newest claim rests on, where each order rests on its customer's order before."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    claims = R.adjacent_pairs(orders, ["o_custkey"], ["o_orderkey"], "o_orderkey").select(F.col("following").alias("id"), F.col("o_orderkey").alias("premise"))
    claims = claims.union(orders.select("o_orderkey", F.lit(None).cast("long")))
    newest = orders.agg(F.max("o_orderkey")).first()[0]
    return M.premises(claims, F.lit(newest)).select("node", "depth")


@query("WITH need(kind, premise_kind) AS (VALUES ('1-URGENT', 'R'), ('1-URGENT', 'A'), ('2-HIGH', 'N')), c AS (SELECT DISTINCT o_orderkey AS id, o_orderpriority AS kind, l_returnflag AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT id, kind, premise_kind FROM (SELECT DISTINCT id, kind FROM c) JOIN need USING (kind) WHERE (id, premise_kind) NOT IN (SELECT (id, p) FROM c)")
def claims_not_valid(spark, d):
    claims = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("l_returnflag").alias("premise_kind")).distinct()
    return M.invalid_claims(claims, spark.createDataFrame([("1-URGENT", "R"), ("1-URGENT", "A"), ("2-HIGH", "N")], "kind string, premise_kind string")).select("id", "kind", "premise_kind")


@query("SELECT l_orderkey AS id, l_suppkey AS occurrence, CASE WHEN (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = 7) > 1 THEN 'ambiguous' ELSE 'exact' END AS status FROM lineitem WHERE l_partkey = 7")
def claims_at_part(spark, d):
    claims = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("occurrence"), "l_partkey")
    return M.claims_at(claims, "l_partkey", 7).select("id", "occurrence", "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 3 AND l_returnflag IN ('R', 'A')")
def callers_of(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber")
    return G.one_hop(edges, F.lit(3), "in", ("R", "A")).select("l_orderkey", "l_linenumber", F.col("src").alias("l_partkey"))


def places(spark, d):
    rows = t(spark, d, "nation").select(text_key("r", "n_regionkey").alias("parent"), text_key("n", "n_nationkey").alias("node"))
    rows = rows.union(t(spark, d, "customer").select(text_key("n", "c_nationkey"), text_key("c", "c_custkey"))).withColumn("name", F.col("node"))
    return G.expand(rows, t(spark, d, "region").select(text_key("r", "r_regionkey").alias("node")))


@query("WITH a AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT 'r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_nationkey % 2 = 0 THEN 'nation' ELSE 'region' END AS value, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_nationkey % 2 = 0 THEN 1 ELSE 2 END AS distance FROM a UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'nation' ELSE 'region' END, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', 0 FROM region")
def nearest_attribute(spark, d):
    held = t(spark, d, "region").select(text_key("r", "r_regionkey").alias("node"), F.lit("region").alias("value"))
    held = held.union(t(spark, d, "nation").where("n_nationkey % 2 = 0").select(text_key("n", "n_nationkey"), F.lit("nation")))
    held = held.union(t(spark, d, "customer").where("c_custkey % 3 = 0").select(text_key("c", "c_custkey"), F.lit("own")))
    return G.nearest_with(places(spark, d), held)


@query("SELECT 'n' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'r2', 0")
def inside_scope(spark, d):
    return G.inside(places(spark, d), "r2").select("node", "depth")


@query("WITH e AS (SELECT DISTINCT 'n' || c_nationkey AS a, 'c' || c_custkey AS b FROM customer), k AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 1), one AS (SELECT DISTINCT b AS node FROM e JOIN k ON a = node) SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM k UNION ALL SELECT node, 2 FROM one")
def focus_on_children(spark, d):
    """A region has no edges of its own, so its neighbourhood is that of its nations, with a hop less."""
    edges = t(spark, d, "customer").select(text_key("n", "c_nationkey").alias("src"), text_key("c", "c_custkey").alias("dst"))
    children = t(spark, d, "nation").select(text_key("r", "n_regionkey").alias("parent"), text_key("n", "n_nationkey").alias("node"))
    return G.focus_neighborhood(edges, spark.createDataFrame([("r1",)], "node string"), children, 2)


@query(r"WITH f AS (SELECT url || '#' || page_id AS path, strlen(html) AS bytes FROM pages), g AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS folder, CASE WHEN path LIKE '%/es/%' THEN 'excluded' WHEN bytes > 3000 THEN 'too-large' END AS reason FROM f), n AS (SELECT path, row_number() OVER (ORDER BY folder, path) AS k, sum(bytes) OVER (ORDER BY folder, path) AS b FROM g WHERE reason IS NULL) SELECT path, bytes, coalesce(reason, CASE WHEN k > 60 THEN 'file-limit' WHEN b > 90000 THEN 'byte-limit' END) AS reason FROM g LEFT JOIN n USING (path)")
def files_with_reasons(spark, d):
    """Why a page would not be taken as a source file; the limits are the feature."""
    listed = t(spark, d, "pages").select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("path"), F.octet_length("html").cast("long").alias("bytes"))
    return files.classify(listed, ("**/es/**",), 60, 3000, 90_000)


@query("SELECT p_partkey AS path, p_name AS revision, CASE WHEN p_partkey % 5 = 0 THEN 'unavailable' WHEN p_partkey % 5 = 1 THEN 'stale' ELSE 'current' END AS state FROM part")
def manifest_freshness(spark, d):
    manifest = t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("revision"))
    now = manifest.where("path % 5 > 0").withColumn("revision", F.when(F.col("path") % 5 == 1, "new").otherwise(F.col("revision")))
    return files.freshness(manifest, now)


@query("WITH a AS (SELECT c_acctbal AS revision, count(*) AS n, min(c_custkey) AS p FROM customer GROUP BY 1), b AS (SELECT CAST(floor(o_totalprice) % 10000 AS DOUBLE) AS revision, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY 1), c AS (SELECT floor(revision) AS revision, sum(n) AS n, min(p) AS p FROM a GROUP BY 1) SELECT revision, CASE WHEN c.n = 1 AND b.n = 1 THEN c.p END AS left_path, CASE WHEN c.n = 1 AND b.n = 1 THEN b.p END AS right_path, CASE WHEN c.n = 1 AND b.n = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM c JOIN b USING (revision)")
def bound_by_content(spark, d):
    left = t(spark, d, "customer").select(F.floor("c_acctbal").cast("double").alias("revision"), F.col("c_custkey").alias("path"))
    right = t(spark, d, "orders").select((F.floor("o_totalprice") % 10000).cast("double").alias("revision"), F.col("o_orderkey").alias("path"))
    return files.bound_by_content(left, right)


@query("SELECT o_orderkey AS path, o_orderpriority AS revision FROM orders WHERE NOT (o_orderstatus = 'F') AND o_orderkey % 4 > 0")
def unseen_documents(spark, d):
    docs = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("revision"), "o_orderstatus")
    return files.unseen(docs, docs.where("o_orderstatus = 'F' or path % 4 = 0")).select("path", "revision")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_wins(spark, d):
    return incremental.latest(t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("SELECT c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'stale' ELSE 'current' END AS state FROM customer")
def rows_with_freshness(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("revision"))
    manifest = rows.where("path % 4 > 0").withColumn("revision", F.when(F.col("path") % 4 == 1, "old").otherwise(F.col("revision")))
    return incremental.with_freshness(rows, manifest).select("path", "state")


@query("SELECT DISTINCT user_id AS path, event_type AS revision FROM events")
def changed_sources(spark, d):
    return incremental.changed(t(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("revision"), F.col("ts").alias("at"))).select("path", "revision")


@query("WITH x AS (SELECT count(*) AS n FROM part) SELECT p_partkey, n AS total, greatest(n - 25, 0) AS omitted, n > 25 AS truncated FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25), x")
def limited_report(spark, d):
    """A top-k report that says how much it leaves out."""
    top, told = R.limited(t(spark, d, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], 25)
    total = told.first()
    return top.select("p_partkey", *(F.lit(total[c]).cast(k).alias(c) for c, k in (("total", "long"), ("omitted", "long"), ("truncated", "boolean"))))


@query("WITH v AS (SELECT l_orderkey AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS index, l_partkey AS bit FROM lineitem), w AS (SELECT entity, entity % 3 AS k, index, index AS position FROM v WHERE entity % 3 = 0 UNION ALL SELECT o_orderkey, 1, unnest([1, 0, 1]), unnest([0, 1, 2]) FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 2, unnest([1, 2]), unnest([0, 1]) FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT o_orderkey, 0, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) SELECT entity, CAST(position AS INT) AS position, CAST(index AS INT) AS index, bit, CASE WHEN bit IS NULL THEN 'invalid' ELSE 'exact' END AS status FROM w LEFT JOIN v USING (entity, index)")
def seed_positions(spark, d):
    """Orders as vectors of their lines: taken whole, by indices with repeats, or by a slice."""
    nth = R.ordinals(None, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    vectors = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), nth.cast("int").alias("index"), F.col("l_partkey").alias("bit"))
    k = F.col("o_orderkey") % 3
    seeds = t(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.when(k == 1, F.array(*map(F.lit, (1, 0, 1)))).alias("indices"), F.when(k == 2, 1).alias("first"), F.when(k == 2, 3).alias("last"))
    return C.seed_positions(vectors, seeds)


@query("WITH f AS (SELECT p_partkey AS function, p_name AS name, p_brand AS package, p_size % 3 AS takes, p_type = 'PROMO' AS dispatched, CASE WHEN p_size % 2 = 0 THEN p_type END AS owner FROM part), c AS (SELECT p_partkey AS call, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Brand#11' END AS package, p_type AS owner, p_size % 3 AS n_arguments FROM part), m AS (SELECT call, n_arguments, f.* FROM c LEFT JOIN f ON c.name = f.name AND ((c.package = f.package AND (f.owner IS NULL OR f.owner = c.owner)) OR (c.package <> f.package AND f.owner IS NULL AND c.package = 'Brand#11' AND f.package IN ('Brand#12', 'Brand#13'))) ), g AS (SELECT call, any_value(n_arguments) AS a, count(function) AS n, min(function) AS target, min(takes) AS takes, coalesce(bool_or(dispatched), false) AS d FROM m GROUP BY call) SELECT call, n, CASE WHEN n = 1 AND NOT d AND takes = a THEN target END AS target, CASE WHEN n = 1 AND NOT d AND takes = a THEN 'exact' ELSE 'unresolved' END AS status, CASE WHEN d THEN 'dispatched' WHEN n = 0 THEN 'no-candidate' WHEN n > 1 THEN 'several' WHEN takes <> a THEN 'arity' END AS reason FROM g")
def resolved_calls(spark, d):
    """Parts as functions and as calls: brands are packages, types their owners."""
    part, size = t(spark, d, "part"), F.col("p_size")
    functions = part.select(F.col("p_partkey").alias("function"), F.col("p_name").alias("name"), F.col("p_brand").alias("package"), (size % 3).alias("n_parameters"), (F.col("p_type") == "PROMO").alias("dispatched"), F.when(size % 2 == 0, F.col("p_type")).alias("owner"))
    calls = part.select(F.col("p_partkey").alias("call"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("Brand#11").alias("package"), F.col("p_type").alias("owner"), (size % 3).alias("n_arguments"))
    return C.resolved_calls(calls, functions, spark.createDataFrame([("Brand#11", "Brand#12"), ("Brand#11", "Brand#13")], "package string, imported string"))


@query("WITH l AS (SELECT 'o' || l_orderkey AS o, max(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 2 WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1), c AS (SELECT 'c' || o_custkey AS c, max(coalesce(r, 0)) AS r FROM orders LEFT JOIN l ON o = 'o' || o_orderkey GROUP BY 1), x AS (SELECT 'o' || o_orderkey AS node, coalesce(r, 0) AS r FROM orders LEFT JOIN l ON o = 'o' || o_orderkey UNION ALL SELECT c, r FROM c) SELECT node, CASE r WHEN 2 THEN 'unsupported' WHEN 1 THEN 'unresolved' ELSE 'exact' END AS status FROM x")
def settled_statuses(spark, d):
    """Statuses of lines go up to orders and customers."""
    lines = t(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("node"), text_key("o", "l_orderkey").alias("up"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "unsupported").when(F.col("l_quantity") > 40, "unresolved").otherwise("exact").alias("status"))
    orders = t(spark, d, "orders").select(text_key("o", "o_orderkey").alias("node"), text_key("c", "o_custkey").alias("up"))
    nodes = lines.groupBy("node").agg(F.max("status").alias("status")).union(orders.select("node", F.lit("exact"))).union(orders.select("up", F.lit("exact")).distinct())
    operands = lines.select(F.col("up").alias("node"), F.col("node").alias("operand")).union(orders.select("up", "node"))
    return C.settled(nodes, operands).where("node not like '%/%'")


@query("WITH b AS (SELECT l_suppkey AS owner, l_partkey AS definition, count(*) AS n, min(l_orderkey) AS behaviour FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT e.owner || ':' || e.definition AS endpoint, CASE WHEN n = 1 THEN behaviour END AS behaviour, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM (SELECT DISTINCT l_suppkey AS owner, l_partkey AS definition FROM lineitem) e LEFT JOIN b USING (owner, definition)")
def endpoint_implementations(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("definition"), F.col("l_orderkey").alias("behaviour"), "l_returnflag")
    endpoints = lines.select("owner", "definition").distinct().withColumn("endpoint", F.concat_ws(":", "owner", "definition"))
    return C.implementations(endpoints, lines.where("l_returnflag = 'R'"))


@query("WITH b AS (SELECT c_custkey AS instance, o_orderpriority AS name, count(*) AS n, min(o_orderkey) AS behaviour FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT x.instance, 'before' AS kind, x.behaviour AS src, y.behaviour AS dst FROM customer JOIN b x ON x.instance = c_custkey AND x.name = '1-URGENT' AND x.n = 1 JOIN b y ON y.instance = c_custkey AND y.name = CASE c_mktsegment WHEN 'BUILDING' THEN '2-HIGH' ELSE '5-LOW' END AND y.n = 1")
def relations_at_instances(spark, d):
    """Relations of market segments, as definitions, at each of their customers."""
    customer = t(spark, d, "customer")
    relations = customer.select(F.col("c_mktsegment").alias("module")).distinct().select("module", F.lit("1-URGENT").alias("src"), F.when(F.col("module") == "BUILDING", "2-HIGH").otherwise("5-LOW").alias("dst"), F.lit("before").alias("kind"))
    behaviours = t(spark, d, "orders").select(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("behaviour"))
    return C.at_instances(relations, customer.select(F.col("c_custkey").alias("instance"), F.col("c_mktsegment").alias("module")), behaviours)


@query("WITH x AS (SELECT o_custkey AS customer, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus NOT IN ('F', 'O')) AS p, count(*) AS n FROM orders GROUP BY 1) SELECT customer, CASE WHEN (f AND (o OR p)) OR (o AND p) THEN 'mixed' WHEN f THEN 'compiler' WHEN p THEN 'heuristic' ELSE 'source' END AS badge, n, f AS authoritative FROM x")
def schedule_badges(spark, d):
    origin = F.when(F.col("o_orderstatus") == "F", "compiler").when(F.col("o_orderstatus") == "O", "attribute").otherwise("heuristic")
    return C.schedule_badge(t(spark, d, "orders").select(F.col("o_custkey").alias("customer"), origin.alias("origin")), ["customer"])


@query("SELECT p_brand AS category, count(*) AS total, count(*) FILTER (p_size > 20) AS resolved, count(*) FILTER (NOT p_size > 20) AS unmapped, CAST(CAST(sum(CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS fingerprint FROM part GROUP BY 1")
def coverage_populations(spark, d):
    part = t(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("id"), "p_size")
    return C.coverage(part, part.where("p_size > 20"))
