"""Queries of paths, budgets, views and spans over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import scalars as S
from tracelake.functions import spans
from tracelake.operators import graph as G
from tracelake.operators import paths as P
from tracelake.operators import relations as R
from tracelake.operators import semantic as M
from tracelake.operators import views
from tracelake.operators.checkpoints import scratch, written
from tracelake.plans.model import KINDS, MODES_SQL
from tracelake.plans.relational import SUPPLY_SQL, supply_edges, t, text_key
from tracelake.sources import config

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


# ---- paths: from orders over their parts to suppliers, every line an edge of its own

FLOWS_SQL = "o AS (SELECT 'o' || l_orderkey AS src, 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS dst, 'o' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '.' || l_suppkey || '.' || l_quantity AS id FROM lineitem), s AS (SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS src, 's' || l_suppkey AS dst, 's' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '.' || l_linenumber || '.' || l_quantity AS id FROM lineitem)"
PAIRS_SQL = "first AS (SELECT c_nationkey, min(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), near AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1), pairs AS (SELECT 'o' || first.k AS origin, 's' || near.k AS goal FROM first, near)"


def flows(spark, d) -> DataFrame:
    """src, dst, id: an order leads to the part of each of its lines, a part to the supplier of each of its lines."""
    lines = t(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    part = F.concat(F.lit("p"), F.lpad(s("l_partkey"), 9, "0"))
    out = lines.select(text_key("o", "l_orderkey"), part, F.concat(F.lit("o"), F.lpad(s("l_linenumber"), 3, "0"), F.lit("."), s("l_suppkey"), F.lit("."), s("l_quantity")))
    into = lines.select(part, text_key("s", "l_suppkey"), F.concat(F.lit("s"), F.lpad(s("l_orderkey"), 9, "0"), F.lit("."), s("l_linenumber"), F.lit("."), s("l_quantity")))
    return out.union(into).toDF("src", "dst", "id")


def ends(spark, d) -> DataFrame:
    """origin, goal: the first order of every nation with the first supplier of every nation."""
    first = t(spark, d, "orders").join(t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").groupBy("c_nationkey").agg(F.min("o_orderkey").alias("k")).select(text_key("o", "k").alias("origin"))
    near = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(text_key("s", "k").alias("goal"))
    return first.join(near, F.lit(True))  # a row for each two nations


@query(f"WITH {FLOWS_SQL}, {PAIRS_SQL}, n AS (SELECT o.src AS origin, s.dst AS goal, count(*) AS n FROM o JOIN s ON o.dst = s.src GROUP BY 1, 2) SELECT origin, goal, CASE WHEN n IS NULL THEN 'no-path' ELSE 'exact' END AS status, CASE WHEN n IS NOT NULL THEN 2 END AS depth, n AS n_paths FROM pairs LEFT JOIN n USING (origin, goal)")
def trace_between(spark, d):
    """All pairs of the nations' first orders and first suppliers in one search."""
    return P.between(flows(spark, d), ends(spark, d)).status.withColumn("n_paths", F.col("n_paths").cast("long"))


@query(f"WITH {FLOWS_SQL}, {PAIRS_SQL}, p AS (SELECT o.src AS origin, s.dst AS goal, o.src || '>' || o.dst || '>' || s.dst AS nodes, o.id || '>' || s.id AS edges, row_number() OVER (PARTITION BY o.src, s.dst ORDER BY o.dst, o.id, s.id) AS nth FROM o JOIN s ON o.dst = s.src) SELECT origin, goal, nth, nodes, edges FROM pairs JOIN p USING (origin, goal) WHERE nth <= 3")
def trace_paths(spark, d):
    """The first three paths of each of these pairs."""
    found = P.between(flows(spark, d), ends(spark, d), max_paths=3).paths
    return found.withColumns({"nodes": F.array_join("nodes", ">"), "edges": F.array_join("edges", ">")})


@query(f"WITH {FLOWS_SQL}, c AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS e FROM orders WHERE o_orderpriority = '1-URGENT'), n AS (SELECT 'n' || s_nationkey AS b, 's' || s_suppkey AS e FROM supplier), who AS (SELECT 'c' || min(c_custkey) AS a FROM customer GROUP BY c_nationkey), m AS (SELECT a, b, count(*) AS n FROM c JOIN who USING (a) JOIN o ON o.src = c.e JOIN s ON o.dst = s.src JOIN n ON n.e = s.dst GROUP BY 1, 2) SELECT who.a AS origin, x.b AS goal, CASE WHEN n IS NULL THEN 'no-path' ELSE 'exact' END AS status, CASE WHEN n IS NOT NULL THEN 2 END AS depth, n AS n_paths FROM who CROSS JOIN (SELECT DISTINCT b FROM n) AS x LEFT JOIN m ON m.a = who.a AND m.b = x.b")
def trace_instances(spark, d):
    """A customer's urgent orders and a nation's suppliers are their endpoints: traces between the first customer of each nation and every nation that supplies."""
    orders = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(text_key("c", "o_custkey").alias("instance"), text_key("o", "o_orderkey").alias("endpoint"))
    suppliers = t(spark, d, "supplier").select(text_key("n", "s_nationkey").alias("instance"), text_key("s", "s_suppkey").alias("endpoint"))
    who = t(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(text_key("c", "k").alias("origin"))
    pairs = who.join(suppliers.select(F.col("instance").alias("goal")).distinct(), F.lit(True))
    return P.between_instances(flows(spark, d), orders.union(suppliers), pairs).status.withColumn("n_paths", F.col("n_paths").cast("long"))


# ---- budgets and roots

@query(f"WITH {SUPPLY_SQL}, c AS (SELECT 'c' || o_custkey AS node, count(*) AS orders, CAST(sum(o_totalprice) AS BIGINT) AS price FROM orders GROUP BY 1), lvl AS (SELECT dst AS node, coalesce(orders, 0) AS orders FROM e LEFT JOIN c ON c.node = dst WHERE src = 'n3'), run AS (SELECT node, sum(orders) OVER (ORDER BY node) AS so_far FROM lvl), lim AS (SELECT sum(orders) // 2 AS top FROM lvl), cut AS (SELECT min(node) AS node FROM run, lim WHERE so_far > top) SELECT 'n3' AS node, 0 AS depth, true AS taken, 'orders' AS reason UNION ALL SELECT run.node, 1, run.node < cut.node, CASE WHEN run.node >= cut.node OR run.node IN (SELECT src FROM e) THEN 'orders' END FROM run, cut")
def budget_frontier(spark, d):
    """A nation's cone that may cost half of its customers' orders: the level in which they are used up is taken in part."""
    edges = supply_edges(spark, d)
    costs = t(spark, d, "orders").groupBy(text_key("c", "o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").cast("long").alias("price"))
    half = edges.where("src = 'n3'").select(F.col("dst").alias("node")).join(costs, "node").agg(F.sum("orders")).first()[0] // 2
    return G.within_budgets(edges, spark.createDataFrame([("n3",)], "node string"), costs, {"orders": half, "price": 1 << 62})


@query(
    "WITH RECURSIVE h(parent, node) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), r AS (SELECT 'r' || r_regionkey AS node FROM region), k AS (SELECT parent, node, row_number() OVER (PARTITION BY parent ORDER BY node) AS nth FROM h), few AS (SELECT * FROM k WHERE nth <= 4), more AS (SELECT parent, count(*) AS omitted FROM k WHERE nth > 4 GROUP BY 1), x(node, path, depth) AS (SELECT node, node, 0 FROM r UNION ALL SELECT few.node, path || '/' || few.node, depth + 1 FROM x JOIN few ON few.parent = x.node), n AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS pl FROM x), kept AS (SELECT * FROM n WHERE pl <= 60), lost AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS omitted FROM n WHERE pl > 60 GROUP BY 1) SELECT node, path, depth, 'expanded' AS status, CAST(NULL AS BIGINT) AS omitted FROM kept UNION ALL SELECT node, path, depth, 'breadth-cut', omitted FROM x JOIN more ON x.node = more.parent WHERE depth < (SELECT max(depth) FROM kept) UNION ALL SELECT node, x.path, depth, 'budget', omitted FROM x JOIN lost ON lost.path = x.path"
)
def hierarchy_budget(spark, d):
    """The features are the limits: four children of each parent and sixty occurrences, and what they leave out."""
    below = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey")]
    rows = [t(spark, d, name).select(text_key(p, parent).alias("parent"), text_key(c, child).alias("node")) for name, p, parent, c, child in below]
    children = rows[0].union(rows[1]).withColumn("name", F.col("node"))
    return G.expand(children, t(spark, d, "region").select(text_key("r", "r_regionkey").alias("node")), max_breadth=4, budget=60).select("node", "path", "depth", "status", "omitted")


TURNS_SQL = "e AS (SELECT DISTINCT o_custkey % 500 AS src, lead(o_custkey % 500) OVER (PARTITION BY o_custkey % 500 // 4 ORDER BY o_orderkey) AS dst FROM orders)"


@query(f"WITH RECURSIVE {TURNS_SQL}, g AS (SELECT src, dst FROM e WHERE dst IS NOT NULL), n AS (SELECT DISTINCT src AS node FROM e), r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src), cyc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS top FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), c AS (SELECT n.node, coalesce(top, n.node) AS top, top IS NOT NULL AS cyclic FROM n LEFT JOIN cyc USING (node)), entered AS (SELECT DISTINCT y.top FROM g JOIN c x ON x.node = g.src JOIN c y ON y.node = g.dst WHERE x.top <> y.top) SELECT node, CASE WHEN cyclic THEN 'cycle-fallback' ELSE 'uninstantiated' END AS reason FROM c WHERE node = top AND top NOT IN (SELECT top FROM entered)")
def component_roots(spark, d):
    """Groups of customers that follow each other's orders: one root for each component that nothing leads into."""
    key = F.col("o_custkey") % 500
    turns = t(spark, d, "orders").select(key.alias("node"), F.expr("o_custkey % 500 div 4").alias("grp"), "o_orderkey")
    following = R.adjacent_pairs(turns, ["grp"], ["o_orderkey"], "node")
    return G.component_roots(turns.select("node"), following.select(F.col("node").alias("src"), F.col("following").alias("dst")))


# ---- views

@query("WITH c AS (SELECT 'c' || c_custkey AS node, CASE WHEN n_nationkey % 2 = 1 THEN 'n' || n_nationkey WHEN n_regionkey <> 2 THEN 'r' || n_regionkey END AS stands FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT s_suppkey, CASE WHEN n_nationkey % 2 = 1 THEN 'n' || n_nationkey WHEN n_regionkey <> 2 THEN 'r' || n_regionkey END AS stands FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s.stands AS src, c.stands AS dst, l_returnflag AS kind, count(*) AS n, min(l_orderkey) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON c.node = 'c' || o_custkey JOIN s ON s_suppkey = l_suppkey WHERE s.stands <> c.stands GROUP BY ALL")
def lifted_edges(spark, d):
    """Deliveries from suppliers to customers between what is shown: odd nations, and regions but one."""
    nation = t(spark, d, "nation")
    up = [
        t(spark, d, "customer").select(text_key("c", "c_custkey"), text_key("n", "c_nationkey")), t(spark, d, "supplier").select(text_key("s", "s_suppkey"), text_key("n", "s_nationkey")),
        nation.select(text_key("n", "n_nationkey"), text_key("r", "n_regionkey")), t(spark, d, "region").select(text_key("r", "r_regionkey"), F.lit(None).cast("string")),
    ]
    parents = reduce(DataFrame.union, up).toDF("node", "parent")
    shown = nation.where("n_nationkey % 2 = 1").select(text_key("n", "n_nationkey").alias("node")).union(t(spark, d, "region").where("r_regionkey <> 2").select(text_key("r", "r_regionkey")))
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    edges = lines.select(text_key("s", "l_suppkey").alias("src"), text_key("c", "o_custkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("id"))
    return views.lifted(edges, parents, shown)


VIEW_SQL = f"""m AS (SELECT row_number() OVER () - 1 AS k, kind, mode FROM {MODES_SQL} AS v(kind, mode)),
n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, 'package' AS kind, 'r' || r_regionkey AS path, false AS hidden FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'module', 'r' || n_regionkey, false FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, ['rule', 'method', 'register', 'interface', 'type', 'other'][c_custkey % 6 + 1], 'r' || n_regionkey, c_acctbal < 0 FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderkey // 16 ORDER BY o_orderkey) AS dst, o_orderkey % 33 AS k FROM orders),
e AS (SELECT 'c' || src AS src, 'c' || dst AS dst, kind, mode FROM t JOIN m USING (k) WHERE dst IS NOT NULL UNION ALL SELECT parent, node, 'contains', 'structure' FROM n WHERE parent IS NOT NULL),
h AS (SELECT * FROM n WHERE NOT hidden)"""
VIEWS = [("system", "structure"), ("system", "data-flow"), ("module", "structure"), ("module", "data-flow"), ("behavior", "data-flow"), ("behavior", "scheduling")]
_IN = {
    "system": "SELECT node, kind FROM h WHERE kind IN ('package', 'module', 'interface') AND path = 'r1'",
    "module": "SELECT node, kind FROM h WHERE node = 'n3' OR parent = 'n3' AND kind IN ('interface', 'type') UNION SELECT 'member-group:n3:' || CASE kind WHEN 'rule' THEN 'rules' WHEN 'method' THEN 'methods' WHEN 'register' THEN 'state' WHEN 'interface' THEN 'interfaces' ELSE 'types' END, 'member-group' FROM h WHERE parent = 'n3' AND kind <> 'other'",
    "behavior": "SELECT node, kind FROM h WHERE node = 'n3' OR parent = 'n3' AND kind IN ('rule', 'method', 'register')",
    "scheduling": "SELECT node, kind FROM h WHERE parent = 'n3' AND kind IN ('rule', 'method')",
}
_SEEN = [(level, mode, _IN["scheduling" if mode == "scheduling" else level]) for level, mode in VIEWS]
_NODES = ", ".join(f"v{k} AS ({sql})" for k, (_, _, sql) in enumerate(_SEEN))
_ROWS = " UNION ALL ".join(
    f"SELECT '{level}' AS level, '{mode}' AS mode, node AS a, NULL AS b, kind FROM v{k} UNION ALL "
    + (f"SELECT '{level}', '{mode}', 'n3', node, 'contains' FROM v{k} WHERE node <> 'n3'" if (level, mode) == ("module", "structure") else f"SELECT '{level}', '{mode}', src, dst, kind FROM e WHERE mode = '{mode}' AND src IN (SELECT node FROM v{k}) AND dst IN (SELECT node FROM v{k})")
    for k, (level, mode, _) in enumerate(_SEEN)
)


def architecture(spark, d) -> tuple[DataFrame, DataFrame]:
    """Regions as packages, nations as modules and customers as their members; edges by who orders after whom, and containment."""
    nation = t(spark, d, "nation")
    kinds = F.get(F.array(*map(F.lit, ["rule", "method", "register", "interface", "type", "other"])), (F.col("c_custkey") % 6).cast("int"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    nodes = (
        t(spark, d, "region").select(text_key("r", "r_regionkey").alias("node"), none.alias("parent"), F.lit("package").alias("kind"), text_key("r", "r_regionkey").alias("path"), no.alias("hidden"))
        .union(nation.select(text_key("n", "n_nationkey"), text_key("r", "n_regionkey"), F.lit("module"), text_key("r", "n_regionkey"), no))
        .union(t(spark, d, "customer").join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select(text_key("c", "c_custkey"), text_key("n", "c_nationkey"), kinds, text_key("r", "n_regionkey"), F.col("c_acctbal") < 0))
    )
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.lead("o_custkey").over(Window.partitionBy(F.expr("o_orderkey div 16")).orderBy("o_orderkey")).alias("following"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % len(KINDS)).cast("int"))
    edges = orders.where("following is not null").select(text_key("c", "o_custkey").alias("src"), text_key("c", "following").alias("dst"), kind.alias("kind"), none.alias("mode"))
    return nodes, edges.union(nodes.where("parent is not null").select("parent", "node", F.lit("contains"), none))


@query(f"WITH {VIEW_SQL}, {_NODES} {_ROWS}")
def visible_views(spark, d):
    """What each level shows in each mode: the system of one region's file, a nation as a module, and as behavior."""
    nodes, edges = architecture(spark, d)
    nodes, edges = written(nodes, scratch(spark)), written(edges, scratch(spark))
    out = []
    for level, mode in VIEWS:
        shown, between = views.visible(nodes, edges, level, mode, owner=None if level == "system" else "n3", file="r1" if level == "system" else None)
        tagged = (F.lit(level).alias("level"), F.lit(mode).alias("mode"))
        out.append(shown.select(*tagged, F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "kind").union(between.select(*tagged, "src", "dst", "kind")))
    return reduce(DataFrame.union, out)


@query(f"WITH {VIEW_SQL}, f AS (SELECT src, dst, kind FROM e WHERE mode = 'data-flow' AND src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)), u AS (SELECT src, dst FROM f UNION SELECT dst, src FROM f), start AS (SELECT h.node, h.parent FROM h JOIN u ON u.src = h.node WHERE kind = 'rule' ORDER BY h.node LIMIT 1), near AS (SELECT node FROM start UNION SELECT u.dst FROM u, start WHERE u.src = start.node UNION SELECT w.dst FROM u JOIN u AS w ON w.src = u.dst, start WHERE u.src = start.node), v AS (SELECT node, kind FROM h WHERE (node = (SELECT parent FROM start) OR parent = (SELECT parent FROM start) AND kind IN ('rule', 'method', 'register')) AND node IN (SELECT node FROM near)) SELECT node AS a, NULL AS b, kind FROM v UNION ALL SELECT src, dst, kind FROM f WHERE src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v)")
def focused_view(spark, d):
    """The behavior of a nation within two hops of data flow around a rule, the first that has any."""
    nodes, edges = architecture(spark, d)
    nodes, edges = written(nodes, scratch(spark)), written(edges, scratch(spark))
    held = nodes.where("not hidden").select("node")
    flow = edges.where(S.edge_mode(F.col("kind")) == "data-flow").join(held.withColumnRenamed("node", "src"), "src", "left_semi").join(held.withColumnRenamed("node", "dst"), "dst", "left_semi")
    touched = flow.select(F.col("src").alias("node")).union(flow.select("dst"))
    start = nodes.where("kind = 'rule' and not hidden").join(touched, "node", "left_semi").orderBy("node").first()
    shown, between = views.visible(nodes, edges, "behavior", "data-flow", owner=start["parent"], focus=start["node"], hops=2)
    return shown.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "kind").union(between)


@query("WITH l AS (SELECT DISTINCT s_suppkey, s_nationkey, sn.n_regionkey AS sr, c_custkey, c_nationkey, cn.n_regionkey AS cr FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation AS cn ON cn.n_nationkey = c_nationkey JOIN nation AS sn ON sn.n_nationkey = s_nationkey) SELECT 's' || s_suppkey AS a, 'c' || c_custkey AS b, CASE WHEN s_nationkey = c_nationkey THEN 'n' || s_nationkey WHEN sr = cr THEN 'r' || sr END AS common, CASE WHEN s_nationkey = c_nationkey THEN 1 WHEN sr = cr THEN 2 END AS up_a, CASE WHEN s_nationkey = c_nationkey THEN 2 WHEN sr = cr THEN 3 END AS up_b FROM l")
def common_owners(spark, d):
    """The lowest owner of every supplier and customer that trade; customers stand below their market segment in the nation."""
    nation, customer = t(spark, d, "nation"), t(spark, d, "customer")
    segment = F.concat_ws("/", text_key("n", "c_nationkey"), "c_mktsegment")
    up = [
        customer.select(text_key("c", "c_custkey"), segment), customer.select(segment, text_key("n", "c_nationkey")).distinct(), t(spark, d, "supplier").select(text_key("s", "s_suppkey"), text_key("n", "s_nationkey")),
        nation.select(text_key("n", "n_nationkey"), text_key("r", "n_regionkey")), t(spark, d, "region").select(text_key("r", "r_regionkey"), F.lit(None).cast("string")),
    ]
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    pairs = lines.select(text_key("s", "l_suppkey").alias("a"), text_key("c", "o_custkey").alias("b"))
    return views.common_ancestors(reduce(DataFrame.union, up).toDF("node", "parent"), pairs)


@query("SELECT p_partkey AS part, CASE WHEN p_size % 7 = 0 THEN 'unparsable' END AS problem, CASE WHEN p_size % 7 = 0 THEN 'BSV Architecture' ELSE p_brand || ' // not a comment' END AS title, CASE WHEN p_size % 7 = 0 THEN '**/gen/**' ELSE '**/gen/**,' || p_type || '/**' END AS exclude, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'b:*.b:0,a/*:a/*:1' ELSE 'a/*:a/*:1,b:*.b:2' END AS groups, CASE WHEN p_size % 7 > 0 AND p_size % 3 = 0 THEN 'TB' ELSE 'LR' END AS direction FROM part")
def configurations(spark, d):
    """Configurations with comments that Spark writes from the parts; every seventh is cut off."""
    size = F.col("p_size")
    text = F.concat(
        F.lit('// a file\n{ "title": "'), "p_brand", F.lit(' // not a comment", /* "title": "x", */\n "exclude": ["**/gen/**", " ", "'), "p_type", F.lit('/**"], // and\n "groups": [{"match": ""}, {"match": "a/*"}, {"match": "*.b", "id": "b"'),
        F.when(size % 2 == 0, ', "order": 0').otherwise(""), F.lit("}],\n"), F.when(size % 3 == 0, '"view": {"direction": "TB"}').otherwise('"view": {"direction": "up"}'), F.when(size % 7 == 0, "").otherwise("} /* end"),
    )
    done = config.configured(t(spark, d, "part").select(F.col("p_partkey").alias("path"), text.alias("value")), ["**/gen/**"])
    groups = F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["id"], g["match"], g["order"].cast("string"))), ",")
    return done.select(F.col("path").alias("part"), "problem", "title", F.array_join("exclude", ",").alias("exclude"), groups.alias("groups"), "direction")


# ---- channels

SIGNALS_SQL = """x AS (SELECT 'm' || l_orderkey AS owner, 'p' || l_partkey % 3 AS base, l_linenumber, l_returnflag FROM lineitem),
methods AS (SELECT DISTINCT owner, base, unnest(CASE l_linenumber % 5 WHEN 0 THEN ['Ready', 'act'] WHEN 1 THEN ['act', 'actTwo'] WHEN 2 THEN ['Valid', 'value'] WHEN 3 THEN ['Valid', 'consume'] ELSE ['current', 'Ready'] END) AS what FROM x),
r AS (SELECT owner, base FROM methods WHERE what = 'Ready'), a AS (SELECT owner, base, count(*) AS n, min(CASE what WHEN 'act' THEN base ELSE base || 'Two' END) AS one, list_sort(list(CASE what WHEN 'act' THEN base ELSE base || 'Two' END)) AS names FROM methods WHERE what IN ('act', 'actTwo') GROUP BY 1, 2),
v AS (SELECT owner, base FROM methods WHERE what = 'Valid'), p AS (SELECT owner, base, count(*) AS n, list_sort(list(CASE what WHEN 'value' THEN base || '_out' ELSE 'currentP' || substr(base, 2) END)) AS names FROM methods WHERE what IN ('value', 'current') GROUP BY 1, 2),
c AS (SELECT owner, base, 'consumeP' || substr(base, 2) AS one FROM methods WHERE what = 'consume')"""


@query(
    f"WITH {SIGNALS_SQL} SELECT owner, base, 'input' AS direction, base || 'Ready' AS anchor, a.one AS first, NULL AS consume, '' AS candidates FROM r JOIN a USING (owner, base) WHERE n = 1 UNION ALL SELECT owner, NULL, NULL, base || 'Ready', NULL, NULL, array_to_string(names, ',') FROM r JOIN a USING (owner, base) WHERE n > 1 "
    "UNION ALL SELECT owner, base, CASE WHEN p.n IS NULL THEN 'ack' WHEN c.one IS NULL THEN 'output' ELSE 'output-with-ack' END, base || 'Valid', p.names[1], c.one, '' FROM v LEFT JOIN p USING (owner, base) LEFT JOIN c USING (owner, base) WHERE coalesce(p.n, 0) < 2 AND (p.n IS NOT NULL OR c.one IS NOT NULL) UNION ALL SELECT owner, NULL, NULL, base || 'Valid', NULL, NULL, array_to_string(list_sort(list_concat(p.names, CASE WHEN c.one IS NULL THEN [] ELSE [c.one] END)), ',') FROM v JOIN p USING (owner, base) LEFT JOIN c USING (owner, base) WHERE p.n > 1"
)
def protocol_channels(spark, d):
    """Orders as owners of methods that their lines stand for: ready, valid, actions and values of three signals."""
    lines = t(spark, d, "lineitem").select(text_key("m", "l_orderkey").alias("owner"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("base"), F.when(F.col("l_linenumber") % 5 < 0, 4).otherwise(F.coalesce(F.col("l_linenumber") % 5, F.lit(4))).alias("k"))
    named = {
        "Ready": ("{}Ready", "output", "Bool", []), "act": ("{}", "input", "Action", ["Bit#(8)"]), "actTwo": ("{}Two", "input", "Action", ["Bit#(8)"]), "Valid": ("{}Valid", "output", "Bool", []),
        "value": ("{}_out", "output", "Bit#(8)", []), "consume": ("consumeP{}", "input", "Action", []), "current": ("currentP{}", "output", "Int", []),
    }
    sets = [["Ready", "act"], ["act", "actTwo"], ["Valid", "value"], ["Valid", "consume"], ["current", "Ready"]]

    def what(form: str, category: str, returns: str, parameters: list):
        before, after = form.split("{}")
        values = {"before": before.removesuffix("P"), "capital": before.endswith("P"), "after": after, "category": category, "returns": returns}
        return F.struct(*(F.lit(v).alias(k) for k, v in values.items()), F.array(*map(F.lit, parameters)).cast("array<string>").alias("parameters"))

    table = F.array(*(F.array(*(what(*named[w]) for w in s)) for s in sets))
    # an order has few lines, so all that follows stays where its owner is; a line is a few bytes there, and about a kilobyte in the sorts after
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // 500_000 + 1)
    rows = lines.repartition(tasks, "owner").select("owner", "base", F.inline(F.get(table, F.col("k"))))
    method = F.concat("before", F.when(F.col("capital"), F.upper("base")).otherwise(F.col("base")), "after")
    methods = rows.select("owner", method.alias("method"), "category", "returns", "parameters").distinct()
    clear = lambda x: F.when(~F.col("ambiguous"), x)
    candidates = F.when(F.col("ambiguous"), F.array_join("candidates", ",")).otherwise("")
    return M.anchored(methods).select("owner", clear(F.col("base")).alias("base"), clear(F.col("direction")).alias("direction"), "anchor", clear(F.coalesce("action", "value")).alias("first"), clear(F.col("consume")).alias("consume"), candidates.alias("candidates"))


# ---- spans in the pages' markup

MARKS_SQL = "ch AS (SELECT page_id AS id, generate_subscripts(string_split(html, ''), 1) - 1 AS pos, unnest(string_split(html, '')) AS mark FROM pages WHERE html IS NOT NULL), marks AS (SELECT * FROM ch WHERE mark IN ('(', ')', '[', ']', '{', '}', ';')), depths AS (SELECT *, " + ", ".join(f"sum(CASE mark WHEN '{o}' THEN 1 WHEN '{c}' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS d{k}" for k, (o, c) in enumerate(("()", "[]", "{}"))) + " FROM marks)"
PAIRED_SQL = "lv AS (" + " UNION ALL ".join(f"SELECT id, pos, '{o}{c}' AS kind, mark = '{o}' AS opens, CASE mark WHEN '{o}' THEN d{k} ELSE d{k} + 1 END AS lvl FROM depths WHERE mark IN ('{o}', '{c}')" for k, (o, c) in enumerate(("()", "[]", "{}"))) + "), nx AS (SELECT *, lead(opens) OVER w AS no, lead(pos) OVER w AS np FROM lv WINDOW w AS (PARTITION BY id, kind, lvl ORDER BY pos)), paired AS (SELECT id, kind, pos AS start, CASE WHEN NOT no THEN np END AS \"end\" FROM nx WHERE opens)"


def markup(spark, d) -> DataFrame:
    return t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))


@query(f"WITH {MARKS_SQL}, {PAIRED_SQL} SELECT id, kind, start, \"end\" FROM paired")
def bracket_pairs(spark, d):
    return spans.matched(markup(spark, d))


@query(f"WITH {MARKS_SQL}, low AS (SELECT *, min(d0) OVER w AS m0, min(d1) OVER w AS m1, min(d2) OVER w AS m2 FROM depths WINDOW w AS (PARTITION BY id ORDER BY pos)), ends AS (SELECT id, pos FROM low WHERE mark = ';' AND d0 - least(0, m0) = 0 AND d1 - least(0, m1) = 0 AND d2 - least(0, m2) = 0) SELECT id, CAST(row_number() OVER w AS INT) AS nth, coalesce(lag(pos) OVER w + 1, 0) AS start, pos + 1 AS \"end\" FROM ends WINDOW w AS (PARTITION BY id ORDER BY pos)")
def statement_spans(spark, d):
    return spans.statement_ends(markup(spark, d))


ELEMENTS_SQL = "s AS (SELECT c_custkey, c_nationkey, n_regionkey, row_number() OVER (ORDER BY n_regionkey, c_nationkey, c_custkey) AS pl FROM customer JOIN nation ON c_nationkey = n_nationkey), g AS (SELECT 'r' || n_regionkey AS key, 2 * min(pl) AS start, 2 * max(pl) + 2 AS stop, 1 AS depth, NULL AS parent FROM s GROUP BY n_regionkey UNION ALL SELECT 'n' || c_nationkey, 2 * min(pl), 2 * max(pl) + 2, 2, 'r' || n_regionkey FROM s GROUP BY c_nationkey, n_regionkey UNION ALL SELECT 'o' || c_custkey, 2 * pl, 2 * pl + 1, 3, 'n' || c_nationkey FROM s)"


@query(f"WITH {ELEMENTS_SQL} SELECT key, depth, parent FROM g")
def range_forest(spark, d):
    """Regions, nations and customers as ranges of one numbering; who encloses whom follows from the ranges alone."""
    from tracelake.operators.ordered import running

    placed = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey").select("c_custkey", "c_nationkey", "n_regionkey")
    at = written(running(placed, [F.col("n_regionkey"), F.col("c_nationkey"), F.col("c_custkey")], {"at": F.lit(1)}, scratch(spark)), scratch(spark))
    span = lambda key, *by: at.groupBy(*by).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(key.alias("key"), (2 * F.col("lo")).alias("start"), (2 * F.col("hi") + 2).alias("end"))
    ranges = span(text_key("r", "n_regionkey"), "n_regionkey").union(span(text_key("n", "c_nationkey"), "c_nationkey")).union(at.select(text_key("o", "c_custkey"), 2 * F.col("at"), 2 * F.col("at") + 1))
    # a region is a text of its own: nothing crosses its range
    region = at.groupBy("n_regionkey").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    of = ranges.join(F.broadcast(region), (F.col("start") >= 2 * F.col("lo")) & (F.col("start") <= 2 * F.col("hi"))).select(F.col("n_regionkey").alias("id"), "key", "start", "end")
    return spans.forest(of).select("key", F.col("depth").cast("int").alias("depth"), "parent")


@query("SELECT p_brand || '.' || p_partkey AS id, 1 + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END + p_size % 9 AS line, unnest(['label', 'hide']) AS key, unnest([p_type, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END]) AS value FROM part WHERE 1 + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END + p_size % 9 <= 8 UNION ALL SELECT p_brand || '.' || p_partkey, 1 + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END + p_size % 9, 'hide', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END FROM part WHERE 1 + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END + p_size % 9 = 9")
def leading_annotations(spark, d):
    """Sources that Spark writes from the parts: annotations, then comments and blank lines, then code; what stands over eight lines before does not count."""
    blank = F.repeat(F.lit("\n"), F.col("p_size") % 9)
    comment = F.when(F.col("p_size") % 3 == 0, "// a note\n// @archive no\n").otherwise("")
    text = F.concat(F.lit("// @arch.label '"), "p_type", F.lit("'\n//@arch hide"), F.when(F.col("p_size") % 2 == 0, "").otherwise("=false"), F.lit("\n"), comment, blank, F.lit("module "), "p_name", F.lit(";\n// @arch.label after\n"))
    return spans.annotations(t(spark, d, "part").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("id"), text.alias("text")))
