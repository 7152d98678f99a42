"""Queries of the relationship operators over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.operators import graph as G
from tracelake.operators import relations as R
from tracelake.operators import resolve as V
from tracelake.operators.checkpoints import scratch, written
from tracelake.operators.components import components

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# ---- graphs: customers and parts, joined by order lines

EDGES_SQL = "e0 AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), hub AS (SELECT src AS node FROM e0 GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def trade_pairs(spark: SparkSession, d: str) -> DataFrame:
    """o_custkey, l_partkey: who ordered what, each once, still as numbers."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    met = lines.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("o_custkey", "l_partkey").distinct()


def named(pairs: DataFrame) -> DataFrame:
    """src and dst, customers and parts by name, of what trade_pairs gives."""
    return pairs.select(text_key("c", "o_custkey").alias("src"), text_key("p", "l_partkey").alias("dst"))


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    return named(trade_pairs(spark, d))


def hub(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("node"))


@query(f"WITH RECURSIVE {EDGES_SQL}, r(node, depth) AS (SELECT node, 0 FROM hub UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def khop_neighborhood(spark, d):
    edges = written(trade_edges(spark, d), scratch(spark))
    return G.neighborhood(edges, hub(edges), 3, stored=True)


@query(f"WITH RECURSIVE {EDGES_SQL}, r(node, top) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, min(r.top) FROM r JOIN e ON r.node = e.src JOIN recurring.r AS old ON old.node = e.dst WHERE r.top < old.top GROUP BY e.dst) SELECT node, top AS component FROM r")
def connected_components(spark, d):
    # as numbers, even for customers and odd for parts, they are grouped and joined with less; a component is named by its least name
    edges = trade_pairs(spark, d).select((F.col("o_custkey").cast("long") * 2).alias("a"), (F.col("l_partkey").cast("long") * 2 + 1).alias("b"))
    found = components(edges, scratch(spark))
    tops = found.select(F.col("class").alias("node"), F.col("class")).distinct()
    name = F.concat(F.when(F.col("node") % 2 == 0, "c").otherwise("p"), F.expr("shiftright(node, 1)").cast("string"))
    placed = written(found.union(tops).select("class", name.alias("node")), scratch(spark))
    least = placed.groupBy("class").agg(F.min("node").alias("component"))
    return placed.join(least, "class").select("node", "component")


@query(
    f"WITH RECURSIVE {EDGES_SQL}, r(node, path) AS (SELECT node, [node] FROM hub UNION ALL SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN e ON r.node = e.src WHERE len(r.path) < 4 AND NOT list_contains(r.path, e.dst)), near AS (SELECT node, min(len(path)) AS n FROM r GROUP BY node), goal AS (SELECT min(node) AS node FROM near WHERE n = 4), found AS (SELECT path AS nodes, list_aggregate(path, 'string_agg', '>') AS path FROM r JOIN goal USING (node) WHERE len(path) = 4) SELECT path, 3 AS depth, (SELECT count(*) FROM found) AS n_paths FROM found ORDER BY nodes LIMIT 50"
)
def shortest_paths(spark, d):
    edges = written(trade_edges(spark, d), scratch(spark))
    start = hub(edges)
    start = written(start, scratch(spark))
    goal = G.neighborhood(edges, start, 3, stored=True).where("depth = 3").agg(F.min("node")).first()[0]
    found = G.shortest_paths(edges, start.first()[0], goal, stored=True)
    return found.select(F.array_join("path", ">").alias("path"), "depth", "n_paths")


SUPPLY_SQL = "e AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem")
    parts = [
        t(spark, d, "customer").select(text_key("n", "c_nationkey"), text_key("c", "c_custkey")),
        t(spark, d, "orders").select(text_key("c", "o_custkey"), text_key("o", "o_orderkey")),
        lines.select(text_key("o", "l_orderkey"), text_key("p", "l_partkey")),
        lines.select(text_key("p", "l_partkey"), text_key("s", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("src", "dst").distinct()


@query(
    f"WITH RECURSIVE {SUPPLY_SQL}, stop AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size > 10), r(node, depth) AS (SELECT 'n3', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.node NOT IN (SELECT node FROM stop)) SELECT r.node, min(depth) AS depth, max(CASE WHEN stop.node IS NOT NULL THEN 'stop' END) AS reason FROM r LEFT JOIN stop ON r.node = stop.node GROUP BY r.node"
)
def dependency_cone(spark, d):
    """What a nation depends on, up to large parts, which are boundaries."""
    stop = t(spark, d, "part").where("p_size > 10").select(text_key("p", "p_partkey").alias("node"))
    return G.reach(supply_edges(spark, d), spark.createDataFrame([("n3",)], "node string"), stop=stop)


@query(
    f"WITH RECURSIVE {SUPPLY_SQL}, r(node, depth) AS (SELECT 'n3', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 2), x AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), cut AS (SELECT count(*) AS n FROM x WHERE depth = 2 AND node IN (SELECT src FROM e)) SELECT CASE WHEN n > 0 THEN 'partial' ELSE 'complete' END AS status, n AS frontier FROM cut"
)
def bounded_completeness(spark, d):
    """A cone that a depth limit cuts off, and how much it left open."""
    return G.completeness(G.reach(supply_edges(spark, d), spark.createDataFrame([("n3",)], "node string"), max_depth=2))


@query(
    "WITH RECURSIVE h(parent, node) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), x(node, path, root, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT h.node, x.path || '/' || h.node, x.root, x.depth + 1 FROM x JOIN h ON h.parent = x.node) SELECT node, path, root, depth, 'expanded' AS status FROM x"
)
def hierarchy_expand(spark, d):
    below = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    rows = [t(spark, d, name).select(text_key(p, parent).alias("parent"), text_key(c, child).alias("node")) for name, p, parent, c, child in below]
    children = rows[0].union(rows[1]).union(rows[2]).withColumn("name", F.col("node"))
    return G.expand(children, t(spark, d, "region").select(text_key("r", "r_regionkey").alias("node"))).select("node", "path", "root", "depth", "status")


USERS_SQL = "e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


def nation_trade(spark: SparkSession, d: str) -> DataFrame:
    met = (
        t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
        .join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    )
    return met.withColumnsRenamed({"s_nationkey": "src", "c_nationkey": "dst"})


@query(f"WITH RECURSIVE {USERS_SQL}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def cycle_members(spark, d):
    """Users on cycles of who comes next in an event type's sequence."""
    following = R.adjacent_pairs(t(spark, d, "events"), ["event_type"], ["ts", "event_id"], "user_id")
    return G.cycle_members(following.select(F.col("user_id").alias("src"), F.col("following").alias("dst")))


@query("WITH e AS (SELECT lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem), top AS (SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL)) SELECT node FROM top UNION ALL SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM top)")
def graph_roots(spark, d):
    """Parts that never follow another in an order; all of them if there is none such."""
    following = R.adjacent_pairs(t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")
    return G.roots_of(t(spark, d, "part").select(F.col("p_partkey").alias("node")), following.select(F.col("l_partkey").alias("src"), F.col("following").alias("dst")))


@query("WITH e AS (SELECT DISTINCT 'a' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS src, 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS dst, l_returnflag AS kind FROM lineitem), n AS (SELECT 'a' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS node, true AS preferred FROM supplier UNION ALL SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), p_type IN ('PROMO', 'LARGE') FROM part), k AS (SELECT node FROM n ORDER BY preferred DESC, node LIMIT 500) SELECT src, dst, kind FROM e WHERE dst IN (SELECT node FROM k) AND src IN (SELECT node FROM k) ORDER BY src, dst, kind LIMIT 2000")
def truncate_no_dangling(spark, d):
    """The feature is the limit: 500 nodes, suppliers and parts of preferred types first, and at most 2000 edges between them."""
    edges = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey")).alias("dst"), F.col("l_returnflag").alias("kind")).distinct()
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").isin("PROMO", "LARGE").alias("preferred"))
    marked = lambda df, p: df.withColumn("node", F.concat(F.lit(p), F.lpad(F.col("node").cast("string"), 9, "0")))
    nodes = marked(parts, "p").union(marked(t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.lit(True).alias("preferred")), "a"))
    ends = edges.select(F.concat(F.lit("a"), F.lpad(F.col("src").cast("string"), 9, "0")).alias("src"), F.concat(F.lit("p"), F.lpad(F.col("dst").cast("string"), 9, "0")).alias("dst"), "kind")
    return G.without_dangling(nodes, ends, 500, 2000)[1]


# ---- resolution

RESOLVE_SQL = "c AS (SELECT c_custkey AS id, n_nationkey AS nation, n_regionkey AS region, c_custkey % 10 AS slot FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT s_suppkey AS id, n_nationkey AS nation, n_regionkey AS region, s_suppkey % 10 AS slot FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def located(spark: SparkSession, d: str, name: str, p: str, key: str) -> DataFrame:
    nations = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return t(spark, d, name).select(F.col(key).alias("id"), F.col(f"{p}_nationkey").alias("nation"), (F.col(key) % 10).alias("slot")).join(F.broadcast(nations), "nation")


@query(
    f"WITH {RESOLVE_SQL}, m AS (SELECT c.id, CASE WHEN s.nation = c.nation THEN 0 WHEN s.region = c.region THEN 1 ELSE 2 END AS tier, s.id AS target FROM c LEFT JOIN s ON s.slot = c.slot), b AS (SELECT id, min(tier) AS tier FROM m WHERE target IS NOT NULL GROUP BY id), n AS (SELECT m.id, m.tier, count(*) AS n, min(target) AS target FROM m JOIN b ON m.id = b.id AND m.tier = b.tier GROUP BY ALL) SELECT c.id, n.tier, coalesce(n.n, 0) AS n, CASE WHEN n.n = 1 THEN n.target END AS target, CASE WHEN n.n = 1 THEN 'exact' WHEN n.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM c LEFT JOIN n ON c.id = n.id"
)
def resolve_tiers(spark, d):
    """Each customer's supplier of the same slot: in its nation, else in its region, else anywhere."""
    suppliers = located(spark, d, "supplier", "s", "s_suppkey").withColumnRenamed("id", "supplier")
    # a closer tier is part of the wider one, so where it has none the wider one counts the rest
    return V.resolve(located(spark, d, "customer", "c", "c_custkey"), suppliers, [["nation", "slot"], ["region", "slot"], ["slot"]], "id", "supplier")


@query(
    "WITH c AS (SELECT c_nationkey AS nation, count(*) AS v FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS v FROM supplier GROUP BY 1) SELECT coalesce(c.nation, s.nation) AS nation, c.v AS expected, s.v AS actual, CASE WHEN s.v IS NULL THEN 'missing' WHEN c.v IS NULL THEN 'unexpected' WHEN c.v = s.v THEN 'exact' ELSE 'mismatch' END AS status FROM c FULL JOIN s ON c.nation = s.nation"
)
def contract_compare(spark, d):
    expected = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("v"))
    return V.compare(expected, t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("v")), ["nation"], "v")


@query(
    "WITH p AS (SELECT DISTINCT c_custkey AS customer, CAST(floor(c_acctbal) AS BIGINT) AS balance FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY customer) AS a, count(*) OVER (PARTITION BY balance) AS b FROM p) SELECT customer, balance, CASE WHEN a = 1 AND b = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM n"
)
def mutual_unique(spark, d):
    pairs = t(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.floor("c_acctbal").cast("long").alias("balance"))
    return V.mutually_unique(pairs, "customer", "balance")


@query(
    "WITH r AS (SELECT c_nationkey * 10 + length(c_mktsegment) AS range_id, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1), m AS (SELECT s_suppkey AS point_id, range_id, rank() OVER (PARTITION BY s_suppkey ORDER BY high - low) AS k FROM supplier JOIN r ON s_acctbal >= low AND s_acctbal < high) SELECT s_suppkey AS point_id, range_id FROM supplier LEFT JOIN m ON s_suppkey = m.point_id AND m.k = 1"
)
def smallest_range(spark, d):
    """The narrowest balance range of a group of customers that holds each supplier's balance."""
    ranges = t(spark, d, "customer").groupBy((F.col("c_nationkey") * 10 + F.length("c_mktsegment")).alias("range_id")).agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    return V.smallest_enclosing(t(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), F.col("s_acctbal").alias("at")), ranges)


@query(
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN max(l.toxic) = 1 THEN 'unsupported' ELSE 'exact' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id, l.doc_id"
)
def status_rollup(spark, d):
    labels = t(spark, d, "labels").withColumnRenamed("doc_id", "labelled")
    each = t(spark, d, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    status = F.when(F.col("labelled").isNull(), "unresolved").when(F.col("toxic") == 1, "unsupported").otherwise("exact")
    return each.withColumn("s", status).groupBy("doc_id").agg(V.combined_status(F.collect_set("s")).alias("status"))


@query("SELECT o_custkey AS customer, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'O') THEN 'O' ELSE 'P' END AS freshness FROM orders GROUP BY 1")
def freshness(spark, d):
    """The worst state of a customer's orders, in a fixed order."""
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(V.worst("o_orderstatus", ["F", "O", "P"]).alias("freshness"))


# ---- relations

@query("SELECT user_id, event_id, following FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE following IS NOT NULL")
def schedule_adjacent(spark, d):
    return R.adjacent_pairs(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@query(
    "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT a.user_id, CAST(a.day AS VARCHAR) AS day, a.event_id AS first, b.event_id AS second FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.k < b.k"
)
def schedule_pairs(spark, d):
    """All ordered pairs of a user's events of one day."""
    events = t(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return R.ordered_pairs(events, ["user_id", "day"], ["ts", "event_id"], "event_id")


@query(
    "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT a.user_id, CAST(a.day AS VARCHAR) AS day, a.event_id AS first, b.event_id AS second FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.k = 1 AND b.k > 1"
)
def schedule_preempts(spark, d):
    events = t(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return R.ordered_pairs(events, ["user_id", "day"], ["ts", "event_id"], "event_id", first_only=True)


@query(
    "WITH a AS (SELECT user_id AS b, CAST(ts AS DATE) || '/' || CAST(json_extract(props, '$.k') AS INTEGER) AS state, bool_or(event_type IN ('signup', 'purchase')) AS w FROM events GROUP BY ALL), m AS (SELECT x.b AS a, y.b AS b, x.state FROM a x JOIN a y ON x.state = y.state AND x.b < y.b AND (x.w OR y.w)) SELECT a, b, count(*) AS n_states, string_agg(state, ',' ORDER BY state) AS states FROM m GROUP BY a, b"
)
def potential_dependency(spark, d):
    """Users whose events met on a day and a property value, at least one of them writing."""
    events = t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    accesses = events.select(F.col("user_id").alias("behaviour"), F.concat_ws("/", F.to_date("ts").cast("string"), k).alias("state"), F.col("event_type").isin("signup", "purchase").alias("writes"))
    return R.shared_state_pairs(accesses).withColumn("states", F.array_join("states", ","))


@query(
    "WITH f AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A') SELECT f.src, f.dst, count(g.src) AS n_support FROM f LEFT JOIN g ON least(f.src, f.dst) = least(g.src, g.dst) AND greatest(f.src, f.dst) = greatest(g.src, g.dst) GROUP BY ALL"
)
def supporting_evidence(spark, d):
    lines = t(spark, d, "lineitem")
    certain = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    guessed = lines.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return R.with_evidence(certain, guessed)[0]


@query("SELECT s_nationkey AS src, c_nationkey AS dst, CASE WHEN s_nationkey = c_nationkey THEN 'inner' ELSE 'outer' END AS direction, count(*) AS n_members, count(DISTINCT l_partkey) AS parts, max(l_quantity) AS most FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def relation_summary(spark, d):
    members = {"parts": F.count_distinct("l_partkey"), "most": F.max("l_quantity")}
    return R.summarised(nation_trade(spark, d).withColumn("direction", F.when(F.col("src") == F.col("dst"), "inner").otherwise("outer")), ["src", "dst", "direction"], members)


@query("SELECT l_suppkey, l_partkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_line FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL")
def edge_dedupe(spark, d):
    lines = t(spark, d, "lineitem").where("l_suppkey <> l_partkey").select("l_suppkey", "l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_line"))
    return R.first_of_each(lines, ["l_suppkey", "l_partkey", "l_returnflag"], ["first_line"])


@query("SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN least(l_suppkey, l_partkey) ELSE l_suppkey END AS src, CASE WHEN l_returnflag = 'N' THEN greatest(l_suppkey, l_partkey) ELSE l_partkey END AS dst, l_returnflag AS kind FROM lineitem WHERE l_suppkey <> l_partkey")
def undirected_dedupe(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return R.undirected(edges, F.col("kind") == "N")


@query("SELECT 'node' AS item, p_type AS kind, count(*) AS n, count(DISTINCT p_brand) AS n_distinct FROM part GROUP BY 2 UNION ALL SELECT 'edge', o_orderstatus, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 2")
def kind_counts(spark, d):
    count = lambda df, item, kind, other: df.groupBy(F.lit(item).alias("item"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(other).alias("n_distinct"))
    return count(t(spark, d, "part"), "node", "p_type", "p_brand").union(count(t(spark, d, "orders"), "edge", "o_orderstatus", "o_custkey"))


@query("SELECT p_brand AS owner, p_type AS bucket, count(*) AS total, count(*) FILTER (p_size <= 25) AS visible FROM part GROUP BY ALL")
def member_buckets(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("owner"), F.col("p_type").alias("bucket")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") <= 25).alias("visible"))


@query("SELECT p_brand AS brand, p_type AS type, count(*) AS n, CASE WHEN count(DISTINCT p_size) = count(*) THEN '× ' || count(*) ELSE '× N' END AS label FROM part GROUP BY ALL")
def instance_groups(spark, d):
    n = F.count(F.lit(1))
    exact = F.count_distinct("p_size") == n
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(n.alias("n"), F.when(exact, F.concat(F.lit("× "), n.cast("string"))).otherwise("× N").alias("label"))


@query("SELECT event_type AS state, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(DISTINCT user_id) FILTER (value >= 50) AS writers, count(DISTINCT user_id) FILTER (value < 50) AS readers FROM events GROUP BY ALL")
def readers_writers(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    users = lambda who: F.count_distinct(F.when(who, F.col("user_id")))
    return t(spark, d, "events").groupBy(F.col("event_type").alias("state"), k.alias("k")).agg(users(F.col("value") >= 50).alias("writers"), users(F.col("value") < 50).alias("readers"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256('{\"event_type\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"user_id\":' || user_id || '}') AS fingerprint FROM events")
def json_params(spark, d):
    """Typed parameters, and the hash of a record with its keys in order."""
    k = F.from_json("props", "k long")["k"]
    return t(spark, d, "events").select("event_id", k.alias("k"), S.fingerprint({"user_id": F.col("user_id"), "event_type": F.col("event_type"), "k": k}).alias("fingerprint"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS ordinal, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1 THEN c_mktsegment ELSE c_mktsegment || '~' || row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) END AS unique_name FROM customer")
def unique_names(spark, d):
    named = R.unique_names(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", ["c_custkey"])
    return named.select("c_custkey", "c_mktsegment", R.ordinals(named, ["c_nationkey", "c_mktsegment"], ["c_custkey"]).alias("ordinal"), "unique_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(string_agg(l_returnflag, ',' ) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM lineitem")
def prior_labels(spark, d):
    """The labels of all earlier arms, here of an order's earlier lines."""
    rows = R.earlier_values(t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("earlier", ",").alias("earlier"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM events")
def carried_context(spark, d):
    marked = t(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return R.carried(marked, ["user_id"], ["ts", "event_id"], "mark", "context").select("event_id", "context")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, CAST(o_orderdate AS DATE)) AS r FROM orders) WHERE r = 1")
def best_per_owner(spark, d):
    return R.best_of_each(t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.to_date("o_orderdate")]).select("o_custkey", "o_orderkey")


@query("WITH s AS (SELECT l_suppkey AS owner, epoch(CAST(l_shipdate AS DATE)) // 86400 AS low, epoch(CAST(l_shipdate AS DATE)) // 86400 + CAST(l_quantity AS BIGINT) AS high FROM lineitem), m AS (SELECT *, max(high) OVER (PARTITION BY owner ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) SELECT owner, CAST(b AS BIGINT) AS low, CAST(low AS BIGINT) AS high FROM m WHERE b < low")
def uncovered_spans(spark, d):
    """Days between a supplier's shipping spans that none of them covers."""
    start = F.unix_date(F.to_date("l_shipdate")).cast("long")
    spans = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), start.alias("low"), (start + F.col("l_quantity").cast("long")).alias("high"))
    return R.gaps(spans, ["owner"], "low", "high")


@query("SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 0 WHEN starts_with(p_name, 'red widget') THEN 1 WHEN contains(p_name, 'red widget') THEN 2 ELSE 3 END AS score FROM part) ORDER BY score, p_partkey LIMIT 100")
def search_ranking(spark, d):
    """A top-k report: the 100 best matches of a name."""
    return t(spark, d, "part").select("p_partkey", R.search_score(F.col("p_name"), "Red Widget").alias("score")).orderBy("score", "p_partkey").limit(100)


@query("WITH s AS (SELECT o_custkey, sha256(array_to_string(list_sort(list_distinct(list(o_orderpriority))), chr(1))) AS signature FROM orders GROUP BY 1) SELECT signature, count(*) AS width, min(o_custkey) AS first_bit FROM s GROUP BY 1")
def net_groups(spark, d):
    """Customers with equal sets of order priorities, as bits with equal endpoints form a bus."""
    orders = t(spark, d, "orders")
    grouped = R.bus_groups(orders.select(F.col("o_custkey").alias("bit"), F.col("o_custkey").alias("position")).distinct(), orders.select(F.col("o_custkey").alias("bit"), F.col("o_orderpriority").alias("endpoint")))
    return grouped.select("signature", "width", F.col("first").alias("first_bit"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS n_tags, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') AS links FROM pages")
def html_tokens(spark, d):
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(html, F.lit("<[a-zA-Z][^>]*>"), F.lit(0))).cast("long").alias("n_tags"), F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


@query("SELECT doc_id, length(regexp_replace(text, '\"[^\"\\n]*\"', '', 'g')) AS outside, len(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS n_identifiers FROM documents")
def mask_and_identifiers(spark, d):
    masked = F.regexp_replace("text", '"[^"\\n]*"', "")
    return t(spark, d, "documents").select("doc_id", F.length(masked).cast("long").alias("outside"), F.size(S.identifiers(F.col("text"))).cast("long").alias("n_identifiers"))
