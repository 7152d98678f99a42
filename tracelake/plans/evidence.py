"""Queries of claims, projections, scenes and symbols over models that Spark derives from the driver's tables, each with the same question in SQL.

Regions are tops, nations their instances and suppliers the instances of these; of
some the compiler keeps no boundary, as their numbers say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import symbols, text as X
from tracelake.operators import claims as C
from tracelake.operators import projection as P
from tracelake.operators import views
from tracelake.operators.checkpoints import scratch, written
from tracelake.plans.relational import t, text_key

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


NONE = "cast(null as string)"


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def grown(spark, d) -> tuple[DataFrame, DataFrame]:
    """nation (n, r) and supplier (k, name, n, r)."""
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    supplier = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    return nation, supplier.join(F.broadcast(nation), "n")


# ---- claims

CLAIMED_SQL = """n AS (SELECT n_nationkey AS n, n_regionkey AS r, n_nationkey % 4 = 3 AS inl FROM nation),
s AS (SELECT s_suppkey AS k, s_name AS name, n.*, CASE WHEN s_suppkey % 7 = 6 THEN 0 WHEN s_suppkey % 11 = 10 THEN 2 ELSE 1 END AS nodes FROM supplier JOIN n ON s_nationkey = n),
p AS (SELECT *, nodes = 1 AND NOT inl AND k % 13 <> 12 AS own FROM s),
b AS (SELECT k, unnest(CASE WHEN k % 17 = 16 THEN ['EN_put'] ELSE ['EN_put', 'put_x'] END) AS port FROM p WHERE own UNION ALL SELECT k, 'RDY_put' FROM p WHERE own AND k % 3 <> 0),
claims AS (SELECT 'source-declaration' AS kind, 'declaration' AS scope, 'd:s' || k AS source, name AS target, '' AS premises FROM s
UNION ALL SELECT 'source-occurrence', 'contract', 'r' || r_regionkey, 'i:r' || r_regionkey, '' FROM region
UNION ALL SELECT CASE WHEN inl THEN 'containing-context' ELSE 'source-occurrence' END, CASE WHEN inl THEN 'context' ELSE 'contract' END, 'n' || n, CASE WHEN inl THEN 'i:r' || r ELSE 'i:n' || n END, 'source-occurrence:r' || r FROM n
UNION ALL SELECT CASE WHEN own THEN 'source-occurrence' ELSE 'containing-context' END, CASE WHEN own THEN 'contract' ELSE 'context' END, 's' || k, CASE WHEN own THEN 'i:s' || k WHEN inl THEN 'i:r' || r ELSE 'i:n' || n END, CASE WHEN inl THEN 'containing-context' ELSE 'source-occurrence' END || ':n' || n FROM p WHERE nodes = 1
UNION ALL SELECT 'method-port-contract', 'contract', 's' || k || '.put', 'mkS.put', 'source-occurrence:s' || k FROM p WHERE own
UNION ALL SELECT 'generated-port', 'contract', 's' || k || '.put', 'i:s' || k || '.' || port, 'method-port-contract:s' || k || '.put' FROM b
UNION ALL SELECT 'ordered-port-binding', 'connectivity', 's' || k || '.put', 'i:s' || k || '.' || port, 'generated-port:s' || k || '.put,method-port-contract:s' || k || '.put,source-occurrence:s' || k FROM b
UNION ALL SELECT 'same-net-contact', 'connectivity', 's' || k || '.put', CASE port WHEN 'EN_put' THEN 'p:n' ELSE 'p:s' END || k, 'ordered-port-binding:s' || k || '.put' FROM b WHERE port <> 'RDY_put')"""


def claimed(spark, d) -> C.Claims:
    nation, supplier = grown(spark, d)
    region = t(spark, d, "region").select(F.col("r_regionkey").alias("r"))
    nation, supplier = nation.withColumn("inl", F.col("n") % 4 == 3), written(supplier.withColumn("inl", F.col("n") % 4 == 3), scratch(spark))
    none = F.expr(NONE)
    r, n, k, inl = F.col("r"), F.col("n"), F.col("k"), F.col("inl")
    instances = union(region.select(text("r", r), none, none, text("mkR", r)), nation.select(text("n", n), text("r", r), text("n", n), F.lit("mkN")), supplier.select(text("s", k), text("n", n), text("s", k), F.lit("mkS"))).toDF("instance", "parent", "name", "definition")
    nodes = supplier.where(k % 7 != 6)
    nodes = nodes.select("*", F.explode(F.when(k % 11 == 10, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("")))).alias("twin"))
    hierarchy = union(
        region.select(text("h:r", r), none, text("mkR", r), text("mkR", r), text("u_r", r)), nation.select(text("h:n", n), text("h:r", r), text("n", n), F.when(~inl, text("mkN", n)), text("u_n", n)),
        nodes.select(text("h:s", k, F.col("twin")), text("h:n", n), text("s", k), F.when(~inl, F.lit("mkS")), text("u_s", k)),
    ).toDF("node", "parent", "name", "module", "unique")
    occurrences = union(
        region.select(text("i:r", r), none, text("u_r", r)), nation.where(~inl).select(text("i:n", n), text("i:r", r), text("u_n", n)), supplier.where(~inl & (k % 13 != 12)).select(text("i:s", k), text("i:n", n), text("u_s", k))
    ).toDF("occurrence", "parent", "name")
    methods = supplier.select(text("s", k).alias("instance"), F.explode(F.when(k % 5 == 4, F.array(F.lit("put"), F.lit("odd"))).otherwise(F.array(F.lit("put")))).alias("method"))
    contracts = spark.createDataFrame([("mkS", "put", "enable", "EN_put"), ("mkS", "put", "argument", "put_x"), ("mkS", "put", "ready", "RDY_put")], "module string, method string, role string, port string")
    generated = spark.createDataFrame([("mkS", "EN_put", 1), ("mkS", "put_x", 2), ("mkS", "RDY_put", 1)], "module string, port string, width int")
    at = text("i:s", k)
    ports = union(
        supplier.select(at, F.lit("EN_put"), F.lit(0), text("b:s", k, ":e")), supplier.where(k % 3 != 0).select(at, F.lit("RDY_put"), F.lit(0), text("b:s", k, ":r")),
        supplier.select("k", F.explode(F.sequence(F.lit(0), F.when(k % 17 == 16, 2).otherwise(1))).alias("i")).select(at, F.lit("put_x"), "i", text("b:s", k, ":x", F.col("i"))),
    ).toDF("occurrence", "port", "position", "bit")
    boundaries = supplier.select(text("b:s", k, ":e").alias("formal"), text("b:n", k, ":e").alias("actual"))
    pins = union(supplier.select(text("b:n", k, ":e"), text("p:n", k)), supplier.select(text("b:s", k, ":x1"), text("p:s", k))).toDF("bit", "pin")
    references = supplier.select(text("d:s", k).alias("source"), F.col("name").alias("range"))
    return C.construct(references, instances, hierarchy, occurrences, methods, contracts, generated, ports, boundaries, pins)


@query(f"WITH {CLAIMED_SQL} SELECT * FROM claims")
def correspondence_claims(spark, d):
    """Every claim of these designs, with the kinds and sources of its premises."""
    claims = written(claimed(spark, d).claims, scratch(spark))
    rests = claims.select("id", F.explode("premises").alias("premise")).join(claims.select(F.col("id").alias("premise"), F.concat_ws(":", "kind", "source").alias("on")), "premise")
    told = rests.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("on")), ",").alias("premises"))
    return claims.drop("premises").join(told, "id", "left").select("kind", "scope", "source", "target", F.coalesce("premises", F.lit("")).alias("premises"))


@query(
    f"WITH {CLAIMED_SQL} SELECT 'context' AS family, 's' || k AS subject, CASE nodes WHEN 0 THEN 'compiler-occurrence-unmapped' WHEN 2 THEN 'ambiguous-occurrence' ELSE 'missing-implementation' END AS reason FROM p WHERE NOT own AND (nodes <> 1 OR NOT inl) UNION ALL SELECT 'contract', 's' || k || '.put', 'inline-or-missing-compiler-method-contract' FROM p WHERE NOT own UNION ALL SELECT 'contract', 's' || k || '.odd', 'inline-or-missing-compiler-method-contract' FROM p WHERE k % 5 = 4 "
    "UNION ALL SELECT 'connectivity', 's' || k || '.put:RDY_put', 'missing-formal' FROM p WHERE own AND k % 3 = 0 UNION ALL SELECT 'connectivity', 's' || k || '.put:put_x', 'width-contradiction' FROM p WHERE own AND k % 17 = 16"
)
def unresolved_claims(spark, d):
    """What could not be claimed, and why."""
    return claimed(spark, d).unresolved


@query(
    f"WITH {CLAIMED_SQL}, x AS (SELECT * FROM p WHERE own AND k % 10 = 0), c AS (SELECT 'method-port-contract' AS kind, 's' || k || '.put' AS source, 'mkS.put' AS target FROM x UNION ALL SELECT 'ordered-port-binding', 's' || k || '.put', 'i:s' || k || '.' || port FROM b WHERE k % 10 = 0) SELECT c.*, unnest(['unknown-premise', 'missing-premise']) AS problem FROM c"
)
def claim_violations(spark, d):
    """What no longer holds when the occurrences of every tenth supplier are no claims any more; with them nothing is wrong."""
    claims = written(claimed(spark, d).claims, scratch(spark))
    dropped = (F.col("kind") == "source-occurrence") & F.col("source").rlike("^s[0-9]*0$")
    wrong = C.violations(claims.where(~dropped)).unionByName(C.violations(claims))
    return wrong.join(claims, "id").select("kind", "source", "target", "problem")


ORIGIN_SQL = "c AS (SELECT 'c' || row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_partkey AS entity, l_suppkey AS occurrence, l_linenumber AS semantic, l_returnflag AS revision FROM lineitem), q AS (SELECT p_partkey AS request, p_partkey AS entity, CASE WHEN p_size % 3 = 0 THEN p_size % 7 + 1 END AS semantic, CASE p_size % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'Z' END AS revision, p_size % 10 = 9 AS complete FROM part)"


@query(f"WITH {ORIGIN_SQL}, m AS (SELECT request, count(*) AS n, count(DISTINCT occurrence) AS places FROM q JOIN c ON c.entity = q.entity AND (q.semantic IS NULL OR c.semantic = q.semantic) AND (q.revision IS NULL OR c.revision = q.revision) WHERE NOT complete AND coalesce(q.revision, 'R') <> 'Z' GROUP BY 1) SELECT request, CASE WHEN revision = 'Z' THEN 'stale' WHEN n IS NULL THEN 'unmapped' WHEN places > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution, coalesce(n, 0) AS n, coalesce(n > 12, false) AS truncated FROM q LEFT JOIN m USING (request)")
def claim_origins(spark, d):
    """Order lines as claims of origin, parts as requests for them; more than twelve claims are cut."""
    s = lambda c: F.col(c).cast("string")
    lines = t(spark, d, "lineitem")
    claims = lines.select(F.concat_ws(".", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("id"), s("l_partkey").alias("entity"), s("l_suppkey").alias("occurrence"), s("l_linenumber").alias("semantic"), F.lit("t").alias("token"), F.col("l_returnflag").alias("revision"))
    size = F.col("p_size")
    requests = t(spark, d, "part").select(F.col("p_partkey").alias("request"), s("p_partkey").alias("entity"), F.when(size % 3 == 0, (size % 7 + 1).cast("string")).alias("semantic"), F.expr(NONE).alias("token"), F.when(size % 4 == 0, "R").when(size % 4 == 1, "Z").alias("revision"), (size % 10 == 9).alias("complete"))
    return C.origins(claims, lines.select(F.col("l_returnflag").alias("revision")), requests, limit=12)[0]


# ---- projection

MODEL_SQL = """n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), s AS (SELECT s_suppkey AS k, n.* FROM supplier JOIN n ON s_nationkey = n), o AS (SELECT o_orderkey AS o, o_custkey AS c, c_nationkey AS n, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || l_quantity AS id, l_suppkey AS k, c, n, l_returnflag AS flag, l_linenumber % 7 = 0 AS link FROM lineitem JOIN o ON l_orderkey = o),
fl AS (SELECT id, 'e:s' || k AS src, CASE WHEN flag = 'N' THEN 'c' || c ELSE 'e:n' || n END AS dst, CASE flag WHEN 'R' THEN 'payload' WHEN 'A' THEN 'invoke' ELSE 'state-write' END AS kind, link, k, n FROM f),
used AS (SELECT src AS node FROM fl WHERE NOT link UNION SELECT dst FROM fl WHERE NOT link UNION SELECT 'e:n' || n FROM s WHERE k % 2 = 0 UNION SELECT 'e:s' || k FROM s WHERE k % 2 = 0),
nd AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, 'instance' AS kind FROM region UNION ALL SELECT 'n' || n, 'r' || r, 'instance' FROM n UNION ALL SELECT 's' || k, 'n' || n, 'instance' FROM s UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'register' FROM customer
UNION ALL SELECT 'o' || o, 'n' || n, CASE st WHEN 'F' THEN 'rule' ELSE 'method' END FROM o UNION ALL SELECT 'ch:s' || k, 's' || k, 'protocol-channel' FROM s WHERE k % 3 = 0
UNION ALL SELECT 'e:s' || k, 's' || k, 'endpoint' FROM s WHERE 'e:s' || k IN (SELECT node FROM used) UNION ALL SELECT 'e:n' || n, 'n' || n, 'endpoint' FROM n WHERE 'e:n' || n IN (SELECT node FROM used)
UNION ALL SELECT 'n' || n || ':' || p_brand, 'n' || n, 'function' FROM n, (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'boundary:r' || r_regionkey || ':' || side, NULL, 'root-boundary' FROM region, (VALUES ('inbound'), ('outbound')) AS v(side)),
ed AS (SELECT parent AS src, node AS dst, CASE WHEN kind = 'instance' THEN 'instance-child' ELSE 'contains' END AS kind, 'containment' AS role, NULL AS id FROM nd WHERE parent IS NOT NULL
UNION ALL SELECT src, dst, kind, 'flow', id FROM fl WHERE NOT link UNION ALL SELECT 's' || k, 'n' || n, kind, 'aggregate', id FROM fl WHERE kind = 'payload'
UNION ALL SELECT CASE WHEN k % 6 = 0 THEN 'boundary:r' || r || ':inbound' ELSE 'ch:s' || k END, CASE WHEN k % 6 = 0 THEN 'ch:s' || k ELSE 'boundary:r' || r || ':outbound' END, CASE WHEN k % 6 = 0 THEN 'boundary-input' ELSE 'boundary-output' END, 'boundary', 'r' || r || ':ch:s' || k || CASE WHEN k % 6 = 0 THEN ':inbound' ELSE ':outbound' END FROM s WHERE k % 3 = 0
UNION ALL SELECT 'n' || n, CASE WHEN k % 3 = 0 THEN 'ch:s' || k ELSE 's' || k END, 'interface-forward', 'forward', 'w' || k FROM s WHERE k % 2 = 0
UNION ALL SELECT 'o' || a.o, 'o' || b.o, 'sequential-before', 'schedule', 'q' || a.o FROM o a JOIN o b ON b.o = a.o + 1)"""


def model(spark, d) -> P.Model:
    nation, supplier = grown(spark, d)
    none, n, k, r = F.expr(NONE), F.col("n"), F.col("k"), F.col("r")
    customer = t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st")).join(customer, "c")
    regions = t(spark, d, "region").select(text_key("r", "r_regionkey").alias("root"))
    instances = union(regions.select("root", none, F.lit("R"), none), nation.select(text("n", n), text("r", r), F.lit("N"), none), supplier.select(text("s", k), text("n", n), F.lit("S"), none), customer.select(text("c", F.col("c")), text("n", n), none, F.lit("register")))
    lines = t(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o"))
    flag = F.col("l_returnflag")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    flows = lines.select(text("l", F.concat_ws(".", *parts)).alias("id"), text_key("e:s", "l_suppkey").alias("src"), F.when(flag == "N", text("c", F.col("c"))).otherwise(text("e:n", n)).alias("dst"), F.when(flag == "R", "payload").when(flag == "A", "invoke").otherwise("state-write").alias("kind"), (F.col("l_linenumber") % 7 == 0).alias("link"))
    channel = supplier.where(k % 3 == 0)
    direction = F.when(k % 6 == 0, P.INWARD).otherwise(P.OUTWARD)
    following = orders.select(F.col("o").alias("next"))
    return P.Model(
        instances=instances.toDF("node", "parent", "definition", "primitive"),
        behaviours=orders.select(text("o", F.col("o")).alias("node"), text("n", n).alias("owner"), F.when(F.col("st") == "F", "rule").otherwise("method").alias("kind")),
        channels=channel.select(text("ch:s", k).alias("node"), text("s", k).alias("owner")),
        channel_methods=channel.select(text("ch:s", k).alias("channel"), text("e:s", k).alias("endpoint")),
        endpoints=supplier.select(text("e:s", k).alias("node"), text("s", k).alias("owner")).union(nation.select(text("e:n", n), text("n", n))),
        members=t(spark, d, "part").select(F.lit("N").alias("definition"), F.col("p_brand").alias("member"), F.lit("function").alias("kind")).distinct(),
        roots=regions,
        exposures=channel.select(text("r", r).alias("root"), text("ch:s", k).alias("channel"), direction.alias("direction")),
        flows=flows,
        forwards=supplier.select(text("w", k).alias("id"), text("s", k).alias("owner"), text("e:n", n).alias("outer"), text("e:s", k).alias("inner"), F.when(k % 2 == 0, "exact").otherwise("unresolved").alias("status")),
        schedules=orders.join(following, F.col("o") + 1 == F.col("next")).select(text("q", F.col("o")).alias("id"), text("o", F.col("o")).alias("src"), text("o", F.col("next")).alias("dst"), F.lit("sequential-before").alias("kind")),
    )


@query(f"WITH {MODEL_SQL} SELECT 'node' AS what, node AS a, parent AS b, kind, NULL AS role, NULL AS id FROM nd UNION ALL SELECT 'edge', src, dst, kind, role, id FROM ed")
def projected_model(spark, d):
    """The whole model as nodes and edges."""
    nodes, edges = P.projected(model(spark, d))
    none = F.expr(NONE)
    return nodes.select(F.lit("node").alias("what"), F.col("node").alias("a"), F.col("parent").alias("b"), "kind", none.alias("role"), none.alias("id")).union(edges.select(F.lit("edge"), "src", "dst", "kind", "role", "id"))


# ---- scenes

ASKED_SQL = "q AS (SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || l_quantity AS request, l_linenumber AS ln, s_suppkey AS k, s_nationkey AS sn, a.n_regionkey AS sr, c_custkey AS c, c_nationkey AS cn, b.n_regionkey AS cr FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)"


@query(
    f"WITH {ASKED_SQL}, x AS (SELECT *, CASE WHEN ln = 1 THEN sn ELSE cn END AS tn, CASE WHEN ln = 1 THEN sr ELSE cr END AS tr FROM q), y AS (SELECT *, CASE WHEN ln = 2 AND sr <> 0 THEN 'foreign-root' WHEN ln = 3 THEN 'unknown-target' WHEN ln = 1 AND k % 3 = 0 THEN 'owner-preserved' WHEN sn = tn AND sn % 2 = 0 OR sr = tr THEN 'owner-broadened' ELSE 'unavailable' END AS status FROM x) "
    "SELECT request, status, CASE status WHEN 'owner-preserved' THEN 's' || k WHEN 'owner-broadened' THEN CASE WHEN sn = tn AND sn % 2 = 0 THEN 'n' || sn ELSE 'r' || sr END END AS owner, CASE status WHEN 'owner-preserved' THEN 'i:s' || k WHEN 'owner-broadened' THEN CASE WHEN sn = tn AND sn % 2 = 0 THEN 'i:n' || sn ELSE 'i:r' || sr END END AS anchor FROM y"
)
def reveal_targets(spark, d):
    """Every order line asks its supplier for its customer, or for itself: the supplier, its nation or its region may show that."""
    nation, supplier = grown(spark, d)
    n, k, r, none = F.col("n"), F.col("k"), F.col("r"), F.expr(NONE)
    regions = t(spark, d, "region").select(F.col("r_regionkey").alias("r"))
    owners = union(regions.select(text("r", r), none), nation.select(text("n", n), text("r", r)), supplier.select(text("s", k), text("n", n))).toDF("node", "parent")
    customers = t(spark, d, "customer").select(text_key("i:c", "c_custkey"), text_key("i:n", "c_nationkey"))
    occurrences = union(regions.select(text("i:r", r), none), nation.select(text("i:n", n), text("i:r", r)), supplier.select(text("i:s", k), text("i:n", n)), customers).toDF("node", "parent")
    contexts = union(regions.select(text("r", r), text("i:r", r)), nation.where(n % 2 == 0).select(text("n", n), text("i:n", n)), supplier.where(k % 3 == 0).select(text("s", k), text("i:s", k))).toDF("owner", "anchor")
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    number = F.col("l_linenumber")
    target = F.when(number == 1, text_key("i:s", "l_suppkey")).when(number == 3, "i:none").otherwise(text_key("i:c", "o_custkey"))
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    requests = lines.select(F.concat_ws(".", *parts).alias("request"), text_key("s", "l_suppkey").alias("owner"), F.when(number == 2, "r0").alias("root"), target.alias("target"))
    return views.revealed(owners, contexts, occurrences, requests)


@query("WITH m AS (SELECT c_nationkey AS n, c_custkey AS c, c_custkey % 3 = 0 AS reg FROM customer), k AS (SELECT n, count(*) FILTER (reg) > 16 AS crowded FROM m GROUP BY n), p AS (SELECT o_orderkey, o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) AS b FROM orders), e AS (SELECT 'n' || x.n AS owner, 'q' || o_orderkey AS relation, x.c AS a, y.c AS b, x.reg AS ra, y.reg AS rb, x.n AS na, y.n AS nb, CASE WHEN o_orderkey % 2 = 0 THEN 'state-read' ELSE 'payload' END AS kind, crowded FROM p JOIN m x ON x.c = a JOIN m y ON y.c = b JOIN k ON k.n = x.n), z AS (SELECT *, CASE WHEN kind = 'state-read' AND crowded AND (ra OR na = nb AND rb) THEN 'on-selection' WHEN na = nb AND a % 5 = b % 5 THEN 'folded' WHEN na <> nb THEN 'continuation' ELSE 'connection' END AS fate FROM e) SELECT owner, relation, fate, CASE WHEN fate IN ('connection', 'continuation') THEN 'g' || a % 5 END AS src, CASE WHEN fate IN ('connection', 'continuation') THEN CASE WHEN na = nb THEN 'g' || b % 5 ELSE 'beyond' END END AS dst, kind FROM z")
def scene_relations(spark, d):
    """A nation's scene shows its customers as five groups: what becomes of who orders after whom."""
    from pyspark.sql import Window

    customer = t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    own = customer.select(text("n", F.col("n")), text("c", F.col("c")), text("g", F.col("c") % 5), F.when(F.col("c") % 3 == 0, "register").otherwise("instance"), F.lit(False)).toDF("owner", "node", "shown", "kind", "outside")
    order = Window.partitionBy(F.expr("o_orderkey div 8")).orderBy("o_orderkey")
    pairs = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), F.lead("o_custkey").over(order).alias("b")).where("b is not null")
    at = lambda x: customer.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"))
    met = pairs.join(at("a"), "a").join(at("b"), "b")
    relations = met.select(text("n", F.col("na")).alias("owner"), text_key("q", "o_orderkey").alias("relation"), text("c", F.col("a")).alias("src"), text("c", F.col("b")).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "state-read").otherwise("payload").alias("kind"))
    beyond = met.where("na <> nb").select(text("n", F.col("na")), text("c", F.col("b")), F.lit("beyond"), F.lit("outside"), F.lit(True)).distinct()
    return views.scenes(own.union(beyond), relations)


# ---- presentations, provenance and statements

@query("WITH c AS (SELECT DISTINCT l_orderkey AS reference, l_partkey AS node, ['exact', 'occurrence', 'member', 'container'][l_linenumber % 4 + 1] AS role, l_linenumber % 4 + 1 AS rk FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 3 <> 0), b AS (SELECT reference, node, min(rk) AS rk FROM c GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY rk, 'p' || node) AS nth, min(rk) OVER (PARTITION BY reference) AS f FROM b), z AS (SELECT *, count(*) FILTER (rk = f) OVER (PARTITION BY reference) > 1 AS amb FROM w) SELECT o_orderkey AS reference, coalesce(nth, 1) AS nth, 'p' || node AS node, ['exact', 'occurrence', 'member', 'container'][rk] AS role, CASE WHEN node IS NULL THEN 'none' WHEN amb THEN 'ambiguous' ELSE 'exact' END AS status FROM orders LEFT JOIN z ON reference = o_orderkey")
def source_presentations(spark, d):
    """Orders as references and their lines' parts as what may stand for them, in roles by line number; parts of every third size are not shown."""
    roles = F.get(F.array(*map(F.lit, P.ROLES)), F.col("l_linenumber") % 4)
    candidates = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("reference"), text_key("p", "l_partkey").alias("node"), roles.alias("role"))
    shown = t(spark, d, "part").where("p_size % 3 <> 0").select(text_key("p", "p_partkey").alias("node"))
    return P.presentations(t(spark, d, "orders").select(F.col("o_orderkey").alias("reference")), candidates, shown)


@query("SELECT event_id, 'Source-derived' AS analysis_origin, CASE WHEN event_id % 5 = 0 THEN 'explicit' WHEN event_type = 'error' THEN 'unresolved' ELSE 'exact' END AS confidence, coalesce(nullif(props, ''), event_type) AS evidence, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS location FROM events")
def event_provenance(spark, d):
    """Every fifth event says how sure it is; the others get that from their type."""
    rows = t(spark, d, "events").withColumn("evidence", F.col("props")).withColumn("confidence", F.when(F.col("event_id") % 5 == 0, "explicit").otherwise(""))
    told = P.with_provenance(rows, F.when(F.col("event_type") == "error", "unresolved").otherwise("exact"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, text_key("u", "user_id")))
    return told.select("event_id", "analysis_origin", "confidence", "evidence", "location")


STATEMENTS_SQL = "s AS (SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 4 WHEN 0 THEN 'return' WHEN 1 THEN 'assignment' ELSE 'call' END AS kind, o_orderstatus = 'P' AS bad FROM orders), b AS (SELECT l_orderkey AS k, arg_min('p' || l_partkey, [l_linenumber, l_partkey]) AS binding FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey AS k, string_agg(CASE WHEN l_returnflag = 'R' THEN '!' ELSE '' END || 's' || l_suppkey, ',' ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN '!' ELSE '' END || 's' || l_suppkey) AS conditions FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)"


@query(f"WITH {STATEMENTS_SQL}, r AS (SELECT *, CASE WHEN bad THEN 'unsupported-statement' WHEN kind = 'return' THEN 'return' WHEN kind = 'assignment' THEN 'assignment' END AS relation FROM s) SELECT 'c' || c AS callable, row_number() OVER (PARTITION BY c ORDER BY k) AS nth, 'o' || k AS statement, kind, binding, coalesce(conditions, '') AS conditions, relation, CASE relation WHEN 'return' THEN 'x' || k WHEN 'assignment' THEN 'y' || k END AS src, CASE relation WHEN 'return' THEN 'c' || c WHEN 'assignment' THEN 'o' || k END AS dst FROM r LEFT JOIN b USING (k) LEFT JOIN w USING (k)")
def statement_slices(spark, d):
    """Customers as callables and their orders as statements; lines are what these bind and the conditions that they stand under."""
    lines, orders, key = t(spark, d, "lineitem"), t(spark, d, "orders"), F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "return").when(key % 4 == 1, "assignment").otherwise("call")
    statements = orders.select(text("o", key).alias("statement"), text_key("c", "o_custkey").alias("callable"), key.alias("position"), kind.alias("kind"), F.when(key % 4 == 0, text("x", key)).alias("expression"), F.when(key % 4 == 1, text("y", key)).alias("right"), F.when(F.col("o_orderstatus") == "P", "unsupported").otherwise("exact").alias("status"))
    bindings = lines.select(text_key("p", "l_partkey").alias("binding"), text_key("o", "l_orderkey").alias("statement"), F.struct("l_linenumber", "l_partkey").alias("position"))
    conditions = lines.where("l_linestatus = 'O'").select(text_key("o", "l_orderkey").alias("statement"), F.col("l_linenumber").alias("position"), text_key("s", "l_suppkey").alias("expression"), (F.col("l_returnflag") == "R").alias("negated"))
    return P.statement_details(statements, bindings, conditions).withColumn("conditions", F.array_join("conditions", ","))


# ---- symbols

SOURCES_SQL = "c AS (SELECT c_custkey AS k, 'N' || c_nationkey || '_' || c_custkey // 200 AS m FROM customer), m AS (SELECT DISTINCT m FROM c)"


def sources(spark, d) -> DataFrame:
    """id, text: a package for each nation and 200 customer numbers; every third customer is a block of an interface with one inside, every other an alias."""
    k = F.col("c_custkey")
    state = text("  Reg#(Bit#(8)) c", k, " <- mkReg(0);\n  rule r", k, " (c", k, " > 0);\n    c", k, " <= 0; // interface Fake f;\n  endrule\n")
    block = text("  interface Put#(Bit#(8)) p", k, ";\n    method Action put(Bit#(8) x); endmethod\n    interface g", k, "; interface Get#(Bit#(8)) deep = q", k, ".port; endinterface\n  endinterface\n")
    offer = F.when(k % 3 == 0, block).otherwise(text("  interface Get a", k, " = c", k, "\n    .out;\n"))
    name = text("N", F.col("c_nationkey"), "_", F.col("block"))
    lists = t(spark, d, "customer").groupBy("c_nationkey", F.expr("c_custkey div 200").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, F.concat(state, offer).alias("x")))), lambda v: v["x"]), "").alias("body"))
    head = text("package ", name, ";\ntypedef enum {A, B} T", name, " deriving (Eq);\ninterface Ifc", name, ";\n  method Action put(Bit#(8) x);\nendinterface\nfunction Bit#(8) f", name, "(Bit#(8) x) = x;\nmodule mk", name, "(Ifc", name, ");\n")
    return lists.select(name.alias("id"), F.concat(head, F.col("body"), F.lit("  method Action put(Bit#(8) x);\n  endmethod\nendmodule\nendpackage\n")).alias("text"))


def bodies(spark, d) -> DataFrame:
    return written(sources(spark, d).select("id", X.masked("text").alias("text")), scratch(spark))


@query(f"WITH {SOURCES_SQL} SELECT m AS id, unnest(['p' || k, 'p' || k || '.g' || k, 'p' || k || '.g' || k || '.deep']) AS path, unnest([1, 2, 3]) AS depth, unnest(['Put#(Bit#(8))', 'inferred', 'Get#(Bit#(8))']) AS type, unnest(['block', 'block', 'alias']) AS form, unnest([NULL, NULL, 'q' || k || '.port']) AS target, true AS complete FROM c WHERE k % 3 = 0 UNION ALL SELECT m, 'a' || k, 1, 'Get', 'alias', 'c' || k || ' .out', true FROM c WHERE k % 3 <> 0")
def provided_interfaces(spark, d):
    modules = bodies(spark, d).select("id", F.regexp_extract("text", r"(?s)\bmodule\b.*", 0).alias("text"))
    return symbols.provided_interfaces(modules).drop("start", "end")


@query(f"WITH {SOURCES_SQL} SELECT m AS id, unnest(['package', 'type', 'interface', 'method', 'function', 'module', 'method']) AS kind, unnest([m, 'T' || m, 'Ifc' || m, 'put', 'f' || m, 'mk' || m, 'put']) AS name, unnest([NULL, 'enum', NULL, 'Action', 'Bit#(8)', 'Ifc' || m, 'Action']) AS detail, unnest([NULL, m, m, 'Ifc' || m, m, m, 'mk' || m]) AS parent FROM m UNION ALL SELECT m, unnest(['instance', 'rule']), unnest(['c' || k, 'r' || k]), unnest(['Reg#(Bit#(8)) <- mkReg', '(c' || k || ' > 0)']), 'mk' || m FROM c")
def document_symbols(spark, d):
    return symbols.document_symbols(bodies(spark, d)).select("id", "kind", "name", "detail", "parent")


@query("SELECT p_partkey AS part, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'Bit#(' || p_size || ')' ELSE 'Maybe#(Vector#(2, Bit#(8)))' END AS returns, 'f' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'Bit#(8) x, Vector#(2, Maybe#(t)) y' END AS parameters FROM part")
def function_signatures(spark, d):
    """A function for every part, of which other declarations stand only in comments."""
    size, key = F.col("p_size"), F.col("p_partkey")
    returns = F.when(size % 3 == 0, "").when(size % 3 == 1, text("Bit#(", size, ") ")).otherwise("Maybe#(Vector#(2, Bit#(8))) ")
    given = F.when(size % 2 == 0, "Bit#(8) x, Vector#(2, Maybe#(t)) y").otherwise("")
    content = text("// function Bool no(Bool x) = x;\nfunction ", returns, "f", key, "(", given, ")", F.when(size % 5 == 0, " provisos (Bits#(t, n))").otherwise(""), F.when(size % 4 == 0, ";\n  return 0;\nendfunction\n").otherwise(" = 0;\n"))
    docs = X.with_masked(t(spark, d, "part").select(key.alias("path"), content.alias("content")))
    return X.functions(docs).select(F.col("path").alias("part"), "returns", "name", "parameters")


# ---- exports and publication

@query("SELECT 'nation' AS section, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'part', p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_name || '\"' || chr(10) || 'ü' END FROM part")
def exported_model(spark, d):
    """Three tables written as one export and read back by its manifest, names with line ends and nulls too."""
    from tracelake.sources import export

    tables = {
        "nation": t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")),
        "customer": t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")),
        "part": t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 4 != 0, F.concat("p_name", F.lit('"\nü'))).alias("name")),
    }
    path = scratch(spark)
    export.write_model(tables, path)
    model = export.read_model(spark, path)
    return union(*(export.table_of(model, s, "k long, name string").select(F.lit(s).alias("section"), "k", "name") for s in tables))


@query("WITH v AS (SELECT * FROM events WHERE value >= 20) SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM v GROUP BY user_id")
def published_latest(spark, d):
    """Events as a stream of eight batches, mixed in time: the last valid one of every user, those of under 20 are refused."""
    from tracelake.streaming.incremental import run_until_done
    from tracelake.streaming.publication import Published

    folder = scratch(spark)
    events = t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    events.repartition(8, F.col("event_id") % 64).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    table = Published(spark, f"{folder}/out", "user_id", "event_id", buckets=16)
    if not run_until_done(table.stream(stream, f"{folder}/checkpoint", F.col("value") >= 20), seconds=3600):
        raise RuntimeError("the stream did not end")
    return table.read()


# ---- seeds and producers

@query("WITH p AS (SELECT o_custkey AS cell, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_custkey AS seed, c_nationkey % 4 = 1 AS bad FROM customer) SELECT seed, 'o' || o_orderkey AS pin, CASE n WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM s JOIN p ON cell = seed JOIN orders ON o_custkey = cell WHERE NOT bad UNION ALL SELECT seed, NULL, 'invalid' FROM s LEFT JOIN p ON cell = seed WHERE bad OR n IS NULL")
def cell_seeds(spark, d):
    """Customers as cells with their orders as pins; a quarter of the nations asks with indices."""
    from tracelake.operators import calls

    nations = t(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("occurrence"))
    pins = t(spark, d, "orders").select(F.col("o_custkey").alias("cell"), text_key("o", "o_orderkey").alias("pin")).join(nations, "cell")
    seeds = nations.select(F.col("cell").alias("seed"), "cell", "occurrence", F.when(F.col("occurrence") % 4 == 1, F.array(F.lit(0))).alias("indices"))
    return calls.cell_seeds(pins, seeds)


@query("WITH l AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || l_quantity AS id, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT a.id AS call, 1 AS position, 'm' || a.p AS expression, 'b' || b.id AS binding, 's' || b.s AS endpoint, count(*) OVER (PARTITION BY a.id, a.p) AS n FROM (SELECT DISTINCT id, p, c FROM l) a JOIN l b ON a.c = b.c AND a.p = b.p AND b.flag = 'R') SELECT call, position, expression, binding, endpoint, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'exact' END AS status FROM m")
def call_producers(spark, d):
    """Every line passes on its part, by way of an operand: what the customer's returned lines of that part bind is produced there."""
    from tracelake.operators import calls

    lines = t(spark, d, "lineitem").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    lines = lines.withColumns({"id": F.concat_ws(".", *parts), "behaviour": text_key("c", "o_custkey"), "statement": text_key("t", "l_partkey")})
    # equal lines of an order are one call: they are told apart where the join has them, by order
    again = F.row_number().over(Window.partitionBy("l_orderkey", "id", "behaviour").orderBy(F.lit(0))) > 1
    lines = written(lines.select("id", "behaviour", "statement", "l_partkey", "l_suppkey", "l_returnflag", again.alias("again")), scratch(spark))
    passed = lines.where("not again").select(F.col("id").alias("call"), F.lit(1).alias("position"), text("x", F.col("id")).alias("expression"), F.col("behaviour").alias("caller"))
    key = t(spark, d, "part").select("p_partkey")
    inside = union(lines.select(text("x", F.col("id")), text_key("p", "l_partkey")), key.select(text_key("p", "p_partkey"), text_key("m", "p_partkey")), key.select(text_key("m", "p_partkey"), text_key("p", "p_partkey"))).toDF("expression", "part")
    references = key.select(text_key("m", "p_partkey").alias("expression"), text_key("t", "p_partkey").alias("statement"), F.lit("0:0").alias("place"))
    bindings = lines.where("l_returnflag = 'R'").select(text("b", F.col("id")).alias("binding"), "behaviour", "statement", F.lit("0:0").alias("place"), text_key("s", "l_suppkey").alias("endpoint"))
    return calls.producers(passed, inside, references, bindings)
