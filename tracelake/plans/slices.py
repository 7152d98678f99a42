"""Queries of the question operators over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import questions as Q
from tracelake.plans.relational import t, text_key

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


PLACED = "WITH RECURSIVE up AS (SELECT o_orderkey AS node, o_orderkey AS anc, CAST(0 AS BIGINT) AS depth FROM orders UNION ALL SELECT node, anc // 7, depth + 1 FROM up WHERE anc // 7 <> anc AND anc // 7 IN (SELECT o_orderkey FROM orders)), placed AS (SELECT node, min(anc) AS root, arg_min(depth, anc) AS depth FROM up WHERE anc IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey = 3) GROUP BY node)"


def placed(spark, d):
    """Orders as instances below the order of a seventh of their number; urgent ones are roots, the least one first."""
    orders = t(spark, d, "orders")
    instances = orders.select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 7").alias("parent"))
    roots = orders.where("o_orderpriority = '1-URGENT' or o_orderkey = 3").select(F.col("o_orderkey").alias("node"), F.col("o_orderkey").alias("nth"))
    return Q.topology(instances, roots)


@query(f"{PLACED} SELECT * FROM placed")
def topology(spark, d):
    return placed(spark, d)


@query(f"{PLACED} SELECT root, count(*) FILTER (depth > 0) AS descendants, CAST(coalesce(sum(n), 0) AS BIGINT) AS channels FROM placed LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON node = l_orderkey GROUP BY root")
def root_headers(spark, d):
    return Q.root_headers(placed(spark, d), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("channel")))


def expressions(spark, d):
    key = F.col("o_orderkey")
    none = F.lit(None).cast("array<bigint>")
    lists = (F.array(F.expr("o_orderkey div 3")), F.when(key % 4 > 0, F.array(F.expr("o_orderkey div 5"), F.expr("o_orderkey div 3"))), F.when(key % 2 > 0, F.array(-key)).otherwise(none))
    return t(spark, d, "orders").select(key.alias("expression"), *(x.alias(n) for x, n in zip(lists, ("operands", "definitions", "arguments"))))


EDGES = "e AS (SELECT o_orderkey AS dst, o_orderkey // 3 AS src FROM orders UNION SELECT o_orderkey, o_orderkey // 5 FROM orders WHERE o_orderkey % 4 > 0)"


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node AND e.src <> e.dst JOIN orders ON o_orderkey = e.src) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def source_dependencies(spark, d):
    """What the expressions of urgent orders are made of."""
    seeds = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))
    return Q.source_dependencies(expressions(spark, d), seeds).select("node", "depth")


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey IN (1, 2) UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node AND e.src <> e.dst WHERE depth < 4) SELECT node, CASE WHEN min(depth) = 4 AND node IN (SELECT e.src FROM e WHERE e.src <> e.dst) THEN 'depth' END AS reason, min(depth) AS depth FROM r GROUP BY node")
def source_dependents(spark, d):
    """What two expressions go into, to four levels."""
    seeds = t(spark, d, "orders").where("o_orderkey in (1, 2)").select(F.col("o_orderkey").alias("node"))
    return Q.source_dependencies(expressions(spark, d), seeds, "forward", 4).select("node", "depth", "reason")


@query("SELECT c_custkey AS behaviour, 'statement' AS part, s_suppkey AS id FROM customer JOIN supplier ON c_nationkey = s_nationkey UNION ALL SELECT c_custkey, 'binding', o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'call', p_partkey FROM customer JOIN part ON p_size % 25 = c_nationkey AND p_type = 'PROMO'")
def behaviour_slices(spark, d):
    parts = {
        "statement": t(spark, d, "supplier").select(F.col("s_nationkey").alias("definition"), F.col("s_suppkey").alias("id")),
        "binding": t(spark, d, "orders").select(F.col("o_custkey").alias("behaviour"), F.col("o_orderkey").alias("id")),
        "call": t(spark, d, "part").where("p_type = 'PROMO'").select((F.col("p_size") % 25).alias("definition"), F.col("p_partkey").alias("id")),
    }
    return Q.behaviour_slices(t(spark, d, "customer").select(F.col("c_custkey").alias("behaviour"), F.col("c_nationkey").alias("definition")), parts)


@query("WITH c AS (SELECT conv_id AS call, CASE WHEN conv_id % 7 > 0 THEN conv_id % 5 + 1 END AS target, count(*) AS n FROM conversations GROUP BY conv_id) SELECT call, turn AS position, length(text) AS expression, CASE WHEN n = target THEN 'f' || target || '_' || turn END AS formal, CASE WHEN n = target THEN 'exact' ELSE 'unresolved' END AS status, CASE WHEN target IS NULL THEN 'unresolved-call-target' WHEN n <> target THEN 'arity' END AS reason FROM c JOIN conversations ON conv_id = call")
def call_mappings(spark, d):
    """Conversations as calls with their turns as arguments, of functions with one to five formals."""
    turns = t(spark, d, "conversations")
    calls = turns.select(F.col("conv_id").alias("call")).distinct().withColumn("target", F.when(F.col("call") % 7 > 0, F.col("call") % 5 + 1))
    formals = spark.range(1, 6).select(F.col("id").alias("target"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("position"))
    formals = formals.withColumn("formal", F.concat(F.lit("f"), F.col("target").cast("string"), F.lit("_"), F.col("position").cast("string")))
    return Q.call_mappings(calls, turns.select(F.col("conv_id").alias("call"), F.col("turn").alias("position"), F.length("text").cast("long").alias("expression")), formals)


@query("WITH c AS (SELECT c_custkey, n_nationkey, n_regionkey, 'n' || n_nationkey AS nation, 'r' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT o_orderkey, c.* FROM orders JOIN c ON o_custkey = c_custkey) SELECT 'r' || n_regionkey AS instance, 'child' AS role, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT nation, 'endpoint', 'c' || c_custkey FROM c UNION ALL SELECT nation, 'payload', 'o' || o_orderkey FROM b UNION ALL SELECT region, 'payload', 'o' || o_orderkey FROM b")
def instance_composition(spark, d):
    """Regions hold nations, these customers; an order goes from a customer to its region."""
    nation = t(spark, d, "nation").select(text_key("n", "n_nationkey").alias("nation"), text_key("r", "n_regionkey").alias("region"), F.col("n_nationkey").alias("c_nationkey"))
    instances = nation.select(F.col("nation").alias("instance"), F.col("region").alias("parent"))
    instances = instances.union(nation.select("region", F.lit(None).cast("string")).distinct())
    customer = t(spark, d, "customer").join(nation, "c_nationkey")
    members = customer.select(F.col("nation").alias("instance"), F.lit("endpoint").alias("role"), text_key("c", "c_custkey").alias("id"))
    orders = t(spark, d, "orders").join(customer.select("c_custkey", "region"), F.col("o_custkey") == F.col("c_custkey"))
    return Q.composition(instances, members, orders.select(text_key("o", "o_orderkey").alias("id"), F.lit("payload").alias("role"), text_key("c", "o_custkey").alias("src"), F.col("region").alias("dst")))


@query("SELECT p_partkey AS channel, role, endpoint FROM (SELECT p_partkey, unnest(['put', 'get']) AS role, unnest([p_partkey, p_partkey + 1]) AS endpoint FROM part) WHERE endpoint IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def channel_members(spark, d):
    part, key = t(spark, d, "part"), F.col("p_partkey")
    return Q.channel_members(part.select(key.alias("channel"), F.create_map(F.lit("put"), key, F.lit("get"), key + 1).alias("methods")), part.where("p_size > 10").select(key.alias("endpoint")))


SCOPE = "WITH RECURSIVE i AS (SELECT p_partkey AS path, (p_partkey * 13 + 2) // 3 % 1500 AS imported FROM part WHERE p_size % 3 = 0), e AS (SELECT path, p_partkey AS dst FROM i JOIN part ON p_partkey % 1000 = imported UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_name || a.p_brand || a.p_size = b.p_name || b.p_brand || b.p_size), r AS (SELECT p_partkey AS path FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#5' UNION SELECT dst FROM r JOIN e USING (path))"


def scope(spark, d):
    part, key = t(spark, d, "part"), F.col("p_partkey")
    files = part.select(key.alias("path"), (key % 1000).alias("package"))
    imports = part.where("p_size % 3 = 0").select(key.alias("path"), F.expr("(p_partkey * 13 + 2) div 3 % 1500").alias("imported"))
    names = part.select(key.alias("path"), F.concat("p_name", "p_brand", F.col("p_size").cast("string")).alias("name"))
    return Q.source_scope(files, imports, names, names, part.where("p_type = 'PROMO' and p_brand = 'Brand#5'").select(key.alias("path")))


@query(f"{SCOPE} SELECT p_partkey AS path, p_partkey IN (SELECT path FROM r) AS included FROM part")
def source_scope(spark, d):
    """The files that offers of a brand need, over imports and over constructed modules of a name."""
    return scope(spark, d)[0]


@query(f"{SCOPE} SELECT DISTINCT path, imported FROM i JOIN r USING (path) WHERE imported NOT IN (SELECT p_partkey % 1000 FROM part)")
def unresolved_imports(spark, d):
    return scope(spark, d)[1]


@query("WITH x AS (SELECT DISTINCT l_suppkey AS uri, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS col, l_linenumber AS end_line, CAST(l_quantity AS INTEGER) AS end_col FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT l_suppkey AS uri, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS col FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey, 1, 0 FROM supplier) SELECT x.*, y.uri IS NOT NULL AS owned FROM x LEFT JOIN y ON x.uri = y.uri AND x.line = y.line AND x.col = y.col")
def owned_locations(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("uri"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("col"), "l_returnflag")
    none = lambda c: F.lit(None).cast("int").alias(c)
    ends = lines.withColumns({"end_line": F.lit(None).cast("int"), "end_col": F.lit(None).cast("int")})
    whole = t(spark, d, "supplier").select(F.col("s_suppkey").alias("uri"), F.lit(1).alias("line"), none("col"), none("end_line"), F.lit(0).alias("end_col"))
    return Q.owned(ends.where("l_returnflag = 'A'"), [ends.where("l_returnflag = 'R'"), whole])


@query("WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS child FROM orders GROUP BY ALL), x AS (SELECT c_custkey AS owner, c_mktsegment AS path, CASE WHEN c_acctbal > 0 THEN 'o' || c_custkey END AS outer, CASE WHEN n = 1 AND o_orderstatus = 'F' THEN 'i' || child END AS inner FROM customer LEFT JOIN k ON k.o_custkey = c_custkey AND k.o_orderpriority = CASE WHEN c_nationkey % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END LEFT JOIN orders ON o_orderkey = child) SELECT *, CASE WHEN outer IS NOT NULL AND inner IS NOT NULL THEN 'exact' ELSE 'unresolved' END AS status FROM x".replace("outer", '"outer"').replace("inner", '"inner"'))
def forwarded_interfaces(spark, d):
    customer, orders = t(spark, d, "customer"), t(spark, d, "orders")
    target = F.array(F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").otherwise("2-HIGH"), F.lit("port"), F.lit("put"))
    provided = customer.select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("path"), target.alias("target"))
    children = orders.select(F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("name"), text_key("i", "o_orderkey").alias("instance"))
    own = customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("instance"), F.col("c_mktsegment").alias("path"), text_key("o", "c_custkey").alias("endpoint"))
    inside = orders.where("o_orderstatus = 'F'").select(text_key("i", "o_orderkey").alias("instance"), F.lit("port.put").alias("path"), text_key("i", "o_orderkey").alias("endpoint"))
    found = Q.forwarded(provided.withColumn("owner", F.col("owner").cast("string")), children.withColumn("parent", F.col("parent").cast("string")), own.union(inside))
    return found.withColumn("owner", F.col("owner").cast("long"))


@query("SELECT l_orderkey AS behaviour, l_suppkey AS instance, coalesce(CASE WHEN l_returnflag = 'R' THEN l_linestatus END, '') AS member, l_returnflag AS kind, l_linestatus AS operation, l_linenumber AS line, CAST(l_quantity AS INTEGER) % 2 AS col, min(l_partkey) AS nth FROM lineitem GROUP BY ALL")
def merged_accesses(spark, d):
    line = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("behaviour"), F.col("l_suppkey").alias("instance"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("member"), F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("operation"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("int") % 2).alias("col"), F.col("l_partkey").alias("nth"),
    )
    return Q.merged_accesses(line, ["nth"])


@query("SELECT l_returnflag AS direction, l_partkey AS other, l_linestatus AS kind, l_linenumber AS evidence, min(l_orderkey) AS edge FROM lineitem GROUP BY ALL")
def distinct_relations(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("direction"), F.col("l_partkey").alias("other"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").alias("evidence"), F.col("l_orderkey").alias("edge"))
    return Q.distinct_relations(line, ["edge"])


@query("SELECT o_custkey % 50 || '>' || o_orderpriority || '>' || o_orderstatus AS steps, min(o_orderkey) AS path FROM orders GROUP BY ALL")
def distinct_paths(spark, d):
    steps = F.array((F.col("o_custkey") % 50).cast("string"), "o_orderpriority", "o_orderstatus")
    found = Q.distinct_paths(t(spark, d, "orders").select(steps.alias("steps"), F.col("o_orderkey").alias("path")), ["path"])
    return found.select(F.array_join("steps", ">").alias("steps"), "path")


@query("WITH o AS (SELECT *, p_partkey % 10 = 0 AS a, p_partkey % 10 > 0 AND p_name LIKE 'cold%' AS b, p_partkey % 10 > 0 AND p_name NOT LIKE 'cold%' AND p_size = 7 AS c FROM part) SELECT p_partkey AS node, CASE WHEN a THEN 'by id' WHEN c THEN 'by place' WHEN p_size > 40 THEN 'noted' ELSE p_name END AS label, CASE WHEN b THEN 'cold' ELSE p_type END AS kind, CASE WHEN a THEN 'ids' ELSE p_brand END AS grp, CASE WHEN p_size > 40 THEN 'a note' ELSE '' END AS description, b OR p_size > 48 OR p_size = 1 AS hidden, a OR p_name = 'small widget' AS entry FROM o")
def configured_nodes(spark, d):
    part, none = t(spark, d, "part"), F.lit(None).cast("string")
    note = F.when(F.col("p_size") > 40, F.create_map(F.lit("label"), F.lit("noted"), F.lit("description"), F.lit("a note"), F.lit("hide"), (F.col("p_size") > 48).cast("string")))
    nodes = part.select(
        F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("package"), F.lit("").alias("label"),
        F.col("p_type").alias("kind"), F.col("p_brand").alias("grp"), none.alias("description"), (F.col("p_size") == 1).alias("hidden"), note.alias("annotations"),
    )
    by = lambda key, label, kind, grp, hide, entry: (key.alias("key"), label.alias("label"), kind.alias("kind"), grp.alias("grp"), none.alias("description"), F.lit(hide).alias("hide"), F.lit(entry).alias("entry"))
    rules = part.where("p_partkey % 10 = 0").select(*by(F.col("p_partkey").cast("string"), F.lit("by id"), none, F.lit("ids"), False, True))
    rules = rules.union(part.where("p_name like 'cold%'").select(*by(F.col("p_name"), F.lit(""), F.lit("cold"), none, True, False)).distinct())
    rules = rules.union(part.where("p_name not like 'cold%'").select(*by(F.concat(F.lit("size7."), "p_name"), F.lit("by place"), none, none, False, False)).distinct())
    return Q.configured(nodes, rules, part.where("p_name = 'small widget'").select(F.col("p_name").alias("name")))


@query("WITH x AS (SELECT l_orderkey, l_returnflag, 's' || l_suppkey AS state, min(l_partkey) AS nth FROM lineitem GROUP BY ALL), y AS (SELECT l_orderkey, string_agg(state, ', ' ORDER BY nth, state) FILTER (l_returnflag = 'A') AS u, string_agg(state, ', ' ORDER BY nth, state) FILTER (l_returnflag = 'N') AS e FROM x GROUP BY 1) SELECT o_orderkey AS behaviour, CASE WHEN u IS NOT NULL OR e IS NOT NULL THEN concat_ws(' and ', 'Updates ' || u, 'enqueues ' || e) || '.' WHEN o_custkey % 2 = 0 THEN 'Invokes f, g.' WHEN o_orderstatus = 'F' THEN 'Rule r.' ELSE 'Method r.' END AS summary FROM orders LEFT JOIN y ON o_orderkey = l_orderkey")
def transition_sentences(spark, d):
    callables = t(spark, d, "orders").select(F.col("o_orderkey").alias("behaviour"), F.when(F.col("o_orderstatus") == "F", "rule").otherwise("method").alias("kind"), F.lit("r").alias("name"), F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("f"), F.lit("g"))).alias("invocations"))
    effect = F.when(F.col("l_returnflag") == "A", "update").when(F.col("l_returnflag") == "N", "enqueue").otherwise("read")
    return Q.transition_sentences(callables, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("behaviour"), effect.alias("effect"), text_key("s", "l_suppkey").alias("state"), F.col("l_partkey").alias("nth")))


@query("WITH p AS (SELECT l_partkey AS entity, count(DISTINCT l_suppkey) AS n, bool_or(l_suppkey % 20 = 0) AS shown FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1) SELECT p_partkey AS entity, coalesce(n, 0) AS n_displays, CASE WHEN shown THEN 'visible' WHEN n > 0 THEN 'hidden' ELSE 'off-scene' END AS visibility FROM part LEFT JOIN p ON entity = p_partkey")
def scene_visibility(spark, d):
    at = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_suppkey").alias("display"), F.col("l_partkey").alias("entity"))
    return Q.visibility(t(spark, d, "part").select(F.col("p_partkey").alias("entity")), at, t(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("display")))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Bit#(' || p_size || ')' WHEN 1 THEN 'Vector#(4, T' || p_size || ')' WHEN 2 THEN 'Addr' WHEN 3 THEN 'Bool' END AS held FROM part")
def storage_types(spark, d):
    size = F.col("p_size").cast("string")
    n = F.col("p_size") % 6
    kind = F.when(n == 1, "memory").when(n == 4, F.lit(None).cast("string")).otherwise("register")
    text = F.when(n == 0, F.concat(F.lit("Reg#(Bit#("), size, F.lit("))"))).when(n == 1, F.concat(F.lit("RegFile#(Addr,  Vector#(4,  T"), size, F.lit("))"))).when(n == 2, "Pair#( Addr, Data)").when(n == 3, "Bool").when(n == 4, "Reg#(Bool)").otherwise("Reg#(Bool")
    return t(spark, d, "part").select("p_partkey", Q.storage_type(text, kind).alias("held"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 5 = 0 THEN 'unresolved' WHEN l_linenumber >= 4 OR l_quantity >= 40 AND l_suppkey % 2 = 0 THEN 'unresolved' WHEN l_suppkey % 2 = 0 THEN 'exact' ELSE 'symbolic' END AS status FROM lineitem")
def element_references(spark, d):
    """[line][quantity] on families of 4 by 40, of which every second has a symbolic second dimension; one in five has a name as index."""
    whole = lambda c: F.col(c).cast("int").cast("string")
    selector = F.concat(F.lit("["), F.when(F.col("l_suppkey") % 5 == 0, "i").otherwise(whole("l_linenumber")), F.lit("][ "), whole("l_quantity"), F.lit(" ]"))
    dim = lambda status, upper: F.struct(status.alias("status"), F.lit(0).alias("lower"), F.lit(upper).alias("upper"))
    dims = F.array(dim(F.lit("concrete"), 4), dim(F.when(F.col("l_suppkey") % 2 == 0, "concrete").otherwise("symbolic"), 40))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", Q.element_reference(selector, dims).alias("status"))
