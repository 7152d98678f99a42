"""Declarations in hardware source text, by expressions over masked text.

Masking blanks comments and strings and keeps every offset and line, so what is
found in masked text is where it says.  Each declaration is one row of a regular
expression's matches; nesting is left to joins on positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tracelake.operators.checkpoints import scratch, written

ID = r"[A-Za-z_$][\w$']*"


@pandas_udf(T.StringType())
def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Comments and strings as blanks of the same length; line ends stay."""
    import re

    pattern = re.compile(r'"(?:[^"\\\n]|\\.)*"?|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
    blank = re.compile(r"[^\n\r]")
    for s in texts:
        yield s.map(lambda t: t if t is None else pattern.sub(lambda m: blank.sub(" ", m[0]), t))


@pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("utf16_start", "utf16_end", "utf8_start", "utf8_end")]))
def offsets(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Code point offsets in UTF-16 units and UTF-8 bytes."""
    rows = []
    for t, a, b in zip(texts, starts, ends):
        head, body = t[:a], t[a:b]
        x, y = (len(p.encode("utf-16-le")) // 2 for p in (head, body))
        p, q = (len(v.encode()) for v in (head, body))
        rows.append((x, x + y, p, p + q))
    return pd.DataFrame(rows, columns=["utf16_start", "utf16_end", "utf8_start", "utf8_end"])


def position(text: Column, offset: Column) -> Column:
    """line and col (from 0) of a code point offset."""
    before = F.substr(text, F.lit(1), offset)
    return F.struct(F.regexp_count(before, F.lit("\n")).alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("col"))


def statements(masked_text: Column) -> Column:
    """Parts that end at a semicolon, without an unterminated rest."""
    parts = F.split(masked_text, ";")
    return F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.trim(s)), lambda s: s != "")


def arguments(list_text: Column) -> Column:
    """A list split at commas that no bracket encloses, to any depth."""
    pieces = F.split(list_text, ",")
    depth = lambda s: F.regexp_count(s, F.lit(r"[(\[{]")) - F.regexp_count(s, F.lit(r"[)\]}]"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def add(state: Column, piece: Column) -> Column:
        text = F.when(state["open"] == "", piece).otherwise(F.concat_ws(",", state["open"], piece))
        level = state["depth"] + depth(piece)
        return F.struct(F.when(level <= 0, F.concat(state["done"], F.array(F.trim(text)))).otherwise(state["done"]).alias("done"), F.when(level <= 0, "").otherwise(text).alias("open"), F.when(level <= 0, 0).otherwise(level).alias("depth"))

    return F.filter(F.aggregate(pieces, start, add, lambda s: s["done"]), lambda x: x != "")


def found(documents: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """path and the named groups of every match in the masked text (documents: path, masked)."""
    hit = F.explode(F.regexp_extract_all("masked", F.lit(pattern), F.lit(0)))
    return documents.select("path", hit.alias("m")).select("path", *(F.nullif(F.trim(F.regexp_extract("m", pattern, g)), F.lit("")).alias(n) for n, g in groups.items()))


def with_masked(documents: DataFrame) -> DataFrame:
    """documents (path, content) with masked."""
    return documents.withColumn("masked", masked("content"))


def packages(documents: DataFrame) -> DataFrame:
    return found(documents, rf"(?m)^\s*package\s+({ID})\s*;", name=1)


def imports(documents: DataFrame) -> DataFrame:
    return found(documents, rf"(?m)^\s*import\s+({ID})\s*::\s*([^;]*);", package=1, names=2)


def modules(documents: DataFrame) -> DataFrame:
    """path, name, parameters (array), interface."""
    head = found(documents, rf"\bmodule\s+(?:\[[^\]]*\]\s*)?({ID})\s*(?:#\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\))?\s*\(([^;]*?)\)\s*(?:provisos\s*\((?:[^()]|\([^()]*\))*\))?\s*;", name=1, parameters=2, interface=3)
    return head.withColumn("parameters", arguments(F.coalesce("parameters", F.lit(""))))


def interfaces(documents: DataFrame) -> DataFrame:
    return found(documents, rf"(?s)\binterface\s+({ID})\s*(#\s*\([^;]*?\))?\s*;(.*?)\bendinterface\b", name=1, parameters=2, body=3)


def interface_methods(documents: DataFrame) -> DataFrame:
    """path, interface, method, returns."""
    body = interfaces(documents).select("path", F.col("name").alias("interface"), F.col("body").alias("masked"))
    pattern = rf"\bmethod\s+([^;=]*?)\s*\b({ID})\s*(?:\([^;]*\))?\s*;"
    hit = body.select("path", "interface", F.explode(F.regexp_extract_all("masked", F.lit(pattern), F.lit(0))).alias("m"))
    return hit.select("path", "interface", F.regexp_extract("m", pattern, 2).alias("method"), F.regexp_extract("m", pattern, 1).alias("returns"))


def instances(documents: DataFrame) -> DataFrame:
    """path, type, name, constructor, family: the constructor's replicator if it has one."""
    return found(documents, rf"(?m)^\s*({ID}(?:\s*#\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?)\s+({ID})\s*<-\s*(?:(replicateM|mapM|genM)\s*\(\s*)?({ID})", type=1, name=2, family=3, constructor=4)


def rules(documents: DataFrame) -> DataFrame:
    """path, name, guard, body."""
    return found(documents, rf"(?s)\brule\s+({ID})\s*(?:\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\))?\s*;(.*?)\bendrule\b", name=1, guard=2, body=3)


def functions(documents: DataFrame) -> DataFrame:
    """path, returns, name, parameters; brackets in types are matched to a depth of three."""
    inner = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
    return found(documents, rf"\bfunction\s+((?:[^;=()]|{inner})*?)\s*\b({ID})\s*\(((?:[^;=()]|{inner})*)\)\s*(?:provisos[^;=]*)?[;=]", returns=1, name=2, parameters=3)


def typedefs(documents: DataFrame) -> DataFrame:
    """path, kind (enum, struct, union or alias), name, definition."""
    body = r"typedef\s+(?:(enum|struct|union\s+tagged)\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}|([^;{]+?))\s*\b(" + ID + r")\s*(?:#\s*\([^;]*\))?\s*(?:deriving\s*\([^;]*\))?\s*;"
    rows = found(documents, rf"(?s)\b{body}", kind=1, members=2, alias=3, name=4)
    return rows.select("path", F.coalesce(F.regexp_extract("kind", r"^\w+", 0), F.lit("alias")).alias("kind"), "name", F.coalesce("members", "alias").alias("definition"))


def attributes(documents: DataFrame) -> DataFrame:
    """path, key, value of (* key = "value" *) scans; these are read from the content, outside comments."""
    text = F.regexp_replace("content", r"//[^\n]*|/\*(?s:.*?)\*/", " ")
    blocks = documents.select("path", F.explode(F.regexp_extract_all(text, F.lit(r'\(\*((?:[^*"]|"[^"]*"|\*(?!\)))*)\*\)'), F.lit(1))).alias("block"))
    pair = r'(\w+)\s*(?:=\s*("[^"]*"|[^,"]+))?'
    each = blocks.select("path", F.explode(F.regexp_extract_all("block", F.lit(pair), F.lit(0))).alias("m"))
    return each.select("path", F.regexp_extract("m", pair, 1).alias("key"), F.nullif(F.trim(F.regexp_replace(F.regexp_extract("m", pair, 2), '"', "")), F.lit("")).alias("value"))


def accesses(bodies: DataFrame, instance_names: DataFrame) -> DataFrame:
    """path, owner, instance, member, operation of rules or methods (path, name, body) against instances (path, name, kind).

    a <= b writes a register, a.put(x) calls a member, and a register that stands
    elsewhere is read.
    """
    writes = bodies.select("path", F.col("name").alias("owner"), F.explode(F.regexp_extract_all("body", F.lit(rf"(?m)(?:^|;|begin)\s*({ID})\s*(?:\[[^\]]*\])?\s*<=(?!=)"), F.lit(1))).alias("instance")).select("path", "owner", "instance", F.lit("_write").alias("member"))
    call = rf"\b({ID})(?:\[[^\]]*\])?\.({ID})"
    calls = bodies.select("path", F.col("name").alias("owner"), F.explode(F.regexp_extract_all("body", F.lit(call), F.lit(0))).alias("m")).select("path", "owner", F.regexp_extract("m", call, 1).alias("instance"), F.regexp_extract("m", call, 2).alias("member"))
    plain = F.regexp_replace(F.regexp_replace("body", call, " "), rf"(?m)(^|;|begin)\s*{ID}\s*(?:\[[^\]]*\])?\s*<=(?!=)", "$1 ")
    reads = bodies.select("path", F.col("name").alias("owner"), F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"\b{ID}\b"), F.lit(0)))).alias("instance")).select("path", "owner", "instance", F.lit("_read").alias("member"))
    known = instance_names.select("path", F.col("name").alias("instance"), "kind")
    met = writes.union(calls).union(reads).distinct().join(known, ["path", "instance"])
    return met.where((F.col("member") != "_read") | (F.col("kind") == "register")).withColumn("operation", operation(F.col("kind"), F.col("member")))


# What a member of a primitive is called and whether it reads or writes.
OPERATIONS = {
    "deq": "dequeue", "enq": "enqueue", "first": "first", "clear": "clear", "notEmpty": "status-read", "notFull": "status-read", "peek": "peek",
    "request": "memory-request", "response": "memory-response", "get": "memory-response", "put": "memory-request",
    "read": "read", "write": "write", "_read": "read", "_write": "write", "wget": "read", "wset": "write", "send": "write", "value": "read",
}
READS = {"register": ["_read", "read", "value"], "fifo": ["deq", "first", "notEmpty", "notFull", "peek"], "wire": ["_read", "read", "wget"], "memory": ["read", "response", "get"]}
WRITES = {"register": ["_write", "write"], "fifo": ["enq", "clear"], "wire": ["_write", "write", "wset", "send"], "memory": ["write", "request", "put"]}


def operation(kind: Column, member: Column) -> Column:
    """What a member does to a primitive of its kind, else 'invoke'."""
    return F.when(access(kind, member).isNotNull(), F.coalesce(*(F.when(member == m, what) for m, what in OPERATIONS.items()))).otherwise("invoke")


def access(kind: Column, member: Column) -> Column:
    """read or write, null for a member that the kind does not have."""
    return F.coalesce(*(F.when((kind == k) & member.isin(*ms), what) for what, table in (("read", READS), ("write", WRITES)) for k, ms in table.items()))


def type_width(members: DataFrame, basic: DataFrame) -> DataFrame:
    """name, bits, status of types: the sum of their members (owner, member_type), basic ones (name, bits) given.

    One join per level of nesting, until no type gets a width any more.  What never
    gets one is 'unknown' if it has a member of no known type, else 'cycle'.
    """
    known = basic.select("name", F.col("bits").cast("long").alias("bits"))
    folder, k = scratch(members.sparkSession), 0
    left = members = written(members.select("owner", "member_type"), f"{folder}/members")
    while True:
        met = left.join(known, left["member_type"] == known["name"], "left")
        ready = met.groupBy("owner").agg(F.count_if(F.col("bits").isNull()).alias("open"), F.sum("bits").alias("bits")).where("open = 0").select(F.col("owner").alias("name"), "bits")
        new = written(ready.join(known.select("name"), "name", "left_anti"), f"{folder}/new{k}")
        if new.isEmpty():
            break
        known = written(known.union(new), f"{folder}/known{k}")
        left = written(left.join(new.withColumnRenamed("name", "owner"), "owner", "left_anti"), f"{folder}/left{k}")
        k += 1
    owners = members.select(F.col("owner").alias("name")).distinct()
    missing = left.join(owners.union(basic.select("name")).withColumnRenamed("name", "member_type"), "member_type", "left_anti").select(F.col("owner").alias("name")).distinct().withColumn("missing", F.lit(True))
    told = owners.join(known, "name", "left").join(missing, "name", "left")
    return told.select("name", "bits", F.when(F.col("bits").isNotNull(), "exact").when(F.col("missing"), "unknown").otherwise("cycle").alias("status"))
