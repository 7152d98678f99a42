"""Declarations with their places in source texts: what a module provides, nested to any depth, and the symbols of a document.

Texts are masked (comments and strings are blank) and cut at the tokens that open
and close; nesting is a running sum over these, so no text is scanned by a stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import spans
from tracelake.functions.text import ID
from tracelake.operators.checkpoints import scratch, written

_LIST = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_TYPE = rf"{ID}(?:\s*#\s*{_LIST})?"
_TOKEN = rf"\binterface\b(?:[^;()]++|{_LIST})*+;|\bendinterface\b"
_HEADER = rf"^interface\s+(?:({_TYPE})\s+)?({ID})\s*([=;])"

# What a symbol may stand in.
HOLDS = {"package": ["type", "interface", "function", "module"], "interface": ["method"], "module": ["instance", "rule", "method", "function"]}


def located(texts: DataFrame, pattern: str) -> DataFrame:
    """id, nth, token, start, end of every match in texts (id, text), left to right; places count code points, ends are exclusive."""
    # each match begins where the last one ended, so what follows the last is looked at once
    whole = rf"(?s)\G.*?({pattern})"
    cut = texts.select("id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(whole), F.lit(0)).alias("piece"), F.regexp_extract_all("text", F.lit(whole), F.lit(1)).alias("token"))).alias("nth", "x"))
    so_far = Window.partitionBy("id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select("id", "nth", "x.token", F.sum(F.length("x.piece")).over(so_far).alias("end"))
    return placed.select("id", "nth", "token", (F.col("end") - F.length("token")).alias("start"), "end")


def provided_interfaces(texts: DataFrame) -> DataFrame:
    """id, path, depth, type, form, target, start, end, complete of the interfaces that bodies (id, text, masked) provide.

    A `block` lasts to its endinterface and holds what stands in it, an `alias` ends
    with its statement and names its target; path has the names from the outermost
    on, joined by dots.  Without a written type it is 'inferred'.  A closing token
    that closes nothing counts for nothing.  An outermost block that the text does
    not close is incomplete: it ends with its header, and what follows in that text
    is not told.  Null and empty texts give no rows.
    """
    tokens = located(texts, _TOKEN)
    closes, part = F.col("token") == "endinterface", lambda g: F.regexp_extract("token", _HEADER, g)
    form = F.when(closes, "close").when(part(3) == "=", "alias").when(part(3) == ";", "block")
    read = tokens.select("id", "start", "end", form.alias("form"), part(1).alias("type"), part(2).alias("name"), F.regexp_replace("token", r"(?s)^[^=]*=|;$", "").alias("target")).where("form is not null")
    so_far = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("sum", F.sum(F.when(F.col("form") == "block", 1).when(F.col("form") == "close", -1).otherwise(0)).over(so_far))
    # what closes nothing lowers the floor from which depths are counted
    open_ = F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))
    deep = read.withColumn("depth", (open_ + F.when(F.col("form") == "block", 0).otherwise(1)).cast("int"))
    ended = Window.partitionBy("id", "depth", F.col("form") == "alias").orderBy("start")
    closed = deep.withColumn("close", F.when(F.lead("form").over(ended) == "close", F.lead("end").over(ended))).where("form <> 'close'")
    lost = F.min(F.when((F.col("form") == "block") & (F.col("depth") == 1) & F.col("close").isNull(), F.col("start"))).over(Window.partitionBy("id"))
    kept = written(closed.withColumn("lost", lost).where("lost is null or start <= lost"), scratch(texts.sparkSession))
    deepest = kept.agg(F.max("depth")).first()[0] or 0
    kept = kept.withColumn("around", F.lit(None).cast("string"))
    own = F.concat_ws(".", "around", "name")
    for k in range(1, deepest):  # the last block before that is one less deep is the one around
        kept = kept.withColumn("around", F.when(F.col("depth") == k + 1, F.last(F.when((F.col("depth") == k) & (F.col("form") == "block"), own), ignorenulls=True).over(so_far)).otherwise(F.col("around")))
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    alias = F.col("form") == "alias"
    return kept.select(
        "id", own.alias("path"), "depth", F.coalesce(F.nullif(blank("type"), F.lit("")), F.lit("inferred")).alias("type"), "form", F.when(alias, blank("target")).alias("target"),
        "start", F.when(alias, F.col("end")).otherwise(F.coalesce("close", "end")).alias("end"), (alias | F.col("close").isNotNull()).alias("complete"),
    )


def _plain(pattern: str) -> str:
    """The pattern with its groups capturing nothing."""
    from re import sub

    return sub(r"(\\.)|\((?!\?)", lambda m: m[1] or "(?:", pattern)


def _declared(texts: DataFrame, kind: str, pattern: str, name: int, detail: int | None = None) -> DataFrame:
    part = lambda g: F.trim(F.regexp_replace(F.regexp_extract("token", pattern, g), r"\s+", " "))
    more: Column = F.lit(None).cast("string") if detail is None else F.nullif(part(detail), F.lit(""))
    return located(texts, _plain(pattern)).select("id", F.lit(kind).alias("kind"), part(name).alias("name"), more.alias("detail"), "start", "end")


def declarations(texts: DataFrame) -> DataFrame:
    """id, kind, name, detail, start, end of what masked texts (id, text) declare; the place of a module, rule or interface is all of it."""
    until = lambda word: rf"(?:(?!\b{word}\b)[\s\S])*+\b{word}\b"
    kinds = {
        "module": (rf"\bmodule\s+(?:\[[^\]]*\]\s*)?({ID})\s*(?:#\s*{_LIST})?\s*\(((?:[^;()]|{_LIST})*)\)\s*(?:provisos\s*{_LIST}\s*)?;{until('endmodule')}", 1, 2),
        "interface": (rf"\binterface\s+({ID})\s*(?:#\s*{_LIST}\s*)?;{until('endinterface')}", 1, None),
        "rule": (rf"\brule\s+({ID})\s*(\((?:[^()]|{_LIST})*\))?\s*;{until('endrule')}", 1, 2),
        "method": (rf"\bmethod\s+((?:[^;=()]|{_LIST})*?)\s*\b({ID})\s*(?:{_LIST})?\s*(?:(?:if\b|provisos\b|=)[^;]*)?;", 2, 1),
        "function": (rf"\bfunction\s+((?:[^;=()]|{_LIST})*?)\s*\b({ID})\s*{_LIST}\s*(?:provisos[^;=]*)?[;=]", 2, 1),
        "type": (rf"\btypedef\s+(enum|struct|union\s+tagged)?(?:[^;{{]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*?\b({ID})\s*(?:#\s*{_LIST}\s*)?(?:deriving\s*\([^;]*\)\s*)?;", 2, 1),
        "instance": (rf"(?m)^[^\S\n]*({_TYPE}\s+{ID}\s*<-\s*(?:(?:replicateM|mapM|genM)\s*\(\s*)?{ID})", 1, None),
    }
    rows = reduce(DataFrame.unionByName, (_declared(texts, kind, *how) for kind, how in kinds.items()))
    binding = rf"^({_TYPE})\s+({ID})\s*<-\s*(?:(?:replicateM|mapM|genM)\s*\(\s*)?({ID})"
    bound = F.col("kind") == "instance"
    told = F.concat_ws(" <- ", F.regexp_extract("name", binding, 1), F.regexp_extract("name", binding, 3))
    return rows.withColumns({"detail": F.when(bound, told).otherwise(F.col("detail")), "name": F.when(bound, F.regexp_extract("name", binding, 2)).otherwise(F.col("name"))})


def document_symbols(texts: DataFrame) -> DataFrame:
    """id, nth, kind, name, detail, start, end, parent_kind, parent of a document's symbols (texts: id, text, masked), in order of their places.

    A package is the document and holds its types, interfaces, functions and modules;
    an interface its methods; a module its instances, rules, methods and
    functions.  A text without a package has one without a name.  What stands in anything
    else is no symbol: a method in a provided interface belongs to that.  Null texts
    have none.
    """
    bodies = texts.where("text is not null").select("id", "text")
    declared = written(declarations(bodies), scratch(texts.sparkSession))
    package = rf"(?m)^\s*package\s+({ID})\s*;"
    whole = bodies.select("id", F.lit("package").alias("kind"), F.regexp_extract("text", package, 1).alias("name"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    # only modules provide; what looks declared inside one is provided too
    held_in = declared.where("kind = 'module'").select("id", F.col("start").alias("from"), F.col("end").alias("to"))
    parts = held_in.join(bodies, "id").select(F.struct("id", "from").alias("id"), F.expr("substring(text, cast(from as int) + 1, cast(to - from as int))").alias("text"))
    inner = provided_interfaces(parts).where("form = 'block'").select("id.id", F.lit("provided").alias("kind"), F.col("path").alias("name"), F.lit(None).cast("string").alias("detail"), (F.col("start") + F.col("id.from")).alias("start"), (F.col("end") + F.col("id.from")).alias("end"))
    same = inner.select("id", "start", F.lit("interface").alias("kind"))
    rows = reduce(DataFrame.unionByName, [whole, declared.join(same, ["id", "start", "kind"], "left_anti").select(whole.columns), inner])
    key = F.concat_ws(":", F.lpad(F.col("start").cast("string"), 12, "0"), F.when(F.col("kind") == "package", "0").otherwise("1"), "kind")
    rows = written(rows.withColumn("key", key).dropDuplicates(["id", "key"]), scratch(texts.sparkSession))
    above = rows.select("id", F.col("key").alias("parent"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"))
    met = rows.join(spans.forest(rows.select("id", "key", "start", "end")), ["id", "key"]).join(above, ["id", "parent"], "left")
    held = reduce(Column.__or__, ((F.col("parent_kind") == k) & F.col("kind").isin(v) for k, v in HOLDS.items()))
    order = Window.partitionBy("id").orderBy("key")
    told = met.where((F.col("kind") == "package") | F.coalesce(held, F.lit(False)))
    return told.select("id", (F.row_number().over(order) - 1).alias("nth"), "kind", "name", "detail", "start", "end", "parent_kind", F.col("parent_name").alias("parent"))
