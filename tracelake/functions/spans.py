"""Spans in texts as data: delimiters, matching brackets, ends of statements, annotations, and the forest of nested ranges.

Every text is cut at its delimiters once; what lies between them is never looked
at character by character.  Depths are running sums over a text's delimiters, so
matching is a window and not a scan with a stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Brackets, and what ends a statement.
BRACKETS = {"()": ("(", ")"), "[]": ("[", "]"), "{}": ("{", "}")}
END = ";"
ANNOTATION = r"^//\s*@arch(?:\.|\s+)([A-Za-z][\w-]*)(?:\s+|=)?(.*)$"
SWITCHES = ["hide", "entry"]
REACH = 8


def delimiters(texts: DataFrame) -> DataFrame:
    """id, pos, mark of brackets and statement ends in texts (id, text); pos counts code points from 0."""
    pieces = F.regexp_extract_all("text", F.lit(r"\G([^()\[\]{};]*+)([()\[\]{};])"), F.lit(0))
    cut = texts.select("id", F.posexplode(pieces).alias("k", "piece"))
    so_far = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return cut.select("id", (F.sum(F.length("piece")).over(so_far) - 1).alias("pos"), F.right("piece", F.lit(1)).alias("mark"))


def _depths(marks: DataFrame) -> DataFrame:
    """marks with the running sum of each kind of bracket, the own one counted."""
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda pair: F.when(F.col("mark") == pair[0], 1).when(F.col("mark") == pair[1], -1).otherwise(0)
    return marks.withColumns({f"depth{k}": F.sum(step(pair)).over(so_far) for k, pair in enumerate(BRACKETS.values())})


def matched(texts: DataFrame) -> DataFrame:
    """id, kind, start, end of every opening bracket; end is that of its partner, null if the text ends first.

    Brackets of one kind are matched without regard to the others.  Closing
    brackets that close nothing have no row.
    """
    deep = _depths(delimiters(texts)).where(F.col("mark") != END)
    opens = F.col("mark").isin([o for o, _ in BRACKETS.values()])
    kind = F.coalesce(*(F.when(F.col("mark").isin(*pair), name) for name, pair in BRACKETS.items()))
    depth = F.coalesce(*(F.when(F.col("mark").isin(*pair), F.col(f"depth{k}")) for k, pair in enumerate(BRACKETS.values())))
    levels = deep.select("id", "pos", kind.alias("kind"), opens.alias("opens"), (depth + F.when(opens, 0).otherwise(1)).alias("level"))
    following = Window.partitionBy("id", "kind", "level").orderBy("pos")
    ended = levels.withColumn("end", F.when(~F.lead("opens").over(following), F.lead("pos").over(following)))
    return ended.where("opens").select("id", "kind", F.col("pos").alias("start"), "end")


def statement_ends(texts: DataFrame) -> DataFrame:
    """id, nth, start, end of every statement: up to and with a ; that no bracket encloses.  What follows the last has no row.

    A closing bracket that closes nothing does not count.
    """
    deep = _depths(delimiters(texts))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    open_ = [F.col(f"depth{k}") - F.least(F.lit(0), F.min(f"depth{k}").over(so_far)) for k in range(len(BRACKETS))]
    outside = deep.withColumns({f"open{k}": c for k, c in enumerate(open_)}).where((F.col("mark") == END) & (F.greatest(*(F.col(f"open{k}") for k in range(len(BRACKETS)))) == 0))
    order = Window.partitionBy("id").orderBy("pos")
    return outside.select("id", F.row_number().over(order).alias("nth"), F.coalesce(F.lag("pos").over(order) + 1, F.lit(0)).alias("start"), (F.col("pos") + 1).alias("end"))


def annotations(texts: DataFrame) -> DataFrame:
    """id, line, key, value: what comments of the form // @arch.key value say about the line of code that follows them.

    Only blank lines and comments may stand between, and at most 8 lines count.  Of equal
    keys the first counts.  hide and entry are true unless they say false; other
    values lose their quotes.
    """
    lines = texts.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).select("id", "line", F.trim("raw").alias("raw"))
    code = (F.col("raw") != "") & ~F.col("raw").startswith("//")
    later = Window.partitionBy("id").orderBy("line").rowsBetween(1, REACH)
    told = lines.withColumn("at", F.first(F.when(code, F.col("line")), ignorenulls=True).over(later)).where(F.col("raw").rlike(ANNOTATION) & F.col("at").isNotNull())
    key, value = F.lower(F.regexp_extract("raw", ANNOTATION, 1)), F.trim(F.regexp_extract("raw", ANNOTATION, 2))
    plain = F.regexp_replace(value, "^['\"]|['\"]$", "")
    said = told.select("id", F.col("at").alias("line"), F.col("line").alias("from"), key.alias("key"), F.when(key.isin(SWITCHES), F.when(value == "false", "false").otherwise("true")).otherwise(plain).alias("value"))
    return said.groupBy("id", "line", "key").agg(F.min_by("value", "from").alias("value"))


def forest(ranges: DataFrame) -> DataFrame:
    """id, key, depth, parent of ranges (id, key, start, end) that are nested or apart: parent is the key of the smallest one around.

    depth is 1 for a range in no other.  Ranges are half-open; of equal ones the
    smaller key is around the other.  One sort tells depths, another finds, in each
    depth, the last range before that is one less deep; no range is held against all.
    """
    begin = ranges.select("id", F.col("start").alias("pos"), F.lit(1).alias("step"), (-F.col("end")).alias("tie"), "key", "start", "end")
    stop = ranges.select("id", F.col("end").alias("pos"), F.lit(-1).alias("step"), F.lit(0).cast("long").alias("tie"), "key", "start", "end")
    so_far = Window.partitionBy("id").orderBy("pos", "step", "tie", "key").rowsBetween(Window.unboundedPreceding, 0)
    deep = begin.unionByName(stop).withColumn("depth", F.sum("step").over(so_far)).where("step = 1").select("id", "key", "start", "end", "depth")
    above = deep.select("id", F.lit(None).cast(deep.schema["key"].dataType).alias("key"), "start", "end", (F.col("depth") + 1).alias("depth"), F.col("key").alias("around"))
    both = deep.withColumn("around", F.lit(None).cast(deep.schema["key"].dataType)).unionByName(above)
    before = Window.partitionBy("id", "depth").orderBy("start", F.desc("end"), F.coalesce("key", "around")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("parent", F.last("around", ignorenulls=True).over(before)).where("key is not null").select("id", "key", F.col("depth").cast("long").alias("depth"), "parent")
