"""Schedule reports as relation tables.

A line is read in one of five ways, by what stands in it: a label and a list
("Sequenced before: a, b"), a code and names ("a: CF [b, c]; SB d"), a phrase
between two names ("a conflicts with b"), a pair that one ending tells about
("a and b are conflict-free"), or, in a section on execution order, a chain
("a -> b").  The tables below say which labels, codes and phrases there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The words of a report and the relation that each tells.
CODES = {
    "C": "conflict", "CF": "conflict-free", "SB": "sequential-before", "SBR": "sequential-before-reverse", "EO": "execution-order",
    "CONFLICT": "conflict", "CONFLICT_FREE": "conflict-free", "SEQUENTIAL_BEFORE": "sequential-before", "SEQUENTIAL_BEFORE_REVERSE": "sequential-before-reverse", "EXECUTION_ORDER": "execution-order",
}
LABELS = {"sequenced before": "sequential-before", "sequenced after": "sequential-before", "conflicts": "conflict", "conflict-free": "conflict-free"}
REVERSED = "sequenced after"
CHAIN_LABEL = "logical execution order"
PHRASES = {
    "conflicts with": "conflict", "is conflict-free with": "conflict-free", "is conflict free with": "conflict-free",
    "must execute before": "execution-order", "execute before": "execution-order", "executes before": "execution-order",
}
ENDINGS = {"are conflict-free": "conflict-free", "are conflict free": "conflict-free"}
MODULE_HEADS = ["schedule dump for module", "=== generated schedule for"]
MEMBER_LABELS = ["method", "rule"]
ORDER_HEADS = ["execution order", "rule execution order"]
BOTH_WAYS = ["conflict", "conflict-free"]


def read_schedules(spark: SparkSession, path: str) -> DataFrame:
    """The relations of all reports at a path."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), "value")
    return relations(whole)


def names(value: Column) -> Column:
    """The names of a list: what is left between blanks, commas, brackets and arrows, without quotes; (none) has none."""
    plain = F.regexp_replace(F.translate(value, "\"'", ""), r"->|[\[\],]", " ")
    return F.when(F.lower(F.trim(value)) == "(none)", F.array().cast("array<string>")).otherwise(F.array_remove(F.split(plain, r"\s+"), ""))


def single(value: Column) -> Column:
    """The one name that a part of a line is, or null; "rule" before it, quotes and a full stop do not count."""
    parts = names(F.rtrim(value, F.lit(".")))
    parts = F.when(F.lower(F.get(parts, F.lit(0))) == "rule", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0)))


def among(value: Column, table: dict[str, str]) -> Column:
    """What the table has for a value, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def relations(reports: DataFrame) -> DataFrame:
    """report, module, src, dst, kind, bidirectional, line, evidence of reports (report, value); each relation once, at its first line.

    The module and member that a line belongs to are those named last before it.
    Lines that fit nothing above are passed over.
    """
    text, low, label, rest = (F.col(c) for c in ("text", "low", "label", "rest"))
    lines = reports.select("report", F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw")).withColumn("text", F.trim("raw")).where("text <> ''")
    lines = lines.withColumn("low", F.lower("text")).withColumn("label", F.when(F.instr("text", ":") > 0, F.trim(F.substring_index("low", ":", 1))).otherwise(low))
    lines = lines.withColumn("rest", F.when(F.instr("text", ":") > 0, F.trim(F.substr("text", F.instr("text", ":") + 1))).otherwise(""))
    head = F.coalesce(*(F.when(low.startswith(h + " "), F.get(F.split(F.trim(F.substr(text, F.lit(len(h) + 1))), r"\s+"), F.lit(0))) for h in MODULE_HEADS))
    section = F.when(F.regexp_replace(label, r"\s*\(.*\)$", "").isin(*ORDER_HEADS) & (rest == ""), 1).when(text.endswith(":"), 0)
    so_far = Window.partitionBy("report").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda c: F.last(c, ignorenulls=True).over(so_far)
    placed = lines.withColumns({"module": carry(head), "member": carry(F.when(label.isin(*MEMBER_LABELS) & (rest != ""), F.get(names(rest), F.lit(0)))), "ordering": carry(section) == 1})

    def told(rows: DataFrame, src: Column, dst: Column, kind: Column) -> DataFrame:
        return rows.select("report", "module", "line", "text", src.alias("src"), dst.alias("dst"), kind.alias("kind"))

    def chain(rows: DataFrame, all_: Column) -> DataFrame:
        steps = F.transform(F.sequence(F.lit(1), F.size("all") - 1), lambda k: F.struct(F.get("all", k - 1).alias("src"), F.get("all", k).alias("dst")))
        each = rows.withColumn("all", all_).where(F.size("all") > 1).withColumn("step", F.explode(steps))
        return told(each, F.col("step.src"), F.col("step.dst"), F.lit("execution-order"))

    listed = placed.withColumn("kind", among(label, LABELS)).where("kind is not null and member is not null").withColumn("other", F.explode(names(rest)))
    after = label == REVERSED
    lists = told(listed, F.when(after, F.col("other")).otherwise(F.col("member")), F.when(after, F.col("member")).otherwise(F.col("other")), F.col("kind"))

    # a name, then items of a code and names; "rule" before the name does not count
    bare = F.regexp_replace(text, "(?i)^rule ", "")
    subject = F.regexp_extract(bare, r"^[^\s:]+", 0)
    items = F.split(F.regexp_replace(F.substr(bare, F.length(subject) + 1), r"^\s*:", ""), ";")
    coded = placed.select("*", subject.alias("subject"), F.explode(items).alias("item"))
    coded = coded.withColumn("code", F.regexp_extract(F.upper(F.trim("item")), r"^[A-Z_]+(?:-[A-Z]+)*", 0))
    coded = coded.withColumn("kind", among(F.translate("code", "-", "_"), CODES)).where("kind is not null")
    coded = coded.withColumn("other", F.explode(names(F.translate(F.substr(F.trim("item"), F.length("code") + 1), ":", " "))))
    codes = told(coded, F.col("subject"), F.col("other"), F.col("kind"))

    def between(phrase: str, kind: str, whole: Column, rows: DataFrame) -> DataFrame:
        at = F.instr(F.lower(whole), f" {phrase} ")
        ends = rows.withColumns({"src": F.when(at > 0, single(F.substr(whole, F.lit(1), at - 1))), "dst": F.when(at > 0, single(F.substr(whole, at + len(phrase) + 2)))})
        return told(ends, F.col("src"), F.col("dst"), F.lit(kind))

    stopped = F.rtrim(text, F.lit("."))
    phrases = [between(phrase, kind, text, placed) for phrase, kind in PHRASES.items()]
    endings = [between("and", kind, F.substr(stopped, F.lit(1), F.length(stopped) - len(e)), placed.where(F.lower(stopped).endswith(" " + e))) for e, kind in ENDINGS.items()]
    steps = F.transform(F.split(F.regexp_replace(text, r"^\d+[.)]\s*", ""), r"\s*(?:->|<)\s*"), single)
    chains = [chain(placed.where(label == CHAIN_LABEL), names(rest)), chain(placed.where("ordering"), F.when(F.forall(steps, lambda s: s.isNotNull()), steps))]

    short = lambda c: F.regexp_replace(c, "^RL_", "")
    out = reduce(DataFrame.unionByName, [lists, codes, *phrases, *endings, *chains])
    out = out.withColumns({"src": short(F.col("src")), "dst": short(F.col("dst"))}).where("src <> dst and src <> '' and dst <> ''")
    both = F.col("kind").isin(*BOTH_WAYS)
    out = out.withColumns({"lo": F.when(both, F.least("src", "dst")).otherwise(F.col("src")), "hi": F.when(both, F.greatest("src", "dst")).otherwise(F.col("dst"))})
    once = out.groupBy("report", "module", "lo", "hi", "kind").agg(F.min(F.struct("line", "src", "dst", "text")).alias("x"))
    return once.select("report", "module", "x.src", "x.dst", "kind", both.alias("bidirectional"), "x.line", F.col("x.text").alias("evidence"))
