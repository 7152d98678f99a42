"""Resolution that never takes the first of many: exact, ambiguous or unresolved, with what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, AMBIGUOUS, UNRESOLVED, MISMATCH = "exact", "ambiguous", "unresolved", "mismatch"


def resolve(references: DataFrame, candidates: DataFrame, tiers: list[list[str]], key: str, target: str, fall_through: bool = False) -> DataFrame:
    """key, tier, n, target, status: each reference at the first tier with any candidate.

    tiers: columns that have to be equal, the closest first; references and
    candidates have them by the same names.  One candidate is exact, several are
    ambiguous (target is null), none in any tier is unresolved.  fall_through: an
    ambiguous tier is passed over, as if it had none.  The candidates of a tier
    are counted by its columns before the join, so no pair is listed.
    """
    out = references
    for k, columns in enumerate(tiers):
        found = candidates.groupBy(*columns).agg(F.count_distinct(target).alias(f"n{k}"), F.min(target).alias(f"t{k}")) if columns else candidates.agg(F.count_distinct(target).alias(f"n{k}"), F.min(target).alias(f"t{k}"))
        out = out.join(found, columns, "left") if columns else out.join(F.broadcast(found))
    hit = lambda k: (F.col(f"n{k}") == 1) if fall_through else (F.col(f"n{k}") > 0)
    first = lambda name: F.coalesce(*(F.when(hit(k), f(k)) for k in range(len(tiers)) for f in [name]))
    n = F.coalesce(first(lambda k: F.col(f"n{k}")), F.lit(0))
    return out.select(
        key,
        first(lambda k: F.lit(k)).alias("tier"),
        n.alias("n"),
        F.when(n == 1, first(lambda k: F.col(f"t{k}"))).alias("target"),
        F.when(n == 1, EXACT).when(n > 1, AMBIGUOUS).otherwise(UNRESOLVED).alias("status"),
    )


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A full outer comparison by key: exact, mismatch, missing, unexpected, or duplicate where a side has the key twice."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(value).alias(name))

    both = side(expected, "expected").join(side(actual, "actual"), keys, "full_outer")
    status = (
        F.when(F.col("n_actual").isNull(), "missing")
        .when(F.col("n_expected").isNull(), "unexpected")
        .when((F.col("n_expected") > 1) | (F.col("n_actual") > 1), "duplicate")
        .when(F.col("expected").eqNullSafe(F.col("actual")), EXACT)
        .otherwise(MISMATCH)
    )
    return both.select(*keys, "expected", "actual", status.alias("status"))


#: Names of types that have no parameter of their own to be resolved.
CONCRETE = ["Action", "ActionValue", "Bit", "Bool", "Int", "Maybe", "Tuple2", "Tuple3", "Tuple4", "UInt", "Vector"]


def type_agreement(expected: Column, actual: Column, concrete: list[str] | None = None) -> Column:
    """Equal but for white space: exact; else unresolved where a side may stand for several types, and mismatch where none does.

    A type may do so if it is not there, is inferred, has a ?, is a variable (lower
    case first, or one capital), or has a parameter that is no number and no
    concrete type.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    known = F.array(*map(F.lit, CONCRETE if concrete is None else concrete))

    def open_(c: Column) -> Column:
        t = plain(c)
        parameters = F.regexp_extract_all(F.regexp_extract(t, "(?s)#(.*)", 1), F.lit(r"(?<![\w$])[A-Za-z_$][\w$]*"), F.lit(0))
        return c.isNull() | t.isin("", "inferred") | t.contains("?") | t.rlike(r"^[a-z_$]|^[A-Z]$") | (F.size(F.array_except(parameters, known)) > 0)

    return F.when(plain(expected) == plain(actual), EXACT).when(open_(expected) | open_(actual), UNRESOLVED).otherwise(MISMATCH)


def mutually_unique(pairs: DataFrame, anchor: str, candidate: str) -> DataFrame:
    """The pairs with status: exact if neither side occurs in another pair, else ambiguous."""
    pairs = pairs.select(anchor, candidate).distinct()
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return pairs.withColumn("status", F.when((n(anchor) == 1) & (n(candidate) == 1), EXACT).otherwise(AMBIGUOUS))


def smallest_enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every point with the ranges [low, high) of least size that hold it; ties are several rows, none is a null range.

    points: point_id, at; ranges: range_id, low, high (numbers).  A range is put into
    the bins, as wide as the next power of two of its size, at which it begins and
    ends: two rows at most.  A point looks once into each width that occurs, so both
    meet by equality however different the sizes are.
    """
    level = F.ceil(F.log2(F.col("high") - F.col("low"))).cast("int")
    bin_of = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    sized = ranges.where("low < high").withColumn("level", level)
    spread = sized.withColumn("bin", F.explode(F.array_distinct(F.array(bin_of(F.col("low")), bin_of(F.col("high"))))))
    levels = sorted(r.level for r in sized.select("level").distinct().collect())  # at most as many as a number has exponents
    looks = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", bin_of(F.col("at")))
    met = looks.join(spread, ["level", "bin"]).where("at >= low and at < high")
    least = met.groupBy("point_id").agg(F.min(F.col("high") - F.col("low")).alias("least"))
    best = met.join(least, "point_id").where("high - low = least").select("point_id", "range_id")
    return points.select("point_id").join(best, "point_id", "left")


def combined_status(statuses: list[str] | Column) -> Column:
    """Of an array: unsupported dominates, then unresolved; none or all exact is exact."""
    return F.when(F.array_contains(statuses, "unsupported"), "unsupported").when(F.exists(statuses, lambda s: s != EXACT), UNRESOLVED).otherwise(EXACT)


def worst(column: str, order: list[str]) -> Column:
    """An aggregate: the value that comes first in order, the worst one; others do not count."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.get(F.array(*map(F.lit, order)), (F.min(F.when(rank > 0, rank)) - 1).cast("int"))
