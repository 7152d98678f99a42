"""Edges and rows as tables: dedupe, evidence, summaries, order within groups, limits that say what they omit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tracelake.operators.checkpoints import scratch, written


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order (of equals the one of least other values): a minimum, which is taken before rows are shuffled."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__x"))
    return first.select(*(c if c in keys else F.col(f"__x.{c}").alias(c) for c in rows.columns))


def undirected(edges: DataFrame, symmetric: Column) -> DataFrame:
    """Edges without self pairs; ends of symmetric ones in order, so both directions are one edge."""
    edges = edges.where("src <> dst")
    return edges.withColumns({"src": F.when(symmetric, F.least("src", "dst")).otherwise(F.col("src")), "dst": F.when(symmetric, F.greatest("src", "dst")).otherwise(F.col("dst"))}).dropDuplicates()


def with_evidence(certain: DataFrame, guessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The certain edges, each told whether a guess between the same ends, either way, supports it; and the guesses that support none."""
    ends = lambda df: df.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    support = ends(guessed).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_support"))
    told = ends(certain).join(support, ["lo", "hi"], "left").withColumn("n_support", F.coalesce("n_support", F.lit(0)))
    alone = ends(guessed).join(ends(certain), ["lo", "hi"], "left_anti")
    return told.drop("lo", "hi"), alone.drop("lo", "hi")


def adjacent_pairs(rows: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """item and following: neighbours within a group."""
    following = F.lead(item).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("following", following).where(F.col("following").isNotNull()).select(*group, item, "following")


def ordered_pairs(rows: DataFrame, group: list[str], order: list[str], item: str, first_only: bool = False) -> DataFrame:
    """All pairs i < j within a group, or only those of its first item.  Groups are meant to be small: the pairs are the result."""
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    left = placed.select(*group, F.col(item).alias("first"), F.col("__k").alias("i"))
    right = placed.select(*group, F.col(item).alias("second"), F.col("__k").alias("j"))
    pairs = left.join(right, group).where("i < j")
    return (pairs.where("i = 1") if first_only else pairs).select(*group, "first", "second")


def paired(left: DataFrame, right: DataFrame, key: str, block: int = 512, per_task: int = 16_000_000) -> DataFrame:
    """The inner join of two tables on a key of which both sides may have very many rows, as the pairs are the result.

    Both sides are cut into blocks of some hundred rows of a key, and what is dealt
    out is pairs of blocks: no task has more than about per_task pairs, however large a
    key is, and a row is shuffled once for each block that it meets.
    """
    count = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias(f"{name}_n"), F.count(F.lit(1)).cast("double").alias(name))
    n = count(left, "__l").join(count(right, "__r"), key)
    pairs = n.agg(F.sum(F.col("__l") * F.col("__r"))).first()[0] or 0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, int(pairs // per_task) + 1)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        placed = rows.join(n.select(key, "__l_n", "__r_n"), key).withColumn(f"{name}_block", F.pmod(F.xxhash64(*rest), f"{name}_n"))
        return placed.groupBy(key, f"{name}_block").agg(F.collect_list(F.struct(*rest)).alias(name), F.first("__l_n").alias("__l_n"))

    # 64 blocks of the left meet those of the right in one place, so a right block is there once for as many
    lefts = blocks(left, "__l").drop("__l_n").withColumn("__part", F.expr("__l_block div 64"))
    rights = blocks(right, "__r").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__l_n - 1) div 64")))).drop("__l_n")
    met = lefts.repartition(tasks, key, "__part").join(rights.repartition(tasks, key, "__part"), [key, "__part"]).repartition(tasks, key, "__l_block", "__r_block")
    # a task holds the rows that it makes of one row until they are read: those of 16 of the left with a block of the right, not of two blocks
    pieces = F.transform(F.sequence(F.lit(0), F.expr("(size(__l) - 1) div 16")), lambda k: F.slice("__l", k.cast("int") * 16 + 1, 16))
    few = met.select(key, F.explode(pieces).alias("__l"), "__r")
    each = few.select(key, F.explode("__l").alias("__l"), "__r").select(key, "__l", F.explode("__r").alias("__r"))
    return each.select(key, *(F.col(f"{side}.{c}").alias(c) for side, rows in (("__l", left), ("__r", right)) for c in rows.columns if c != key))


def _pairs_of_cell(chunk: int, numbers: int = 1 << 63):
    """What makes the pairs of one cell, about chunk of them with their states at a time; a pair and state is one number where there are enough numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(values):
            """The place of each value in order, and the different values in order."""
            coded = values.dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)

        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        column = lambda name: rows.column(name).chunk(0)
        i, j, g = (column(c).to_numpy() for c in ("i", "j", "g"))
        same = i[0] == j[0]
        state, states = ranked(column("state"))
        lists = [column("writers"), column("readers")]
        row = np.concatenate([np.repeat(np.arange(len(g)), pc.list_value_length(x).to_numpy()) for x in lists])
        values = [x.flatten() for x in lists]
        who, names = ranked(pa.concat_arrays(values))
        writes, on, n, ns = np.arange(len(who)) < len(values[0]), state[row], len(names), len(states)

        # the right side by state, writers first; the left by behaviour
        right = np.flatnonzero((g == j)[row])
        right = right[np.lexsort((~writes[right], on[right]))]
        met, of_state = who[right], np.bincount(on[right], minlength=ns)
        of_writers, start = np.bincount(on[right][writes[right]], minlength=ns), np.cumsum(of_state) - of_state
        left = np.flatnonzero((g == i)[row])
        size = np.where(writes[left], of_state[on[left]], of_writers[on[left]])
        left, size = left[size > 0], size[size > 0]
        order = np.argsort(who[left], kind="stable")
        left, size = left[order], size[order]
        who, on, ends = who[left], on[left], np.cumsum(size)
        last = np.flatnonzero(np.append(who[1:] != who[:-1], True)) + 1 if len(who) else np.empty(0, np.int64)  # behind each behaviour's rows
        lo = done = 0
        while lo < len(who):
            k = max(np.searchsorted(ends[last - 1], done + chunk, "right") - 1, np.searchsorted(last, lo, "right"))
            hi = last[k]
            c, at, lowest = size[lo:hi], on[lo:hi], who[lo]
            x, s = np.repeat(who[lo:hi] - lowest, c), np.repeat(at, c)
            y = met[np.arange(done, ends[hi - 1]) + np.repeat(start[at] - (ends[lo:hi] - c), c)]
            if same:
                keep = x + lowest < y
                x, y, s = x[keep], y[keep], s[keep]
            if int(who[hi - 1] - lowest + 1) * n * ns < numbers:
                key = (x * n + y) * ns + s
                key.sort()
                pair, s = np.divmod(key, ns)
                x, y = np.divmod(pair, n)
            else:
                order = np.lexsort((s, y, x))
                x, y, s = x[order], y[order], s[order]
            lo, done = hi, ends[hi - 1]
            if not len(s):
                continue
            first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            offsets = np.append(first, len(s)).astype(np.int32)
            x, y = x[first] + lowest, y[first]
            found = pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.minimum(x, y))), names.take(pa.array(np.maximum(x, y))), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), states.take(pa.array(s)))],
                names=["a", "b", "n_states", "states"],
            )
            for k in range(0, len(first), 50_000):
                yield found.slice(k, 50_000)

    return run


def shared_state_pairs(accesses: DataFrame, per_cell: int = 32_000_000, per_group: int = 1_000_000, chunk: int = 1_000_000) -> DataFrame:
    """a, b, n_states, states: behaviours that access a state in common of which at least one writes it, a < b.

    accesses: behaviour, state, writes.  A state that k behaviours read and w
    write gives only pairs with a writer.  Behaviours are dealt into groups, as many as
    leave about per_cell pairs to each two of them and per_group accesses to each; what
    two groups do to a state meets in their cell, so no pair is shuffled.  A cell numbers
    its behaviours and states and makes its pairs as sorted numbers, about chunk at a
    time: beside its accesses it holds no more, however many pairs it has.
    """
    each = accesses.where("behaviour is not null and state is not null").groupBy("behaviour", "state").agg(F.coalesce(F.max("writes"), F.lit(False)).alias("writes"))
    each = written(each, scratch(accesses.sparkSession))
    sizes = each.groupBy("state").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("writes").alias("w"))
    pairs, rows = (v or 0 for v in sizes.agg(F.sum(F.col("n") * F.col("w")), F.sum("n")).first())
    cores = accesses.sparkSession.sparkContext.defaultParallelism
    to_each = min(per_cell, max(1_000_000, pairs / (4 * cores)))
    groups = int(max((2 * pairs / to_each) ** 0.5, rows / per_group)) + 1
    tasks = min(groups * (groups + 1) // 2, max(4 * cores, int(2 * pairs // to_each)))
    dealt = each.withColumn("g", F.pmod(F.xxhash64("behaviour"), F.lit(groups)))
    # where a state's accesses have to go: to the cells with groups that have it too, if one of both writes it
    places = dealt.groupBy("state", "g").agg(F.max("writes").alias("w")).groupBy("state").agg(F.collect_list(F.struct("g", "w")).alias("others"))
    of = lambda kind, which: F.collect_list(F.when(which, F.col("behaviour"))).alias(kind)
    blocks = dealt.groupBy("state", "g").agg(of("writers", F.col("writes")), of("readers", ~F.col("writes")))
    sent = blocks.join(places, "state").withColumn("other", F.explode("others")).where("other.w or size(writers) > 0")
    sent = sent.select(F.least("g", "other.g").alias("i"), F.greatest("g", "other.g").alias("j"), "g", "state", "writers", "readers").repartition(tasks, "i", "j")
    types = {f.name: f.dataType for f in each.schema.fields}
    found = StructType([StructField("a", types["behaviour"]), StructField("b", types["behaviour"]), StructField("n_states", LongType()), StructField("states", ArrayType(types["state"]))])
    return sent.groupBy("i", "j").applyInArrow(_pairs_of_cell(chunk), found)


def summarised(relations: DataFrame, keys: list[str], members: dict[str, Column]) -> DataFrame:
    """Member relations folded to one row per key, with counts and the given aggregates."""
    return relations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"), *(c.alias(n) for n, c in members.items()))


def ordinals(rows: DataFrame, keys: list[str], order: list[str]) -> Column:
    """0, 1, ... among rows with the same key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def unique_names(rows: DataFrame, scope: list[str], name: str, order: list[str]) -> DataFrame:
    """name, and name~2, name~3, ... for those that a scope has again."""
    nth = F.row_number().over(Window.partitionBy(*scope, name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(nth == 1, F.col(name)).otherwise(F.concat_ws("~", F.col(name), nth.cast("string"))))


def earlier_values(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """earlier: the values of all rows before this one in its group, in order."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("earlier", F.collect_list(value).over(window))


def carried(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def best_of_each(rows: DataFrame, owner: list[str], priority: list[Column]) -> DataFrame:
    """The rows of highest priority per owner; ties all stay."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(*owner).orderBy(*priority))).where("__r = 1").drop("__r")


def islands(spans: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Overlapping or touching half-open spans merged; what lies between consecutive ones is uncovered."""
    window = Window.partitionBy(*group).orderBy(low, high)
    before = F.max(high).over(window.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(low) < F.col(high)).withColumn("__new", F.when(before >= F.col(low), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(window))
    return marked.groupBy(*group, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def gaps(spans: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """The uncovered spans between the islands of a group."""
    merged = islands(spans, group, low, high)
    following = F.lead(low).over(Window.partitionBy(*group).orderBy(low))
    return merged.withColumn("__next", following).where("__next is not null").select(*group, F.col(high).alias(low), F.col("__next").alias(high))


def limited(rows: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in order, and one row with total, omitted and truncated."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(limit), total.select("total", F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"), (F.col("total") > limit).alias("truncated"))


def search_score(text: Column, query: str) -> Column:
    """0 equal, 1 prefix, 2 inside, 3 not at all; upper and lower case do not differ."""
    text, query = F.lower(text), query.lower()
    return F.when(text == query, 0).when(text.startswith(query), 1).when(text.contains(query), 2).otherwise(3)


def bus_groups(bits: DataFrame, endpoints: DataFrame) -> DataFrame:
    """signature, width, first: bits whose sets of endpoints are equal form one net; first is the bit of the least position.

    bits: bit, position; endpoints: bit, endpoint.  No net's bits are gathered in
    one row; signed_bits() has them by signature.
    """
    return signed_bits(bits, endpoints).groupBy("signature").agg(F.count(F.lit(1)).alias("width"), F.min_by("bit", F.struct("position", "bit")).alias("first"))


def signed_bits(bits: DataFrame, endpoints: DataFrame) -> DataFrame:
    """bit, position, signature: the bits that have endpoints, with a digest of the set of them."""
    signed = endpoints.groupBy("bit").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("endpoint")), "\u0001"), 256).alias("signature"))
    return bits.select("bit", "position").join(signed, "bit")

