"""Near-duplicate documents by Order MinHash.

A document is the sequence of its five-word shingles, each labelled with how
often it occurred before.  A sketch is the `ell` labelled shingles of least hash,
kept in text order, so it is shared by texts that agree in content and in order.
Documents with one of `bands` equal sketches are candidates.  A candidate pair is
verified by a banded alignment of the two shingle sequences: with n aligned
shingles the similarity is n / (a + b - n).

Exact copies count as one text throughout.  In a bucket every text is compared
with one of them, its head.  Where a bucket still has several classes, its texts
are compared with the one nearest to their mean.  What is then still open meets
by prefixes: texts that are alike share one of the rarest shingles of each, so
only those that share such a shingle, as well as a sketch, are verified, and
never two of one class.  Where they meet, parities of hash slots tell at least how many
shingles two texts do not share; what cannot be alike by that makes no row, and a
pair that shares many rare shingles makes one where it meets by the rarest.  So
every pair that shares a sketch is verified or ruled out, and a crowded bucket is
not compared all with all.

Two texts at the threshold of 0.8 share one sketch of three shingles with a
probability of about 0.51; all 16 bands miss with one of 1e-5.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ragged as R
from tracelake.operators.components import components
from tracelake.llm.session import bounded_batches, shared_dir, table, written

#: A text's profile: how many of its shingles fall into each of so many ranges of hashes.
RANGES = 16
#: Shingles are counted by so many hash slots; the counts tell rare ones from frequent ones.
SLOTS = 1 << 18
#: A text has so many words of 64 parity bits, one for each hash slot in which its shingles are an odd number.
PARITIES = 8
ODD = [f"odd{i}" for i in range(PARITIES)]
#: A row of a rare shingle tells so many of its text's rarer ones, so that two texts meet once.
RARER = 32
#: Rows of one class are dealt into so many parts where the class's id is joined back.
PARTS = 16
_odd = np.random.default_rng(8).integers(1, 1 << 62, 512, dtype=np.uint64) * R.U(2) + R.U(1)


def labelled(texts: R.Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles, and where each text's begin.  A shorter text that has words is one shingle."""
    words = R.words_of(texts, R.ALNUM)
    h = R.span_hashes(texts.data, words.starts, words.ends, fold=True)
    n = np.diff(words.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]), np.uint64)
    long = n >= shingle
    if long.any():
        rolled = R.window_hashes(h, shingle)
        out[R.ranges(first[:-1][long], count[long])] = rolled[R.ranges(words.first[:-1][long], count[long])]
    for t in np.flatnonzero((n > 0) & ~long):
        lo, hi = words.first[t], words.first[t + 1]
        out[first[t]] = R.window_hashes(h[lo:hi], hi - lo)[0] + R.U(hi - lo)
    owner = np.repeat(np.arange(len(texts)), count)
    key = R.mix(out ^ R.mix(owner.astype(np.uint64) + R.U(1)))
    by = np.argsort(key, kind="stable")
    new = np.append(True, key[by][1:] != key[by][:-1]) if len(by) else np.zeros(0, bool)
    places = np.arange(len(by))
    nth = np.empty(len(by), np.uint64)
    nth[by] = (places - np.maximum.accumulate(np.where(new, places, 0))).astype(np.uint64)
    return R.mix(out + nth * R.U(0xA0761D6478BD642F)), first


def sketches(labels: np.ndarray, first: np.ndarray, ell: int, bands: int) -> np.ndarray:
    """One row per text with shingles, one column per band."""
    count = np.diff(first)
    texts = np.flatnonzero(count)
    count = count[texts]
    owner = np.repeat(np.arange(len(texts)), count)
    begin = first[texts]
    # few values lie below the bound, and those of least hash among them unless too few do
    bound = np.where(count <= 24, np.float64(2**64 - 4096), 24.0 / count * 2.0**64).astype(np.uint64)
    bound[count <= 24] = np.iinfo(np.uint64).max
    per_item = np.repeat(bound, count)
    out = np.zeros((len(texts), bands), np.uint64)
    for b in range(bands):
        v = (labels ^ _odd[b]) * _odd[b + 256]
        v ^= v >> R.U(32)
        at = np.flatnonzero(v <= per_item)
        few = np.bincount(owner[at], minlength=len(texts)) < np.minimum(ell, count)
        if few.any():
            at = np.flatnonzero((v <= per_item) | few[owner])
        by = at[np.lexsort((v[at], owner[at]))]
        o = owner[by]
        rank = np.arange(len(by)) - np.searchsorted(o, np.arange(len(texts)))[o]
        by = np.sort(by[rank < ell])  # in text order
        o = owner[by]
        rank = np.arange(len(by)) - np.searchsorted(o, np.arange(len(texts)))[o]
        key = np.full(len(texts), b, np.uint64)
        for k in range(ell):
            sel = rank == k
            key[o[sel]] = R.mix(key[o[sel]] * R.U(0xE7037ED1A0B428DB) + labels[by[sel]])
        out[:, b] = key
    return out


def similarities(left: R.Texts, right: R.Texts, shingle: int, threshold: float) -> np.ndarray:
    """For each pair the share of shingles that a banded alignment aligns; below the threshold it may be less than that.

    Equal labelled shingles within the band are the alignment's steps; its length
    is their longest increasing subsequence.  The band is as wide as an alignment
    that reaches the threshold can stray.
    """
    a, first_a = labelled(left, shingle)
    b, first_b = labelled(right, shingle)
    na, nb = np.diff(first_a), np.diff(first_b)
    pair_a, pair_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    key_a = R.mix(a ^ R.mix(pair_a.astype(np.uint64) + R.U(1)))
    key_b = R.mix(b ^ R.mix(pair_b.astype(np.uint64) + R.U(1)))
    by = np.argsort(key_b, kind="stable")
    ordered = key_b[by]
    place = np.minimum(np.searchsorted(ordered, key_a), max(len(ordered) - 1, 0))
    at = np.flatnonzero(ordered[place] == key_a) if len(ordered) else np.zeros(0, np.int64)
    pair = pair_a[at]
    i, j = at - first_a[pair], by[place[at]] - first_b[pair]
    band = na + nb - 2 * np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
    near = np.abs(i - j) <= band[pair]
    pair, j = pair[near], j[near]
    aligned = np.bincount(pair, minlength=len(na))
    back = np.flatnonzero((pair[1:] == pair[:-1]) & (j[1:] < j[:-1]))
    bounds = np.searchsorted(pair, np.arange(len(na) + 1))
    for p in np.unique(pair[back]):
        tails: list[int] = []
        for x in j[bounds[p] : bounds[p + 1]].tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        aligned[p] = len(tails)
    total = na + nb - aligned
    return np.where(total > 0, aligned / np.maximum(total, 1), 0.0)


class Rule(NamedTuple):
    """Texts are alike at this similarity of shingles of so many words; candidates share one of `bands` sketches of `ell` shingles."""

    shingle: int = 5
    threshold: float = 0.8
    ell: int = 3
    bands: int = 16

    def alike(self, x: str, y: str, most: Column) -> Column:
        """Can texts of x and y shingles, of which they share `most` at most, be alike?"""
        return most >= F.lit(self.threshold / (1 + self.threshold)) * (F.col(x) + F.col(y)) - 1e-6


def node_of(text: Column) -> Column:
    """A text's number: equal texts, null as an empty one, have the same."""
    return F.xxhash64(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def classes_of(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """doc_id and node (the text) of every row, and node and class of the texts that have others in their class, but for the class's own node."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), node_of(text).alias("node"), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in R.chunks(R.texts_of(batch.column(2))):
                labels, first = labelled(texts, rule.shingle)
                n = np.diff(first)
                held = np.concatenate([[0], np.cumsum(np.where(n > 0, rule.bands, 0))])
                keys = pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(R.signed(sketches(labels, first, rule.ell, rule.bands).ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n, pa.int64()), keys], names=["doc_id", "node", "n", "keys"])

    drawn = written(docs.mapInArrow(sketch, "doc_id long, node long, n long, keys array<long>"), f"{folder}/sketches")
    distinct = drawn.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    buckets = distinct.select("node", "n", F.explode("keys").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.min_by("n", "node").alias("head_n"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    crowded = written(buckets.join(heads, "key"), f"{folder}/buckets")
    met = crowded.select("node").distinct()
    texts = written(docs.select("node", "text").join(met, "node", "left_semi").dropDuplicates(["node"]), f"{folder}/texts")

    # with the bucket's head
    stars = crowded.where((F.col("node") != F.col("head")) & rule.alike("n", "head_n", F.least("n", "head_n")))
    links = written(verified(texts, written(pairs(stars, "node", "head"), f"{folder}/pairs1"), rule), f"{folder}/links1")
    classes = components(links, f"{folder}/classes1")

    # with the text nearest to the bucket's mean, where a bucket still has several classes
    split = written(contested(crowded.select("key", "node", "n"), ["key"], classes), f"{folder}/contested1")
    if not split.isEmpty():
        profile = written(profiles(texts.join(split.select("node").distinct(), "node", "left_semi"), rule), f"{folder}/profiles")
        split = split.join(profile, "node")
        means = split.groupBy("key").agg(*(F.avg(F.get("profile", F.lit(i))).alias(f"mean{i}") for i in range(RANGES)))
        stray = reduce(lambda total, i: total + F.abs(F.get("profile", F.lit(i)) - F.col(f"mean{i}")), range(RANGES), F.lit(0.0))
        hubs = split.join(means, "key").groupBy("key").agg(F.min(F.struct(stray.alias("stray"), "node", "n", "own", "profile")).alias("hub"))
        shared = F.aggregate(F.zip_with(F.col("profile"), F.col("hub.profile"), lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
        spokes = split.join(hubs, "key").where((F.col("own") != F.col("hub.own")) & rule.alike("n", "hub.n", F.least("n", "hub.n")) & rule.alike("n", "hub.n", shared))
        classes = with_links(classes, texts, written(pairs(spokes, "node", "hub.node"), f"{folder}/pairs2"), rule, f"{folder}/2")

        # the rest by rare shingles
        left = written(contested(crowded.select("key", "node", "n"), ["key"], classes), f"{folder}/contested2")
        if not left.isEmpty():
            keys = distinct.select("node", "keys")
            opened = written(left.select("node", "own").distinct().join(texts, "node").join(keys, "node"), f"{folder}/open")
            classes = with_links(classes, opened, written(sharing_rare(opened, rule), f"{folder}/pairs3"), rule, f"{folder}/3")
    return drawn.select("doc_id", "node"), classes


def pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def contested(rows: DataFrame, group: list[str], classes: DataFrame | None) -> DataFrame:
    """The rows of groups with several classes, each with its class as own; without classes the rows have it."""
    if classes is not None:
        placed = rows.join(classes.select("node", F.col("class").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    else:
        placed = rows
    several = placed.groupBy(*group).agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    return placed.join(several.select(*group), group, "left_semi")


def with_links(classes: DataFrame, texts: DataFrame, candidates: DataFrame, rule: Rule, folder: str) -> DataFrame:
    """The classes when those of the candidate pairs (a, b) that verify are linked too: only the classes that they link are connected anew."""
    if candidates.isEmpty():
        return classes
    links = written(verified(texts, candidates, rule), f"{folder}/links")
    if links.isEmpty():
        return classes
    placed = links.join(classes.toDF("a", "class_a"), "a", "left").join(classes.toDF("b", "class_b"), "b", "left")
    joined = components(placed.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")), f"{folder}/classes")
    moved = classes.join(joined.toDF("class", "into"), "class", "left").select("node", F.coalesce("into", "class").alias("class"))
    return written(moved.union(joined), f"{folder}/joined")


def profiles(texts: DataFrame, rule: Rule) -> DataFrame:
    """node and profile of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, chunk in R.chunks(R.texts_of(batch.column(1))):
                labels, first = labelled(chunk, rule.shingle)
                owner = np.repeat(np.arange(len(chunk)), np.diff(first))
                counts = np.bincount(owner * RANGES + (labels >> R.U(60)).astype(np.int64), minlength=len(chunk) * RANGES)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * RANGES, pa.int32()), pa.array(counts, pa.int32()))], names=["node", "profile"])

    return texts.select("node", "text").mapInArrow(run, "node long, profile array<int>")


def slot_counts(texts: DataFrame, rule: Rule) -> np.ndarray:
    """How often the shingles of each hash slot occur in the texts: SLOTS numbers, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, chunk in R.chunks(R.texts_of(batch.column(0))):
                labels, _ = labelled(chunk, rule.shingle)
                seen += np.bincount((labels & R.U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        there = np.flatnonzero(seen)
        for at in range(0, len(there), 50_000):
            part = there[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seen[part], pa.int64())], names=["slot", "n"])

    counts = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[np.asarray(counts.column("slot"))] = np.asarray(counts.column("n"))
    return out


def parities(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text PARITIES words of bits: is the number of its shingles in a hash slot odd?

    Two texts have at least as many shingles that only one of them has as these bits differ.
    """
    bits, texts = 64 * PARITIES, len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    held = np.bincount(owner * bits + ((labels >> R.U(32)) % R.U(bits)).astype(np.int64), minlength=texts * bits)
    return np.packbits((held & 1).astype(np.uint8).reshape(texts, bits), axis=1).view(np.int64)


def prefixes(texts: DataFrame, counts: Broadcast, rule: Rule) -> DataFrame:
    """node, own, n, shingle, place, odd0...: the rarest shingles of each text, of which a text that is alike has one, with their places from the rarest on and the text's parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, chunk in R.chunks(R.texts_of(batch.column(2))):
                labels, first = labelled(chunk, rule.shingle)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(chunk)), n)
                by = np.lexsort((labels, counts.value[(labels & R.U(SLOTS - 1)).astype(np.int64)], owner))
                place = np.arange(len(by)) - np.repeat(first[:-1], n)
                own = np.flatnonzero(place < np.repeat(n - np.ceil(rule.threshold * n - 1e-9).astype(np.int64) + 1, n))
                text = owner[own]
                odd = parities(labels, first)[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(at, to - at).take(pa.array(text)) for c in (0, 1)),
                        *(pa.array(x, pa.int64()) for x in (n[text], R.signed(labels[by[own]]), place[own], *odd.T)),
                    ],
                    names=["node", "own", "n", "shingle", "place", *ODD],
                )

    return texts.select("node", "own", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("node", "own", "n", "shingle", "place", *ODD)))


def sharing_rare(texts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of texts (node, own, text, keys) of different classes that share a sketch and one of their rarest shingles, and can be alike by lengths, places and parities."""
    near = pairs(meetings(texts, rule), "node", "x_node")
    of = lambda c: texts.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"))
    return near.join(of("a"), "a").join(of("b"), "b").where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b")


def meetings(texts: DataFrame, rule: Rule) -> DataFrame:
    """node, x_node: texts (node, own, text) of different classes that share one of their rarest shingles, and can be alike by lengths, places and parities.

    For each shingle only texts that are not of its largest class meet the others.
    Where two have met by a rarer one they do not meet again, as far as each tells
    its first RARER: a pair makes a row, or a few if it shares none of those.
    """
    counts = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, rule))
    rows = contested(prefixes(texts, counts, rule), ["shingle"], None)
    held = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("own", "n", *ODD)), F.sort_array(F.collect_list(F.struct("place", "shingle"))).alias("held"))
    told = held.select("node", "own", "n", *ODD, F.slice("held.shingle", 1, RARER).alias("first"), F.posexplode("held").alias("before", "at"))
    rows = told.select("node", "own", "n", *ODD, "at.place", "at.shingle", F.slice("first", F.lit(1), F.least("before", F.lit(RARER))).alias("rarer"))
    rows = written(rows, shared_dir(texts.sparkSession))
    largest = rows.groupBy("shingle", "own").count().groupBy("shingle").agg(F.max_by("own", "count").alias("large"))
    odd = rows.join(largest, "shingle").where("own <> large").select("shingle", "large", *(F.col(c).alias(f"x_{c}") for c in ("node", "own", "n", "place", "rarer", *ODD)))
    met = rows.join(odd, "shingle").where((F.col("own") != F.col("x_own")) & ((F.col("own") == F.col("large")) | (F.col("x_node") < F.col("node"))))
    apart = reduce(lambda total, c: total + F.bit_count(F.col(c).bitwiseXOR(F.col(f"x_{c}"))), ODD, F.lit(0))
    most = F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place"), (F.col("n") + F.col("x_n") - apart) / 2)
    return met.where(rule.alike("n", "x_n", most) & ~F.arrays_overlap("rarer", "x_rarer")).select("node", "x_node")


def verified(texts: DataFrame, candidates: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of nodes whose alignment reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = R.texts_of(batch.column(2)), R.texts_of(batch.column(3))
            both = left.offsets + right.offsets
            for at, to in R.runs(both):
                linked = np.flatnonzero(similarities(left.part(at, to), right.part(at, to), rule.shingle, rule.threshold) >= rule.threshold - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, to - at).take(pa.array(linked)) for c in (0, 1)], names=["a", "b"])

    right = candidates.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def members(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and least (its smallest doc_id, null if none has one) of every text, and the same with class of those in classes of several."""
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    tops = classes.select(F.col("class").alias("node"), "class").distinct()
    return least, classes.select("node", "class").union(tops).join(least, "node")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of the document's class, for every row.

    docs: doc_id and text; other columns are not read.  Null texts are empty.
    Texts without a word are alike only if they are equal; a text of fewer than
    rule.shingle words is one shingle.  Rows are told apart by their texts, so one
    doc_id with several texts is in the class of each.  A null doc_id stays null
    and is no class's id, unless the class has no other: then that is null.
    Repeated rows give equal rows.  An empty table gives no rows.  A text is
    worked on whole, in about 40 times its size of memory.
    """
    rows, classes = classes_of(docs, rule)
    least, placed = members(rows, classes)
    ids = placed.groupBy("class").agg(F.min("least").alias("class_id"))
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")
    dealt = ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = placed.withColumn("part", part).join(dealt, ["class", "part"]).select("node", "class_id")
    by_node = least.join(told, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"))
    return rows.join(by_node, "node").select("doc_id", "class_id")


def first_of_classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of docs per class, with all its columns: that of the smallest doc_id.

    A null doc_id comes after all others.  Of several texts of a class with one
    doc_id that of the smallest hash stays, of equal texts with one doc_id any row.
    """
    rows, classes = classes_of(docs, rule)
    least, placed = members(rows, classes)
    alone = least.join(placed.select("node"), "node", "left_anti")
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("x")).select("x.node", "x.least")
    kept = alone.select("node", "least").unionByName(first).select(F.col("node").alias("__node"), F.coalesce("least", F.lit(0)).alias("__id"), F.col("least").isNull().alias("__none"))
    number = docs["doc_id"].cast("long")
    keys = {"__node": node_of(docs["text"]), "__id": F.coalesce(number, F.lit(0)), "__none": number.isNull()}
    return docs.withColumns(keys).join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_order_minhash": op8_order_minhash}
ORACLES: dict[str, str] = {}
