"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits one sequence.  The linear
program asks for the least amount of configurations, in fractions, that covers how
often each length occurs.  Multiplicative weights solve it: a length's weight
falls as it is covered, a knapsack dynamic program finds the dearest
configuration, and some of it is taken, until every length is covered.  The
amounts are rounded down, then up where the pieces are there; for what is left the
program is solved again, until that is a tenth of all pieces or rounding places
little.  Best fit, which looks for exact fills first, packs those last pieces.
Plan.bound is the least number of sequences by a dual solution, Plan.placed the
share of the pieces that the program placed.

The histogram has at most max_tokens entries whatever the input's size, and so
have plan and prices; only they are on the driver.  The pieces themselves stay in
Spark: they are numbered within their length and looked up in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, shared_dir, table, written
from tracelake.llm.tokens import Known, distinct_of, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: The program is solved again for the pieces that rounding leaves, until they are this share of all.
LAST_SHARE = 0.1
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordIds:
    """Token ids of white-space separated words, each distinct one encoded once by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.known, self.flat, self.bounds = Known(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: R.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        if self.known.trim():  # the ids of what stays move together
            rows = self.known.values
            size = self.bounds[rows + 1] - self.bounds[rows]
            self.flat, self.bounds = self.flat[R.ranges(self.bounds[rows], size)], np.concatenate([[0], np.cumsum(size)])
            self.known.values = np.arange(len(rows))
        words = R.words_of(texts, R.SPACED)
        distinct, codes, first = distinct_of(R.span_hashes(texts.data, words.starts, words.ends))
        at = self.known.get(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, spans = texts.data.tobytes(), first[new]
            found = self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(words.starts[spans].tolist(), words.ends[spans].tolist())], add_special_tokens=False)
            ids = [x.ids for x in found]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            at[new] = len(self.bounds) - 1 + np.arange(len(new))
            self.known.put(distinct[new], at[new])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)])
        word = at[codes]
        counts = self.bounds[word + 1] - self.bounds[word]
        ids = self.flat[R.ranges(self.bounds[word], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[words.first]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, most: int) -> DataFrame:
    """Every document's pieces, numbered (nth) among those of equal length made by the same task (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_ids(vocabulary_path(vocabulary)), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            for at, to, texts in R.chunks(R.texts_of(batch.column(1))):
                ids, begin = encoder.encode(texts)
                raw = memoryview(ids.astype("<u4").tobytes())
                size = np.diff(begin) + 1
                n = -(-size // most)
                owner = np.repeat(np.arange(to - at), n)
                piece = R.ranges(np.zeros(len(n), np.int64), n)
                start = piece * most
                length = np.minimum(most, size[owner] - start)
                crc = []
                for o, s, k in zip(owner.tolist(), start.tolist(), length.tolist()):
                    a, b = int(begin[o]) + s, min(int(begin[o]) + s + k, int(begin[o + 1]))
                    c = zlib.crc32(raw[4 * a : 4 * b])
                    crc.append(zlib.crc32(end, c) if b - a < k else c)
                by = np.argsort(length, kind="stable")
                ordered = length[by]
                new = np.append(True, ordered[1:] != ordered[:-1])
                nth = np.empty(len(by), np.int64)
                nth[by] = seen[ordered] + np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                seen += np.bincount(length, minlength=most + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at).take(pa.array(owner)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(owner), part), pa.int32()),
                        pa.array(nth, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, PIECES)


def worths(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack's table: the worth of the dearest configuration within each capacity.  prices by length, -inf for one that is not there."""
    value = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        value[c] = max(value[c - 1], prices[c])
        if h := c // 2:  # of two pieces or more, one takes half at most
            value[c] = max(value[c], (prices[1 : h + 1] + value[c - 1 : c - h - 1 : -1]).max())
    return value


def traced(value: np.ndarray, prices: np.ndarray, left: np.ndarray) -> list[int]:
    """A configuration by the table, the longest of equally dear lengths first; none is taken more often than it is left."""
    out, prices, c = [], prices.copy(), len(value) - 1
    while c > 0:
        worth = prices[1 : c + 1] + value[c - 1 :: -1]
        top = worth.max()
        if top == -np.inf:
            break
        out.append(int(np.flatnonzero(worth >= top - 1e-9)[-1]) + 1)
        if out.count(out[-1]) >= left[out[-1]]:
            prices[out[-1]] = -np.inf
        c -= out[-1]
    return out


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack's best configuration at these prices: how often it takes each length.  lengths ascend."""
    every = np.full(capacity + 1, -np.inf)
    every[lengths] = prices
    return np.bincount(traced(worths(every, capacity), every, np.full(capacity + 1, capacity)), minlength=capacity + 1)[lengths]


def dual(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Worths of the lengths, by which no configuration is worth over 1, and the sequences that all pieces need at least by them.

    The best of the functions that give pieces longer than capacity - k a whole
    sequence, shorter ones than k nothing, and the others their share of one; as
    much dearer as the lengths that are there allow.
    """
    length = np.arange(capacity + 1)
    full, part = np.cumsum(demand[::-1])[::-1], np.concatenate([[0], np.cumsum(demand * length)])
    k = np.arange(capacity // 2 + 1)
    bounds = np.append(full, 0)[capacity - k + 1] + (part[capacity - k + 1] - part[k]) / capacity
    best = int(np.argmax(bounds))
    worth = np.where(length > capacity - best, 1.0, np.where(length >= best, length / capacity, 0.0))
    most = worths(np.where(demand > 0, worth, -np.inf), capacity)[-1]
    return (worth / most, float(bounds[best] / most)) if most > 0 else (worth, 0.0)


class Covering(NamedTuple):
    """The program's answer: an amount, in fractions, of each configuration; the least share of its demand that a length gets; the least number of sequences."""

    amounts: dict[tuple[int, ...], float]
    covered: float
    bound: float


def program(demand: np.ndarray, capacity: int, parts: int, slack: float = 0.5, rate: float = 0.2) -> Covering:
    """The fewest configurations that cover the demand, in fractional amounts, by multiplicative weights.

    A length's weight is its worth in the best dual solution that is known, with a
    `slack` of its share of a sequence, times a factor that falls with the share of
    its demand that is covered.  The knapsack finds the dearest configuration; a
    step takes so much of it that none of its lengths gets more than a 1/parts of
    its demand, or than it lacks.  A length that is covered leaves the program,
    which ends when all are.  Weights only fall, so the knapsack's last table
    bounds every configuration's worth; it serves until what it finds is worth less
    than the bound by more than a step changes a weight.
    """
    length = np.arange(capacity + 1)
    worth, bound = dual(demand, capacity)
    base = (1 - slack) * worth + slack * length / capacity
    wanted = demand.astype(float)
    left, step = wanted.copy(), wanted / parts
    price = lambda k: np.where(left[k] > 0, base[k] * np.exp(-rate * (1 - left[k] / np.maximum(wanted[k], 1))), -np.inf)
    prices, amounts, stale = price(length), {}, True
    while left.any():
        if stale:
            value = worths(prices, capacity)
            least = (1 - rate / parts) * value[-1]
        config = traced(value, prices, demand)
        if not stale and prices[config].sum() < least:
            stale = True
            continue
        stale = False
        lengths, n = np.unique(config, return_counts=True)
        amount = float((np.minimum(left[lengths], step[lengths]) / n).min())
        left[lengths] -= amount * n
        left[lengths[left[lengths] < 1e-9 * wanted[lengths]]] = 0
        prices[lengths] = price(lengths)
        key = tuple(sorted(config, reverse=True))
        amounts[key] = amounts.get(key, 0) + amount
    held = demand > 0
    return Covering(amounts, float((1 - left[held] / wanted[held]).min(initial=1.0)), bound)


def rounded(covering: Covering, left: np.ndarray, worth: np.ndarray, loss: float = 0.005) -> Iterator[tuple[int, list[int]]]:
    """Whole copies of the program's configurations, taken from left: first each amount rounded down, then one more in order of what was cut off, as long as the pieces are there.

    Only configurations that the dual solution leaves hardly cheaper than a
    sequence are taken (no others are in an optimal answer).
    """
    tight = [(c, x) for c, x in covering.amounts.items() if worth[list(c)].sum() >= 1 - loss]
    for whole in (True, False):
        for config, x in sorted(tight, key=lambda t: (-(t[1] % 1), t[0])):
            lengths, n = np.unique(config, return_counts=True)
            copies = int((left[lengths] // n).min())
            copies = min(copies, int(x + 1e-9)) if whole else min(copies, 1)
            if copies:
                left[lengths] -= copies * n
                yield copies, list(config)


def best_fit(left: np.ndarray, capacity: int) -> Iterator[tuple[int, list[int]]]:
    """Packs counts by length (left, used up): the longest piece first, then one that fills the rest, or two, or else the longest that fits."""
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return
        config, rest = [int(there[-1])], capacity - int(there[-1])
        left[config[0]] -= 1
        while rest:
            fits = there[: np.searchsorted(there, rest, "right")]
            fits = fits[left[fits] > 0]
            if not len(fits):
                break
            take = [rest] if left[rest] else None
            if take is None:
                other = rest - fits
                pair = np.flatnonzero((other > 0) & (left[np.maximum(other, 0)] > (other == fits)))
                take = [int(fits[pair[-1]]), int(other[pair[-1]])] if len(pair) else [int(fits[-1])]
            for x in take:
                left[x] -= 1
                config.append(x)
                rest -= x
        need = np.bincount(config, minlength=len(left))
        used = need > 0
        more = int((left[used] // need[used]).min())
        left -= more * need
        yield 1 + more, sorted(config, reverse=True)


class Plan:
    """Where the nth piece of a length goes."""

    def __init__(self, histogram: dict[int, int], capacity: int, parts: int):
        count = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            count[length] = n
        self.sequences, used, rows = 0, np.zeros(capacity + 1, np.int64), []

        def use(copies: int, config: list[int]) -> None:
            offset = 0
            for length in sorted(set(config), reverse=True):
                slots = config.count(length)
                rows.append((length, used[length], copies, self.sequences, offset))
                used[length] += copies * slots
                offset += length * slots
            self.sequences += copies

        left, self.rounds = count.copy(), []
        while (now := int(left.sum())) > LAST_SHARE * count.sum() and (not self.rounds or placed > 0.1 * before):
            covering, before = program(left, capacity, parts), now
            for copies, config in rounded(covering, left, dual(left, capacity)[0]):
                use(copies, config)
            placed = now - int(left.sum())
            self.rounds.append(covering)
        self.bound = int(np.ceil(self.rounds[0].bound - 1e-6)) if self.rounds else 0
        self.placed = 1 - float(left.sum() / max(1, count.sum()))  # the program's share of the pieces; best fit packs the others
        for copies, config in best_fit(left, capacity):
            use(copies, config)
        rows.sort()
        self.length, self.rank, self.copies, self.base, self.offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        self.key = self.length << 48 | self.rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, length << 48 | rank, "right") - 1
        within = rank - self.rank[row]
        return self.base[row] + within % self.copies[row], self.offset[row] + within // self.copies[row] * length


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, max_tokens: int = 4096, parts: int = 8) -> DataFrame:
    """Every document's tokens and an end id, in pieces, packed into sequences of at most max_tokens.

    docs: doc_id and text; other columns are not read.  Null and empty texts are
    the end id alone.  Repeated rows are packed each.  An empty table gives no
    rows.  A text is tokenized whole, in about 40 times its size of memory.  The
    pieces are written to the shared folder once, so their numbers do not change
    when a task is run again.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = written(pieces_of(docs, vocabulary, end_id, max_tokens), shared_dir(spark))
    made = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = Plan({r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}, max_tokens, parts)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, rank = batch.columns
            sequence, offset = shared.value.place(np.asarray(own[3], np.int64), np.asarray(rank, np.int64))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    numbered = pieces.join(made.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, RESULT)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
