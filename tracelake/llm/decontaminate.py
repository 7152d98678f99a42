"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` words (a shorter one is one window).  A
window is the set of its shingles.  Shingles are ordered by how often they occur
in the documents; as a window must be contained whole, its prefix is its one
rarest shingle, and only that is joined with the documents' shingles.  A match
gives the place at which the window would have to stand: it must lie within the
document (positional and length bounds), and its words are then compared.

The windows are dealt into blocks of about block_windows.  A block is a file in
the shared folder: the driver makes one at a time, and a worker holds one at a
time, however large the benchmark is.  Documents are read twice and never
shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, shared_dir, table, written

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """One row per window of each item: item_id, pos, size and the hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in R.chunks(R.texts_of(batch.column(1))):
                words = R.words_of(texts, R.ALNUM)
                h = R.span_hashes(texts.data, words.starts, words.ends, fold=True)
                ids, pos, sizes, hashes = [], [], [], []
                for k, item in enumerate(batch.column(0).slice(at, to - at).to_pylist()):
                    lo, hi = words.first[k], words.first[k + 1]
                    size = min(window, hi - lo)
                    for p in range(lo, hi - size + 1) if size else ():
                        ids.append(item)
                        pos.append(p - lo)
                        sizes.append(size)
                        hashes.append(h[p : p + size].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(pos, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())],
                    names=["item_id", "pos", "size", "words"],
                )

    return items.select(items["item_id"].cast("string"), items["text"].cast("string")).mapInArrow(run, "item_id string, pos long, size int, words binary")


class Verdict(NamedTuple):
    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[list[str]]
    contaminated: np.ndarray


class Block:
    """Distinct windows of some items, with their shingles."""

    def __init__(self, rows: pa.Table, shingle: int):
        flat: dict[bytes, list[str]] = {}
        for item, words in zip(rows.column("item_id").to_pylist(), rows.column("words").to_pylist()):
            flat.setdefault(words, []).append(item if item is not None else "")
        self.items = [sorted(set(x)) for x in flat.values()]
        self.words = [np.frombuffer(w, np.uint64) for w in flat]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.width = int(self.sizes.max())
        self.grid = np.zeros((len(self.words), self.width), np.uint64)
        for row, w in zip(self.grid, self.words):
            row[: len(w)] = w
        self.lengths = sorted({min(shingle, int(s)) for s in self.sizes})
        self.shingles = [R.window_hashes(w, min(shingle, len(w))) for w in self.words]
        self.of_length = np.minimum(shingle, self.sizes)
        self.vocabulary = {k: np.unique(np.concatenate([s for s, n in zip(self.shingles, self.of_length) if n == k])) for k in self.lengths}

    def counts_in(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shingle length the places in its vocabulary that occur, and how often."""
        for k in self.lengths:
            found, _ = look_up(self.vocabulary[k], R.window_hashes(hashes, k))
            n = np.bincount(found, minlength=0)
            yield k, np.flatnonzero(n), n[n > 0]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix: its rarest shingle, among equals the least hash."""
        offset, key = [], []
        for s, k in zip(self.shingles, self.of_length):
            place = np.searchsorted(self.vocabulary[int(k)], s)
            best = min(range(len(s)), key=lambda i: (counts.get((int(k), int(place[i])), 0), s[i]))
            offset.append(best)
            key.append(s[best])
        self.offset, key = np.array(offset, np.int64), np.array(key, np.uint64)
        self.prefix, self.with_prefix, self.at_prefix = {}, {}, {}
        for k in self.lengths:
            own = np.flatnonzero(self.of_length == k)
            own = own[np.argsort(key[own], kind="stable")]
            self.prefix[k], begin = np.unique(key[own], return_index=True)
            self.with_prefix[k], self.at_prefix[k] = own, np.append(begin, len(own))

    def places(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a window inside one document: its first word and the window."""
        starts, windows = [], []
        for k in self.lengths:
            entry, at = look_up(self.prefix[k], R.window_hashes(hashes, k))
            lo, hi = self.at_prefix[k][entry], self.at_prefix[k][entry + 1]
            w = self.with_prefix[k][R.ranges(lo, hi - lo)]
            at = np.repeat(at, hi - lo)
            text = np.searchsorted(first, at, "right") - 1
            start = at - self.offset[w]
            fits = (start >= first[text]) & (start + self.sizes[w] <= first[text + 1])
            start, w = start[fits], w[fits]
            for j in range(self.width):
                open_ = self.sizes[w] > j
                same = ~open_
                same[open_] = hashes[start[open_] + j] == self.grid[w[open_], j]
                start, w = start[same], w[same]
            starts.append(start)
            windows.append(w)
        return np.concatenate(starts), np.concatenate(windows)


def look_up(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ordered table of those x that are in it, and their places in x."""
    place = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    at = np.flatnonzero(ordered[place] == x)
    return place[at], at


@lru_cache(maxsize=1)
def block_at(uri: str) -> Block:
    """A block from its file; a worker keeps the last one."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as stream:
        return pickle.loads(stream.read())


def put_block(block: Block, uri: str) -> str:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as stream:
        stream.write(pickle.dumps(block))
    return uri


def judge_of(docs: DataFrame, items: DataFrame, window: int, shingle: int, block_windows: int) -> Callable[[R.Texts], Verdict]:
    """What tells for some texts how far they hold windows of the items; for this the items' shingles are counted in docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark)
    windows = written(item_windows(items, window), f"{folder}/windows")
    n_blocks = -(-windows.count() // block_windows)
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "pos"), F.lit(max(1, n_blocks))).cast("int"))
    dealt.write.partitionBy("block").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
    plain = []
    for b in range(n_blocks):
        rows = dealt.where(F.col("block") == b).select("item_id", "words").toArrow()
        if rows.num_rows:
            plain.append(put_block(Block(rows, shingle), f"{folder}/plain-{b}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for _, _, texts in R.chunks(R.texts_of(batch.column(0))):
                words = R.words_of(texts, R.ALNUM)
                hashes.append(R.span_hashes(texts.data, words.starts, words.ends, fold=True))
            for b, uri in enumerate(plain):
                for h in hashes:
                    for k, which, n in block_at(uri).counts_in(h):
                        columns = (np.full(len(which), b), np.full(len(which), k), which, n)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["b", "k", "which", "n"])

    blocks = []
    if plain:
        rare = docs.select(docs["text"].cast("string")).mapInArrow(count, "b long, k long, which long, n long").groupBy("b", "k", "which").agg(F.sum("n").alias("n"))
        rare = written(rare, f"{folder}/counts")
        for b, uri in enumerate(plain):  # at most a block's shingles at a time
            block = block_at(uri)
            block.order({(r.k, r.which): r.n for r in rare.where(F.col("b") == b).collect()})
            blocks.append(put_block(block, f"{folder}/block-{b}"))
        block_at.cache_clear()

    def judge(texts: R.Texts) -> Verdict:
        words = R.words_of(texts, R.ALNUM)
        h = R.span_hashes(texts.data, words.starts, words.ends, fold=True)
        hit, found = np.zeros(len(h), bool), {}
        for uri in blocks:
            block = block_at(uri)
            start, w = block.places(h, words.first)
            hit |= R.covered(start, block.sizes[w], len(h))
            of = np.searchsorted(words.first, start, "right") - 1
            for t, x in set(zip(of.tolist(), w.tolist())):
                found.setdefault(t, set()).update(block.items[x])
        run = np.concatenate([[0], np.cumsum(hit)])
        n_words, n_hit = np.diff(words.first), run[words.first[1:]] - run[words.first[:-1]]
        return Verdict(n_words, n_hit, [sorted(found.get(t, ())) for t in range(len(texts))], (n_hit > 0) & (20 * n_hit >= n_words))

    return judge


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 3, block_windows: int = 1 << 17) -> DataFrame:
    """Per document: words inside occurrences of item windows, and the items.

    docs: doc_id, text; items: item_id, text; other columns are not read.  Null
    and empty texts have no words; an item without words has no window; with no
    windows at all nothing is hit.  Repeated documents give one row each;
    repeated items count once by item_id (a null one is "").  An empty table
    gives no rows.  A document is worked on whole, in about 25 times its size of
    memory.
    """
    judge = judge_of(docs, items, window, shingle, block_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in R.chunks(R.texts_of(batch.column(1))):
                v = judge(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(v.n_words, pa.int64()),
                        pa.array(v.n_hit, pa.int64()),
                        pa.array([len(x) for x in v.items], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in v.items], pa.string()),
                        pa.array(v.contaminated),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, RESULT)


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 3, block_windows: int = 1 << 17) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated; no row moves between partitions."""
    judge, place = judge_of(docs, items, window, shingle, block_windows), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [judge(texts).contaminated for _, _, texts in R.chunks(R.texts_of(batch.column(place)))]
            yield batch.filter(pa.array(~np.concatenate(bad) if bad else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {
    "op4_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS s, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, s, array_to_string(w[k:k + s - 1], ' ') AS win FROM starts),
x AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM d),
ahead AS (SELECT r, k, array_agg(word) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS words FROM x),
places AS (
  SELECT r, k, s, array_to_string(words[1:s], ' ') AS win
  FROM ahead JOIN (SELECT DISTINCT s FROM windows) AS sizes ON len(words) >= s),
found AS (SELECT r, k, s, item_id FROM places JOIN windows USING (s, win)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + s)) AS place FROM (SELECT DISTINCT r, k, s FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
}
