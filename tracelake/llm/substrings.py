"""Substring dedup: repeated word windows found by Rabin-Karp hashes.

Documents are dealt into groups of about group_bytes.  Each group hashes all
its windows and keeps one entry a window, with its smallest doc_id; the entries
are dealt by hash to buckets, where Spark brings equal windows of all groups
together.  A bucket answers each group with one bit an entry: whether the window
starts in a smaller document of another group.  The group then merges its
repeated windows into maximal removal intervals.  A window that fills a third of
all documents is one entry a group, so no bucket holds its every occurrence.

The shuffled data are the texts once, and for each entry the hash and the id,
sorted and laid out by byte so that they compress.  A window is taken for
another with a probability of about n / 2**64 among n windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ragged as R
from tracelake.llm.session import table

NO_ID = np.iinfo(np.int64).max
ENTRIES = "bucket int, g int, hashes binary, ids binary, n int"
ANSWERS = "g int, bucket int, earlier binary, n int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def planes(x: np.ndarray) -> bytes:
    """64-bit values by byte: all first bytes, then all second bytes, ..."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def from_planes(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view("<u8").ravel()


def buckets_of(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds: entries bounds[b] to bounds[b + 1] of the sorted hashes are in bucket b."""
    top = (sorted_hashes >> R.U(32)) * R.U(n) >> R.U(32)
    return np.searchsorted(top, np.arange(n + 1, dtype=np.uint64))


class Group:
    """The documents of one group in order of doc_id, with their windows."""

    def __init__(self, rows: pa.Table, size: int):
        ids = rows.column("doc_id")
        self.null = np.asarray(ids.is_null())
        keys = np.where(self.null, NO_ID, np.asarray(ids.fill_null(0), np.int64))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.null = self.null[self.order]
        self.column = rows.column("text").take(pa.array(self.order))
        self.size = size
        self.hashes, owners, self.parts = [], [], []
        for at, _, texts in R.chunks(R.texts_of(self.column)):
            words = R.words_of(texts, R.SPACED)
            h = R.span_hashes(texts.data, words.starts, words.ends)
            starts = R.window_starts(words.first, size)
            self.hashes.append(R.window_hashes(h, size)[starts] if len(starts) else np.zeros(0, np.uint64))
            owners.append(np.searchsorted(words.first, starts, "right") - 1 + at)
            self.parts.append((at, texts, words, starts))
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        flat = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        ordered = flat[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.entries = ordered[new]  # sorted; documents are in order, so the first of each has the smallest id
        self.least = self.keys[self.owner[by[new]]] if len(by) else np.zeros(0, np.int64)
        self.entry_of = np.empty(len(by), np.int64)
        self.entry_of[by] = np.cumsum(new) - 1


def substring_dedup(docs: DataFrame, window: int = 13, group_bytes: int = 12 << 20, group_rows: int = 50_000) -> DataFrame:
    """Per document the words left when repeated windows are removed.

    docs: doc_id and text; other columns are not read.  A word goes if it lies
    in a window of `window` words that also starts in a document with a smaller
    doc_id.  Windows of one document, or of rows with the same doc_id, do not
    remove each other.  Null and empty texts have no words and the hash of "".
    A null doc_id counts as larger than any other.  Repeated rows give one row
    each; they are in one group.  An empty table gives no rows.  A text is worked
    on whole, in about 30 times its size of memory.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows, size = docs.where(worded).agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-(size or 0) // group_bytes), -(-rows // group_rows))
    without = docs.where(~worded).select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    dealt = docs.where(worded).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def enter(rows: pa.Table) -> pa.Table:
        g = Group(rows, window)
        bounds = buckets_of(g.entries, n)
        held = np.flatnonzero(np.diff(bounds))
        spans = [slice(bounds[b], bounds[b + 1]) for b in held]
        return pa.table(
            {
                "bucket": pa.array(held, pa.int32()),
                "g": pa.array(np.full(len(held), rows.column("g")[0].as_py()), pa.int32()),
                "hashes": pa.array([planes(g.entries[s]) for s in spans], pa.binary()),
                "ids": pa.array([planes(g.least[s]) for s in spans], pa.binary()),
                "n": pa.array([s.stop - s.start for s in spans], pa.int32()),
            }
        )

    def answer(rows: pa.Table) -> pa.Table:
        counts = np.asarray(rows.column("n"), np.int64)
        hashes = np.concatenate([from_planes(x.as_py(), k) for x, k in zip(rows.column("hashes"), counts)])
        ids = np.concatenate([from_planes(x.as_py(), k) for x, k in zip(rows.column("ids"), counts)]).view(np.int64)
        by = np.argsort(hashes, kind="stable")
        ordered = hashes[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        least = np.minimum.reduceat(ids[by], np.flatnonzero(new))
        earlier = np.empty(len(by), bool)
        earlier[by] = ids[by] > least[np.cumsum(new) - 1]
        cuts = np.split(earlier, np.cumsum(counts)[:-1])
        return pa.table(
            {
                "g": rows.column("g").cast(pa.int32()),
                "bucket": rows.column("bucket").cast(pa.int32()),
                "earlier": pa.array([np.packbits(c).tobytes() for c in cuts], pa.binary()),
                "n": rows.column("n").cast(pa.int32()),
            }
        )

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(rows, window)
        bounds = buckets_of(g.entries, n)
        elsewhere = np.zeros(len(g.entries), bool)
        for b, bits, k in zip(*(answers.column(c).to_pylist() for c in ("bucket", "earlier", "n"))):
            elsewhere[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=k).astype(bool)
        repeated = elsewhere[g.entry_of] | (g.keys[g.owner] > g.least[g.entry_of]) if len(g.owner) else np.zeros(0, bool)
        n_words, n_removed, digests, at_window = [], [], [], 0
        for _, texts, words, starts in g.parts:
            hit = starts[repeated[at_window : at_window + len(starts)]]
            at_window += len(starts)
            gone = R.covered(hit, window, int(words.first[-1]))
            total = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(words.first))
            n_removed.append(total[words.first[1:]] - total[words.first[:-1]])
            digests += kept_digests(texts, words, ~gone)
        return pa.table(
            {
                "doc_id": pa.array(np.where(g.null, 0, g.keys), pa.int64(), mask=g.null),
                "n_words": pa.array(np.concatenate(n_words), pa.int64()),
                "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    answers = dealt.groupBy("g").applyInArrow(enter, ENTRIES).groupBy("bucket").applyInArrow(answer, ANSWERS)
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(remove, RESULT).union(without)


def kept_digests(texts: R.Texts, words: R.Words, kept: np.ndarray) -> list[str]:
    """SHA-256 of each text's kept words, joined by one space."""
    starts, lengths = words.starts[kept], (words.ends - words.starts)[kept] + 1  # and the byte that follows, made a space
    source = R.ranges(starts, lengths)
    spaces = np.cumsum(lengths) - 1
    source[spaces] = 0
    flat = texts.data[source] if len(source) else np.zeros(0, np.uint8)
    flat[spaces] = 0x20
    count = np.concatenate([[0], np.cumsum(kept)])[words.first]
    place = np.concatenate([[0], np.cumsum(lengths)])[count]
    view = memoryview(flat)
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM d),
windows AS (
  SELECT r, doc_id, k, word, count(*) OVER s AS n, string_agg(word, ' ') OVER s AS win
  FROM x WINDOW s AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
earliest AS (SELECT win, min(doc_id) AS least FROM windows WHERE n = 13 GROUP BY win),
hits AS (SELECT r, k, word, coalesce(n = 13 AND doc_id > least, false) AS hit FROM windows LEFT JOIN earliest USING (win)),
gone AS (SELECT r, k, word, bool_or(hit) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS g FROM hits),
done AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE g) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT g) AS kept
  FROM gone GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done USING (r)
"""
}
