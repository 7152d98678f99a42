"""Target-distribution importance resampling by bit-sliced aggregation.

A document's features are its runs of 1 to 3 words, dealt to n_buckets buckets by
CRC-32.  Its bucket counts become bit planes: bit b of plane i is bit i of the
count of bucket b.  The gains of the buckets become planes too, of their
magnitudes, one set for positive and one for negative gains.  A weight is the sum
over all pairs of planes of 2**(i + j) * popcount(plane_i AND gain_j), positive
less negative: exact integers, and no multiplication per bucket.

The CRC of a run of words comes from the CRCs of its words: appending n bytes to
a text multiplies its CRC by a fixed matrix over GF(2), which is four table
lookups, so no Python runs per word or feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, shared_dir, table, written

MOST_WORDS = 3
SHORT = 64
BLOCK_DOCS = 128
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of CRC-32 by byte, and for n = 0 to SHORT what appending n zero bytes makes of each byte of a CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    shifts = np.empty((SHORT + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT + 1):
        shifts[n] = step[shifts[n - 1] & 255] ^ (shifts[n - 1] >> 8)
    return step, shifts


def shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """crc through one table of four bytes."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def appended(crc: np.ndarray, lengths: np.ndarray, of_rest: np.ndarray) -> np.ndarray:
    """CRC of each text with a rest of so many bytes behind it, from both CRCs."""
    shifts = crc_tables()[1]
    flat, base = shifts.ravel(), (lengths & (SHORT - 1)) * 1024
    crc = flat[base + (crc & 255)] ^ flat[base + 256 + ((crc >> 8) & 255)] ^ flat[base + 512 + ((crc >> 16) & 255)] ^ flat[base + 768 + (crc >> 24)]
    high, power = lengths // SHORT, shifts[SHORT]
    while high.any():
        odd = np.flatnonzero(high & 1)
        crc[odd] = shifted(crc[odd], power)
        power, high = shifted(power, power), high >> 1
    return crc ^ of_rest


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans."""
    step, lengths = crc_tables()[0], ends - starts
    by = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.int8), kind="stable")
    at, size = starts[by], lengths[by]
    crc = np.full(len(by), 0xFFFFFFFF, np.uint32)
    short = int(np.searchsorted(size, SHORT, "right"))
    for k in range(int(size[short - 1]) if short else 0):
        lo = int(np.searchsorted(size[:short], k, "right"))
        crc[lo:short] = step[(crc[lo:short] ^ data[at[lo:short] + k]) & 255] ^ (crc[lo:short] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(short, len(by)):
        crc[k] = zlib.crc32(data[at[k] : at[k] + size[k]])
    out = np.empty_like(crc)
    out[by] = crc
    return out


def features(texts: R.Texts, n_buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of 1, 2, ... words the bucket of each, in order of texts, with where those of each text begin; and the words of each text."""
    data = FOLD[texts.data]
    words = R.words_of(R.Texts(data, texts.offsets), R.ALNUM)
    crc, lengths = word_crcs(data, words.starts, words.ends), words.ends - words.starts
    step, run, out = crc_tables()[0], crc, []
    for n in range(1, MOST_WORDS + 1):
        if n > 1:
            run = ~run[: max(0, len(crc) - n + 1)]
            run = ~(step[(run ^ 0x20) & 255] ^ (run >> 8))
            run = appended(run, lengths[n - 1 :], crc[n - 1 :])
        starts = R.window_starts(words.first, n)
        out.append(((run[starts] % np.uint32(n_buckets)).astype(np.int64), np.searchsorted(starts, words.first)))
    return out, np.diff(words.first)


def blocks(texts: R.Texts, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket counts of some texts at a time (text by bucket), the features and the words of each."""
    runs, n_words = features(texts, n_buckets)
    for at in range(0, len(texts), BLOCK_DOCS):
        to = min(at + BLOCK_DOCS, len(texts))
        key = np.concatenate([np.repeat(np.arange(to - at), np.diff(first[at : to + 1])) * n_buckets + bucket[first[at] : first[to]] for bucket, first in runs])
        counts = np.bincount(key, minlength=(to - at) * n_buckets).reshape(to - at, n_buckets)
        yield counts, counts.sum(1), n_words[at:to]


def planes(values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each bit i: the rows that have it anywhere, and for them all values' bits i as 64-bit words."""
    most = values.max(1, initial=0)
    pad = -values.shape[1] % 64
    for i in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> i)
        bits = np.pad(((values[rows] >> i) & 1).astype(np.uint8), ((0, 0), (0, pad)))
        yield i, rows, np.packbits(bits, axis=1).view(np.uint64)


class GainPlanes:
    """Signed gains as bit planes of their positive and of their negative magnitudes."""

    def __init__(self, gains: np.ndarray):
        self.signed = [(sign, j, bits[0]) for sign in (1, -1) for j, rows, bits in planes(np.maximum(sign * gains, 0)[None, :]) if len(rows)]

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """The sum of gains over each row of counts."""
        total = np.zeros(len(counts), np.int64)
        for i, rows, bits in planes(counts):
            for sign, j, gain in self.signed:
                total[rows] += sign * (np.bitwise_count(bits & gain).sum(1, dtype=np.int64) << (i + j))
        return total


def bucket_totals(docs: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, n: features of the whole table by bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, texts in R.chunks(R.texts_of(batch.column(0))):
                for bucket, _ in features(texts, n_buckets)[0]:
                    total += np.bincount(bucket, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    parts = docs.select(docs["text"].cast("string").alias("text")).where("text is not null").mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n_buckets: int, scale: int) -> np.ndarray:
    """The gain of each bucket: n_buckets numbers, whatever the size of the tables."""
    spark = docs.sparkSession
    both = bucket_totals(docs, n_buckets).withColumnRenamed("n", "s").join(bucket_totals(target, n_buckets).withColumnRenamed("n", "t"), "bucket", "full")
    held = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    rows = held.select("bucket", "s", "t").toArrow()
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for name, x in (("s", s), ("t", t)):
        x[np.asarray(rows.column("bucket"))] = np.asarray(rows.column(name), float)
    ratio = (t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    bounded_batches(docs.sparkSession)
    n_buckets, sliced = len(gains), GainPlanes(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, texts in R.chunks(R.texts_of(batch.column(1))):
                for counts, n_features, n_words in blocks(texts, n_buckets):
                    ids = batch.column(0).slice(at, len(counts))
                    at += len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(sliced.weights(counts), pa.int64())],
                        names=["doc_id", "n_words", "n_features", "weight"],
                    )

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def globally_ranked(rows: DataFrame, order: list, folder: str) -> DataFrame:
    """The rows with place (0, 1, 2, ...) in a total order, without one task for all.

    Rows are dealt by ranges of the order and sorted within each; a row's place is
    its place in the range plus the rows of the ranges before.  What is broadcast
    is a row for each range.
    """
    spark = rows.sparkSession
    rows = written(rows, f"{folder}/rows")  # ranges come from a sample, which reads the rows once more
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 2_000_000 + 1)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = written(dealt, f"{folder}/dealt")
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes, before = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}, []
    total = 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    offsets = spark.createDataFrame(before, "__range long, __before long")
    return dealt.join(F.broadcast(offsets), "__range").withColumn("place", F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")


def importance_resample(docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, scale: int = 1000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's weight towards the target's distribution of features, its score with Gumbel noise, and its rank if it is drawn.

    docs: doc_id and text; target: text; other columns are not read.  Of the
    documents with min_words words or more, percent of a hundred are drawn, those
    of the highest score, equal scores by smaller doc_id.  Null and empty texts
    have no features and weigh 0; they count as documents but are not drawn.  A
    null doc_id has the noise of an empty id and comes after all others of its
    score.  Repeated rows are documents of their own; of rows with equal id and
    score any may come first.  An empty target gives gains by rarity; an empty
    docs gives no rows.  A text is worked on whole, in about 100 times its size
    of memory.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    gains = bucket_gains(docs, target, n_buckets, scale)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(docs, gains).withColumn("score", F.col("weight") + noise).withColumn("__may", F.col("n_words") >= min_words)
    ranked = globally_ranked(scored, [F.desc("__may"), F.desc("score"), F.asc_nulls_last("doc_id")], shared_dir(spark))
    drawn = ranked.agg(F.expr(f"coalesce({percent} * count_if(__may) div 100, 0)")).first()[0]
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("__may") & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {
    "op11_importance_resampling": r"""
WITH bit AS (SELECT unnest(range(256)) AS i),
step AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM bit)),
texts AS (
  SELECT row_number() OVER () AS r, kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
words AS (SELECT r, kind, generate_subscripts(w, 1) AS k, unnest(w) AS a FROM texts),
runs AS (SELECT r, kind, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM words WINDOW s AS (PARTITION BY r ORDER BY k)),
feature AS (
  SELECT r, kind, a AS f FROM runs UNION ALL SELECT r, kind, a || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT r, kind, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)),
bytes AS (SELECT f, list_transform(range(1, length(x), 2), lambda p : 16 * (instr('0123456789ABCDEF', substr(x, p, 1)) - 1) + instr('0123456789ABCDEF', substr(x, p + 1, 1)) - 1) AS x FROM hexed),
bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda c, y : xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM bytes, step),
counted AS (SELECT r, kind, bucket, count(*) AS n FROM feature JOIN bucketed USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM totals) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) >= 20 AS may, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM texts LEFT JOIN weights USING (r) WHERE kind = 0),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (ORDER BY may DESC, score DESC, doc_id NULLS LAST) AS place FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= (SELECT 5 * count(*) FILTER (WHERE may) // 100 FROM placed) THEN place END AS rank FROM placed
"""
}
