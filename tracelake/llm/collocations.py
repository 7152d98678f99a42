"""Phrase collocations by prefix-free parsing.

A piece of text is cut after every run of `most - 1` words whose hash is a
multiple of `trigger`; the next chunk begins with that same run, so every phrase
of up to `most` words lies whole in a chunk.  Spark brings equal chunks together:
a dictionary of distinct chunks with how often each occurs.  Phrases are counted
inside distinct chunks, times the chunk's frequency; one that starts in the run
that the next chunk repeats is counted there and not here.

Counting goes by length.  A phrase can be frequent only if the shorter phrases in
it are; which those are stands in a table of 2**FILTER_BITS bits, of a size that
does not depend on the input.  A bit that two phrases share lets a rare phrase be
counted, never a frequent one be missed.  Phrases are told apart by 64-bit hashes
of language and words, so among n one is taken for another with a probability of
about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, shared_dir, table, written

FILTER_BITS = 26
SEGMENT_BITS = 16
GATHER_BYTES = 4 << 20
_bytes = np.arange(256)
BREAK = np.isin(_bytes, list(b".,;:!?\n\x0b\x0c\r"))
WORD = ~(BREAK | np.isin(_bytes, list(b" \t")))
SPACE = np.uint8(0x20)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def lang_hashes(langs: pa.Array) -> np.ndarray:
    texts = R.texts_of(langs)
    return R.span_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:])


def chunks_of(texts: R.Texts, lap: int, trigger: int) -> tuple[R.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, and the first word, the end and whether it is its piece's last for every chunk."""
    words = R.words_of(texts, WORD)
    n = len(words.starts)
    cuts = np.concatenate([[0], np.cumsum(BREAK[texts.data])])[words.starts]
    owner = words.text()
    new = np.ones(n, bool)
    new[1:] = (cuts[1:] != cuts[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(new)
    edges = np.append(begins, n)
    starts = R.window_starts(edges, lap)
    hashes = R.window_hashes(R.span_hashes(texts.data, words.starts, words.ends), lap)
    ends = starts[hashes[starts] % R.U(trigger) == 0] + lap if len(starts) else starts
    inner = ends[~np.append(new, True)[ends]]  # a run at the end of its piece ends its last chunk
    first = np.sort(np.concatenate([begins, inner - lap]), kind="stable")
    # in order of words each chunk begins at its piece's begin or at the run that closed the one before
    stops = np.sort(np.concatenate([inner, edges[1:]]), kind="stable")
    last = ~np.isin(stops, inner)
    return words, first, stops, last


def spelled(texts: R.Texts, words: R.Words, first: np.ndarray, stops: np.ndarray) -> R.Texts:
    """The words of each chunk with one space between, all chunks one after another."""
    counts = stops - first
    of = R.ranges(first, counts)
    starts, lengths = words.starts[of], (words.ends - words.starts)[of] + 1
    source = R.ranges(starts, lengths)
    spaces = np.cumsum(lengths) - 1
    source[spaces] = 0
    flat = texts.data[source] if len(source) else np.zeros(0, np.uint8)
    flat[spaces] = SPACE
    return R.Texts(flat, np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])])


def dictionary(docs: DataFrame, lap: int, trigger: int) -> DataFrame:
    """lang, chunk, last, n: distinct chunks and how often each occurs.  A task adds up equal chunks of about 2 MB of text before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            of_lang = lang_hashes(langs)
            for at, _, texts in R.chunks(R.texts_of(batch.column(1))):
                texts = R.Texts(FOLD[texts.data], texts.offsets)
                words, first, stops, last = chunks_of(texts, lap, trigger)
                if not len(first):
                    continue
                flat = spelled(texts, words, first, stops)
                row = at + np.searchsorted(words.first, first, "right") - 1
                key = R.mix(R.span_hashes(flat.data, flat.offsets[:-1], flat.offsets[1:] - 1) ^ R.mix(of_lang[row] + last.astype(np.uint64)))
                _, where, n = np.unique(key, return_index=True, return_counts=True)
                sizes = np.diff(flat.offsets)[where] - 1
                data = flat.data[R.ranges(flat.offsets[where], sizes)]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                chunk = pa.Array.from_buffers(pa.large_string(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(row[where])), chunk, pa.array(last[where]), pa.array(n, pa.int64())], names=["lang", "chunk", "last", "n"])

    parts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    return parts.mapInArrow(run, "lang string, chunk string, last boolean, n long").groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of short rows put together to about GATHER_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Phrases:
    """Word hashes of some chunks, and the phrases that are counted in them."""

    def __init__(self, rows: pa.Table, lap: int):
        self.texts = R.texts_of(rows.column("chunk"))
        self.words = R.words_of(self.texts, WORD)
        self.hashes = R.span_hashes(self.texts.data, self.words.starts, self.words.ends)
        self.row = self.words.text()
        self.times = np.asarray(rows.column("n"), np.int64)
        self.ids = np.asarray(rows.column("id"), np.int64) if "id" in rows.column_names else np.zeros(len(rows), np.int64)
        self.lang = lang_hashes(rows.column("lang"))[self.row]
        last, end = np.asarray(rows.column("last")), self.words.first[1:]
        self.counted = np.arange(len(self.row)) < (end - np.where(last, 0, lap))[self.row]
        self.end = end[self.row]

    def starts(self, n: int) -> np.ndarray:
        """Word places where a phrase of n words is counted."""
        places = np.arange(len(self.row))
        return np.flatnonzero(self.counted & (places + n <= self.end))

    def keys(self, n: int) -> np.ndarray:
        """Hash of language and phrase of n words at every place, within a chunk or not."""
        hashes = R.window_hashes(self.hashes, n)
        return R.mix(hashes ^ R.mix(self.lang[: len(hashes)] + R.U(n)))


class Filter:
    """Hashes of which some are known to be frequent, in a table of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> R.U(64 - FILTER_BITS)
        return (self.bits[at >> R.U(3)] >> (at & R.U(7)).astype(np.uint8)) & 1 == 1


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The bit table of the keys of a table: 2**FILTER_BITS bits, gathered by segments of them."""
    segments = 1 << (FILTER_BITS - SEGMENT_BITS)
    size = (1 << SEGMENT_BITS) // 8

    def run(rows: pa.Table) -> pa.Table:
        at = np.asarray(rows.column("key"), np.int64).view(np.uint64) >> R.U(64 - FILTER_BITS)
        bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
        bits[(at & R.U((1 << SEGMENT_BITS) - 1)).astype(np.int64)] = 1
        return pa.table({"segment": pa.array([int(at[0] >> R.U(SEGMENT_BITS))], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    segment = F.shiftrightunsigned("key", 64 - FILTER_BITS + SEGMENT_BITS)
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    # one key stands for all that have its bit, so a segment's group is bounded
    once = frequent.groupBy(place.alias("place")).agg(F.first("key").alias("key"))
    out = np.zeros(segments * size, np.uint8)
    for r in once.select("key").groupBy(segment).applyInArrow(run, "segment int, bits binary").toLocalIterator():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def counted(chunks: DataFrame, sizes: tuple[int, ...], lap: int, least: int, known: np.ndarray | None, known_size: int) -> DataFrame:
    """size, key, a, id: phrases of the given sizes with a frequency of at least `least`, and the smallest id of a chunk that has each.

    known: the bits of frequent phrases of known_size words; a phrase is counted
    only where all phrases of that size in it are among them.  A task adds up equal
    phrases of about 4 MB of chunks before they are sent.
    """
    spark = chunks.sparkSession
    shared = None if known is None else spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            p = Phrases(rows, lap)
            sure = None if shared is None else Filter(shared.value).holds(p.keys(known_size))
            for size in sizes:
                at = p.starts(size)
                if sure is not None:
                    for k in range(size - known_size + 1):
                        at = at[sure[at + k]]
                keys, where, inverse = np.unique(p.keys(size)[at], return_index=True, return_inverse=True)
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, inverse, p.times[p.row[at]])
                ids = p.ids[p.row[at[where]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size), pa.int32()), pa.array(R.signed(keys)), pa.array(n), pa.array(ids)], names=["size", "key", "a", "id"])

    found = chunks.mapInArrow(run, "size int, key long, a long, id long")
    if len(sizes) == 1:  # one column less to send
        return found.groupBy("key").agg(F.sum("a").alias("a"), F.min("id").alias("id")).where(F.col("a") >= least).select(F.lit(sizes[0]).alias("size"), "key", "a", "id")
    return found.groupBy("size", "key").agg(F.sum("a").alias("a"), F.min("id").alias("id")).where(F.col("a") >= least)


PARTS = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("size", T.IntegerType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("left", "right", "inner")]
)


def chosen(chunks: DataFrame, ids: np.ndarray) -> DataFrame:
    """The chunks whose id is among those of a bit table, and a few others; no row moves."""
    shared = chunks.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(Filter(shared.value).holds(R.mix(np.asarray(batch.column("id"), np.int64).view(np.uint64)))))

    return chunks.mapInArrow(run, chunks.schema)


def spelled_out(chunks: DataFrame, frequent: DataFrame, lap: int, most: int) -> DataFrame:
    """key, lang, phrase, size, left, right, inner of each frequent phrase of 2 words or more, from the one chunk that its counts name.

    left and right: the keys of both parts of each cut; inner: of the shorter phrases of 2 words or more in it.
    """
    mixed = frequent.select(F.col("id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(R.signed(R.mix(np.asarray(batch.column(0), np.int64).view(np.uint64))))], names=["key"])

    wanted = frequent.groupBy("id").agg(F.collect_list("key").alias("keys"))
    rows = chosen(chunks, filter_of(mixed.mapInArrow(hashed, "key long"))).join(wanted, "id").select("lang", "chunk", "last", "n", "keys")

    def lists(columns: list[np.ndarray], n: int) -> pa.Array:
        flat = np.column_stack(columns).ravel() if columns else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(columns)), pa.array(R.signed(np.ascontiguousarray(flat))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            p = Phrases(rows, lap)
            keys = {n: p.keys(n) for n in range(1, most + 1)}
            asked = rows.column("keys").combine_chunks()
            of = np.repeat(np.arange(len(asked)), np.diff(np.asarray(asked.offsets, np.int64)))
            pair = lambda key, row: key ^ R.mix(row.astype(np.uint64))
            asked = pair(np.asarray(asked.flatten(), np.int64).view(np.uint64), of)
            for size in range(2, most + 1):
                at = p.starts(size)
                at = at[np.isin(pair(keys[size][at], p.row[at]), asked)]
                at = at[np.unique(keys[size][at], return_index=True)[1]]
                begins, ends = p.words.starts[at], p.words.ends[at + size - 1]
                data = p.texts.data[R.ranges(begins, ends - begins)]
                offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
                phrase = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
                cuts = range(1, size)
                inner = [keys[n][at + k] for n in range(2, size) for k in range(size - n + 1)]
                columns = [
                    pa.array(R.signed(keys[size][at])),
                    rows.column("lang").combine_chunks().take(pa.array(p.row[at])).cast(pa.string()),
                    phrase,
                    pa.array(np.full(len(at), size), pa.int32()),
                    lists([keys[k][at] for k in cuts], len(at)),
                    lists([keys[size - k][at + k] for k in cuts], len(at)),
                    lists(inner, len(at)),
                ]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=PARTS.names)

    return rows.mapInArrow(run, PARTS)


def collocations(docs: DataFrame, most: int = 4, least: int = 30, best: int = 2000, trigger: int = 64, covered_percent: int = 80) -> DataFrame:
    """The first `best` phrases of every language by how much their parts keep together.

    docs: lang and text; other columns are not read.  A null lang is `und`, a null
    text is empty and has no words; a language without words is left out.  Repeated
    rows count each.  No rows are left of an empty table.  Ties are settled by
    frequency, then by the phrase's bytes, so the rows are the same in every run.  A
    text is worked on whole, in about 40 times its size of memory; a piece without
    a run to cut at is one chunk.  Phrases are of 2 to `most` words, found `least`
    times or more.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    lap, folder = most - 1, shared_dir(spark)
    chunks = written(dictionary(docs, lap, trigger).withColumn("id", F.monotonically_increasing_id()), f"{folder}/chunks")
    frequent = written(counted(chunks, (1,), lap, least, None, 1), f"{folder}/1")
    known = filter_of(frequent)
    for size, sizes in ((1, (2,)), (2, tuple(range(3, most + 1)))):
        if sizes:
            more = written(counted(chunks, sizes, lap, least, known, size), f"{folder}/{sizes[0]}")
            frequent, known = frequent.union(more), filter_of(more) if size == 1 and most > 2 else known
    several = frequent.where("size > 1")
    phrases = written(spelled_out(chunks, several, lap, most).join(several.select("key", "a"), "key"), f"{folder}/phrases")
    cuts = phrases.select("key", "a", F.posexplode(F.arrays_zip("left", "right")).alias("k", "p")).select("key", "a", "k", "p.left", "p.right")
    counts = frequent.where(F.col("size") < most)
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inside = phrases.where("size > 2").select("a", F.explode("inner").alias("key")).groupBy("key").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, "key", "left").where(F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {covered_percent}"))
    scored = kept.join(worst, "key").select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # a language may hold most phrases: the best of each part of it first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    first = scored.withColumn("__at", F.row_number().over(part)).where(F.col("__at") <= best).drop("__at")
    first = first.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= best)
    return first.join(lang_words(chunks, lap), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def lang_words(chunks: DataFrame, lap: int) -> DataFrame:
    """lang, n: all words of each language, from the chunks: the run that the next chunk repeats counts there."""
    words = F.length("chunk") - F.length(F.translate("chunk", " ", "")) + 1 - F.when(F.col("last"), 0).otherwise(lap)
    return chunks.groupBy("lang").agg(F.sum(words * F.col("n")).cast("long").alias("n"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
ORACLES = {
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT r, lang, generate_subscripts(w, 1) AS k, unnest(w) AS w1 FROM pieces),
runs AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4 FROM words WINDOW s AS (PARTITION BY r ORDER BY k)),
grams AS (
  SELECT lang, [w1] AS p FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL),
f AS (SELECT lang, p, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f AS y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, p[i:i + s - 1] AS p FROM (
    SELECT lang, a, p, s, unnest(range(1, len(p) - s + 2)) AS i FROM (SELECT lang, a, p, unnest(range(2, len(p))) AS s FROM f WHERE len(p) > 2))),
longer AS (SELECT lang, p, max(a) AS longer FROM inner_phrases GROUP BY lang, p),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score FROM least AS s LEFT JOIN longer AS o ON o.lang = s.lang AND o.p = s.p
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
}
