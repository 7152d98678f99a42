"""Secret scans: known shapes, and a battery of randomness tests.

Beside assignments, access keys and long hexadecimal runs, every run of
`[A-Za-z0-9+/_-]` long enough is held against chance.  Its encoding is the first
alphabet that has all its characters.  Three tests ask whether its characters
could be drawn evenly and independently from that alphabet: chi-squared over the
counts, runs above and below the alphabet's middle, and the serial correlation of
neighbours.  The least of the three p-values, corrected for three, is the run's.

What p-value is enough depends on encoding and length: short runs of ordinary
words pass too.  So each run has a decoy, the same number of characters of the
text just before it, other characters left out, tested in the same way.  Spark
counts runs and decoys by encoding, length (in powers of two) and p-value over all
texts; a class accepts runs from the least p-value on at which decoys are at most
`discovery_percent` of the runs accepted, or none.  The table of these limits has
a row for each class and p-value, whatever the size of the input.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, table

#: The shapes, in order of kinds; letters of an assignment's name count in either case.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMED = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]"""
ASSIGNED, ACCESS, HEX = 6, 20, 24
#: Alphabets by what characters they have, the narrowest first: name and size.
ALPHABETS = (("decimal", 10), ("hex", 16), ("HEX", 16), ("lower", 26), ("upper", 26), ("base32", 32), ("base36", 36), ("BASE36", 36), ("letters", 52), ("base62", 62), ("base64", 64), ("base64url", 64), ("mixed", 66))
DIGIT, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = (DIGIT, DIGIT + LOWER[:6], DIGIT + UPPER[:6], LOWER, UPPER, UPPER + DIGIT[2:8], DIGIT + LOWER, DIGIT + UPPER, UPPER + LOWER, UPPER + LOWER + DIGIT, UPPER + LOWER + DIGIT + b"+/", UPPER + LOWER + DIGIT + b"-_", UPPER + LOWER + DIGIT + b"+/-_")
_bytes = np.arange(256)
RUN = np.isin(_bytes, list(ORDERS[-1]))
CAPITALS = np.isin(_bytes, list(UPPER + DIGIT))
HEXES = np.isin(_bytes, list(ORDERS[1]))
#: Bit k: the character is in alphabet k; and its place there.
MEMBER = np.array([sum(1 << k for k, order in enumerate(ORDERS) if b in order) for b in range(256)], np.int32)
PLACE = np.array([[max(order.find(b), 0) for b in range(256)] for order in ORDERS], np.int64)
STEPS = 100


class Scan(NamedTuple):
    """Runs of at least min_bits bits (characters times the logarithm of the alphabet's size) are tested; least_p is the least p-value that any class accepts."""

    min_bits: int = 80
    least_p: float = 0.01
    discovery_percent: int = 5


def two_sided(z: np.ndarray) -> np.ndarray:
    return np.fromiter((math.erfc(abs(x) / math.sqrt(2)) for x in z.tolist()), float, len(z))


def battery(symbols: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """p-value of each sequence: symbols of all one after another, numbers from 0 to the alphabet's size - 1."""
    n, k = lengths.astype(float), sizes.astype(float)
    m = len(lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    of = np.repeat(np.arange(m), lengths)
    total = lambda x: np.bincount(of, x, minlength=m)

    # chi-squared of the counts, as a scaled variable of the same mean and variance, made normal by its cube root
    key, counts = np.unique(of * 128 + symbols, return_counts=True)
    squares = np.bincount(key // 128, counts.astype(float) ** 2, minlength=m)
    chi, scale, freedom = squares * k / n - n, (n - 1) / n, (k - 1) * n / (n - 1)
    z = (np.cbrt(np.maximum(chi, 0) / (scale * freedom)) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    even = np.fromiter((0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()), float, m)

    # runs above and below the middle of the alphabet
    above = symbols * 2 >= np.repeat(sizes, lengths)
    change = np.zeros(len(symbols))
    change[1:] = above[1:] != above[:-1]
    change[first[:-1]] = 1
    up = total(above.astype(float))
    mean = 1 + 2 * up * (n - up) / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 0))
    mixed = two_sided(np.divide(total(change) - mean, spread, out=np.zeros(m), where=spread > 0))
    mixed = np.where(spread > 0, mixed, np.minimum(1, 2.0 ** (1 - np.minimum(n, 1000))))

    # correlation of each symbol with the one before, around the end to the first
    value = symbols - np.repeat(total(symbols.astype(float)) / n, lengths)
    before = np.roll(value, 1)
    before[first[:-1]] = value[first[1:] - 1]
    square = total(value * value)
    r = np.divide(total(value * before), square, out=np.ones(m), where=square > 0)
    serial = two_sided((r + 1 / (n - 1)) / (n / ((n - 1) * np.sqrt(np.maximum(n - 2, 1)))))
    return 1 - (1 - np.minimum(np.minimum(even, mixed), serial)) ** 3


class Runs(NamedTuple):
    """Runs that are long enough: byte spans, alphabet and p-value, and the same of their decoys (alphabet -1: none)."""

    starts: np.ndarray
    ends: np.ndarray
    alphabet: np.ndarray
    p: np.ndarray
    decoy_alphabet: np.ndarray
    decoy_p: np.ndarray


def inferred(data: np.ndarray, lengths: np.ndarray, min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Alphabet and p-value of sequences of characters, one after another; -1 where they have too few bits."""
    alphabet, p = np.full(len(lengths), -1), np.zeros(len(lengths))
    if not len(lengths):
        return alphabet, p
    first = np.concatenate([[0], np.cumsum(lengths)])
    common = np.bitwise_and.reduceat(MEMBER[data], first[:-1])
    narrowest = np.log2((common & -common).astype(float)).astype(np.int64)
    sizes = np.array([k for _, k in ALPHABETS])[narrowest]
    held = np.flatnonzero(lengths * np.log2(sizes) >= min_bits)
    chars = data[R.ranges(first[held], lengths[held])]
    symbols = PLACE.ravel()[np.repeat(narrowest[held], lengths[held]) * 256 + chars]
    alphabet[held] = narrowest[held]
    p[held] = battery(symbols, lengths[held], sizes[held]) if len(held) else 0
    return alphabet, p


def runs_of(texts: R.Texts, scan: Scan) -> Runs:
    """The runs of a chunk of texts that are long enough, tested."""
    words = R.words_of(texts, RUN)
    lengths = words.ends - words.starts
    long = np.flatnonzero(lengths * 6.05 >= scan.min_bits)
    starts, sizes = words.starts[long], lengths[long]
    alphabet, p = inferred(texts.data[R.ranges(starts, sizes)], sizes, scan.min_bits)
    # a decoy: as many characters as the run has, out of those of all runs before it in the text
    held = np.flatnonzero(RUN[texts.data])
    place = np.searchsorted(held, starts)
    begin = np.searchsorted(held, texts.offsets[np.searchsorted(texts.offsets, starts, "right") - 1])
    enough = np.flatnonzero((place - begin >= sizes) & (alphabet >= 0))
    decoy, decoy_p = np.full(len(long), -1), np.zeros(len(long))
    decoy[enough], decoy_p[enough] = inferred(texts.data[held[R.ranges(place[enough] - sizes[enough], sizes[enough])]], sizes[enough], scan.min_bits)
    kept = alphabet >= 0
    return Runs(*(x[kept] for x in (starts, starts + sizes, alphabet, p, decoy, decoy_p)))


def band(lengths: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(lengths, 1)).astype(np.int64)


def steps(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * STEPS).astype(np.int64), STEPS - 1)


def limits(docs: DataFrame, scan: Scan) -> dict[tuple[int, int], int]:
    """For each alphabet and band of lengths the least step of p-values that is accepted; classes that accept nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for _, _, texts in R.chunks(R.texts_of(batch.column(0))):
                found = runs_of(texts, scan)
                bands = band(found.ends - found.starts)
                for which, alphabet, p in ((0, found.alphabet, found.p), (1, found.decoy_alphabet, found.decoy_p)):
                    rows = np.column_stack([alphabet, bands, steps(p)])[alphabet >= 0]
                    for row, n in zip(*np.unique(rows, axis=0, return_counts=True)):
                        total.setdefault(tuple(row.tolist()), [0, 0])[which] += int(n)
        columns = [[key[k] for key in total] for k in range(3)] + [[n[k] for n in total.values()] for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["alphabet", "band", "step", "runs", "decoys"])

    parts = docs.select(docs["text"].cast("string").alias("text")).where("text is not null").mapInArrow(run, "alphabet long, band long, step long, runs long, decoys long")
    counts: dict[tuple[int, int], np.ndarray] = {}
    for r in parts.groupBy("alphabet", "band", "step").agg(F.sum("runs").alias("runs"), F.sum("decoys").alias("decoys")).collect():
        counts.setdefault((r["alphabet"], r["band"]), np.zeros((STEPS, 2), np.int64))[r["step"]] += (r["runs"], r["decoys"])
    out = {}
    for kind, n in counts.items():
        runs, decoys = np.cumsum(n[::-1], axis=0)[::-1].T
        good = np.flatnonzero((100 * decoys <= scan.discovery_percent * runs) & (runs > 0) & (np.arange(STEPS) >= scan.least_p * STEPS))
        if len(good):
            out[kind] = int(good[0])
    return out


def base_spans(texts: R.Texts, column: pa.Array, points: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, kind, end) of the three shapes in code points.

    points: code points before each byte.  Only texts in which a name and a sign
    stand go through the pattern of assignments.
    """
    found = []
    for t in np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(column, NAMED), False))).tolist():
        for m in ASSIGN.finditer(column[t].as_py()):
            if len(m[2]) >= ASSIGNED:
                found.append((t, m.start(), 0, m.end()))
    at = points[texts.offsets[:-1]]
    for kind, kept, least in ((1, CAPITALS, ACCESS), (2, HEXES, HEX)):
        spans = R.words_of(texts, kept)
        long = np.flatnonzero(spans.ends - spans.starts >= least)
        for s, e in zip(spans.starts[long].tolist(), spans.ends[long].tolist()):
            if kind == 1:
                first = texts.data[s:e].tobytes().find(b"AKIA")
                if first < 0 or e - s - first < least:
                    continue
                s += first
            t = int(np.searchsorted(texts.offsets, s, "right")) - 1
            found.append((t, int(points[s] - at[t]), kind, int(points[e] - at[t])))
    return found


def apart(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Does start to end meet none of the united spans?"""
    k = bisect_right(spans, start, key=lambda x: x[1])
    return k == len(spans) or spans[k][0] >= end


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans with those that meet made one, in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def secret_scan(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """Per document the secrets that stand in it: counts of each shape and all spans.

    docs: doc_id and text; other columns are not read.  Spans are in code points,
    the end exclusive, kind:start:end joined by commas in order of start and kind;
    an assignment's span is its whole match.  The battery adds spans of the kind
    random where they meet no other span.  Null and empty texts have no spans, and
    the hash of "".  Repeated rows give one row each, and a null doc_id stays.  An
    empty table gives no rows.  A text is worked on whole, in about 30 times its
    size of memory.
    """
    bounded_batches(docs.sparkSession)
    accepted = limits(docs, scan)
    least = np.full((len(ALPHABETS), 64), STEPS)
    for (alphabet, length), step in accepted.items():
        least[alphabet, length] = step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for at, to, texts in R.chunks(R.texts_of(column)):
                points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                runs = runs_of(texts, scan)
                spans: list[list] = [[] for _ in range(to - at)]
                for t, start, kind, end in base_spans(texts, column.slice(at, to - at), points):
                    spans[t].append((start, kind, end))
                taken = [united(x) for x in spans]
                base = [told(x) for x in spans]
                n = np.array([[sum(kind == k for _, kind, _ in x) for k in range(3)] for x in spans], np.int64).reshape(-1, 3)
                good = steps(runs.p) >= least[runs.alphabet, band(runs.ends - runs.starts)]
                owner = np.searchsorted(texts.offsets, runs.starts, "right") - 1
                n_random = np.zeros(to - at, np.int64)
                for k in np.flatnonzero(good).tolist():
                    t = int(owner[k])
                    s, e = (int(points[x[k]] - points[texts.offsets[t]]) for x in (runs.starts, runs.ends))
                    if apart(taken[t], s, e):
                        spans[t].append((s, 3, e))
                        n_random[t] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        *(pa.array(n[:, k]) for k in range(3)),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                        pa.array([told(x) for x in spans], pa.string()),
                        pa.array(n_random),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
                )

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op13_secret_scan": op13_secret_scan}
#: SQL has no tests of randomness; the shapes are held against a plain scan in the tests.
ORACLES: dict[str, str] = {}
