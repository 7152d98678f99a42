"""Quality rules: repetition within a text from a suffix array of its words.

The suffixes of a text, as sequences of words, are sorted by prefix doubling.
Runs of suffixes that share a prefix are its longest-common-prefix intervals;
each gives a maximal repeated substring.  The spans of those of min_repeat words
or more are united; a text fails when they cover too much of it or when one
repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, table

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)]
    + [T.StructField("repeat_fraction", T.DoubleType(), False), T.StructField("longest_repeat", T.LongType(), False)]
)


def repeats(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places where a repeated substring of `least` words or more starts, and the length of the longest one there.

    Suffixes are ranked by their first 1, 2, 4, ... words; a suffix whose rank
    is its own is done.  The lengths are the larger of the longest common
    prefixes with both neighbours in suffix order.
    """
    n = len(hashes)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = R.mix(hashes ^ R.mix(text.astype(np.uint64) + R.U(1)))
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    end = np.repeat(first[1:], np.diff(first))
    alone = np.append(new[1:], True) & new
    active = np.sort(order[~alone])
    levels, width = [rank], 1
    while len(active):
        beyond = active + width
        following = np.where(beyond < end[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.lexsort((following, rank[active]))
        a, g, f = active[by], rank[active[by]], following[by]
        new_group = np.ones(len(a), bool)
        new_group[1:] = g[1:] != g[:-1]
        new_rank = new_group.copy()
        new_rank[1:] |= f[1:] != f[:-1]
        places = np.arange(len(a))
        inside = places - np.maximum.accumulate(np.where(new_group, places, 0))
        rank = rank.copy()
        rank[a] = g + np.maximum.accumulate(np.where(new_rank, places, 0)) - places + inside
        single = np.append(new_rank[1:], True) & new_rank
        active = np.sort(a[~single])
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1], order[1:]
    both = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[both], right[both]
    common = np.zeros(len(both), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = left + common, right + common
        inside = (x < end[left]) & (y < end[right])
        inside &= (x + (1 << k) <= end[left]) & (y + (1 << k) <= end[right])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    starts = np.flatnonzero(longest >= least)
    return starts, longest[starts]


def measure(texts: R.Texts, min_repeat: int) -> dict[str, np.ndarray]:
    """Counts of one chunk of texts."""
    words = R.words_of(texts, R.SPACED)
    n_words = np.diff(words.first)
    point = (texts.data & 0xC0) != 0x80
    starts, lengths = repeats(R.span_hashes(texts.data, words.starts, words.ends), words.first, min_repeat)
    hit = np.concatenate([[0], np.cumsum(R.covered(starts, lengths, int(words.first[-1])))])
    of = np.searchsorted(words.first, starts, "right") - 1
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, of, lengths)

    # lines: from a text's begin or after \n, up to \n or the text's end
    breaks = np.flatnonzero(texts.data == 10)
    owner = np.searchsorted(texts.offsets, breaks, "right") - 1
    begins = np.concatenate([texts.offsets[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(len(texts)), owner])
    by = np.lexsort((begins, line_text))
    begins, line_text = begins[by], line_text[by]
    ends = np.empty(len(begins), np.int64)
    ends[:-1] = begins[1:] - 1
    last = np.append(line_text[1:] != line_text[:-1], True) if len(begins) else np.zeros(0, bool)
    ends[last] = texts.offsets[1:][line_text[last]]
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends, line_text = begins[worded], ends[worded], line_text[worded]
    line = R.mix(R.span_hashes(texts.data, begins, ends) ^ R.mix(line_text.astype(np.uint64) + R.U(1)))
    by = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[1:] = line[by][1:] == line[by][:-1]
    return {
        "n_words": n_words,
        "word_chars": texts.sums(R.SPACED[texts.data] & point),
        "n_symbols": texts.sums(SYMBOLS[texts.data]),
        "n_dup_lines": np.bincount(line_text[by][again], minlength=len(texts)),
        "n_repeat_words": hit[words.first[1:]] - hit[words.first[:-1]],
        "longest_repeat": longest,
    }


class Rules(NamedTuple):
    """A text fails with under min_words words; if the union of its maximal repeated substrings of min_repeat words or more covers over max_percent of its words; or if one repeat has over max_longest words."""

    min_words: int = 20
    min_repeat: int = 8
    max_percent: int = 30
    max_longest: int = 200

    def judge(self, texts: R.Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Counts, whether the rules on words and covered share fail, and whether the text is kept."""
        m = measure(texts, self.min_repeat)
        failed = (m["n_words"] < self.min_words) | (100 * m["n_repeat_words"] > self.max_percent * m["n_words"])
        return m, failed, ~failed & (m["longest_repeat"] <= self.max_longest)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts and the verdict for every document.

    docs: doc_id and text; other columns are not read.  Null and empty texts
    have no words and fail.  Repeated rows give one row each.  An empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in R.chunks(R.texts_of(batch.column(1))):
                m, failed, kept = rules.judge(texts)
                longest = m.pop("longest_repeat")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        *(pa.array(x, pa.int64()) for x in m.values()),
                        pa.array(failed),
                        pa.array(kept),
                        pa.array(m["n_repeat_words"] / np.maximum(m["n_words"], 1)),
                        pa.array(longest, pa.int64()),
                    ],
                    names=SCHEMA.names,
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept; no row moves between partitions."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [rules.judge(texts)[2] for _, _, texts in R.chunks(R.texts_of(batch.column(place)))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM d),
windows AS (
  SELECT r, k, count(*) OVER s AS n, string_agg(word, ' ') OVER s AS win
  FROM x WINDOW s AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
again AS (SELECT r, k, win FROM windows WHERE n = 8 QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 8)) AS place FROM again) GROUP BY r),
-- equal windows at one distance, one after another, are one repeat
pairs AS (SELECT a.r, a.k, b.k - a.k AS gap FROM again AS a JOIN again AS b ON a.r = b.r AND a.win = b.win AND a.k < b.k),
runs AS (SELECT r, count(*) + 7 AS size FROM (SELECT r, gap, k - row_number() OVER (PARTITION BY r, gap ORDER BY k) AS run FROM pairs) GROUP BY r, gap, run),
longest AS (SELECT r, max(size) AS longest_repeat FROM runs GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
doubled AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(longest_repeat, 0) AS longest_repeat
  FROM d LEFT JOIN covered USING (r) LEFT JOIN longest USING (r) LEFT JOIN doubled USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND longest_repeat <= 200 AS kept,
  CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS repeat_fraction, longest_repeat
FROM judged
"""
}
