"""Token counts by rank-synchronous merging of byte-level BPE.

Pre-tokens are held as one ragged numpy array of symbols.  In each round every
sequence applies its own lowest-rank pair, at all places at once; sequences
without a mergeable pair are done and their symbols are counted.  As a merge
only makes pairs of higher rank, this gives what merging one pair at a time does.

A text is cut at white space into units that the pre-tokenizer never joins.
Each distinct unit of a chunk is merged once and remembered by its hash; a
worker remembers a bounded number of them, those that it met last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import ragged as R
from tracelake.llm.session import bounded_batches, table

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
NEVER = np.iinfo(np.int64).max
#: So many words or units are remembered by a worker.
CACHED = 1 << 19


def vocabulary_path(name: str) -> str:
    """A vocabulary file: an absolute path, or a name that the installed public tokenizers know."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Known:
    """Values of the hashes met so far, in sorted arrays; of more than `most`, about half stay: those met last."""

    def __init__(self, most: int = CACHED):
        self.most, self.turn = most, 0
        self.keys, self.values, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 for one that is not known."""
        self.turn += 1
        if not len(self.keys):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        there = self.keys[place] == hashes
        self.met[place[there]] = self.turn
        return np.where(there, self.values[place], -1)

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """New hashes, ascending."""
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.values, self.met = np.insert(self.keys, at, hashes), np.insert(self.values, at, values), np.insert(self.met, at, self.turn)

    def trim(self) -> bool:
        """Forgets what was not met for longest, if there is too much."""
        if len(self.keys) <= self.most:
            return False
        stay = self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]
        self.keys, self.values, self.met = self.keys[stay], self.values[stay], self.met[stay]
        return True


def distinct_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values ascending, each value's place among them, and where each first stands."""
    codes, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    by = np.argsort(found, kind="stable")
    rank = np.empty(len(found), np.int64)
    rank[by] = np.arange(len(found))
    return found[by], rank[codes], first[by]


class ByteBpe:
    """The merges of a byte-level BPE file, and the counts of units seen so far in this worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        by = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[by], by, made[by]
        self.symbol = {c: i for c, i in vocab.items() if len(c) == 1}
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.counts = Known()

    def merged(self, sequences: list[list[int]]) -> np.ndarray:
        """Symbols left in each sequence when nothing more merges."""
        out = np.zeros(len(sequences), np.int64)
        lengths = np.array([len(s) for s in sequences], np.int64)
        symbols = np.fromiter(chain.from_iterable(sequences), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(sequences)), lengths)
        while len(symbols):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            key = np.append(symbols[:-1] << 32 | symbols[1:], 0)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[place] == key, self.rank[place], NEVER)
            rank[np.append(begin[1:], len(symbols)) - 1] = NEVER  # the last symbol of a sequence has no pair
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbols)))
            done = best == NEVER
            out[owner[begin[done]]] = size[done]
            apply = (rank == np.repeat(best, size)) & (rank != NEVER)
            places = np.arange(len(symbols))
            run = places - np.maximum.accumulate(np.where(apply, -1, places))  # 1, 2, ... along overlapping pairs
            apply &= run % 2 == 1
            symbols[apply] = self.made[place[apply]]
            stay = ~np.repeat(done, size)
            stay[1:] &= ~apply[:-1]
            symbols, owner = symbols[stay], owner[stay]
        return out

    def count_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each text that has no special string inside."""
        pieces = [[p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(u)] for u in units]
        n = self.merged([[self.symbol[c] for c in p] for ps in pieces for p in ps])
        owner = np.repeat(np.arange(len(units)), [len(ps) for ps in pieces])
        return np.bincount(owner, weights=n, minlength=len(units)).astype(np.int64)

    def count_text(self, text: str) -> int:
        """Tokens of a whole text; each special string is one token, as the library has it by default."""
        parts, n = [text], 0
        for s in self.special:
            cut = [p.split(s) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c if x]
        return n + int(self.count_units(parts).sum())

    def count_texts(self, texts: R.Texts) -> np.ndarray:
        odd = self.odd(texts)
        starts, ends, owner = units_of(texts)
        distinct, codes, first = distinct_of(R.span_hashes(texts.data, starts, ends))
        n = self.counts.get(distinct)
        new = np.flatnonzero(n < 0)
        if len(new):
            raw, spans = texts.data.tobytes(), first[new]
            n[new] = self.count_units([raw[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
            self.counts.put(distinct[new], n[new])
            self.counts.trim()
        out = np.bincount(owner, weights=n[codes], minlength=len(texts)).astype(np.int64)
        for t in np.flatnonzero(odd):
            out[t] = self.count_text(texts.data[texts.offsets[t] : texts.offsets[t + 1]].tobytes().decode())
        return out

    def odd(self, texts: R.Texts) -> np.ndarray:
        """Texts with white space beyond ASCII or with a special string: they are not cut into units."""
        d = texts.data
        places = []
        lead = np.flatnonzero((d == 0xC2) | (d == 0xE1) | (d == 0xE2) | (d == 0xE3))
        if len(lead):
            a, b = d[lead], d[np.minimum(lead + 1, len(d) - 1)]
            c = d[np.minimum(lead + 2, len(d) - 1)]
            space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            space |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            places.append(lead[space])
        raw = d.tobytes()
        for s in self.special:
            at, s = -1, s.encode()
            found = []
            while (at := raw.find(s, at + 1)) >= 0:
                found.append(at)
            places.append(np.array(found, np.int64))
        out = np.zeros(len(texts), bool)
        if places:
            out[np.searchsorted(texts.offsets, np.concatenate(places), "right") - 1] = True
        return out


def units_of(texts: R.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the byte-level pattern never joins, and their texts.

    A word takes one space before it; of other white space before a word the
    last character stands alone, and what is before that is one unit, as is
    white space at a text's end.
    """
    words = R.words_of(texts, R.SPACED)
    text = words.text()
    opening = words.first[:-1][np.diff(words.first) > 0]
    gap = np.empty(len(words.starts), np.int64)
    gap[1:] = words.ends[:-1]
    gap[opening] = texts.offsets[:-1][np.diff(words.first) > 0]
    spaced = words.starts > gap
    before = texts.data[np.maximum(words.starts - 1, 0)]
    joined = spaced & (before == 0x20)
    alone = spaced & ~joined
    rest = words.starts - 1 > gap
    tail = texts.offsets[:-1].copy()
    filled = np.diff(words.first) > 0
    tail[filled] = words.ends[words.first[1:][filled] - 1]
    trailing = np.flatnonzero(tail < texts.offsets[1:])
    starts = np.concatenate([words.starts - joined, words.starts[alone] - 1, gap[rest], tail[trailing]])
    ends = np.concatenate([words.ends, words.starts[alone], words.starts[rest] - 1, texts.offsets[1:][trailing]])
    return starts, ends, np.concatenate([text, text[alone], text[rest], trailing])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text.

    docs: doc_id and text; other columns are not read.  Null and empty texts
    have no bytes and no tokens.  Repeated rows give one row each.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary_path(vocabulary))
        for batch in batches:
            for at, to, texts in R.chunks(R.texts_of(batch.column(1))):
                n = bpe.count_texts(texts)
                columns = [batch.column(0).slice(at, to - at), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, RESULT)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
