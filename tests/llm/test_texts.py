"""Operators on whole texts against brute force: quality, decontamination, substrings, tokens, packing."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tracelake.llm import decontaminate, packing, quality, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PHRASE = "the quick brown fox jumps over the lazy dog while seven cats look on"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a " * 400), (5, PHRASE), (6, f"{PHRASE} and more, {PHRASE}"), (7, f"x y z\n{PHRASE}\nx y z\n\nx y z"),
    (8, "é ü 日本語 " * 30), (9, " ".join(f"w{i}" for i in range(6000))), (9, " ".join(f"w{i}" for i in range(6000))), (None, PHRASE), (10, "#*$ %&| <> a"),
    (11, "The QUICK brown fox, jumps over the lazy dog; while SEVEN cats look on!"), (12, " ".join(f"v{i % 7}" for i in range(300))),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, g string, n int, kept boolean")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(r):
    return repr(r)


def test_quality(docs, none):
    want = []
    for i, t in ODD:
        t = t or ""
        w = WORD.findall(t)
        n = len(w)
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(n - 7))
        hit = {k + j for k in range(n - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n))
    got = quality.quality_rules(docs).collect()
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:7]) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_rules(none).count() == 0
    kept = quality.passing(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_longest_repeat_is_the_longest_maximal_repeat():
    rng = np.random.default_rng(3)
    for _ in range(30):
        w = rng.integers(0, 3, 60).astype(np.uint64)
        starts, lengths = quality.repeats(w, np.array([0, 25, 60]), 3)
        got = dict(zip(starts.tolist(), lengths.tolist()))
        for lo, hi in ((0, 25), (25, 60)):
            for i in range(lo, hi):
                best = 0
                for j in range(lo, hi):
                    k = 0
                    while i != j and i + k < hi and j + k < hi and w[i + k] == w[j + k]:
                        k += 1
                    best = max(best, k)
                assert got.get(i, 0) == (best if best >= 3 else 0)


def test_substrings(docs, none):
    first, want = {}, []
    order = [(2**63 if i is None else i, t) for i, t in ODD]
    for i, t in sorted(order, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in order:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((None if i == 2**63 else i, len(w), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    for size in (12 << 20, 4096):
        assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in substrings.substring_dedup(docs, group_bytes=size).collect())
    assert substrings.substring_dedup(none).count() == 0


@pytest.mark.parametrize("block", [1 << 17, 3])
def test_decontamination(spark, docs, none, block):
    items = [(1, PHRASE), (2, "fox jumps"), (3, None), (4, ""), (2, "fox jumps"), (5, " ".join(f"w{i}" for i in range(100, 130))), (6, "v1 v2 v3")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        s = min(13, len(w))
        for k in range(len(w) - s + 1) if s else ():
            windows[tuple(w[k : k + s])].add(str(i))
    want = []
    for i, t in ODD:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= ids
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, table, block_windows=block).collect()
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in got)
    assert decontaminate.decontaminate(none, table).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, table.limit(0)).collect())
    assert decontaminate.uncontaminated(docs, table).count() == sum(not r.contaminated for r in got)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(name))


def test_token_counts(spark, docs, none):
    odd = ["\n\n a  b\t\tc \n", "x<|endoftext|>y <|endoftext|>  z ", "foo  bar  \nbaz　", "aaaaaaaa" * 40, "it's  'll can't 've\n'd", "\x1c \x1f a\x85b", "a\r\n\r\nb", " \n", "1234 5678.90 !!!???" * 9]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    lib = library("byte_bpe_50k.json")
    want = []
    for i, t in [*ODD, *((100 + k, t) for k, t in enumerate(odd))]:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in tokens.token_counts(table).collect())
    assert tokens.token_counts(none).count() == 0


def test_packing(docs, none):
    lib = library("word_bpe_49k.json")
    out = packing.pack(docs).toPandas()
    want = collections.Counter()
    for i, t in ODD:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(-(-len(ids) // 4096)):
            part = np.array(ids[4096 * p : 4096 * p + 4096], "<u4")
            want[(i, p, 4096 * p, len(part), zlib.crc32(part.tobytes()))] += 1
    got = collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == want
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(x.length)
        assert list(x.offset) == [0, *ends[:-1]] and ends.iloc[-1] <= 4096
    assert out.sequence_id.nunique() == -(-out.length.sum() // 4096)
    assert packing.pack(none).count() == 0


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 400, 3000), rng.integers(300, 4097, 800), np.full(500, 1366), np.array([4096, 1, 1])):
        plan = packing.Plan(dict(collections.Counter(lengths.tolist())), 4096, 40)
        seen = collections.defaultdict(list)
        for n, k in collections.Counter(lengths.tolist()).items():
            for s, o in zip(*plan.place(np.full(k, n), np.arange(k))):
                seen[int(s)].append((int(o), n))
        for items in seen.values():
            at = 0
            for o, n in sorted(items):
                assert o == at
                at += n
            assert at <= 4096
        assert len(seen) == plan.sequences and sum(map(len, seen.values())) == len(lengths)
        assert plan.sequences >= -(-int(lengths.sum()) // 4096)


def test_the_knapsack_is_exact():
    lengths, prices = np.array([3, 5, 7]), np.array([4.0, 7.0, 10.0])
    best = max(4 * a + 7 * b + 10 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 22)
    assert float(packing.dearest(lengths, prices, 22) @ prices) == best


def piece_counts(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    made = packing.pieces_of(docs, "word_bpe_49k.json", 1, 4096).groupBy("length").count().collect()
    return {r["length"]: r["count"] for r in made}


@pytest.mark.parametrize("case", ["short", "one", "middle", "few", "many", "sf0.01", "sf0.1"])
def test_the_program_covers_all_and_its_rounding_places_the_bulk(spark, case):
    rng = np.random.default_rng(6)
    lengths = {"short": (rng.integers(1, 200, 20000), 512), "one": (np.full(500, 100), 512), "middle": (rng.integers(1, 1000, 20000), 4096), "few": (np.array([4096, 1, 1, 3000]), 4096), "many": (rng.integers(300, 4097, 80_000), 4096)}
    values, capacity = lengths.get(case, (None, 4096))
    histogram = piece_counts(spark, case) if values is None else dict(collections.Counter(values.tolist()))
    plan = packing.Plan(histogram, capacity, 8)
    demand = np.zeros(capacity + 1)
    for length, n in histogram.items():
        demand[length] = n
    covering = plan.rounds[0]
    got = np.zeros(capacity + 1)
    for config, x in covering.amounts.items():
        assert x > 0 and sum(config) <= capacity
        np.add.at(got, list(config), x)
    assert (got >= (1 - 1e-6) * demand).all() and covering.covered >= 1 - 1e-6
    assert sum(covering.amounts.values()) <= 1.03 * covering.bound + 1
    assert plan.bound <= plan.sequences <= min(plan.bound + len(histogram), 1.02 * plan.bound + 1)
    assert plan.placed >= 0.8


def test_the_dual_bound_holds():
    rng = np.random.default_rng(9)
    for _ in range(50):
        lengths = rng.integers(1, 33, rng.integers(1, 40))
        count = np.bincount(lengths, minlength=33)
        worth, bound = packing.dual(count, 32)
        fullest = packing.worths(np.where(count > 0, worth, -np.inf), 32)
        assert fullest[-1] <= 1 + 1e-9 and abs(bound - worth[lengths].sum()) < 1e-9
        assert bound <= sum(n for n, _ in packing.best_fit(np.bincount(lengths, minlength=33), 32)) + 1e-9
