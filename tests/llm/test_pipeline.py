"""The pipeline against a brute-force chain of its stages, and its stages on odd rows."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tracelake.llm import pseudonyms, tokens

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def passes(t):
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    long = collections.Counter(tuple(w[k : k + 201]) for k in range(len(w) - 200))
    return len(w) >= 20 and 100 * len(hit) <= 30 * len(w) and max(long.values(), default=0) < 2


def first_of_near(rows):
    own, sets = {}, []

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, t in rows:
        w, seen, s = PLAIN.findall(t.translate(LOWER)), collections.Counter(), set()
        for k in range(max(len(w) - 4, 1)):
            g = tuple(w[k : k + 5])
            s.add((g, seen[g]))
            seen[g] += 1
        own[i] = i
        for j, z in sets:
            if len(s & z) >= 0.8 * len(s | z):
                a, b = top(i), top(j)
                own[max(a, b)] = min(a, b)
        sets.append((i, s))
    return [(i, t) for i, t in rows if top(i) == i]


def contaminated(t, windows):
    w = PLAIN.findall(t.translate(LOWER))
    hit = {k + j for n, found in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in found for j in range(n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_gives_what_brute_force_gives(spark):
    from tokenizers import Tokenizer

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = PLAIN.findall((r.text or "").translate(LOWER))
        n = min(13, len(w))
        windows[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    left = [(i, t) for i, t in first_of_near([(i, t or "") for i, t in rows if passes(t or "")]) if not contaminated(t, windows)]
    assert 0 < len(left) < len(rows)
    hidden = pseudonyms.pseudonymise(spark.createDataFrame(left, "doc_id long, text string"), pseudonyms.session_key(spark)).collect()
    library, want = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json")), []
    for r in hidden:
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, len(ids[4096 * k : 4096 * k + 4096]), zlib.crc32(np.array(ids[4096 * k : 4096 * k + 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
    out = P.run(spark, D)
    assert sorted(tuple(r) for r in out.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(want)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_on_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, text.replace("w", "v")), (2, text), (None, text.replace("w", "u")), (3, None), (4, ""), (5, " ".join(f"x{k}" for k in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "n_found": F.lit("clash"), "g": F.lit(1), "node": F.lit(2)})
    want = {"quality rules": 6, "near-duplicates": 5, "decontamination": 8, "personal data": 8}
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, D)
        assert got.columns == P.COLUMNS and got.count() == want[name], name
        assert stage(spark, docs.limit(0), D).count() == 0
    packed = P.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == 6 and packed.where("piece = 0").count() == 8
    assert P.STAGES[-1][1](spark, docs.limit(0), D).count() == 0
