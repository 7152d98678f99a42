"""Near-duplicates, pseudonyms, licenses, archives, pages and the pipeline."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.llm import extract, licenses, neardup, pseudonyms, warc
from tracelake.llm import ragged as R


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(base, rate, seed):
    rng = random.Random(seed)
    return [f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in base]


def shingles(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates_are_the_components_of_similar_texts(spark):
    base = words(1, 150)
    rows = [(k, " ".join(edited(base, rate, k))) for k, rate in enumerate([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.06] * 6)]
    rows += [(100 + k, " ".join(words(k + 50, 120))) for k in range(10)] + [(200, rows[0][1]), (201, rows[0][1])]
    rows += [(300, None), (301, ""), (302, "..."), (303, "..."), (304, "one two"), (305, "One, two!"), (306, "one three"), (310, rows[5][1]), (310, rows[5][1])]
    got = dict(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(1))).collect())
    own = {i: i for i, _ in rows}

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    sets = {i: shingles(t) for i, t in rows}
    for a, s in sets.items():
        for b, z in sets.items():
            same = s and z and len(s & z) / len(s | z) >= 0.8 or dict(rows)[a] is not None and not s and (dict(rows)[a] or "") == (dict(rows)[b] or "")
            if same and top(a) != top(b):
                own[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in own}


def test_one_id_with_several_texts(spark):
    a, b = words(7, 90), words(8, 90)
    near = " ".join([*a[:89], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near), (None, " ".join(b)), (None, "alone"), (3, None), (4, "")]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string")
        assert sorted(map(repr, map(tuple, neardup.near_duplicates(table).collect()))) == sorted(map(repr, [(1, 1), (1, 1), (2, 1), (None, 1), (None, None), (3, 3), (4, 3)]))
        kept = neardup.first_of_classes(table.withColumn("node", F.lit("clash")).withColumn("n", F.lit(1)))
        assert kept.columns == ["doc_id", "text", "node", "n"]
        assert sorted(repr(tuple(r)[:2]) for r in kept.collect()) == sorted(map(repr, [(1, " ".join(a)), (1, " ".join(b)), (None, "alone"), (3, None)]))


def test_near_duplicates_of_the_tables_against_all_pairs(spark):
    """Recall and precision over all pairs of the documents: 1 on both."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    own, sets, seen = {i: i for i, _ in rows}, {}, {}

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, t in sorted(rows):
        t = t or ""
        if t in seen:
            own[i] = seen[t]
            continue
        seen[t], s = i, shingles(t)
        for j, z in sets.items():
            if s and z and min(len(s), len(z)) >= 0.8 * max(len(s), len(z)) and len(s & z) >= 0.8 * len(s | z):
                own[max(top(i), top(j))] = min(top(i), top(j))
        sets[i] = s
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {i: top(i) for i in own}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.first_of_classes(empty).count() == 0


def test_alignment_counts_shingles_in_order():
    a, b = words(3, 100), words(4, 100)
    pairs = [(a, a, 1.0), (a, b, 0.0), (a, a[:50] + a[60:], 82 / 100)]
    got = neardup.similarities(*(R.texts_of(pa.array([" ".join(p[k]) for p in pairs])) for k in (0, 1)), 5, 0.5)
    assert got[0] == 1.0 and got[1] == 0.0 and abs(got[2] - 82 / 100) < 1e-9


VALUES = {
    "4111111111111111": r"\d{16}", "4111-1111-1111-1111": r"\d{4}-\d{4}-\d{4}-\d{4}", "97.51.17.173": r"\d+(\.\d+){3}", "2021-02-28": r"\d{4}-\d\d-\d\d", "31/12/1999": r"\d\d/\d\d/\d{4}", "3/4/2020": r"\d\d?/\d\d?/\d{4}", "api_key: '" + "a1B2" * 90 + "'": r"api_key: '([a-z]\d[A-Z]\d){90}'",
    "und.34@mail7.example.com": r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}", "123-45-6789": r"\d{3}-\d\d-\d{4}", "GB82 WEST 1234 5698 7654 32": r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d",
    'token = "04dbebab91ab85687d33eeaaf9ac699e"': r'token = "[0-9a-f]{32}"',
}
KEPT = ["666-12-3456", "900-12-3456", "000-12-3456", "123-00-4567", "123-45-0000", "4111111111111112", "300.1.1.1", "2021-02-30", "GB83 WEST 1234 5698 7654 32", "version 1.2.3", "1234567", ""]


def test_pseudonyms_keep_format_and_links(spark):
    rows = [(k, f"see {v}, then é {v}.", "a") for k, v in enumerate(VALUES)] + [(50 + k, f"x {v} y", "b") for k, v in enumerate(KEPT)] + [(90, None, "c")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, source string"), "k").collect()}
    for k, (v, form) in enumerate(VALUES.items()):
        a, b = re.fullmatch(r"see (.*), then é (.*)\.", got[k].text).groups()
        assert a == b != v and re.fullmatch(form, a) and got[k].n_changed == 2
    for k, v in enumerate(KEPT):
        assert got[50 + k].text == f"x {v} y" and got[50 + k].n_changed == 0
    assert got[90].text is None and got[90].n_found == 0
    clash = spark.createDataFrame([(1, "a 123-45-6789", 7, "x")] * 2, "doc_id long, text string, n_found int, value string")
    once, twice = pseudonyms.pseudonymise(clash, "k").collect()
    assert once == twice and once.n_found == 1 and once.value == "x"
    assert pseudonyms.pseudonymise(clash.limit(0), "k").count() == 0
    card = re.search(r"see (\d+)", got[0].text)[1]
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(card[::-1])) % 10 == 0
    assert got[1].text.replace("-", "") .startswith("see " + card)


def test_the_network_is_a_permutation(spark):
    small = spark.range(1000).select(F.col("id"), F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    out = small.select(pseudonyms.moved_digits(F.col("v"), "k", "t").alias("p"))
    assert out.distinct().count() == 1000
    numbers = spark.range(1, 900).where("id <> 666").select(F.format_string("%03d-01-0001", "id").alias("v")).select(pseudonyms.ssn(F.col("v"), "k").alias("p"))
    assert numbers.where(r"p rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'").distinct().count() == 898
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pseudonyms.date(F.col("d"), "k").alias("p")).distinct().count() == 3000


def test_licenses_against_all_lines_and_templates(spark):
    texts = [None, "", "MIT license mit, License; x the GNU general\npublic LICENSE! éMIT license", "Released under MIT the License friend", "Licensed under the Apache License, Version 2.0.\nAll rights", "rights all, reserved", "apache license " * 3]
    rows = list(enumerate(texts)) + [(None, "mit license")]
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = set()
    for i, t in rows:
        t = (t or "").lower()
        w, at, base = plain.findall(t), [], set()
        for label, phrase in licenses.PHRASES.items():
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    base.add(label)
        more, score = set(base), 0.0
        for line in t.split("\n"):
            for label, template in licenses.TEMPLATES:
                s = set(plain.findall(template.lower()))
                share = len(s & set(plain.findall(line))) / len(s)
                if share >= 0.8:
                    more.add(label)
                    score = max(score, share)
        want.add((i, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(more)), score))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    assert {tuple(r) for r in licenses.license_scan(table).collect()} == want
    assert licenses.license_scan(table.limit(0)).count() == 0


def test_wrapped_license_notices(spark):
    notice = {label: text for label, text in licenses.TEMPLATES if label in ("mit", "bsd", "gpl")}
    wrapped = {k: "x = 1\n# and so " + "\n# ".join(" ".join(v.split()[i : i + 6]) for i in range(0, len(v.split()), 6)) + " etc\n" for k, v in notice.items()}
    apart = "\n".join(f"{w} " + "lorem ipsum dolor sit amet " * 9 for w in notice["mit"].split())
    rows = [*enumerate(wrapped.values()), (9, apart)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k][0] for k in range(3)} == set(wrapped) and all(got[k][1] == 1 for k in range(3))
    assert got[9] == ("", 0)


def test_archives_round_trip(spark):
    pages = [(5, "http://b.example.com/x", "same"), (7, "http://a.example.com/y#f", "same"), (1, "https://www.a.example.com/y", "é" * 5000), (2, None, None), (3, "u\nv", ""), (9, "http://a.example.com/y", "same"), (9, "http://a.example.com/y", "same")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archive_index(table).collect()
    newest = {}
    for i, _, h in pages:
        newest[h or ""] = max(newest.get(h or "", i), i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if newest[h or ""] == i else "revisit", None if newest[h or ""] == i else newest[h or ""]) for i, _, h in pages)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    order = [(r.url_key, r.capture_time, r.page_id) for r in got]
    assert order == sorted(order)
    assert warc.archive_index(table.limit(0)).count() == 0


def test_one_url_key_is_merged_in_many_ranges(spark):
    rows = [(i * 7 % 600, "http://a.example.com/") for i in range(600)] + [(i, f"http://b.example.com/{i % 9}") for i in range(300)]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.col("url"))
    from tracelake.llm.session import shared_dir

    folder = shared_dir(spark)
    runs = warc.capture_runs(warc.write_archives(table, folder), folder)
    index = warc.merged(runs, 900, range_rows=100)
    parts = [p for p in index.rdd.glom().collect() if p]
    assert len(parts) > 5 and max(map(len, parts)) < 400
    order = [(r.url_key, r.capture_time, r.page_id) for p in parts for r in p]
    assert len(order) == 900 and order == sorted(order)


def test_loser_tree_merges_any_runs():
    rng = np.random.default_rng(1)
    for k in range(12):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 9)).tolist()) for _ in range(k)]
        merged = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert merged == sorted(x for r in runs for x in r)


def test_pages(spark):
    tree = extract.grow(*extract.labelled_table())
    x, y = extract.labelled_table()
    assert (extract.classify(tree, x) == (y > 0)).mean() > 0.9
    long = "This is a sentence of some length that tells what the page is about, and it goes on."
    page = f"<head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{long}<br>more\n text<p>Short.</p><div class='comments'><p>{long}</p></div></article><aside><p>{long}</p></aside><form>{long}</form><footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 2000), (5, "u", page), (5, "u", page)]
    got = extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    want = f"A & B\n{long} more text\nShort."
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0), (5, want, len(want)), (5, want, len(want))])


def splits(tree):
    return set() if tree.feature < 0 else {extract.FEATURES[tree.feature]} | splits(tree.low) | splits(tree.high)


def test_tree_uses_neighbours():
    x, y = extract.labelled_table()
    tree = extract.grow(x, y)
    assert splits(tree) & {"words before", "links before", "words after", "links after"} and {"words", "links"} & splits(tree)
    blind = x.copy()
    blind[:, 6:] = 0
    assert (extract.classify(tree, x) == (y > 0)).mean() > (extract.classify(extract.grow(blind, y), blind) == (y > 0)).mean()


def test_tree_on_held_out_pages():
    """Grown without one of the labelled pages, the tree is right on most blocks of the others, also where tags and names tell nothing."""
    for form, least in ((lambda p: p, 0.88), (extract.untold, 0.78)):
        right = total = 0
        for k, page in enumerate(extract.LABELLED):
            tree = extract.grow(*extract.labelled_table([p for j, p in enumerate(extract.LABELLED) if j != k]))
            held = extract.blocks_of(form(page))
            right += int((extract.classify(tree, extract.features(held)) == np.array([b.label for b in held])).sum())
            total += len(held)
        assert right / total > least


def test_pages_give_their_articles(spark):
    """The text of each page of the tables is that of its article element; with tags and names taken away most of it still is."""
    tree = extract.grow(*extract.labelled_table())
    shared = kept = found = 0
    for page in [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html]:
        article = re.search(r"<article>.*?</article>", page, re.S)[0]
        want = extract.main_text(article, extract.Node(1.0))
        assert extract.main_text(page, tree) == want
        want, got = ({b for b in t.split("\n")} for t in (want, extract.main_text(extract.untold(page), tree)))
        size = lambda blocks: sum(len(b.split()) for b in blocks)
        shared, kept, found = shared + size(want & got), kept + size(want), found + size(got)
    assert shared / kept > 0.95 and shared / found > 0.95


def test_unmatched_tags_take_linear_time():
    began = time.process_time()
    assert len(extract.blocks_of("<div>" * 50_000 + "a" + "</ul>" * 50_000 + "b")) == 2
    assert time.process_time() - began < 10


def test_no_pages(spark):
    assert extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_texts_that_cannot_be_alike_make_no_pairs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(80):  # versions of one text with four wordings of each of eleven places, so each wording is in some twenty of them
        words = [f"w{i}" for i in range(220)]
        for at in range(10, 220, 20):
            words[at] = f"x{at}.{rng.randrange(4)}"
        rows.append((k, k, " ".join(words), [1]))
    rows += [(100 + k, 100 + k, f"{rows[0][2]} end{k}", [1]) for k in (0, 1)]
    texts = spark.createDataFrame(rows, "node long, own long, text string, keys array<long>")
    got = {tuple(r) for r in neardup.sharing_rare(texts, neardup.Rule()).collect()}
    assert got >= {(0, 100), (0, 101), (100, 101)}
    assert len(got) < 300  # of 3,321


def test_texts_that_share_many_rare_shingles_meet_once(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):  # versions of one text, most of them alike, that share many of their rarest shingles
        words = [f"w{i}" for i in range(220)]
        for at in range(10, 220, 40):
            words[at] = f"x{at}.{rng.randrange(3)}"
        rows.append((k, k, " ".join(words), [1]))
    texts = spark.createDataFrame(rows, "node long, own long, text string, keys array<long>")
    rule = neardup.Rule()
    got = [(min(r), max(r)) for r in neardup.meetings(texts, rule).collect()]
    assert len(set(got)) <= len(got) < 1.2 * len(set(got))  # without the rarer shingles 12,732 rows for 1,467 pairs
    every = [(a, b) for a in range(60) for b in range(a)]
    alike = neardup.similarities(R.texts_of(pa.array([rows[a][2] for a, _ in every])), R.texts_of(pa.array([rows[b][2] for _, b in every])), rule.shingle, rule.threshold) >= rule.threshold
    assert {(b, a) for (a, b), x in zip(every, alike) if x} <= set(got)


def test_parities_bound_what_two_texts_do_not_share():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 1, 5, 40, 300, 3000)] * 2
    labels, first = neardup.labelled(R.texts_of(pa.array(texts)), 5)
    odd = neardup.parities(labels, first)
    sets = [set(labels[a:b].tolist()) for a, b in zip(first, first[1:])]
    for x in range(len(texts)):
        for y in range(len(texts)):
            assert sum(int(v).bit_count() for v in (odd[x] ^ odd[y]).view("uint64")) <= len(sets[x] ^ sets[y])
