"""License scan: an exact set-similarity join with short notices, in SQL functions only.

A template is the set of words of a license notice, a block is the set of words
of one line, or of a span of words over lines as long as the notice (so that a
wrapped one is found) but for the words that may differ.  A block belongs to a template if it holds at least `threshold` of
the template's words.  Template words are ordered by how many documents have
them, rarest first.  A block that holds `need` of a template's n words holds one
of its first n - need + 1: that prefix is joined with the words of the blocks.
Of a match at place i in the template and j in the block, no more than what
follows both can be shared, and the block needs `need` words at least; what
passes these positional and length filters is verified exactly.

Beside it stand the plain places of the phrases in PHRASES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.session import table

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Sentences of public license notices.  Those that differ from another in one word of many (the Lesser and Affero notices) cannot be told apart by sets of words and are not here.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Released under the MIT License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]

#: A word of the texts as they are; upper and lower case of A-Z do not differ.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def phrase(words: str) -> str:
    return rf"(?<!{WORD})(?:{f'{GAP}+'.join(words.split())})(?!{WORD})"


ANY_PHRASE = "(?i:" + "|".join(map(phrase, PHRASES.values())) + ")"


def words_of(text: Column) -> Column:
    """The words in lower case, among them an empty one at an end that is no word."""
    return F.split(F.lower(text), f"{GAP}+")


def with_places(docs: DataFrame) -> DataFrame:
    """n_base, first_word, last_word and base (an array of labels) from the phrases of PHRASES."""
    text = F.col("text")
    count = lambda x: F.regexp_count(x, F.lit(f"{WORD}+")).cast("long")
    held = docs.withColumn("__places", F.when(text.rlike(ANY_PHRASE), F.regexp_extract_all(text, F.lit(ANY_PHRASE), F.lit(0))))
    held = held.withColumn("__around", F.when(F.col("__places").isNotNull(), F.split(text, ANY_PHRASE, -1)))
    holds = lambda words: F.exists("__places", lambda p: p.rlike(f"(?i)^(?:{phrase(words)})$"))
    n = F.size("__places")
    some = F.col("__places").isNotNull()
    before_last = F.concat(F.slice("__around", F.lit(1), n), F.slice("__places", F.lit(1), n - 1))
    return held.select(
        *docs.columns,
        F.when(some, n).otherwise(0).cast("long").alias("n_base"),
        F.when(some, count(F.get("__around", F.lit(0)))).alias("first_word"),
        F.when(some, F.aggregate(before_last, F.lit(0).cast("long"), lambda t, x: t + count(x))).alias("last_word"),
        F.array_compact(F.array(*(F.when(some & holds(words), F.lit(label)) for label, words in PHRASES.items()))).alias("base"),
    )


def template_table(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """t, label, size, need and words of each template, and the span: how many words a wrapped notice may take."""
    rows = spark.createDataFrame([(t, label, text) for t, (label, text) in enumerate(templates)], "t int, label string, text string").coalesce(1)
    words = F.array_remove(F.array_distinct(words_of(F.col("text"))), "")
    length = F.size(F.array_remove(words_of(F.col("text")), ""))
    sized = rows.select("t", "label", words.alias("words"), F.ceil(length / threshold - 1e-9).cast("int").alias("span")).withColumn("size", F.size("words"))
    return sized.where("size > 0").withColumn("need", F.ceil(F.col("size") * threshold - 1e-9).cast("int"))


def matches(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_hash, label, containment: every pair of a line, or of a span of words over lines, and a template that meets the threshold, once per label.

    docs: doc_id, text, text_hash.  The templates are a fixed list of short
    texts: their words, prefixes and sets are small whatever the input.
    """
    vocabulary = sorted({w for (ws,) in templates.select("words").collect() for w in ws})
    listed = F.array(*map(F.lit, vocabulary))
    seen = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), listed)).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    order = F.array(*map(F.lit, ordered))

    sets = [(r.t, r.label, r.size, r.need, r.span, sorted(r.words, key=ordered.index)) for r in templates.collect()]
    prefix = docs.sparkSession.createDataFrame(
        [(ws[i], t, label, size, need, span, i, ws) for t, label, size, need, span, ws in sets for i in range(size - need + 1)],
        "word string, t int, label string, t_size int, need int, span int, i int, t_words array<string>",
    )
    rare = F.array(*map(F.lit, sorted({ws[i] for _, _, size, need, _, ws in sets for i in range(size - need + 1)})))
    # array_intersect keeps the order of its first list: the block's template words, rarest first
    held = docs.where(F.arrays_overlap(words_of(F.col("text")), rare))

    def verified(blocks: DataFrame) -> DataFrame:
        """Pairs of a block (a set of words) and a template of which it holds `need` words."""
        known = blocks.withColumn("known", F.array_intersect(order, "block"))
        tokens = known.where(F.arrays_overlap("known", rare)).select("*", F.posexplode("known").alias("j", "word"))
        joined = tokens.join(F.broadcast(prefix), "word")
        possible = F.least(F.col("t_size") - F.col("i"), F.size("known") - F.col("j"))
        joined = joined.where((F.size("known") >= F.col("need")) & (F.col("i") + possible >= F.col("need")))
        return joined.withColumn("shared", F.size(F.array_intersect("known", "t_words"))).where("shared >= need")

    lines = held.select("doc_id", "text_hash", F.explode(F.split("text", "\n")).alias("line"))
    by_line = verified(lines.select("doc_id", "text_hash", words_of(F.col("line")).alias("block")))
    # a notice wrapped over lines: in a text that holds enough of the template's words, spans of words that begin with one of them
    wrapped = held.where(F.col("text").contains("\n")).select("doc_id", "text_hash", F.array_remove(words_of(F.col("text")), "").alias("block"))
    wrapped = verified(wrapped).dropDuplicates(["doc_id", "text_hash", "t"])
    begins = F.filter(F.sequence(F.lit(1), F.size("block")), lambda k: F.array_contains("t_words", F.get("block", k - 1)))
    most = F.array_max(F.transform(begins, lambda k: F.size(F.array_intersect(F.slice("block", k, F.col("span")), "t_words"))))
    wrapped = wrapped.withColumn("shared", most).where("shared >= need")
    columns = ["doc_id", "text_hash", "label", "shared", "t_size"]
    found = by_line.select(*columns).unionByName(wrapped.select(*columns))
    return found.groupBy("doc_id", "text_hash", "label").agg(F.max(F.col("shared") / F.col("t_size")).alias("containment"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """Places of license phrases, and labels of all license notices found.

    docs: doc_id and text; other columns are not read.  Null and empty texts
    have no words, place or label; score is 0 where no notice is found, else the
    highest containment.  Repeated rows give equal rows, an empty table gives
    none.  A null doc_id stays.  A text of any length is one value of the
    expressions.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = matches(docs, template_table(spark, TEMPLATES if templates is None else templates, threshold))
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "more", "score")
    places = with_places(docs).drop("text")
    both = places.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
_listed = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(TEMPLATES))
ORACLES = {
    "op7_license_scan": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS a FROM d),
phrases AS (
  SELECT r, CAST(k - 1 AS BIGINT) AS k, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label
  FROM (SELECT r, k, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM x WINDOW s AS (PARTITION BY r ORDER BY k))),
places AS (SELECT * FROM phrases WHERE label IS NOT NULL),
base AS (SELECT r, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
templates AS (SELECT label, list_distinct(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words FROM (VALUES {_listed}) AS v(t, label, text)),
lines AS (SELECT r, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
notices AS (
  SELECT r, label, len(list_intersect(lines.words, templates.words)) / len(templates.words) AS containment
  FROM lines JOIN templates ON len(list_intersect(lines.words, templates.words)) >= ceil(len(templates.words) * 0.8 - 1e-9)),
scores AS (SELECT r, max(containment) AS score FROM notices GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM notices) GROUP BY r)
SELECT doc_id, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN scores USING (r) LEFT JOIN every USING (r)
"""
}
