"""Licenses of documents by diagonal voting: rolling word grams joined with the places of license texts.

Every gram of three words (two where a two-word phrase could end) is joined by its hash with the places where license texts hold it, and its words are
compared. A hit of document word p and template word t votes for the diagonal p - t; diagonals of one template that lie close to each
other are one span, so that words put in or left out shift a copy without breaking it. A span is verified by the share of the template's words
that its grams cover. All of it are DataFrame operations; only hits and one narrow row a document are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand together.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Public license notices.
NOTICES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the"
        " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
        " notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of"
        " source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and"
        " this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)

COVER = 0.75
# Diagonals up to this many words apart, and a quarter of the template at most, belong to one span.
BAND = 8
# A diagonal needs one of so many grams of its template.
SHARE = 40
# Templates of up to so many words in all are sent to every executor (about 100 bytes a word); beyond, Spark chooses the join.
BROADCAST_WORDS = 50_000
BITS = 60


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def grams(rows: DataFrame, keys: Sequence[str], ends: Sequence[str]) -> DataFrame:
    """``keys``, n_words, p (null without words), w0, w1, w2 and the gram's hash, for every place of ``words``."""
    shifted = rows.select(*keys, F.size("words").alias("n_words"), F.col("words").alias("w0"), F.slice("words", 2, F.size("words")).alias("w1"), F.slice("words", 3, F.size("words")).alias("w2"))
    each = shifted.select(*keys, "n_words", F.posexplode_outer(F.arrays_zip("w0", "w1", "w2")).alias("p", "g")).select(*keys, "n_words", "p", "g.*")
    two = F.col("w1").isin(list(ends)) if ends else F.lit(False)
    return each.withColumn("w2", F.when(two, F.lit(None)).otherwise(F.col("w2"))).withColumn("gram", F.xxhash64("w0", "w1", "w2"))


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> tuple[DataFrame, int, list[str]]:
    """(one row per gram wholly inside a template, number of bit columns, last words of two-word phrases).

    A row has its template's number, label, kind, words and grams, the place t, the words, and in m0, m1, ... the bits of the words it covers.
    """
    texts = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in notices]
    split = [re.findall(WORD, text.lower()) for _, _, text in texts]
    if any(len(w) < 2 for w in split):
        raise ValueError("a template needs two words")
    ends = sorted({w[1] for w in split if len(w) == 2})
    masks = -(-max(map(len, split)) // BITS)
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), F.lit(text).alias("text")) for i, (label, phrase, text) in enumerate(texts)])
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.label", "t.phrase", words(F.col("t.text")).alias("words"))
    each = grams(table, ["template", "label", "phrase"], ends)
    width = F.when(F.col("w1").isin(ends), 2).otherwise(3)
    each = each.withColumn("width", width).where("w1 IS NOT NULL AND (width = 2 OR w2 IS NOT NULL)")
    bit = lambda o, j: F.when((F.lit(o) < F.col("width")) & (F.floor((F.col("p") + o) / BITS) == j), F.expr(f"shiftleft(1L, cast((p + {o}) % {BITS} as int))")).otherwise(F.lit(0))
    covers = [bit(0, j).bitwiseOR(bit(1, j)).bitwiseOR(bit(2, j)).alias(f"m{j}") for j in range(masks)]
    each = each.select("template", "label", "phrase", F.col("n_words").alias("size"), F.col("p").alias("t"), F.col("w0").alias("t0"), F.col("w1").alias("t1"), F.col("w2").alias("t2"), "gram", *covers)
    counts = each.groupBy("template").agg(F.count("*").alias("grams"))
    each = each.join(F.broadcast(counts), "template") if sum(map(len, split)) <= BROADCAST_WORDS else each.join(counts, "template")
    return (F.broadcast(each) if sum(map(len, split)) <= BROADCAST_WORDS else each), masks, ends


def license_scan(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    ``n_base`` counts the places where the words of a phrase stand together, ``first_word`` and ``last_word`` are the smallest and largest of them (null
    without any). ``spans`` are the (label, start, end, score) of notices whose words are covered to ``cover`` or more, by start. ``labels`` are those of phrases
    and spans, ``base_labels`` those of phrases alone: distinct, sorted, joined by commas. ``score`` is the largest share of a template's words found, 1 where a phrase stands.
    A null or empty text has no word: counts of 0, empty labels, no span. Repeated rows and rows with equal or null ids are answered one by one;
    other columns are not read; an empty table gives an empty result. Only a-z are matched without regard to case.
    """
    templates, masks, ends = template_grams(docs.sparkSession, phrases, notices)
    rows = docs.select(F.monotonically_increasing_id().alias("_ref"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("words"))
    hits = grams(rows, ["_ref", "_id"], ends).join(templates, "gram", "left")
    # one hash may stand for other words; the first place of a document always stays, so that every document keeps a row
    real = F.col("w0").eqNullSafe(F.col("t0")) & F.col("w1").eqNullSafe(F.col("t1")) & F.col("w2").eqNullSafe(F.col("t2"))
    own = lambda c: F.when(real & F.col("template").isNotNull(), F.col(c)).alias(c)
    bits = [f"m{j}" for j in range(masks)]
    hits = hits.select("_ref", "_id", "n_words", "p", (F.col("p") - F.col("t")).alias("d"), *[own(c) for c in ("template", "label", "phrase", "size", "grams", *bits)])
    hits = hits.where(F.col("template").isNotNull() | (F.coalesce(F.col("p"), F.lit(0)) == 0))

    key = ["_ref", "_id", "n_words", "template", "label", "phrase", "size", "grams"]
    place = F.when(F.col("template").isNotNull(), F.col("d")).alias("d")
    voted = [F.count("*").alias("votes"), F.min("p").alias("start"), F.max("p").alias("last"), *[F.bit_or(m).alias(m) for m in bits]]
    diagonals = hits.groupBy(*key, place).agg(*voted)
    strong = F.when(F.col("phrase"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") * SHARE >= F.col("grams"))
    diagonals = diagonals.withColumn("strong", F.coalesce(strong, F.lit(False)))

    # places of phrases stand for themselves; weak diagonals take no part in spans
    diagonals = diagonals.withColumn("alone", F.when(F.col("phrase") | ~F.col("strong"), F.col("d")))
    line = Window.partitionBy("_ref", "template", "strong", "alone").orderBy("d")
    apart = F.least(F.lit(BAND), F.floor(F.col("size") / 4))
    begins = F.when(F.col("d") - F.lag("d").over(line) <= apart, 0).otherwise(1)
    spans = diagonals.withColumn("begins", begins).withColumn("span", F.sum("begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "strong", "alone", "span").agg(F.min("start").alias("start"), F.max("last").alias("last"), *[F.bit_or(m).alias(m) for m in bits])
    found = sum((F.bit_count(m) for m in bits), F.lit(0)) / F.col("size")
    spans = spans.withColumn("share", F.when(F.col("strong"), found).otherwise(F.lit(0.0)))

    base, notice = F.col("strong") & F.col("phrase"), F.col("strong") & ~F.col("phrase") & (F.col("share") >= cover)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    span = F.struct("label", F.col("start").cast("long").alias("start"), (F.col("last") + 2).cast("long").alias("end"), F.col("share").alias("score"))
    by_start = lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0)
    return (
        spans.groupBy("_ref", "_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(base | notice).alias("labels"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.when(notice, span)), by_start).alias("spans"),
        )
        .select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )


def scan_sql(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, cover: float = COVER) -> str:
    """The same over ``documents`` in DuckDB, with grams as texts and covered words counted one by one."""
    quoted = ", ".join(f"({i}, '{label}', {i < len(phrases)}, '{text}')" for i, (label, text) in enumerate([*phrases, *notices]))
    ends = sorted({w[1] for _, text in [*phrases, *notices] if len(w := re.findall(WORD, text.lower())) == 2})
    two = "w[p + 2] IN (" + ", ".join(f"'{e}'" for e in ends) + ")" if ends else "false"
    split = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}')"
    gram = f"CASE WHEN coalesce({two}, false) THEN [w[p + 1], w[p + 2]] ELSE [w[p + 1], w[p + 2], w[p + 3]] END"
    return rf"""
WITH texts(template, label, phrase, text) AS (VALUES {quoted}),
t AS (SELECT template, label, phrase, {split("text")} AS w FROM texts),
tg AS (SELECT template, label, phrase, len(w) AS size, p AS t, {gram} AS g FROM (SELECT *, unnest(range(len(w))) AS p FROM t)),
tgc AS (SELECT *, count(*) OVER (PARTITION BY template) AS grams FROM tg WHERE list_count(g) = len(g)),
docs AS (SELECT doc_id, {split("text")} AS w FROM documents),
dg AS (SELECT doc_id, p, {gram} AS g FROM (SELECT *, unnest(range(len(w))) AS p FROM docs)),
hits AS (SELECT doc_id, template, label, phrase, size, grams, p, t, len(tgc.g) AS width, p - t AS d FROM dg JOIN tgc ON dg.g = tgc.g),
diag AS (SELECT doc_id, template, label, phrase, size, d, count(*) AS votes, min(p) AS start FROM hits GROUP BY ALL
  HAVING CASE WHEN phrase THEN count(*) = max(grams) ELSE count(*) * {SHARE} >= max(grams) END),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM diag WHERE phrase GROUP BY doc_id),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, template ORDER BY d ROWS UNBOUNDED PRECEDING) AS span FROM (
  SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= least({BAND}, size // 4) THEN 0 ELSE 1 END AS begins FROM diag WHERE NOT phrase)),
covered AS (SELECT n.doc_id, n.template, n.label, n.size, n.span, count(DISTINCT o) AS n FROM numbered n
  JOIN (SELECT doc_id, template, d, unnest(range(t, t + width)) AS o FROM hits) h ON h.doc_id = n.doc_id AND h.template = n.template AND h.d = n.d GROUP BY ALL),
found AS (SELECT doc_id, label, 1.0::DOUBLE AS share, true AS holds FROM diag WHERE phrase
  UNION ALL SELECT doc_id, label, n / size, n / size >= {cover} FROM covered),
per AS (SELECT doc_id, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE holds) AS labels FROM found GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN per USING (doc_id)
"""
