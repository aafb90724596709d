"""License scans: an exact set-similarity join of text blocks with license templates.

DataFrame and SQL functions only. A block is a line, or a paragraph (lines
between blank lines); a template is found in a block that contains at least
``CONTAINMENT`` of the template's distinct words (all of them for templates of
fewer than ``SHORT`` words). Words are put in one global order, the rarest over
all documents first. If at least a of a template's t words are in a block, then
one of its t - a + 1 rarest is, and so:

* prefix filter: only those words of a template are joined with the blocks;
* length filter: blocks with fewer than a words of any template are out;
* positional filter: a shared word at places i and j of the two ordered lists
  leaves an overlap of at most min(i, j) + 1 + what follows the nearer end.

Candidates are verified by the intersection itself. Of two templates of which one
has all words of the other, a block has the wider if it holds all words that
tell them apart, else the narrower. All templates together have
a fixed number of words, so the broadcast side of each join is bounded.

Beside it, the base labels: places where a phrase's words stand consecutively.

Cases: a null text is empty; rows that share doc_id and text get equal results,
each its own; a null doc_id stays null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import written

CONTAINMENT, SHORT = 0.8, 10
#: Words after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels (fixed values).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: License notices and their labels (fixed values).
TEMPLATES = [
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]


def template_words() -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, how many of them a block needs) of each template."""
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        words = sorted(set(re.findall("[a-z0-9]+", text.lower())))
        out.append((i, label, words, len(words) if len(words) < SHORT else math.ceil(CONTAINMENT * len(words))))
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _table(spark: SparkSession, rows: str, schema: str) -> DataFrame:
    """A small literal table."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({schema})")


def _vocabulary() -> list[str]:
    """All words of templates and phrases."""
    return sorted({w for _, _, words, _ in template_words() for w in words} | {w for p, _ in PHRASES for w in p.split()})


def overview(docs: DataFrame) -> DataFrame:
    """key, n_words and seen, the words of templates and phrases in each text of ``docs`` (key, text).

    One split of each text. Lower-casing is wider than A-Z here: that moves no
    word border, and at most adds to seen, which only chooses candidates.
    """
    words = F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++")
    edges = F.expr("CAST(words[0] = '' AS int) + CAST(size(words) > 1 AND element_at(words, -1) = '' AS int)")
    return docs.withColumn("words", words).select(
        "key",
        (F.size("words") - edges).cast("long").alias("n_words"),
        F.array_intersect("words", F.array(*map(F.lit, _vocabulary()))).alias("seen"),
    )


def word_order(seen: DataFrame) -> DataFrame:
    """word, rank: the templates' words, those in the fewest texts first."""
    every = _table(seen.sparkSession, ", ".join(f"('{w}')" for w in _vocabulary()), "word")
    counts = seen.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "word", "left").select("word", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "word")).alias("rank"))


def _templates(order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates with their words' ranks in order (t), and a row for each word of their prefixes."""
    sides = _table(order.sparkSession, ", ".join(f"({i}, '{label}', {need}, array({', '.join(repr(w) for w in words)}))" for i, label, words, need in template_words()), "template, label, need, words")
    templates = (
        sides.select("template", "label", "need", F.explode("words").alias("word"))
        .join(order, "word")
        .groupBy("template", "label", "need")
        .agg(F.array_sort(F.collect_list("rank")).alias("t"))
    )
    return templates, templates.select("*", F.posexplode("t").alias("j", "rank")).where("j <= size(t) - need")


def found_templates(docs: DataFrame, order: DataFrame, prefixes: DataFrame) -> DataFrame:
    """key, label, share for each template found in a block of ``docs`` (key, text)."""
    vocabulary = F.array(*map(F.lit, _vocabulary()))
    least = min(need for *_, need in template_words())
    cut = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \\t\\r\\f\\x0B]*\n[\\s]*")))
    blocks = (
        docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("key", F.explode(cut).alias("block"))
        .select("key", "block", F.array_intersect(words_of(F.col("block")), vocabulary).alias("words"))
        .where(F.size("words") >= least)
        .select("key", F.xxhash64("block", F.length("block")).alias("block"), F.explode("words").alias("word"))
        .join(F.broadcast(order), "word")
        .groupBy("key", "block")
        .agg(F.array_sort(F.collect_set("rank")).alias("b"))
    )
    candidates = (
        blocks.select("key", "block", "b", F.posexplode("b").alias("i", "rank"))
        .join(F.broadcast(prefixes), "rank")
        .where("size(b) >= need AND i <= size(b) - need")
        .where("least(i, j) + 1 + least(size(b) - i - 1, size(t) - j - 1) >= need")
        .withColumn("overlap", F.size(F.array_intersect("b", "t")))
        .where("overlap >= need")
    )
    found = candidates.select("key", "block", "b", F.struct("label", "t", (F.col("overlap") / F.size("t")).alias("share")).alias("f")).distinct()
    together = found.groupBy("key", "block", "b").agg(F.collect_list("f").alias("f"))
    wider = "size(y.t) > size(x.t) AND size(array_except(x.t, y.t)) = 0 AND size(array_except(array_except(y.t, x.t), b)) = 0"
    narrower = "size(y.t) < size(x.t) AND size(array_except(y.t, x.t)) = 0 AND size(array_except(array_except(x.t, y.t), b)) > 0"
    apart = together.select("key", F.explode(F.expr(f"filter(f, x -> NOT exists(f, y -> ({wider}) OR ({narrower})))")).alias("f"))
    return apart.groupBy("key", "f.label").agg(F.max("f.share").alias("share"))


def base_places(docs: DataFrame) -> DataFrame:
    """key, hits (array of at, label) for each row of ``docs`` (key, words).

    The words must come from a table: an expression would be computed anew for each place.
    """
    places = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        fits = " AND ".join(f"element_at(words, i + {k + 1}) = '{w}'" for k, w in enumerate(parts))
        every = f"filter(sequence(0, size(words) - {len(parts)}), i -> {fits})"
        places.append(f"IF(size(words) < {len(parts)}, array(), transform({every}, i -> struct(i AS at, '{label}' AS label)))")
    return docs.select("key", F.expr(f"concat({', '.join(places)})").alias("hits"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs`` (doc_id, text).

    score is 1 where a base phrase stands, else the largest share of a template's words that a block holds, else 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select(F.struct(F.col("doc_id"), F.xxhash64("text", F.length("text")).alias("text_key")).alias("key"), "text")
    seen = written(overview(keyed), "overview")
    order = written(word_order(seen), "word-order")
    prefixes = _templates(order)[1]
    # as many words as the templates have at most: texts without any of them hold no template
    rare = sorted({r.word for r in prefixes.join(order, "rank").select("word").collect()})
    phrase = F.expr(" OR ".join("(" + " AND ".join(f"array_contains(seen, '{w}')" for w in p.split()) + ")" for p, _ in PHRASES))
    wanted = seen.where(phrase | F.arrays_overlap("seen", F.array(*map(F.lit, rare)))).select("key").distinct()
    same = F.expr("a.key.text_key = b.key.text_key AND a.key.doc_id <=> b.key.doc_id")
    # few bytes, much work for each: as many tasks as for all texts
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = written(keyed.alias("a").join(wanted.alias("b"), same, "left_semi").distinct().repartition(tasks).withColumn("words", words_of(F.col("text"))), "candidates")
    labels = found_templates(near, order, prefixes).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = base_places(near).alias("a").join(labels.alias("b"), same, "full_outer").select(F.coalesce("a.key", "b.key").alias("key"), "hits", "more", "share")
    own = F.coalesce("hits", F.expr("array()").cast("array<struct<at: int, label: string>>"))
    none = F.array().cast("array<string>")
    return (
        seen.alias("a")
        .join(more.alias("b"), same, "left")
        .select("a.key.doc_id", "n_words", own.alias("hits"), F.coalesce("more", none).alias("more"), "share")
        .withColumn("base", F.expr("array_distinct(transform(hits, h -> h.label))"))
        .select(
            "doc_id",
            "n_words",
            F.size("hits").cast("long").alias("n_base"),
            F.expr("CAST(array_min(transform(hits, h -> h.at)) AS BIGINT)").alias("first_word"),
            F.expr("CAST(array_max(transform(hits, h -> h.at)) AS BIGINT)").alias("last_word"),
            F.array_join(F.array_sort("base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
            F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i AS pos, '{label}' AS label FROM places WHERE " + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split()))
        for p, label in PHRASES
    )
    own = ", ".join(f"({i}, '{label}', {need}, {words!r})" for i, label, words, need in template_words())
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(len(words))) AS i FROM d
), hits AS ({phrases}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM hits GROUP BY doc_id
), t(template, label, need, words) AS (VALUES {own}),
blocks AS (
  SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r\f\x0B]*\n\s*'))) AS block FROM d
), sets AS (
  SELECT row_number() OVER () AS n, doc_id, list_distinct(regexp_extract_all(translate(block, '{UPPER}', '{LOWER}'), '{WORD}')) AS words FROM blocks
), held AS (
  SELECT s.n, s.doc_id, s.words AS b, t.label, t.words AS t, len(list_intersect(s.words, t.words)) / len(t.words) AS share
  FROM sets s, t WHERE len(list_intersect(s.words, t.words)) >= t.need
), found AS (
  SELECT * FROM held x WHERE NOT EXISTS (
    SELECT 1 FROM held y WHERE y.n = x.n AND (
      (len(y.t) > len(x.t) AND list_has_all(y.t, x.t) AND list_has_all(x.b, list_filter(y.t, lambda w: NOT list_contains(x.t, w))))
      OR (len(y.t) < len(x.t) AND list_has_all(x.t, y.t) AND NOT list_has_all(x.b, list_filter(x.t, lambda w: NOT list_contains(y.t, w))))))
), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base,
       b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN more m ON m.doc_id = d.doc_id
"""


OP4_SQL = _sql()
