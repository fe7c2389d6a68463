"""License scan by diagonal voting, with DataFrame functions only.

Every run of K words of every text is hashed and joined to the places where a license template has it. A hit at text position p
and template place t votes for the diagonal p - t; votes are counted per diagonal, diagonals at most `GAP` apart (inserted or lost
words) are merged, and a merged span is a license if it covers enough of the template's word runs without being stretched.
Beside that, fixed phrases are found word by word.

Templates are the caller's own values, so their hash table is broadcast after its size is checked; the exploded word runs of
the texts are never shuffled, only hits are, one row per text, template and diagonal.

Defined cases: a null text counts as empty; without a word both positions are null and the score is 0; repeated rows each get
their result; a null doc_id is kept as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 4
GAP = 3
#: Least share of a template's word runs, and most words of a span for one of the template's.
COVER = 0.6
STRETCH = 2.0
BROADCAST_BYTES = 16 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and opening paragraphs of public licenses; a label may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                   "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                   "basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written "
                 "permission of the publisher"),
]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def runs(words: str, k: int) -> Column:
    """Hash of the k words from each word on, for as many as there are."""
    all_runs = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, k))))
    n = F.size(words)
    return F.when(n >= k, F.slice(all_runs, F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<bigint>"))


def places(words: str, phrase: str) -> Column:
    """Positions where the phrase's words stand one after the other."""
    first, *rest = phrase.split(" ")
    here = lambda w, i: reduce(lambda a, b: a & b, [F.get(F.col(words), i + j) == F.lit(r) for j, r in enumerate(rest, 1)], w == F.lit(first))
    hits = F.filter(F.transform(words, lambda w, i: F.when(here(w, i), i)), lambda p: p.isNotNull())
    rare = max([first, *rest], key=len)  # most texts lack the longest word and need no look at each place
    return F.when(F.array_contains(words, rare), hits).otherwise(F.array().cast("array<int>"))


def _templates(docs: DataFrame, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """run, template, label, place, runs: where a template has a word run, and how many runs it has."""
    size = sum(len(t) for _, t in templates) * 8
    rows = docs.sparkSession.createDataFrame([(n, label, text) for n, (label, text) in enumerate(templates)], "template int, label string, text string")
    table = rows.select("template", "label", words_of(F.col("text")).alias("w")).select("template", "label", runs("w", k).alias("r")).select(
        "template", "label", F.size("r").alias("runs"), F.posexplode("r").alias("place", "run"))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, gap: int = GAP, cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """doc_id, text_key, label, first_word, end_word, coverage of every license found in `docs` (doc_id, text)."""
    templates = TEMPLATES if templates is None else templates
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    grams = worded.select("doc_id", "text_key", F.posexplode(runs("w", k)).alias("at", "run"))
    hits = grams.join(_templates(docs, templates, k), "run")
    diagonal = hits.groupBy("doc_id", "text_key", "template", "label", "runs", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    own = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > gap).cast("int"), F.lit(1))
    merged = diagonal.withColumn("apart", apart).withColumn("band", F.sum("apart").over(own)).groupBy(
        "doc_id", "text_key", "template", "label", "runs", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = merged.withColumn("coverage", F.size("places") / F.col("runs")).where(
        (F.col("coverage") >= cover) & (F.col("high") - F.col("low") + k <= stretch * (F.col("runs") + k - 1)))
    return found.select("doc_id", "text_key", "label", F.col("low").cast("bigint").alias("first_word"), (F.col("high") + k).cast("bigint").alias("end_word"), "coverage")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, **settings) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    The score is the best coverage of a template, and at least 0.5 with a fixed phrase.
    """
    phrases = PHRASES if phrases is None else phrases
    docs = docs.select("doc_id", "text")
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    names = [f"base{n}" for n in range(len(phrases))]
    base = worded.select("doc_id", "text_key", F.size("w").cast("bigint").alias("n_words"), *(places("w", p).alias(n) for p, n in zip(phrases, names)))
    every = F.concat(*(F.col(n) for n in names))
    labels = F.filter(F.array(*(F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values()))), lambda v: v.isNotNull())
    base = base.select("doc_id", "text_key", "n_words", every.alias("at"), F.array_distinct(labels).alias("base"))
    found = spans(docs, templates, **settings).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("n_spans"))
    both = base.join(found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "more", "coverage", "n_spans"),
                     F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    text = lambda a: F.array_join(F.array_sort(a), ",")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", F.size("at").cast("bigint").alias("n_base"), F.array_min("at").cast("bigint").alias("first_word"), F.array_max("at").cast("bigint").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.size("at") > 0, 0.5).otherwise(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
