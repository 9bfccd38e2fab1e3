"""License scan by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the k-grams of a fixed
set of license templates. A hit votes for the diagonal ``text position - template
position``; the votes are summed for each diagonal, diagonals that lie close to each
other (words added or left out) are merged, and what is left is verified. A hit counts
only if the words themselves agree, so hashes never decide.

The templates are a constant of this module (a few hundred k-grams), which bounds the
broadcast side of the join at every size of the corpus.

Defined cases: a null text is an empty text and has no words; texts shorter than k words
have no hits; rows that repeat a (doc_id, text) pair get the same result each; a null
doc_id is kept and matched null-safely; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gram_words, lower_for_ascii_match, rolling_grams

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose consecutive words are a base place, with their label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public notices, as their licenses ask users to state them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def words(text: Column) -> Column:
    """The words; an empty string may stand before the first and after the last of them."""
    return F.split(lower_for_ascii_match(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_grams(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES, k: int = K) -> DataFrame:
    """(template, label, is_base, n_grams, t_pos, gram, gram_hash), a row for each k-gram."""
    rows = []
    for n, (label, text, base) in enumerate([(label, phrase, True) for phrase, label in phrases] + [(label, text, False) for label, text in templates]):
        ws = words_of(text)
        grams = [ws[i : i + k] for i in range(len(ws) - k + 1)]
        rows += [(n, label, base, len(grams), i, gram) for i, gram in enumerate(grams)]
    made = spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, t_pos int, gram array<string>")
    return made.withColumn("gram_hash", F.xxhash64(*[F.col("gram")[j] for j in range(k)]))


def license_spans(docs: DataFrame, k: int = K, max_gap: int = 2, min_votes: int = 2, min_coverage: float = 0.6, long_run: int = 12, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Verified spans: (doc_id, text_hash, label, is_base, first_word, last_word, votes, coverage).

    A base phrase needs every k-gram on one diagonal. A template needs, on diagonals
    that are at most ``max_gap`` words apart, ``min_coverage`` of its k-grams or
    ``long_run`` of them, and ``min_votes`` at least.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, phrases, k)
    read = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("w"))
    lead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)  # an empty string before the first word
    rolled = read.select("doc_id", "text_hash", lead.alias("lead"), F.posexplode(rolling_grams("w", k)).alias("pos", "x"))
    rolled = rolled.select("doc_id", "text_hash", (F.col("pos") - F.col("lead")).alias("pos"), F.xxhash64(*gram_words("x", k)).alias("gram_hash"), F.array(*gram_words("x", k)).alias("found"))
    agree = (F.col("found") <= F.col("gram")) & (F.col("found") >= F.col("gram"))  # as an equality it would become a join key
    hits = rolled.join(F.broadcast(grams), "gram_hash").filter(agree).select("doc_id", "text_hash", "template", "label", "is_base", "n_grams", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    key = ["doc_id", "text_hash", "template", "label", "is_base", "n_grams"]
    voted = hits.groupBy(*key, "diagonal").agg(F.collect_set("t_pos").alias("at"))
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = (F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > max_gap, F.lit(True))).cast("int")
    merged = voted.withColumn("band", F.sum(apart).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*key, "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("at")).cast("long").alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("at") + k - 1).cast("long").alias("last_word"),
    )
    coverage = F.col("votes") / F.col("n_grams")
    kept = F.when(F.col("is_base"), F.col("votes") == F.col("n_grams")).otherwise((F.col("votes") >= min_votes) & ((coverage >= min_coverage) | (F.col("votes") >= long_run)))
    return spans.filter(kept).select("doc_id", "text_hash", "label", "is_base", "first_word", "last_word", "votes", coverage.alias("coverage"))


def scan_licenses(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: its words, base places, labels and score (best coverage)."""
    of_doc = license_spans(docs, **how).groupBy("doc_id", "text_hash").agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    text = F.coalesce("text", F.lit(""))
    n_words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    all_docs = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), n_words.cast("long").alias("n_words")).alias("d")
    joined = all_docs.join(of_doc.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    return joined.select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
