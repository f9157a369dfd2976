"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
BANDS, ROWS = 48, 2  # see collision_probability
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices as they are published.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate({k: k + 32 for k in range(65, 91)}))


def shingles_of(words: list[str]) -> list[str]:
    size = min(SHINGLE, len(words))
    return sorted({" ".join(words[k:k + size]) for k in range(len(words) - size + 1)})


def stride_of(length: int) -> int:
    return max(1, length // 2 if length > 12 else length // 4)


def window_of(length: int) -> int:
    """Words of the windows in which a template of that many words is looked for: a quarter more than it has."""
    return length + length // 4


def collision_probability(length: int, contained: float = CONTAINED) -> float:
    """The least probability that a dealt window which holds `contained` of a template of that many words shares a
    band with it: its Jaccard similarity with the template is least when its other shingles are all foreign."""
    of_template = max(1, length - SHINGLE + 1)
    shared = -(-contained * of_template // 1)
    window = max(1, window_of(length) + stride_of(length) - 1 - min(SHINGLE, length) + 1)
    similar = shared / (of_template + window - shared)
    return 1 - (1 - similar**ROWS) ** BANDS


def anchors_of(templates: list[list[str]]) -> list[str]:
    """Words, long ones first, such that each template has more than 1 - CONTAINED of its shingles with one of them:
    what holds CONTAINED of a template holds one of these words."""
    chosen: list[str] = []
    for words in templates:
        size = min(SHINGLE, len(words))
        grams = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}
        while sum(any(a in g for a in chosen) for g in grams) <= (1 - CONTAINED) * len(grams):
            left = [g for g in grams if not any(a in g for a in chosen)]
            chosen.append(max(sorted({w for g in left for w in g}), key=lambda w: (len(w) > 5) * sum(w in g for g in left) * len(w) + len(w) / 100))
    return chosen


def _shingles(words: Column, size: Column) -> Column:
    last = F.size(words) - size
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(F.slice(words, k + 1, size), " "))))


def _starts(size: int, stride: int) -> Callable[[Column], Column]:
    """Of the place of a word, the starts of the dealt windows that hold it."""
    def of(place: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((place - size + 1) / stride).cast("int"))
        return F.transform(F.sequence(first, F.floor(place / stride).cast("int")), lambda k: k * stride)

    return of


def _dealt(length: int, anchors: list[str]) -> Column:
    """Around these anchors of a text, the windows (length, first_word) for templates of that many words.

    They hold window_of(length) + stride - 1 words and start at each stride, so each window of window_of(length)
    words lies within one of them.
    """
    listed = F.array(*map(F.lit, anchors))
    places = F.transform(F.filter("anchors", lambda x: F.array_contains(listed, x["word"])), lambda x: x["at"])
    starts = _starts(window_of(length) + stride_of(length) - 1, stride_of(length))
    return F.transform(F.array_distinct(F.flatten(F.transform(places, starts))), lambda k: F.struct(F.lit(length).alias("length"), k.alias("first_word")))


def _seeded(seed: int) -> Callable[[Column], Column]:
    return lambda h: F.xxhash64(h, F.lit(seed))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often `of` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _bands(shingles: Column) -> Column:
    """One hash of ROWS least values for each band; none for an empty set."""
    def signed(least: Column) -> Column:
        return F.array(*(F.xxhash64(F.lit(b), *(least[b * ROWS + r] for r in range(ROWS))) for b in range(BANDS)))

    def banded(hashed: Column) -> Column:
        return _let(F.array(*(F.array_min(F.transform(hashed, _seeded(k))) for k in range(BANDS * ROWS))), signed)

    return F.when(F.size(shingles) > 0, _let(F.transform(shingles, lambda s: F.xxhash64(s)), banded))


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = [(name, len(words_of(text)), shingles_of(words_of(text))) for name, text in templates]
    return spark.createDataFrame(rows, "license string, length int, wanted array<string>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, first_word, containment: the licenses of which a text holds a template, at best where it does.

    A text holds a template of n words if window_of(n) consecutive words of it have CONTAINED of the template's
    five-word shingles (a template of fewer words is one shingle); first_word is where the earliest best window
    starts. Case and punctuation don't matter. Null and empty texts have no windows; a text without any license
    gives no row; rows with equal doc_id are one document. Templates come as a list that the caller holds, so they
    are sent to all tasks. Columns beyond doc_id and text are ignored.

    Texts are read and cut into words once. Only windows around anchors, words that any window holding CONTAINED of
    a template must have, are hashed; MinHash bands retrieve their templates, and every window of window_of(n) words
    within a retrieved one is compared exactly.
    """
    templates = TEMPLATES if templates is None else templates
    known = [(name, text) for name, text in templates if words_of(text)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not known:
        return rows.filter("false").select("doc_id", F.lit("").alias("license"), F.lit(0).alias("first_word"), F.lit(0.0).alias("containment"))
    anchors = anchors_of([words_of(text) for _, text in known])
    # as a filter alone: an anchor in capitals is one in lower case then
    hinted = rows.filter(_let(F.lower("text"), lambda low: reduce(or_, (low.contains(a) for a in anchors))))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = hinted.select("doc_id", F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)).alias("words"))
    listed = F.array(*map(F.lit, anchors))
    places = F.filter(F.transform("words", lambda w, k: F.when(F.array_contains(listed, w), F.struct(w.alias("word"), k.alias("at")))), lambda k: k.isNotNull())
    by_length = {}
    for _, text in known:
        by_length.setdefault(len(words_of(text)), set()).update(a for a in anchors if a in words_of(text))
    lengths = sorted(by_length)
    sizes = F.create_map(*(F.lit(x) for n in lengths for x in (n, window_of(n))))
    strides = F.create_map(*(F.lit(x) for n in lengths for x in (n, stride_of(n))))
    windows = (
        words.withColumn("anchors", places).filter(F.size("anchors") > 0)
        .select("doc_id", "words", F.explode(F.concat(*(_dealt(n, sorted(by_length[n])) for n in lengths))).alias("dealt"))
        .select("doc_id", "dealt.length", "dealt.first_word", F.slice("words", F.col("dealt.first_word") + 1, sizes[F.col("dealt.length")] + strides[F.col("dealt.length")] - 1).alias("words"))
    )
    size = F.least(F.lit(SHINGLE), F.col("length"))
    banded = windows.withColumn("bands", _bands(_shingles(F.col("words"), size))).filter("bands is not null")
    banded = banded.select("doc_id", "length", "first_word", "words", F.explode("bands").alias("band"))
    wanted = _templates(docs.sparkSession, known)
    wanted = wanted.select("license", "length", "wanted", F.explode(_bands(F.col("wanted"))).alias("band"))
    candidates = banded.join(F.broadcast(wanted), ["length", "band"]).drop("band").dropDuplicates(["doc_id", "license", "length", "first_word", "wanted", "words"])

    def share(k: Column) -> Column:
        inner = _shingles(F.slice("words", k + 1, sizes[F.col("length")]), size)
        return F.struct((F.size(F.array_intersect(inner, F.col("wanted"))) / F.size("wanted")).alias("containment"), (-F.col("first_word") - k).alias("at"))

    inner = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(strides[F.col("length")], F.size("words") - sizes[F.col("length")] + 1) - 1))
    held = candidates.select("doc_id", "license", F.array_max(F.transform(inner, share)).alias("best")).filter(F.col("best.containment") >= CONTAINED)
    best = held.groupBy("doc_id", "license").agg(F.max("best").alias("best"))
    return best.select("doc_id", "license", (-F.col("best.at")).alias("first_word"), F.col("best.containment").alias("containment"))
