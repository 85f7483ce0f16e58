"""Licence scan by diagonal voting.

The rolling hashes of all k-word grams of every text are joined by Spark with those of licence templates.
Hits of one text and template that share the offset (text position minus template position) lie on one
diagonal; diagonals are counted, neighbouring ones (a word inserted or left out) are merged. Texts with
passages are then read again and each span is aligned with its template word by word: it counts when the
words matched in order cover enough of the template, and when the words that tell licences apart agree.
A phrase of up to SHORT words is one k-gram of its own length: each hit whose words are the phrase's is a
place where its words stand consecutively.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, row_key, slabs, trimmed
from .textkit import IS_TERM, LOWER, rolling, signed, word_bounds, word_keys

SHORT = 5
GRAM = 5
#: Diagonals at most so far apart, with spans at most so many words apart, are one passage.
SLACK = 4
GAP = 40
#: Share of a template's words that a passage must cover.
COVER = 0.6

# Words that tell templates apart, the label that needs each and the one that must not have it.
MARKS = (("noncommercial", "cc-by-nc", "cc-by"), ("sharealike", "cc-by-sa", "cc-by"), ("lesser", "lgpl", "gpl"))

# The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Passages of public licence texts.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def terms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return data, *_terms(data, np.array([0, len(data)], np.int64))


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, doc = word_bounds(data, offs, IS_TERM)
    return start, end, doc, word_keys(data, start, end)


def shown(text: str) -> list[bytes]:
    data, start, end, _, _ = terms(text)
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]


def template_rows(phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """(template, base, k, tpos, h) of every k-gram of the phrases and templates."""
    out = []
    for t, (text, base) in enumerate([(p, True) for p, _ in phrases] + [(x, False) for _, x in templates]):
        _, _, _, doc, words = terms(text)
        k = len(words) if len(words) <= SHORT else GRAM
        at, h = rolling(words, doc, k)
        out += [(t, base, k, int(i), int(x)) for i, x in zip(at.tolist(), signed(h).tolist(), strict=True)]
    return out


def matched(template: list[bytes], span: list[bytes]) -> int:
    """Words of the longest common subsequence, one bit a template word."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    open_ = full
    for w in span:
        x = open_ & places.get(w, 0)
        open_ = (open_ + x | open_ - x) & full
    return len(template) - open_.bit_count()


def cover(label: str, template: list[bytes], span: list[bytes], inner: list[bytes]) -> float:
    """Share of the template's words that `span` has in order; 0 if a mark is missing or, in `inner`, too much."""
    for mark, needs, bars in MARKS:
        word = mark.encode()
        if label == needs and word in template and word not in span or label == bars and word not in template and word in inner:
            return 0.0
    return matched(template, span) / len(template)


TEMPLATE_SCHEMA = "template int, base boolean, k int, tpos long, h long"
#: Most hashes in a cell; a text with more has several.
CELL = 1 << 17


def gram_hashes(rows: DataFrame, ks: list[int], cell: int = CELL) -> DataFrame:
    """rows: row, text. Gives (row, k, first, hashes): the hashes of all grams of k words, in order from word `first` on."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for a, z, raw, offs in slabs(b, "text"):
                start, end, doc, words = _terms(LOWER[raw], offs)
                n = z - a
                for k in ks:
                    at, h = rolling(words, doc, k)
                    size = np.bincount(doc[at], minlength=n)
                    if (size <= cell).all():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a:z]), pa.array(np.full(n, k, np.int32)), pa.array(np.zeros(n, np.int64)), _lists(signed(h), size)], ["row", "k", "first", "hashes"])
                        continue
                    ends = np.cumsum(size)
                    for d in range(n):
                        own = signed(h[ends[d] - size[d] : ends[d]])
                        cells = [own[c : c + cell] for c in range(0, len(own), cell)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), ids[a + d])), pa.array(np.full(len(cells), k, np.int32)), pa.array(np.arange(len(cells)) * cell), _lists(np.concatenate([*cells, own[:0]]), np.array([len(c) for c in cells], np.int64))], ["row", "k", "first", "hashes"])

    return rows.mapInArrow(trimmed(run), "row long, k int, first long, hashes array<bigint>")


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row a document.

    Words are runs of digits, letters and non-ASCII characters after lowering A-Z; null counts as empty.
    Base places are all places of the phrases, overlapping ones too; first_word and last_word are null
    without one, the base labels are then empty and the score is the best cover of a verified passage, or 0. Repeated
    rows are scanned and returned each. Empty tables give an empty result; extra columns are ignored. Up to
    `broadcast` places and passages are sent to the tasks; more are joined.
    """
    spark: SparkSession = docs.sparkSession
    grams = template_rows(phrases, templates)
    kinds = [(lab, shown(x)) for x, lab in [*phrases, *((x, lab) for lab, x in templates)]]
    known = F.broadcast(spark.createDataFrame(grams, TEMPLATE_SCHEMA))  # a fixed number of templates
    key = row_key(docs, F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("row"))

    hashed = gram_hashes(rows.select("row", "text"), sorted({r[2] for r in grams}))
    exploded = hashed.select("row", "k", "first", F.posexplode("hashes").alias("i", "h"))
    hits = cut(exploded.join(known, ["h", "k"]).select("row", "template", "base", "tpos", (F.col("first") + F.col("i")).alias("pos")).distinct())  # rows alike hit alike
    votes = hits.groupBy("row", "template", "base", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    along = Window.partitionBy("row", "template").orderBy("a", "diagonal")
    fresh = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) <= SLACK) & (F.col("a") - F.lag("b").over(along) <= GAP)
    passages = (
        votes.where("not base").withColumn("new", F.when(fresh, 0).otherwise(1)).withColumn("passage", F.sum("new").over(along))
        .groupBy("row", "template", "passage").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    )
    places = votes.where("base").select("row", "template", F.col("diagonal").alias("low"), F.col("diagonal").alias("high"))
    spans = cut(places.unionByName(passages.select(*places.columns)).groupBy("row").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans")))
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= broadcast

    def verify(batches):
        for b in batches:
            out = []
            for row, text, found in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = shown(text or "")
                at, base, labels, best = [], set(), set(), 0.0
                for x in found:
                    label, template = kinds[x["template"]]
                    lo, hi = max(x["low"], 0), x["high"] + len(template)
                    if x["template"] < len(phrases):
                        if words[lo:hi] == template:
                            at.append(lo)
                            base.add(label)
                        continue
                    c = cover(label, template, words[max(lo - SLACK, 0) : hi + SLACK], words[lo:hi])
                    best = max(best, c)
                    if c >= COVER:
                        labels.add(label)
                out.append((row, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else best))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kind = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind, strict=True)], ["row", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    texts = rows.select("row", "text").join(F.broadcast(spans) if few else spans, "row").select("row", "text", "spans")
    verified = texts.mapInArrow(trimmed(verify), "row long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").dropDuplicates(["row"])

    def counted(batches):
        for b in batches:
            for a, z, raw, offs in slabs(b, "text"):
                n = np.bincount(word_bounds(LOWER[raw], offs, IS_TERM)[2], minlength=z - a)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(n)], ["doc_id", "row", "n_words"])

    out = rows.mapInArrow(trimmed(counted), "doc_id long, row long, n_words long").join(verified, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
