"""License scans by diagonal voting.

Every rolling word k-gram hash of every text is joined, in Spark, to the positions of
the license templates.  A hit at text position p and template position t votes for
the diagonal p - t; hits of one text and template are summed per diagonal, diagonals
at most ``SLACK`` words apart whose hits lie near each other are merged (insertions
and deletions), and merged spans with enough votes are verified by aligning the
text's words with the template's.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased.  Null and
empty texts have no words, no labels and score 0.  Repeated rows give equal rows; votes
count distinct positions per (id, text), so repeats don't add up, and rows that share
an id but not a text are told apart by the text's hash.  Rows with a null id are
scanned like others.  A very long text is scanned whole, alone in its chunk.  Other columns
are ignored; an empty table gives an empty one.  The templates are constants, so the
broadcast tables are of fixed size.  Only texts that hold some template k-gram are shuffled
to their spans.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textscan import ALNUM, LOWER, Scan, scans, windows

GRAM = 3
SLACK = 4
#: A span needs this share of its template's k-grams to be verified, and this share of its words to be kept.
MIN_VOTES, MIN_SIMILARITY = 0.5, 0.7

# Phrases and labels of the base report.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license texts and customary notices.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0"),
]


def _constant(text: str) -> tuple[list[str], Scan, tuple]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    scan = Scan(data, np.array([0, len(data)]))
    s, e, owner = scan.spans(ALNUM)
    return [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)], scan, (s, e, owner)


def template_grams(spark: SparkSession) -> DataFrame:
    """gram, template, t_pos and n_grams of all templates."""
    rows = []
    for number, (_, text) in enumerate(TEMPLATES):
        _, scan, (s, e, owner) = _constant(text)
        grams, first = windows(scan.hashes(s, e), owner, GRAM)
        rows += [(int(g), number, int(p), len(grams)) for g, p in zip(grams.view(np.int64), first, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, t_pos int, n_grams int")


def _phrase_hashes() -> list[tuple[str, np.ndarray]]:
    out = []
    for phrase, label in PHRASES.items():
        _, scan, (s, e, _) = _constant(phrase)
        out.append((label, scan.hashes(s, e)))
    return out


_BASE = ("n_words", "n_base", "first_word", "last_word")


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = _phrase_hashes()
    for batch in batches:
        out = {c: np.zeros(batch.num_rows, np.int64) for c in _BASE}
        out["first_word"][:] = np.iinfo(np.int64).max
        out["last_word"][:] = -1
        seen = [np.zeros(batch.num_rows, bool) for _ in phrases]
        for lo, hi, scan in scans(batch.column(1)):
            low = scan.lowered()
            s, e, owner = low.spans(ALNUM)
            h = low.hashes(s, e)
            out["n_words"][lo:hi] = np.bincount(owner, minlength=scan.n)
            start = np.searchsorted(owner, np.arange(scan.n))
            for (_, want), mark in zip(phrases, seen, strict=True):
                n = len(h) - len(want) + 1
                if n <= 0:
                    continue
                hit = owner[:n] == owner[len(want) - 1 :]
                for k, x in enumerate(want):
                    hit &= h[k : k + n] == x
                at = np.flatnonzero(hit)
                rows, place = lo + owner[at], at - start[owner[at]]
                np.add.at(out["n_base"], rows, 1)
                np.minimum.at(out["first_word"], rows, place)
                np.maximum.at(out["last_word"], rows, place)
                mark[rows] = True
        none = out["n_base"] == 0
        labels = [",".join(sorted(label for (label, _), mark in zip(phrases, seen, strict=True) if mark[i])) for i in range(batch.num_rows)]
        columns = [pa.array(out["n_words"]), pa.array(out["n_base"]), pa.array(out["first_word"], mask=none), pa.array(out["last_word"], mask=none), pa.array(labels, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["id", *_BASE, "base_labels", "text_hash"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, scan in scans(batch.column(1)):
            low = scan.lowered()
            s, e, owner = low.spans(ALNUM)
            grams, first = windows(low.hashes(s, e), owner, GRAM)
            cuts = np.searchsorted(owner[first], np.arange(scan.n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], names=["id", "text_hash", "grams"])


def candidate_spans(rows: DataFrame, templates: DataFrame, id_type: str) -> DataFrame:
    """id, text_hash, template and the text words [start, stop] of merged diagonals with enough votes.  rows: id, text, text_hash."""
    grams = rows.mapInArrow(_grams, f"id {id_type}, text_hash long, grams array<long>")
    hits = grams.select("id", "text_hash", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(templates), "gram")
    diagonals = hits.groupBy("id", "text_hash", "template", "n_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("start"), F.max("pos").alias("stop"))
    order = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal", "start")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK) | F.lag("diagonal").over(order).isNull()
    merged = diagonals.withColumn("island", F.sum(apart.cast("int")).over(order))
    spans = merged.groupBy("id", "text_hash", "template", "n_grams", "island").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), (F.max("stop") + GRAM - 1).alias("stop"))
    return spans.where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("n_grams") * MIN_VOTES))).drop("island", "n_grams")


def _alignments(have: list[str], want: list[str]) -> Iterator[tuple[int, int, int]]:
    """Places (first word, last word, equal words) in ``have`` where ``want`` stands, aligned by matching blocks.

    A span can hold a template several times, so it is read in windows of three times the template that overlap by two.
    """
    n, lo = len(want), 0
    while True:
        part = have[lo : lo + 3 * n]
        blocks = [m for m in difflib.SequenceMatcher(None, part, want, autojunk=False).get_matching_blocks() if m.size]
        if blocks:
            yield lo + blocks[0].a, lo + blocks[-1].a + blocks[-1].size - 1, sum(m.size for m in blocks)
        lo += n
        if lo + 2 * n >= max(len(have), 2 * n + 1):
            break


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = [_constant(text)[0] for _, text in TEMPLATES]
    for batch in batches:
        out = []
        for i, row in enumerate(batch.select(["id", "text_hash", "spans"]).to_pylist()):
            for _, _, scan in scans(batch.column(1).slice(i, 1), 1):
                low = scan.lowered()
                s, e, _ = low.spans(ALNUM)
                found = set()
                for span in row["spans"]:
                    want = words_of[span["template"]]
                    a, b = span["start"], span["stop"] + 1
                    have = [low.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(s[a:b], e[a:b], strict=True)]
                    for start, stop, same in _alignments(have, want):
                        if same >= MIN_SIMILARITY * len(want):
                            found.add((same / len(want), same, a + start, a + stop, TEMPLATES[span["template"]][0]))
                kept = []  # of overlapping spans the more similar, then the longer one stays, unless equally good ones differ in label
                for x in sorted(found, reverse=True):
                    if all(x[3] < y[2] or y[3] < x[2] or (x[:2] == y[:2] and x[4] != y[4]) for y in kept):
                        kept.append(x)
                out += [(row["id"], row["text_hash"], label, a, b, similarity) for similarity, _, a, b, label in sorted(kept, key=lambda x: (x[2], x[4]))]
        names = ["id", "text_hash", "label", "start", "stop", "similarity"]
        kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _holding(grams: np.ndarray):
    """Rows (id, text, text_hash) whose text holds one of some hashed k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for lo, _, scan in scans(batch.column(1)):
                low = scan.lowered()
                s, e, owner = low.spans(ALNUM)
                found, first = windows(low.hashes(s, e), owner, GRAM)
                hit[lo + owner[first[np.isin(found, grams)]]] = True
            yield batch.filter(pa.array(hit))

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, label, first and last word, and similarity of every verified license span."""
    rows, kind = _rows(docs, id_col, text_col), docs.schema[id_col].dataType.simpleString()
    templates = template_grams(docs.sparkSession)
    spans = candidate_spans(rows, templates, kind)
    listed = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("template", "start", "stop")).alias("spans"))
    grams = np.array([r["gram"] for r in templates.select("gram").collect()], np.int64).view(np.uint64)  # constants
    near = rows.mapInArrow(_holding(grams), rows.schema)
    same = listed["id"].eqNullSafe(near["id"]) & (listed["text_hash"] == near["text_hash"])
    texts = near.join(listed, same).select(near["id"], near["text"], near["text_hash"], "spans")
    return texts.mapInArrow(_verify, f"id {kind}, text_hash long, label string, start long, stop long, similarity double")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans of every row.

    ``score`` is the best verified similarity, and at least 0.5 with a base label.
    """
    rows, kind = _rows(docs, id_col, text_col), docs.schema[id_col].dataType.simpleString()
    base = rows.mapInArrow(_base, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, text_hash long")
    spans = license_spans(docs, id_col, text_col)
    found = spans.groupBy(spans["id"].alias("s_id"), spans["text_hash"].alias("s_hash")).agg(F.collect_set("label").alias("more"), F.max("similarity").alias("similarity"), F.count_distinct("label", "start", "stop").alias("n_spans"))
    joined = base.join(found, base["id"].eqNullSafe(found["s_id"]) & (base["text_hash"] == found["s_hash"]), "left")
    own = F.when(F.col("base_labels") != "", F.split("base_labels", ",")).otherwise(F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("similarity", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return joined.select("id", *_BASE, "base_labels", F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
