"""Licences of files: TF-IDF cosine to templates, then inheritance down the directories.

Every line of a file, and the file as a whole, is a sparse TF-IDF vector; its cosine to
the templates names a licence. The templates are customary notices and, for whole files,
the full texts in ``license_texts``. A licence file speaks for its directory: one that is a
full licence text, or one named as such that is a notice. Files without a licence of
their own take that of the nearest directory above them that has one. A notice elsewhere is a header.
"""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.columns import Aside
from notemill.llm.scratch import Scratch
from notemill.llm.words import text_slices, word_hashes, words

LINE_COSINE = 0.6
FILE_COSINE = 0.5
#: For full texts: unlike licences of other families lie under it, texts with names and copyright lines added over it.
TEXT_COSINE = 0.65
#: Names of licence files, as the last part of a path.
LICENSE_NAME = r"(?i)(^|/)((un)?licen[cs]e|copying)([-_][^/.]*|\.lesser)?(\.(txt|md|rst|html?))?$"
#: Rows of one directory are dealt to so many parts where they meet its licence.
SALTS = 16

# Customary notices and opening sentences of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]



def full_texts() -> list[tuple[str, str]]:
    """Name and text of every full licence text of the package, by name."""
    files = [f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files)


_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_U = np.uint64


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, lengths, counts = words(data, offsets, _APART)
    return word_hashes(data, starts, lengths, space=_APART), starts, counts


@dataclass
class Templates:
    names: list[str]
    terms: np.ndarray  # sorted hashes of the words of all templates
    counts: np.ndarray  # templates x terms


def prepare(templates: list[tuple[str, str]]) -> Templates:
    found = []
    for _, text in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        found.append(_hashes(data, np.array([0, len(data)]))[0])
    terms = np.unique(np.concatenate([np.zeros(0, _U), *found]))
    counts = np.zeros((len(templates), len(terms)))
    for i, f in enumerate(found):
        np.add.at(counts[i], np.searchsorted(terms, f), 1)
    return Templates([n for n, _ in templates], terms, counts)


def _term_of(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Place of each hash among the terms, -1 for words of no template."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each of the sorted template words occurs, and the number of texts."""

    def rows(batches):
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(0)):
                hashes, _, counts = _hashes(data, offsets)
                term = _term_of(hashes, terms)
                text = np.repeat(np.arange(end - start), counts)[term >= 0]
                cells = np.unique(text * len(terms) + term[term >= 0])
                total += np.bincount(cells % len(terms), minlength=len(terms))
                n += end - start
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(terms)), -1]), pa.array([*total, n])], names=["term", "n"])

    found = texts.mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    by = {r["term"]: r["n"] for r in found}
    return np.array([by.get(i, 0) for i in range(len(terms))], float), by.get(-1, 0)


@dataclass
class Matcher:
    terms: np.ndarray
    idf: np.ndarray
    other: float  # idf of words of no template
    matrix: np.ndarray  # terms x templates, unit columns
    anchors: np.ndarray  # terms without one of which no template is near enough


def matcher(templates: Templates, df: np.ndarray, n: int, least: float = min(LINE_COSINE, FILE_COSINE)) -> Matcher:
    idf = np.log((1 + n) / (1 + df)) + 1
    weights = np.where(templates.counts > 0, 1 + np.log(np.maximum(templates.counts, 1)), 0) * idf
    unit = weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    anchors = np.zeros(len(templates.terms), bool)
    for row in unit:
        # A text with none of the heaviest words has a cosine of the norm of the others at most.
        order = np.argsort(-row, kind="stable")
        rest = np.sqrt(np.maximum(0, 1 - np.cumsum(row[order] ** 2)))
        anchors[order[: int(np.argmax(rest < least - 1e-9)) + 1]] = True
    return Matcher(templates.terms, idf, float(np.log(1 + n) + 1), unit.T.copy(), anchors)


def _best(m: Matcher, group: np.ndarray, hashes: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best template and cosine of each group (line or text) that has an anchor word."""
    has = np.unique(group[(term >= 0) & m.anchors[term]]) if len(term) else group[:0]
    inside = np.isin(group, has)
    g = np.searchsorted(has, group[inside])
    h, t = hashes[inside], term[inside]
    if not len(has):
        return has, has, np.zeros(0)
    order = np.lexsort((h, g))
    g, h, t = g[order], h[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
    times = np.diff(np.append(first, len(g)))
    g, t = g[first], t[first]
    value = (1 + np.log(times)) * np.where(t >= 0, m.idf[t], m.other)
    norm = np.sqrt(np.bincount(g, value * value, minlength=len(has)))
    dots = np.zeros((len(has), m.matrix.shape[1]))
    known = t >= 0
    np.add.at(dots, g[known], value[known, None] * m.matrix[t[known]])
    cosine = np.round(dots / norm[:, None], 9)
    pick = cosine.argmax(axis=1)
    return has, pick, cosine[np.arange(len(has)), pick]


def _whole(m: Matcher, n: int, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best full text and cosine of each of ``n`` texts; -1 for none near enough."""
    pick, cosine = np.full(n, -1), np.zeros(n)
    term = _term_of(hashes, m.terms)
    known = term >= 0
    cells, times = np.unique(text[known] * len(m.terms) + term[known], return_counts=True)
    if not len(cells):
        return pick, cosine
    of, t = cells // len(m.terms), cells % len(m.terms)
    value = (1 + np.log(times)) * m.idf[t]
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    has = of[edges]
    dots = np.add.reduceat(value[:, None] * m.matrix[t], edges, axis=0)
    square = np.add.reduceat(value * value, edges)
    # Words of no template only lengthen a vector: texts too far without them need none counted.
    near = dots.max(axis=1) >= (TEXT_COSINE - 1e-6) * np.sqrt(square)
    has, dots, square = has[near], dots[near], square[near]
    inside = np.isin(text, has) & ~known
    other, h = np.searchsorted(has, text[inside]), hashes[inside]
    order = np.lexsort((h, other))
    other, h = other[order], h[order]
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (h[1:] != h[:-1])]))
        more = (1 + np.log(np.diff(np.append(first, len(h))))) * m.other
        square = square + np.bincount(other[first], more * more, minlength=len(has))
    found = np.round(dots / np.sqrt(square)[:, None], 9)
    best = found.argmax(axis=1)
    top = found[np.arange(len(has)), best]
    pick[has[top >= TEXT_COSINE]], cosine[has[top >= TEXT_COSINE]] = best[top >= TEXT_COSINE], top[top >= TEXT_COSINE]
    return pick, cosine


def match(
    m: Matcher, full: Matcher, data: np.ndarray, offsets: np.ndarray, named: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: best header template and cosine, licence-file template and cosine; -1 for none near enough.

    A notice as a whole text makes a licence file of one that is ``named`` so, and is a header like a line elsewhere.
    Licence-file templates are the notices, then the full texts; the nearer one counts.
    """
    n = len(offsets) - 1
    hashes, starts, counts = _hashes(data, offsets)
    term = _term_of(hashes, m.terms)
    text = np.repeat(np.arange(n), counts)
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:-1]]))
    line = np.searchsorted(breaks, starts, side="right")
    line_pick, line_cos = np.full(n, -1), np.zeros(n)
    has, pick, cosine = _best(m, line, hashes, term)
    if len(has):
        first_word = np.searchsorted(line, has)
        for t, p, c in zip(text[first_word].tolist(), pick.tolist(), cosine.tolist()):
            if c >= LINE_COSINE and c > line_cos[t]:
                line_pick[t], line_cos[t] = p, c
    file_pick, file_cos = np.full(n, -1), np.zeros(n)
    has, pick, cosine = _best(m, text, hashes, term)
    near = cosine >= FILE_COSINE
    speaks = near & named[has]
    file_pick[has[speaks]], file_cos[has[speaks]] = pick[speaks], cosine[speaks]
    header = near & ~named[has] & (cosine > line_cos[has])
    line_pick[has[header]], line_cos[has[header]] = pick[header], cosine[header]
    pick, cosine = _whole(full, n, text, hashes)
    nearer = cosine > file_cos
    file_pick[nearer], file_cos[nearer] = pick[nearer] + m.matrix.shape[1], cosine[nearer]
    return line_pick, line_cos, file_pick, file_cos


def scan(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
    full: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """The licence of every file: its columns but the text, ``license``, ``via``, ``cosine``, ``license_dir``.

    ``via`` is ``file`` (the text as a whole is a full licence text, or a notice in a file named like a licence),
    ``header`` (a line is a notice, or the whole text of another file; the best
    one, the first of equals), ``inherited`` (from ``license_dir``, the nearest directory above with a licence file;
    of several there the best, then the one of the first path) or null. Word weights come from
    all files. A whole file is held against ``templates`` and the full texts ``full`` (those of
    the package unless given); the nearer one counts, and a notice before a full text. A null text is empty; a file without a path inherits nothing; paths need not be
    unique; columns of these names, in any letter case, give way; no rows give no rows.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    own = ("license", "via", "cosine", "license_dir")
    aside = Aside(files, *own, text_col)
    carried, path = aside.working, F.col(path_col).cast("string")
    texts = files.select(
        *aside.take, path.alias("__path"), F.coalesce(F.rlike(path, F.lit(LICENSE_NAME)), F.lit(False)).alias("__named"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
    )
    ready, whole = prepare(templates), prepare(full_texts() if full is None else full)
    terms = np.union1d(ready.terms, whole.terms)
    df, n = document_frequencies(texts.select("__text"), terms)
    df_of = lambda t: df[np.searchsorted(terms, t.terms)]
    # A few notices, and some twenty full texts of some 5,000 words in all.
    shared = spark.sparkContext.broadcast(
        (ready.names + whole.names, matcher(ready, df_of(ready), n), matcher(whole, df_of(whole), n, TEXT_COSINE))
    )

    def rows(batches):
        names, m, w = shared.value
        named = lambda picks: pa.array([names[p] if p >= 0 else None for p in picks], pa.string())
        for batch in batches:
            last = batch.num_columns - 1
            speaks = np.array(batch.column(last - 1).to_pylist(), bool)
            parts = [match(m, w, data, offsets, speaks[start:end]) for start, end, data, offsets in text_slices(batch.column(last))]
            line, line_cos, file, file_cos = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, int)] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(last - 1)], named(line), pa.array(line_cos, pa.float64()),
                    named(file), pa.array(file_cos, pa.float64()),
                ],
                names=[*carried, "__path", "__line", "__line_cos", "__file", "__file_cos"],
            )

    found_as = {"__path": T.StringType(), "__line": T.StringType(), "__line_cos": T.DoubleType(), "__file": T.StringType(), "__file_cos": T.DoubleType()}
    more = [T.StructField(c, k) for c, k in found_as.items()]
    found = texts.mapInArrow(rows, T.StructType([*aside.fields, *more]))
    folder = F.regexp_replace("__path", "/?[^/]*$", "")
    placed = scratch.table(found.withColumn("__dir", folder), "found")

    speaking = placed.filter("__file IS NOT NULL AND __dir IS NOT NULL").groupBy(F.col("__dir").alias("from_dir")).agg(
        F.min(F.struct((-F.col("__file_cos")).alias("far"), F.col("__path").alias("p"), F.col("__file").alias("f"))).alias("x")
    ).select("from_dir", "x.f", (-F.col("x.far")).alias("c"))
    dirs = placed.filter("__dir IS NOT NULL").select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = dirs.select(
        "__dir",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(parts)),
                lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("d")),
            )
        ).alias("a"),
    ).select("__dir", "a.depth", F.col("a.d").alias("from_dir"))
    # The root is above every directory, and one directory may hold most files: both sides go by part of their key.
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    above = above.withColumn("salt", F.pmod(F.xxhash64("__dir"), F.lit(SALTS)).cast("int"))
    nearest = above.join(speaking.withColumn("salt", copies), ["from_dir", "salt"]).groupBy(F.col("__dir").alias("in_dir")).agg(
        F.max(F.struct("depth", "from_dir", "f", "c")).alias("near")
    )
    nearest = nearest.withColumn("in_salt", copies)
    dealt = placed.withColumn("__salt", F.pmod(F.xxhash64("__path"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(nearest, (F.col("__dir") == F.col("in_dir")) & (F.col("__salt") == F.col("in_salt")), "left")
    via = F.when(F.col("__file").isNotNull(), "file").when(F.col("__line").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited")
    return joined.select(
        *aside.give, F.coalesce("__file", "__line", "near.f").alias("license"), via.alias("via"),
        F.when(F.col("__file").isNotNull(), F.col("__file_cos")).when(F.col("__line").isNotNull(), F.col("__line_cos"))
        .when(F.col("near").isNotNull(), F.col("near.c")).alias("cosine"),
        F.when(via == "inherited", F.col("near.from_dir")).alias("license_dir"),
    )
