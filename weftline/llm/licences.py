"""Operator 6: licence scan by sparse TF-IDF cosine to templates, with inheritance from the nearest directory.

A text is compared with every template in stretches of lines: a stretch's terms are weighted by TF-IDF over the
templates' vocabulary and the corpus' document frequencies, and the cosine of the stretch and a template decides.
Files that have no licence of their own take that of the nearest directory above them that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.scratch import attach, materialise

#: Short notices by which the licences are named, several templates a licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST = 0.75
#: A text whose licence stretch makes up at least this share of its words is a licence file, and so is any text with a
#: stretch under a name that licence files have.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright|notice)([._-][^/]*)?$"
TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


@dataclass
class Templates:
    names: list[str]
    vectors: list[dict[str, float]]
    idf: dict[str, float]
    top: float  # the weight of a term no template has
    lengths: list[int]
    anchors: re.Pattern

    @classmethod
    def build(cls, df: dict[str, int], n: int, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Templates:
        """``df``: in how many of the ``n`` texts each template term occurs."""
        top = math.log(1 + n) + 1
        idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, text in templates for t in terms(text)}
        vectors, lengths = [], []
        for _, text in templates:
            tf = Counter(terms(text))
            v = {t: c * idf[t] for t, c in tf.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vectors.append({t: x / norm for t, x in v.items()})
            lengths.append(sum(tf.values()))
        # a stretch that reaches the least cosine shares one of the heaviest terms that together exceed 1 - LEAST**2
        anchors: set[str] = set()
        for v in vectors:
            left = 1.0
            for t, x in sorted(v.items(), key=lambda i: -i[1]):
                if left < LEAST**2:
                    break
                anchors.add(t)
                left -= x * x
        pattern = "|".join(sorted((re.escape(a) for a in anchors), key=lambda a: (-len(a), a)))
        return cls([n for n, _ in templates], vectors, idf, top, lengths, re.compile(rf"(?<![a-z0-9.])(?:{pattern})(?![a-z0-9])"))

    def weight(self, words: list[str]) -> dict[str, float]:
        return {t: c * self.idf.get(t, self.top) for t, c in Counter(words).items()}

    def window(self, words: list[str]) -> tuple[str | None, float, int]:
        """(licence, cosine, words): the best run of as many words as a template has that holds an anchor."""
        marks = [i for i, w in enumerate(words) if self.anchors.fullmatch(w)]
        top = (None, 0.0, 0)
        for name, v, n in zip(self.names, self.vectors, self.lengths):
            begun = -1
            for mark in marks:
                for s in range(max(begun + 1, mark - n + 1, 0), min(mark, len(words) - n) + 1):
                    begun = s
                    w = self.weight(words[s : s + n])
                    c = sum(x * v[t] for t, x in w.items() if t in v) / math.sqrt(sum(x * x for x in w.values()))
                    if c > top[1] + 1e-12:
                        top = (name, c, n)
        return top

    def best(self, text: str | None) -> tuple[str | None, float, float]:
        """(licence, cosine, share of the text's words): the best stretch of whole lines anywhere in the text.

        A stretch grows from each line that holds an anchor over the lines behind it, up to the longest template's
        word count and a half; in a line longer than the longest template, windows of each template's length around the
        anchors count as well.  Ties go to the first template."""
        if not text:
            return None, 0.0, 0.0
        low = text.lower()
        if not self.anchors.search(low):
            return None, 0.0, 0.0
        lines = low.split("\n")
        split: dict[int, list[str]] = {}
        words_of = lambda i: split.setdefault(i, TERM.findall(lines[i]))
        top, most = (None, 0.0, 0.0), max(self.lengths) * 3 // 2
        total = None
        for i, line in enumerate(lines):
            if not self.anchors.search(line):
                continue
            if len(words_of(i)) > max(self.lengths):
                name, c, n = self.window(words_of(i))
                if c >= LEAST and c > top[1] + 1e-12:
                    total = total or max(1, len(TERM.findall(low)))
                    top = (name, c, n / total)
            for s in range(max(0, i - 2), i + 1):
                stretch: list[str] = []
                for j in range(s, len(lines)):
                    stretch = stretch + words_of(j)
                    if j > s and len(stretch) > most:
                        break
                    if j < i or not stretch:
                        continue
                    w = self.weight(stretch)
                    norm = math.sqrt(sum(x * x for x in w.values()))
                    for name, v in zip(self.names, self.vectors):
                        c = sum(x * v[t] for t, x in w.items() if t in v) / norm
                        if c >= LEAST and c > top[1] + 1e-12:
                            if total is None:
                                total = max(1, len(TERM.findall(low)))
                            top = (name, c, len(stretch) / total)
        return top


def document_frequencies(texts: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of the rows of (text) each template term occurs, over all rows; the vocabulary is fixed."""
    wanted = {t for _, text in templates for t in terms(text)}
    pattern = re.compile(rf"(?<![a-z0-9.])(?:{'|'.join(sorted(map(re.escape, wanted), key=lambda a: (-len(a), a)))})(?![a-z0-9])")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count[""] += 1
                if text:
                    count.update(wanted.intersection(pattern.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    got = {r["term"]: r["n"] for r in texts.mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("", 0)


def parent(path: Column) -> Column:
    """The directory of a path; null for the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def scan_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(key, path, licence, cosine, licence_file, inherited) for every row; key is ``key_col`` or the path.

    ``licence`` is the row's own, else that of the licence file in the nearest directory at or above its own; of
    several licence files in a directory the one of the highest cosine, then the first path and name, counts.  Null
    texts and paths are borne: no own licence, nothing to inherit.  Empty tables give no rows.

    Only licence files travel: their directories are a small aggregate, and each level up is one join of the distinct
    directories, not of the rows.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key_col or path_col).alias("key"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(Templates.build(*document_frequencies(rows.select("text"))))

    @F.pandas_udf("struct<licence:string,cosine:double,share:double>")
    def best(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([shared.value.best(t if isinstance(t, str) else None) for t in text], columns=["licence", "cosine", "share"])

    found = rows.select("key", "path", best("text").alias("b")).select("key", "path", parent(F.col("path")).alias("dir"), "b.*")
    found = materialise(found)
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    is_file = F.col("licence").isNotNull() & ((F.col("share") >= FILE_SHARE) | named)
    own = found.where(is_file & F.col("dir").isNotNull())
    held = own.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("x")).select("dir", F.col("x.licence").alias("held"))
    held = materialise(held)
    now = materialise(found.where("dir is not null").select("dir", F.col("dir").alias("at")).distinct())
    solved = None
    while True:
        step = attach(now, held.withColumnRenamed("dir", "at"), "at")
        done = step.where("held is not null").select("dir", "held")
        solved = done if solved is None else solved.unionByName(done)
        now = materialise(step.where("held is null").select("dir", parent(F.col("at")).alias("at")).where("at is not null"))
        if now.isEmpty():
            break
    out = attach(found, materialise(solved), "dir")
    return out.select("key", "path", F.coalesce("licence", "held").alias("licence"), "cosine", is_file.alias("licence_file"), (F.col("licence").isNull() & F.col("held").isNotNull()).alias("inherited"))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    """Documents as files of their source: the path is <source>/<language>/<id>.txt, so a source is a repository."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    out = scan_licences(docs.select("doc_id", path.alias("path"), "text"), key_col="doc_id")
    return out.select(F.col("key").alias("doc_id"), "path", "licence", F.round("cosine", 9).alias("cosine"), "licence_file", "inherited")
