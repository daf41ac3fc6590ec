"""License notices in texts, by MinHash over overlapping windows of word shingles."""

from __future__ import annotations

import re
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = re.compile(r"\w+")
SHINGLE = 5           # words
CONTAINED = 0.8       # least share of a template's shingles
CHANCE = 0.99         # least probability that a window with that share is looked at
RUN = 300_000         # words looked at together

# Short public notices of common licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    """The five-word shingles; none of a shorter sequence."""
    return {tuple(tokens[k:k + SHINGLE]) for k in range(len(tokens) - SHINGLE + 1)}


def _hashes(tokens: list[str]) -> np.ndarray:
    """A hash of the shingle at each position. Python's string hash differs between processes,
    so templates are hashed in the process that hashes the texts."""
    h = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    n = len(h) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


class Templates:
    """Bucket keys of the templates, by the stride of their windows.

    A template of m shingles lies inside a window of three blocks of `stride` shingles, where
    2 * stride >= m, wherever it stands. A band is one MinHash value: windows that share no
    shingle with a template never meet it. With the least share contained, window and template
    have a Jaccard similarity of j or more, so 1 - (1 - j)^bands gives the number of bands.
    """

    def __init__(self, rows: list[tuple[str, str]], contained: float = CONTAINED, chance: float = CHANCE):
        self.names = [r[0] for r in rows]
        self.contained, self.sets, strides = contained, [], {}
        for k, (_, text) in enumerate(rows):
            tokens = words(text)
            self.sets.append(shingles(tokens))
            m = len(tokens) - SHINGLE + 1
            if m > 0:
                stride = 2
                while 2 * stride < m:
                    stride *= 2
                strides.setdefault(stride, []).append((k, _hashes(tokens)))
        self.bands, self.keys = {}, {}
        rng = np.random.default_rng(5)
        for stride, own in strides.items():
            j = min((need := ceil(contained * len(self.sets[k]))) / (3 * stride + len(self.sets[k]) - need) for k, _ in own)
            self.bands[stride] = ceil(log(1 - chance) / log(1 - j)) if j < 1 else 1
        most = max(self.bands.values(), default=0)
        self.mult = rng.integers(1, 1 << 63, most, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, most, np.uint64)
        for stride, own in strides.items():
            for band in range(self.bands[stride]):
                keys = np.array([self.permuted(h, band).min() for _, h in own], np.uint64)
                order = np.argsort(keys)
                self.keys[stride, band] = keys[order], np.array([k for k, _ in own])[order]

    def permuted(self, h: np.ndarray, band: int) -> np.ndarray:
        x = (h ^ self.add[band]) * self.mult[band]
        return x ^ x >> np.uint64(29)

    def scan(self, texts: list[str | None]):
        """(row, license, share contained, first word, end word) of each license in each text."""
        part, n = [], 0
        for k, text in enumerate(texts):
            w = words(text)
            if part and n + len(w) > RUN:
                yield from self._scan(part)
                part, n = [], 0
            part.append((k, w))
            n += len(w)
        if part:
            yield from self._scan(part)

    def _scan(self, rows: list[tuple[int, list[str]]]):
        # One sequence of shingles; those that cross from text to text only add to a window.
        tokens = [x for _, w in rows for x in w]
        h = _hashes(tokens)
        if not self.keys or not len(h):
            return
        first = np.cumsum([0] + [len(w) for _, w in rows])
        top = max(self.bands)
        found = []
        for band in range(len(self.mult)):
            low = self.permuted(h, band)
            low = np.concatenate([low, np.full(-len(low) % top + 2 * top, np.uint64(2**64 - 1))])
            stride = 1
            while stride < top:
                low, stride = np.minimum(low[0::2], low[1::2]), stride * 2
                if band < self.bands.get(stride, 0):
                    window = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:])
                    keys, names = self.keys[stride, band]
                    at = np.searchsorted(keys, window)
                    hit = np.nonzero(keys[np.minimum(at, len(keys) - 1)] == window)[0]
                    for j, a in zip(hit.tolist(), at[hit].tolist(), strict=True):
                        while a < len(keys) and keys[a] == window[j]:
                            found.append((j * stride, stride, int(names[a])))
                            a += 1
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        for start, stride, name in sorted(set(found)):
            wanted = self.sets[name]
            a = max(0, int(np.searchsorted(first, start, "right")) - 1)
            while a < len(rows) and first[a] < start + 3 * stride + SHINGLE - 1:
                own = rows[a][1]
                lo, hi = max(0, start - int(first[a])), max(0, start + 3 * stride - int(first[a]))
                places = [k for k in range(lo, min(hi, len(own) - SHINGLE + 1)) if tuple(own[k:k + SHINGLE]) in wanted]
                share = len({tuple(own[k:k + SHINGLE]) for k in places}) / len(wanted)
                key = (rows[a][0], self.names[name])
                if share >= self.contained and share > best.get(key, (0.0,))[0]:
                    best[key] = (share, places[0], places[-1] + SHINGLE)
                a += 1
        for (row, name), (share, a, b) in best.items():
            yield row, name, share, a, b


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED,
                  chance: float = CHANCE) -> DataFrame:
    """(id, license, contained, first_word, end_word): each row and each license whose notice it holds.

    A notice is held where one window has `contained` of the five-word shingles of one of the
    license's templates; words are runs of letters, digits and underscores in lower case. The
    best window's share and words are returned. A window that holds as much is looked at with
    probability `chance` at least. Templates under five words are never found. Rows are
    independent: no shuffle. Null and empty texts hold nothing, repeated rows stay, null ids
    stay null, other columns are not read, an empty table gives no rows. Templates are a
    parameter of the driver's, sent to each task.
    """

    def run(batches):
        index = Templates(templates, contained, chance)
        for batch in batches:
            rows = list(index.scan(batch.column(1).to_pylist()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                ["id", "license", "contained", "first_word", "end_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, license string, contained double, first_word int, end_word int")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and license that it holds."""
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
