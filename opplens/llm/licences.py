"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

Families are learned from short notices (`NOTICES`), each with deterministic variations (words dropped, neighbours around it). The
unknown class is learned from wordings of other licences (`OTHERS`) and from lines of a bounded sample of the corpus: of the
`background` distinct texts with the least MD5, the first `lines` lines, of each `line_chars` characters at most; lines that speak
of licences are left out, as nothing says what they are. The model is a multinomial logistic regression over hashed word 1- and
2-grams. Its unknown class is calibrated on held-out variations: a temperature that gives the best likelihood. A predicted
family stands only if a template of it is confirmed: enough of the template's n-grams occur in the paragraph.

What is classified are all lines of every whole text, and all stretches of consecutive lines of up to SPAN_WORDS words without a
blank line in between that begin at a line with HINTS n-grams of two template words: a notice may be wrapped. Punctuation and
comment marks are no words. Of overlapping stretches that stand the one with the greatest overlap is reported, of ties the first and
shortest. Null and empty texts have no lines and no licence; equal texts get equal results; repeated rows all stay; an empty
table gives no rows, and a model that is trained on one knows the notices alone. The column licences replaces one of that
name; all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, window_hashes, word_hashes, word_spans

#: Common wordings of licence notices by family.
NOTICES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This file is licensed to you under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl-2": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "gpl-3": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    "mit": ("Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved. No part of this work may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Wordings of licences outside the families, for the unknown class.
OTHERS = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",
    "Licensed under the GNU Lesser General Public License, version 3.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "SPDX-License-Identifier: LGPL-2.1-only",
    "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SPDX-License-Identifier: ISC",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "This software is provided as is, without any express or implied warranty.",
    "This is free and unencumbered software released into the public domain.",
    "Licensed under the Boost Software License, Version 1.0.",
    "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "The licence of the driver was renewed by the public office in the city.",
)
UNKNOWN = "unknown"
#: Words in a stretch of lines, and n-grams of two template words at which one begins.
SPAN_WORDS, HINTS = 96, 2


@dataclass
class Model:
    families: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[frozenset[int]]]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every word 1- and 2-gram."""
    buf, starts, ends, _, first = word_spans(texts)
    words = word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    two = window_hashes(words, 2)
    same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    return np.concatenate([doc, doc[:-1][same] if len(doc) else doc]), np.concatenate([words, two[same]])


def _matrix(texts: list[bytes], grams: np.ndarray) -> np.ndarray:
    doc, g = _grams(texts)
    at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
    hit = grams[at] == g
    x = np.zeros((len(texts), len(grams)))
    x[doc[hit], at[hit]] = 1
    return x


def _variations(neighbours: list[str], seed: int) -> list[tuple[str, str]]:
    rng = np.random.default_rng(seed)
    out = []
    for family, notices in NOTICES.items():
        for notice in notices:
            for i in range(12):
                words = notice.split(" ")
                if i % 3 and len(words) > 6:
                    del words[rng.integers(len(words))]
                around = neighbours[rng.integers(len(neighbours))].split(" ")[: int(rng.integers(0, 12))] if neighbours and i % 4 == 3 else []
                out.append((family, " ".join([*around, *words])))
    return out


def train(docs: DataFrame, text_col: str = "text", background: int = 500, lines: int = 40, line_chars: int = 400, rounds: int = 400, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """Fits the classifier on the driver: the notices, and the lines of at most `background` texts (see above)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # only digests are sorted; the lines of the few chosen texts are read after that
    digest = F.unhex(F.md5(text.cast("binary")))
    least = [bytes(r["h"]) for r in docs.select(digest.alias("h")).distinct().orderBy("h").limit(background).collect()]
    chosen = docs.select(digest.alias("h"), text.alias("t")).where(F.col("h").isin(least)).dropDuplicates(["h"]).select("h", F.transform(F.slice(F.split("t", "\n"), 1, lines), lambda p: F.substring(p, 1, line_chars)).alias("p"))
    sample = sorted(chosen.collect(), key=lambda r: bytes(r["h"])) if least else []
    plain = [p for r in sample for p in r["p"] if p.strip() and "licen" not in p.lower()]
    families = [*sorted(NOTICES), UNKNOWN]
    known, held = _variations(plain, 1), _variations(plain, 2)
    rows = known + [(UNKNOWN, p) for p in [*OTHERS, *plain[::2]]]
    tests = held + [(UNKNOWN, p) for p in [*OTHERS, *plain[1::2]]]
    notices = [n.encode() for all_ in [*NOTICES.values(), OTHERS] for n in all_]
    grams = np.unique(_grams(notices)[1])
    x, y = _matrix([t.encode() for _, t in rows], grams), np.array([families.index(f) for f, _ in rows])
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    weight = 1 / np.bincount(y, minlength=len(families)).clip(1)[y]
    weight /= weight.sum()
    one = np.eye(len(families))[y]
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - one) * weight[:, None]
        w -= rate * 20 * (x.T @ g + penalty * w)
        b -= rate * 20 * g.sum(0)
    logits = _matrix([t.encode() for _, t in tests], grams) @ w + b
    truth = np.array([families.index(f) for f, _ in tests])
    temperatures = np.geomspace(0.25, 4, 33)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth].clip(1e-12)).mean() for t in temperatures]
    templates = {f: [frozenset(_grams([n.encode()])[1].tolist()) for n in notices_] for f, notices_ in NOTICES.items()}
    return Model(families, grams, w, b, float(temperatures[int(np.argmin(loss))]), templates)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


FOUND = T.StructType([T.StructField("family", T.StringType()), T.StructField("paragraph", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("probability", T.DoubleType()), T.StructField("overlap", T.DoubleType())])


def _stretches(texts: list[list[bytes]], hints: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first line, end) of all lines with an n-gram of two template words, and of the stretches that begin at a line with HINTS of
    them or more. Line numbers run through all texts."""
    out, base = [], 0
    for t, lines in enumerate(texts):
        for i in np.flatnonzero(hints[base : base + len(lines)]).tolist():
            out.append((t, base + i, base + i + 1))
            total, j = int(sizes[base + i]), i + 1
            while hints[base + i] >= HINTS and j < len(lines) and sizes[base + j] and total + sizes[base + j] <= SPAN_WORDS:
                total += int(sizes[base + j])
                j += 1
                out.append((t, base + i, base + j))
        base += len(lines)
    return out


def _classify(texts: list[bytes], model: Model, least: float, confirm: float) -> list[list[dict]]:
    lines = [t.split(b"\n") for t in texts]
    flat = [p for ps in lines for p in ps]
    start = np.cumsum([0, *map(len, lines)])
    buf, starts, ends, _, first = word_spans(flat)
    words = word_hashes(buf, starts, ends)
    two = window_hashes(words, 2)
    line = np.repeat(np.arange(len(flat)), np.diff(first))
    index = lambda g: np.where(model.grams[np.minimum(np.searchsorted(model.grams, g), len(model.grams) - 1)] == g, np.searchsorted(model.grams, g), -1)
    one, pair = index(words), index(two)
    inside = np.flatnonzero((pair >= 0) & (line[1:] == line[:-1])) if len(two) else np.zeros(0, np.int64)
    hints = np.bincount(line[inside], minlength=len(flat))
    out: list[list[dict]] = [[] for _ in texts]
    standing: dict[int, list[tuple[float, int, int, str, float]]] = {}
    for t, lo, hi in _stretches(lines, hints, np.diff(first)):
        a, b = int(first[lo]), int(first[hi])
        own = np.unique(np.concatenate([one[a:b], pair[a : b - 1]]))  # each n-gram counts once in a stretch; words that no template has do not
        own = own[own >= 0]
        p = _softmax((model.weights[own].sum(0) + model.bias)[None, :] / model.temperature)[0]
        best = int(p.argmax())
        if model.families[best] == UNKNOWN or p[best] < least:
            continue
        have = set(model.grams[own].tolist())
        overlap = max(len(x & have) / len(x) for x in model.templates[model.families[best]])
        if overlap >= confirm:
            standing.setdefault(t, []).append((-overlap, hi - lo, lo, model.families[best], float(p[best])))
    for t, found in standing.items():
        used: set[int] = set()
        for overlap, size, lo, family, p in sorted(found):
            if used.isdisjoint(range(lo, lo + size)):
                used.update(range(lo, lo + size))
                out[t].append({"family": family, "paragraph": int(lo - start[t]), "lines": size, "probability": round(p, 6), "overlap": round(-overlap, 6)})
        out[t].sort(key=lambda x: x["paragraph"])
    return out


def scan(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7, confirm: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs with licences: family, first line, number of lines, probability and template overlap of each confirmed licence paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("paragraph", pa.int64()), ("lines", pa.int64()), ("probability", pa.float64()), ("overlap", pa.float64())]))

    def work(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(_classify(texts, shared.value, least, confirm), kind)]

    return map_text(docs, text_col, T.StructType([T.StructField("licences", T.ArrayType(FOUND))]), work, keep)
