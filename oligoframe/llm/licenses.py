"""License scans by a trained paragraph classifier.

A text is cut into units: its lines, and of long lines stretches of UNIT words. Paragraphs are windows of one to MOST_UNITS
units that follow one another without a blank line between, so that wrapped notices, and those amid a long line, are seen
whole. Every paragraph becomes hashed counts of its word unigrams and bigrams. A multinomial logistic regression
over the licence families and an unknown class is fitted on the driver to notices of each family, varied by a fixed random
generator (words dropped, foreign words before and behind, wrappings), and to a bounded sample of ordinary paragraphs. Its
temperature and the threshold of the unknown class are calibrated on variants kept aside. A prediction is confirmed by the
share of a template's word bigrams that the paragraph holds. Of windows that overlap, the one with the largest share stays, the
shorter one of equals; of unconfirmed predictions single units are reported only, as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import WORDY, Words, code_points, groups, mix, view
from .rows import column, extend
from .scratch import table

SLOTS, CONFIRMED = 1 << 16, 0.6
#: Words of a unit of a long line, and units and words of a window.
UNIT, MOST_UNITS, MOST_WORDS = 40, 6, 160
#: Customary notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the LGPL version 2.1 or later.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the 3-clause BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Ordinary sentences with words of licences.
PLAIN = [
    "He showed his driving license to the officer and drove on.",
    "The general public was not admitted to the version of the play.",
    "You may use this path in summer, but not the bridge.",
    "The author retained all copies of the letter and released a statement.",
    "Creative people in common rooms share attribution for good ideas.",
    "The software version was released in spring and sold without warranty.",
    "Permission to enter was granted free of charge to any person.",
    "Apache helicopters landed; the terms of peace were agreed in writing.",
    "Conditions were met and the list of members was published.",
    "International law applies to the source of the river.",
]
FAMILIES = ["unknown", *TEMPLATES]
COLUMNS = T.StructType(
    [
        T.StructField("n_paragraphs", T.LongType()),
        T.StructField(
            "licenses",
            T.ArrayType(T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("start", T.LongType()), T.StructField("family", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("template", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])),
        ),
    ]
)


def units_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the units of all rows, the place of each row's first unit, and of each unit whether a line begins there."""
    breaks = np.flatnonzero(data == 10) + 1
    lines = np.unique(np.concatenate((off, breaks[breaks < len(data)] if len(data) else breaks)))
    w = Words(data, lines, WORDY)
    inside = np.arange(len(w)) - np.repeat(w.rows[:-1], np.diff(w.rows))
    bounds = np.union1d(lines, w.start[(inside > 0) & (inside % UNIT == 0)])
    return bounds, np.searchsorted(bounds, off), np.isin(bounds[:-1], lines)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words, and of each word with the one before in its paragraph (-1: none)."""
    h = w.hashes()
    one = (mix(h) >> np.uint64(48)).astype(np.int32)
    two = np.full(len(h), -1, np.int32)
    if len(h) > 1:
        row = w.row_of()
        same = row[1:] == row[:-1]
        two[1:][same] = (mix(h[1:] + mix(h[:-1] + np.uint64(77)))[same] >> np.uint64(48)).astype(np.int32)
    return one, two


class Model:
    """weights: SLOTS + 1 rows (the last stays 0) for the families; floor: least probability for a family to be named."""

    def __init__(self):
        self.weights = np.zeros((SLOTS + 1, len(FAMILIES)), np.float32)
        self.bias = np.zeros(len(FAMILIES))
        self.temperature, self.floor = 1.0, 0.5
        self.templates = {f: [template_shingles(t) for t in ts] for f, ts in TEMPLATES.items()}

    def sums(self, w: Words, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Summed weights of the words of each row."""
        out = np.zeros((len(w.rows) - 1, len(FAMILIES)))
        some = np.flatnonzero(np.diff(w.rows))
        if len(some):
            out[some] = np.add.reduceat(self.weights[one] + self.weights[two], w.rows[some], 0)
        return out

    def _sum(self, w: Words, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.sums(w, one, two) / np.sqrt(np.maximum(1, np.diff(w.rows)))[:, None] + self.bias

    def fit(self, plain: list[str], variants: int = 15, rounds: int = 80, seed: int = 7) -> Model:
        """plain: ordinary paragraphs; those that hold a template are left out."""
        rng = np.random.default_rng(seed)
        plain = [p for p in plain if not any(share(t, template_shingles(p)) >= 0.4 for ts in self.templates.values() for t in ts)] + PLAIN * 3
        words = " ".join(plain).split() or ["the"]
        texts, labels = list(plain), [0] * len(plain)
        for i, family in enumerate(FAMILIES[1:], 1):
            for notice in TEMPLATES[family]:
                for _ in range(variants):
                    own = [x for x in notice.split() if rng.random() > 0.08] or notice.split()
                    around = [list(rng.choice(words, rng.integers(0, 12))) if rng.random() < 0.4 else [] for _ in range(2)]
                    texts.append(" ".join([*around[0], *own, *around[1]]))
                    labels.append(i)
        y, aside = np.array(labels), rng.random(len(labels)) < 0.2
        data, off = view(pa.array(texts))
        w = Words(data, off, WORDY)
        one, two = features(w)
        row, scale = w.row_of(), 1 / np.sqrt(np.maximum(1, np.diff(w.rows)))
        slots, place = np.unique(np.concatenate((one, two[two >= 0])), return_inverse=True)
        x_row = np.concatenate((row, row[two >= 0]))
        keep = ~aside[x_row]
        weights, seen = np.zeros((len(slots), len(FAMILIES))), np.full((len(slots), len(FAMILIES)), 1e-4)
        target = np.eye(len(FAMILIES))[y]
        order = np.argsort(place[keep], kind="stable")
        rows_of, starts = x_row[keep][order], np.searchsorted(place[keep][order], np.arange(len(slots)))
        counts = np.diff(np.concatenate((starts, [len(order)])))
        by_row = np.argsort(x_row, kind="stable")
        row_starts = np.searchsorted(x_row[by_row], np.arange(len(texts)))
        full = np.diff(np.concatenate((row_starts, [len(by_row)]))) > 0
        for _ in range(rounds):
            z = np.zeros((len(texts), len(FAMILIES)))
            z[full] = np.add.reduceat(weights[place[by_row]], row_starts[full], 0)
            z = z * scale[:, None] + self.bias
            g = (target - softmax(z)) * (scale * ~aside)[:, None]
            self.bias = self.bias + 0.01 * (target - softmax(z))[~aside].mean(0)
            grad = np.zeros_like(weights)
            grad[counts > 0] = np.add.reduceat(g[rows_of], starts[counts > 0], 0)
            grad -= 0.01 * weights
            seen += grad * grad
            weights += 0.5 * grad / np.sqrt(seen)
        self.weights[slots] = weights
        z = self._sum(w, one, two)[aside]
        truth = y[aside]
        ts = np.linspace(0.3, 3.0, 28)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in ts]
        self.temperature = float(ts[int(np.argmin(loss))])
        p = softmax(z / self.temperature)
        known = p[:, 1:].max(1)
        cuts = np.linspace(0.3, 0.95, 27)
        right = [((known >= c) & (p[:, 1:].argmax(1) + 1 == truth)).sum() + ((known < c) & (truth == 0)).sum() for c in cuts]
        self.floor = float(cuts[int(np.argmax(right))])
        return self

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Lines of each row, and the licences found in it."""
        bounds, rows, begins = units_of(data, off)
        found: list[list[dict]] = [[] for _ in range(len(off) - 1)]
        w = Words(data, bounds, WORDY)
        sizes, sums = np.diff(w.rows), self.sums(w, *features(w))
        lines = np.concatenate(([0], np.cumsum(begins)))
        # A window doesn't leave its row, nor go over a unit without words.
        row = np.searchsorted(rows, np.arange(len(sizes)), "right") - 1
        named = []
        total, words, ok = np.zeros_like(sums), np.zeros_like(sizes), np.ones(len(sizes), bool)
        for k in range(MOST_UNITS):
            at = np.arange(len(sizes) - k)
            if not len(at):
                break
            total, words = total[: len(at)] + sums[at + k], words[: len(at)] + sizes[at + k]
            ok = ok[: len(at)] & (sizes[at + k] > 0) & (row[at] == row[at + k]) & ((words <= MOST_WORDS) | (k == 0))
            p = softmax((total / np.sqrt(np.maximum(1, words))[:, None] + self.bias) / self.temperature)
            best = p[:, 1:].argmax(1) + 1
            for i in np.flatnonzero(ok & (p[at, best] >= self.floor)).tolist():
                family = FAMILIES[best[i]]
                own = template_shingles(data[bounds[i] : bounds[i + k + 1]].tobytes().decode("utf-8", "replace"))
                part = max(share(t, own) for t in self.templates[family])
                if part >= CONFIRMED or k == 0:
                    named.append((part < CONFIRMED, -part, k, i, family, float(p[i, best[i]])))
        taken = np.zeros(len(sizes), bool)
        chars = code_points(data) if named else None
        for unsure, part, k, i, family, p_ in sorted(named):
            if not taken[i : i + k + 1].any():
                taken[i : i + k + 1] = True
                r = int(row[i])
                found[r].append({"paragraph": int(lines[i + 1] - lines[rows[r] + 1]), "start": int(chars[bounds[i]] - chars[off[r]]), "family": family, "p": p_, "template": -part, "confirmed": not unsure})
        for x in found:
            x.sort(key=lambda y: y["start"])
        return lines[rows[1:]] - lines[rows[:-1]], found


def template_shingles(text: str) -> set[int]:
    w = Words(*view(pa.array([text])), WORDY)
    h = w.hashes()
    return set((mix(h[1:] + mix(h[:-1] + np.uint64(77)))).tolist()) if len(h) > 1 else set(h.tolist())


def share(template: set[int], own: set[int]) -> float:
    return len(template & own) / len(template) if template else 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return z / z.sum(1, keepdims=True)


def fit(docs: DataFrame, fit_docs: int = 200, fit_lines: int = 2000) -> Model:
    """Ordinary paragraphs come from at most fit_docs documents of at most 8 kB, in order of a hash of their ids, and at most fit_lines lines."""
    short = docs.filter("doc_id is not null and octet_length(text) < 8192")
    ids = [r[0] for r in short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).collect()]
    rows = sorted((r[0], r[1]) for r in short.filter(F.col("doc_id").isin(ids)).select("doc_id", "text").collect())
    return Model().fit([line for r in rows for line in r[1].split("\n") if line.strip()][:fit_lines])


def scan(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_paragraphs and licenses (paragraph number, start in code points, family, probability, share of the template, confirmed).

    Null and empty texts have no paragraphs; texts and lines of any length are read whole. Repeated rows each give a row.
    Columns of docs named like a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def row(b: pa.RecordBatch) -> list:
            data, off = view(column(b, "text"))
            counts, found = [], []
            for a, z in groups(off, 1 << 20):
                n, x = m.scan(data[off[a] : off[z]], off[a : z + 1] - off[a])
                counts.append(n)
                found += x
            return [np.concatenate(counts) if counts else np.zeros(0, np.int64), found]

        return row

    return extend(docs, COLUMNS, make, drop)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs), drop=("text",))
    confirmed = F.filter("licenses", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_found"), F.size(confirmed).cast("long").alias("n_confirmed"), F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))), ",").alias("families"), "licenses")
