"""Licence scans: a trained paragraph classifier with template confirmation.

Each line of a text is a paragraph; in long ones, overlapping windows of words are, and a notice that
runs over line ends is judged whole, where template word pairs go on over the end of a line. Its word 1- to 3-grams that occur in the licence templates are
the features of a multinomial logistic regression over licence families and ``none``. The model is
trained on statements built from the templates below (every family's names in every frame, and
paragraphs of the licences' own texts) against a bounded sample of paragraphs from the corpus.
Probabilities are calibrated by a temperature on paragraphs, frames and licence names kept out of
training; a paragraph that is surely some licence, but no family surely enough, is ``unknown``. A
prediction is confirmed where the paragraph holds most of the word n-grams of one of the family's
templates, or most of its own are in one of the family's texts. A window that names several families
gives a row for each: without the words of those found, the rest is judged again and must be confirmed.

A statement holds a word pair of the templates or is one word of them; a line that has neither is
not judged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import map_batches

NONE, UNKNOWN = "none", "unknown"
#: Paragraphs of the corpus that training uses at most, and bytes of each.
SAMPLE, SAMPLE_BYTES = 4000, 400
#: A paragraph is a licence statement from this probability on; a family must reach its own.
LICENSE_AT, FAMILY_AT, CONFIRM_AT = 0.8, 0.6, 0.6
GRAMS = 3

#: Names of each family; the first template that a paragraph holds confirms it.
FAMILIES = {
    "MIT": ["MIT License", "the MIT License", "MIT licence terms", "Expat License"],
    "Apache": ["Apache License, Version 2.0", "the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL": ["GNU General Public License, version 3", "the GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0-or-later", "the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["GNU Lesser General Public License, version 3", "the GNU Lesser General Public License", "LGPL-2.1", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License, version 3", "the GNU Affero General Public License", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "the Modified BSD License"],
    "MPL": ["Mozilla Public License, version 2.0", "the Mozilla Public License", "MPL-2.0"],
    "ISC": ["ISC License", "the ISC License"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "proprietary": ["All rights reserved", "All rights reserved. Unauthorized copying of this file is strictly prohibited", "proprietary and confidential, all rights reserved"],
}
#: Paragraphs of the licences' own texts and of the notices that they ask for.
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0": ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "CC-BY": ["You are free to share and adapt the material for any purpose, even commercially, under the Creative Commons Attribution licence, as long as you give appropriate credit."],
}
FRAMES = [
    "{}", "Licensed under {}.", "Released under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.",
    "Distributed under the terms of the {}.", "This file is part of the project and available under {}.", "This software is licensed under the {}. See LICENSE for details.", "SPDX-License-Identifier: {}",
    "Code is provided under the {}, text is not.", "Copyright 2020 the authors. Licensed under {}.", "you may not use this file except in compliance with the {}", "Copyright (c) 2019 the authors. {}.",
]
#: Licences of no family above: they teach the calibration what ``unknown`` looks like.
OTHERS = ["Zlib License", "Boost Software License 1.0", "Eclipse Public License 2.0", "Artistic License 2.0", "Open Font License 1.1", "European Union Public Licence", "Academic Free License 3.0", "Unicode License", "PostgreSQL License", "Vim License", "Beerware License", "Open Data Commons License"]
#: Sentences that mention licences without being statements.
MENTIONS = ["He lost his driving license in the city.", "The council issued a license to sell food.", "Read the license before you install the software.", "The public library is open to all.", "General terms apply to every version.", "She works at the mit lab in general.", "A common creative work of the commons.", "All rights and wrongs were reserved for later.", "The file is under the table.", "Copyright law changed in 1976."]

_WORDS = re.compile(r"\w+").findall
_NUMBER = re.compile(r"\d")


def words(text: str) -> list[str]:
    """Lower-cased words; a digit stands for any digit, so that versions don't matter."""
    text = text.lower()
    return _WORDS(_NUMBER.sub("0", text) if _NUMBER.search(text) else text)


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    return {tuple(tokens[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(tokens) - n + 1)}


@dataclass
class Model:
    classes: list[str]
    features: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def __post_init__(self):
        self.number = {w: k for k, w in enumerate(sorted({w for g in self.features for w in g}), 1)}
        self.templates = {f: [set(zip(*(words(name)[k:] for k in range(n)))) for name in names for n in [min(2, len(words(name)))]] for f, names in FAMILIES.items()}
        self.notices = {f: [set(zip(words(x), words(x)[1:])) for x in texts] for f, texts in NOTICES.items()}
        self.own = {f: {g for t in (*self.templates[f], *self.notices.get(f, [])) for g in t} for f in FAMILIES}

    def scores(self, tokens: list[str]) -> np.ndarray:
        found = [self.features[g] for g in grams(tokens) if g in self.features]
        return self.bias + self.weights[found].sum(0) / max(1.0, len(found)) ** 0.5

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        s = self.scores(tokens) / self.temperature
        p = np.exp(s - s.max())
        return p / p.sum()

    def similarity(self, family: str, tokens: list[str]) -> float:
        """Largest share of a name's word n-grams that the paragraph holds, or of its own that one of the family's texts holds."""
        own = {n: set(zip(*(tokens[k:] for k in range(n)))) for n in (1, 2)}
        named = max((len(t & own[len(next(iter(t)))]) / len(t) for t in self.templates.get(family, []) if t), default=0.0)
        pairs = own[2]
        return max([named, *(len(t & pairs) / min(len(t), len(pairs)) for t in self.notices.get(family, []) if len(pairs) >= 8)])

    def judge(self, paragraph: str) -> tuple[str, float, float, bool] | None:
        """(family, probability, similarity, confirmed) of a licence statement; None otherwise."""
        return self.judge_words(words(paragraph))

    def judge_words(self, tokens: list[str]) -> tuple[str, float, float, bool] | None:
        p = self.probabilities(tokens)
        none = self.classes.index(NONE)
        if 1 - p[none] < LICENSE_AT:
            return None
        best = int(np.argmax(np.where(np.arange(len(p)) == none, -1, p)))
        family, sure = self.classes[best], float(p[best])
        if sure < FAMILY_AT or family == UNKNOWN:
            return UNKNOWN, float(1 - p[none]), 0.0, False
        alike = self.similarity(family, tokens)
        return family, sure, alike, alike >= CONFIRM_AT

    def _spans(self, family: str, tokens: list[str]) -> list[tuple[int, int, float]]:
        """(first, end, similarity) of the runs of words whose pairs, or single words, are in the family's names and texts, where they confirm it."""
        grams, out, start = self.own[family], [], 0
        for k in range(1, len(tokens) + 1):
            if k == len(tokens) or (tokens[k - 1], tokens[k]) not in grams:
                run = tokens[start:k]
                if (len(run) > 1 or tuple(run) in grams) and (alike := self.similarity(family, run)) >= CONFIRM_AT:
                    out.append((start, k, alike))
                start = k
        return out

    def _without(self, families: set[str], tokens: list[str]) -> list[str]:
        """The words with the runs blanked that confirm ``families``, but for those in which another family is confirmed better."""
        others = [x for f in FAMILIES if f not in families for x in self._spans(f, tokens)] if families else []
        out = list(tokens)
        for first, end, alike in (x for f in families for x in self._spans(f, tokens)):
            if not any(a < end and first < b and better > alike for a, b, better in others):
                out[first:end] = [""] * (end - first)
        return out

    def judge_all(self, tokens: list[str]) -> list[tuple[str, float, float, bool]]:
        """Verdicts on all families that a window states, the first found first; ``unknown`` only where no family is.

        Without the words of the families found, what is left is judged again, as long as a further family is confirmed.
        """
        first = self.judge_words(tokens)
        if first is None:
            return []
        found = {} if first[0] == UNKNOWN else {first[0]: first}
        while (x := self._further(self._without(set(found), tokens))) is not None and x[0] not in found:
            found[x[0]] = x
        return list(found.values()) or [first]

    def _further(self, tokens: list[str]) -> tuple[str, float, float, bool] | None:
        """A confirmed verdict on what is left of a window.

        Two families may share the probability, so that neither is sure: then it is judged without the likelier one's words.
        """
        x = self.judge_words(tokens) if self._pairs(tokens) else None
        if x and x[0] == UNKNOWN:
            p = self.probabilities(tokens)
            tokens = self._without({max(FAMILIES, key=lambda f: p[self.classes.index(f)])}, tokens)
            x = self.judge_words(tokens) if self._pairs(tokens) else None
        return x if x and x[3] else None

    def statements(self, text: str | None) -> list[tuple[int, int, str, float, float, bool]]:
        """(paragraph, word, family, probability, similarity, confirmed) of every statement in the whole text."""
        if not text:
            return []
        lines = [words(line) for line in text.split("\n")]
        found = {k: rows for k, tokens in enumerate(lines) if (rows := self._runs(tokens))}
        out = []
        for first, last, start, end in self._seams(lines):
            own = [x for k in range(first, last + 1) for x in found.get(k, [])]
            whole = self.judge_all([w for k in range(first, last + 1) for w in lines[k][start if k == first else 0 : end if k == last else None]])
            if whole and (not own or whole[0][2] > max(x[3] for x in own)):
                # The lines keep what they hold beside the notice that runs over their ends.
                out += [(first, start, *x) for x in whole]
                for k in range(first, last + 1):
                    rest = self._runs(lines[k][:start]) if k == first else []
                    if k == last:
                        rest = rest + [(end + w, *x) for w, *x in self._runs(lines[k][end:])]
                    found[k] = rest
        return sorted(out + [(k, *x) for k, rows in found.items() for x in rows])

    def _seams(self, lines: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(first line, last line, first word, end word) of template word pairs in a row, at most 40 words, that run over line ends.

        A blank line parts notices.
        """
        out = []
        k = 0
        while k + 1 < len(lines):
            if not (lines[k] and lines[k + 1] and (lines[k][-1], lines[k + 1][0]) in self.features):
                k += 1
                continue
            start = len(lines[k]) - 1
            while start and len(lines[k]) - start < 20 and (lines[k][start - 1], lines[k][start]) in self.features:
                start -= 1
            size, last, end = len(lines[k]) - start + 1, k + 1, 1
            while size < 40:
                if end < len(lines[last]):
                    if (lines[last][end - 1], lines[last][end]) not in self.features:
                        break
                    end += 1
                elif last + 1 < len(lines) and lines[last + 1] and (lines[last][-1], lines[last + 1][0]) in self.features:
                    last, end = last + 1, 1
                else:
                    break
                size += 1
            out.append((k, last, start, end))
            k = last
        return out

    def _pairs(self, tokens: list[str]) -> list[int]:
        """Places of the word pairs that the templates hold, too; of a single word, 0 if they hold it."""
        known = list(map(self.number.get, tokens, repeat(0)))
        if not any(known):
            return []
        if len(tokens) == 1:
            return [0]
        return [k for k, (a, b, x, y) in enumerate(zip(known, known[1:], tokens, tokens[1:])) if a and b and (x, y) in self.features]

    def _runs(self, tokens: list[str]) -> list[tuple[int, str, float, float, bool]]:
        """(word, family, ...) of the statements in a line: in long ones, of each run of overlapping windows of 40 words that state a family."""
        # A statement has a word pair of the templates; most lines end here.
        if not (pairs := self._pairs(tokens)):
            return []
        if len(tokens) <= 40:
            return [(0, *x) for x in self.judge_all(tokens)]
        runs: list[list] = []  # first word, end, verdicts
        latest: dict[str, list] = {}
        for k in range(0, len(tokens) - 20, 20):
            for x in self.judge_all(tokens[k : k + 40]):
                run = latest.get(x[0])
                if run and run[1] == k + 20:
                    run[1] = k + 40
                    run[2].append(x)
                else:
                    runs.append(run := [k, k + 40, [x]])
                latest[x[0]] = run
        known = [(k, end) for k, end, x in runs if x[0][0] != UNKNOWN]
        out = []
        for k, end, x in runs:
            # An unknown window that only holds the edge of a known statement's words tells nothing more.
            if x[0][0] == UNKNOWN and all(any(a <= p < b for a, b in known) for p in pairs if k <= p < end - 1):
                continue
            out.append((k, *max(x, key=lambda v: (v[3], v[1]))))
        return out


def _fit(rows: list[set[int]], target: np.ndarray, classes: int, features: int, epochs: int = 60, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on sparse rows by full-batch descent with momentum."""
    sizes = np.array([len(r) for r in rows])
    column = np.fromiter((f for r in rows for f in sorted(r)), np.int64, sizes.sum())
    row = np.repeat(np.arange(len(rows)), sizes)
    value = 1 / np.sqrt(np.maximum(sizes, 1))[row]
    weights, bias = np.zeros((features, classes)), np.zeros(classes)
    pace_w, pace_b = np.zeros_like(weights), np.zeros_like(bias)
    balance = (len(target) / (classes * np.maximum(1, np.bincount(target, minlength=classes))))[target] ** 0.5
    truth = np.eye(classes)[target]
    for _ in range(epochs):
        s = np.tile(bias, (len(rows), 1))
        np.add.at(s, row, weights[column] * value[:, None])
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - truth) * balance[:, None] / len(rows) * classes
        g = np.zeros_like(weights)
        np.add.at(g, column, d[row] * value[:, None])
        pace_w = 0.9 * pace_w + g + decay * weights
        pace_b = 0.9 * pace_b + d.sum(0)
        weights -= rate * pace_w
        bias -= rate * pace_b
    return weights, bias


def examples(background: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    """Paragraphs, their classes, and which are kept for calibration.

    Kept are every fifth frame with all names, every fourth name of the other licences in all frames,
    and a fifth of the background; so calibration sees no frame, no unknown licence and no paragraph
    that training sees.
    """
    rows = [(frame.format(name), family, k % 5 == 4) for family, names in FAMILIES.items() for name in names for k, frame in enumerate(FRAMES)]
    rows += [(frame.format(name), UNKNOWN, j % 4 == 3) for j, name in enumerate(OTHERS) for frame in FRAMES]
    # A licence's own text, and the two windows of 40 words at its ends.
    for family, texts in NOTICES.items():
        for text in texts:
            own = text.split()
            rows += [(x, family, False) for x in {text, " ".join(own[:40]), " ".join(own[-40:])} for _ in range(4)]
    plain = [x for x in background if not re.search(r"licen[sc]e|copyright|rights reserved", x, re.I)]
    rows += [(x, NONE, False) for x in MENTIONS * 3] + [(x, NONE, k % 5 == 4) for k, x in enumerate(plain)]
    return [x for x, _, _ in rows], [c for _, c, _ in rows], np.array([h for _, _, h in rows])


def train(background: list[str]) -> Model:
    """Fits the model on the templates and ``background`` paragraphs; see ``examples`` for what calibrates it."""
    paragraphs, named, held = examples(background)
    tokens = [words(x) for x in paragraphs]
    classes = [*FAMILIES, UNKNOWN, NONE]
    vocabulary = sorted({g for t, c in zip(tokens, named) if c != NONE for g in grams(t)})
    features = {g: k for k, g in enumerate(vocabulary)}
    rows = [{features[g] for g in grams(t) if g in features} for t in tokens]
    target = np.array([classes.index(c) for c in named])
    weights, bias = _fit([r for r, h in zip(rows, held) if not h], target[~held], len(classes), len(features))
    model = Model(classes, features, weights, bias, 1.0)
    out = np.array([model.scores(t) for t, h in zip(tokens, held) if h])
    best = None
    for temperature in np.geomspace(0.2, 5, 40):
        s = out / temperature
        s = s - s.max(1, keepdims=True)
        loss = -(s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(len(s)), target[held]].mean()
        if best is None or loss < best[0]:
            best = loss, float(temperature)
    model.temperature = best[1]
    return model


def calibration_error(model: Model, paragraphs: list[str], classes: list[str], bins: int = 10) -> float:
    """Mean gap between how sure the model is of its best class and how often that is right, over bins of sureness."""
    p = np.array([model.probabilities(words(x)) for x in paragraphs])
    sure, right = p.max(1), np.array([model.classes[k] == c for k, c in zip(p.argmax(1), classes)])
    place = np.minimum((sure * bins).astype(int), bins - 1)
    return float(sum(abs(sure[place == k].mean() - right[place == k].mean()) * (place == k).mean() for k in set(place.tolist())))


def background(docs: DataFrame, limit: int = SAMPLE, size: int = SAMPLE_BYTES) -> list[str]:
    """At most ``limit`` paragraphs of the corpus, one of each sampled text, picked by hash.

    Texts are picked at a rate set by their count, so that tasks send the driver few rows in all.
    """
    count = docs.count()
    if not count:
        return []
    spot = F.xxhash64("doc_id", F.length("text"))
    rows = docs.where("text is not null").where(F.pmod(spot, F.lit(1 << 30)) < int(min(1.0, 1.5 * limit / count) * (1 << 30)))
    rows = rows.select(spot.alias("pick"), F.split("text", "\n").alias("p"))
    rows = rows.select("pick", F.substring(F.element_at("p", (F.pmod("pick", F.size("p")) + 1).cast("int")), 1, size).alias("text"))
    return [r["text"] for r in rows.orderBy("pick", "text").limit(limit).collect()]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (from 0), word (from 0), family, probability, similarity, confirmed: a row per licence statement.

    ``word`` is where in the paragraph the statement's window begins: 0 in lines of up to 40 words.
    Null and empty texts have none. Repeated rows are each reported. Other columns are ignored.
    """
    model = model or train(background(docs))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "paragraph", "word", "family", "probability", "similarity", "confirmed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def make():
        own = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(key, *x) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in own.statements(text)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, "doc_id long, paragraph long, word long, family string, probability double, similarity double, confirmed boolean")
