"""Licence scans: which paragraphs state a licence, of which family.

A paragraph is a line with a word. Its features are its words and word pairs, hashed; a
multinomial logistic regression gives family scores, as sums of weights at the features. It is
trained on wordings of the licence families (the paragraphs of short licence texts and of the
notices of long ones, whole and cut, alone and among foreign words) against a bounded sample of the
corpus's own paragraphs. Scores are calibrated by a temperature on wordings from elsewhere
(HELD_OUT), which no training sees. A paragraph that looks like a licence is confirmed by its word
triples' share in the nearest template of that family; unconfirmed or unsure ones are `unknown`.

All paragraphs of a batch are scored at once on arrays; only licence-like ones are compared.

Defined results: a null or empty text has no paragraphs and no licence; repeated rows are
scanned row by row; of tied families the first in FAMILIES counts; texts of any length are scanned
whole; extra columns are ignored; an empty table gives an empty result (the classifier is then
trained on templates alone).
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.llm.store import bound_batches
from braidmark.llm.words import U, bytes_and_offsets, hash_words, mix, pieces, rolling

# Families and common wordings of their notices.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "cc-by-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}
FAMILIES = tuple(TEMPLATES)
#: Notices of no listed family, for the unknown class.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without permission.",
    "Licensed under the terms of our site licence; see the agreement.",
    "This software is licensed to you under a commercial license agreement.",
    "Copyright reserved by the author; redistribution is not permitted.",
)
#: Wordings from elsewhere, for the temperature and the tests only.
HELD_OUT = {
    "mit": ("MIT licensed, see the file LICENSE for the full text.", "The code in this repository is available under the MIT license.", "Distributed under the MIT License, free of charge and without warranty of any kind."),
    "apache-2.0": ("The source is available under version 2.0 of the Apache License.", "Apache License 2.0, see http://www.apache.org/licenses/ for its text.", "You may not use these files except in compliance with the Apache License, Version 2.0."),
    "gpl-3.0": ("You can redistribute it under the GNU GPL, version 3 or later.", "Free software under the GNU General Public License v3.", "Licensed under the GNU General Public License as published by the Free Software Foundation."),
    "bsd-3-clause": ("Use of this source code is governed by a BSD-style 3-clause license.", "Distributed under the three clause BSD License.", "Redistribution in source and binary forms is permitted if the conditions and the disclaimer are retained."),
    "cc-by-4.0": ("Text available under the Creative Commons Attribution 4.0 License.", "Shared under a CC BY 4.0 licence.", "Content is licensed under Creative Commons Attribution 4.0 International."),
    "cc-by-nc-4.0": ("Text available under the Creative Commons Attribution-NonCommercial 4.0 License.", "Shared under a CC BY-NC 4.0 licence for non-commercial use."),
    "mpl-2.0": ("Covered by the Mozilla Public License, version 2.0.", "This file is subject to the MPL, v. 2.0; you can obtain one at mozilla.org."),
}
HELD_OUT_OTHERS = ("All rights reserved by the publisher; no part may be reproduced.", "Subject to our commercial license agreement and its terms.")
HELD_OUT_NONE = ("The committee will meet on Tuesday to discuss the budget for the new school.", "She opened the window and watched the rain fall on the garden.", "Der Zug nach Hamburg fährt heute vom Gleis sieben ab.", "Mix the flour with two eggs and a pinch of salt.")
BITS = 18


@dataclass(frozen=True)
class Model:
    """weights[feature, class]: no licence, each family, unknown notice; class priors; temperature."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list = field(default_factory=list)


def paragraph_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of the texts, and the number of lines before each text."""
    cuts = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
    return cuts, np.searchsorted(cuts, offsets)


def _word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, before, *_ = hash_words(texts, lower=True)
    return hashes, before


def features_of(hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs, with the paragraph of each."""
    pairs = rolling(hashes, 2)
    same = text_of[:-1] == text_of[1:] if len(text_of) else np.empty(0, bool)
    pairs = pairs[same] if len(pairs) else pairs
    both = np.concatenate([hashes, pairs])
    return (mix(both) >> U(64 - BITS)).astype(np.int64), np.concatenate([text_of, text_of[:-1][same]]) if len(pairs) else text_of


def _scores(model: Model, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Score of each class for each paragraph, divided by the root of its number of features."""
    n = len(before) - 1
    at, text_of = features_of(hashes, np.repeat(np.arange(n), np.diff(before)))
    out = np.empty((n, model.weights.shape[1]))
    size = np.sqrt(np.maximum(1, np.bincount(text_of, minlength=n)))
    for c in range(out.shape[1]):
        out[:, c] = np.bincount(text_of, model.weights[at, c], minlength=n) / size + model.bias[c]
    return out / model.temperature


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def wordings(background: list[str], seed: int = 5, copies: int = 12) -> tuple[list[str], list[int]]:
    """Training paragraphs and classes: templates whole, cut, and among foreign words; the corpus's own as none."""
    rng = random.Random(seed)
    foreign = [w for p in background for w in p.split()][:20000] or ["lorem", "ipsum", "dolor"]
    texts, kinds = list(background), [0] * len(background)
    for kind, group in [*enumerate((TEMPLATES[f] for f in FAMILIES), 1), (len(FAMILIES) + 1, OTHERS)]:
        for t in group:
            w = t.split()
            for i in range(copies):
                cut = w if i % 3 == 0 or len(w) < 8 else w[: max(6, len(w) - rng.randint(0, len(w) // 3))]
                around = [rng.choice(foreign) for _ in range(rng.randint(0, 6) * (i % 2))]
                texts.append(" ".join([*around[: len(around) // 2], *cut, *around[len(around) // 2 :]]))
                kinds.append(kind)
    return texts, kinds


def fit(texts: list[str], kinds: list[int], rounds: int = 120, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Multinomial logistic regression by full-batch gradient steps on the sparse features; HELD_OUT sets the temperature."""
    apart = [(t, k) for k, f in enumerate(FAMILIES, 1) for t in HELD_OUT[f]] + [(t, len(FAMILIES) + 1) for t in HELD_OUT_OTHERS] + [(t, 0) for t in HELD_OUT_NONE]
    own, texts, kinds = len(texts), [*texts, *(t for t, _ in apart)], [*kinds, *(k for _, k in apart)]
    hashes, before = _word_numbers(pa.array(texts, pa.string()))
    n, classes = len(texts), len(FAMILIES) + 2
    at, text_of = features_of(hashes, np.repeat(np.arange(n), np.diff(before)))
    value = 1 / np.sqrt(np.maximum(1, np.bincount(text_of, minlength=n)))[text_of]
    used, at = np.unique(at, return_inverse=True)
    y = np.asarray(kinds)
    held = np.arange(n) >= own
    share = np.bincount(y[~held], minlength=classes).astype(float)
    weight = np.where(held, 0, 1 / np.maximum(1, share)[y])
    weight = weight / weight.sum()
    w, bias = np.zeros((len(used), classes)), np.zeros(classes)

    def scores():
        return np.stack([np.bincount(text_of, w[at, c] * value, minlength=n) for c in range(classes)], 1) + bias

    target = np.eye(classes)[y]
    for _ in range(rounds):
        error = (_softmax(scores()) - target) * weight[:, None]
        for c in range(classes):
            w[:, c] -= rate * 10 * (np.bincount(at, error[text_of, c] * value, minlength=len(used)) + decay * w[:, c])
        bias -= rate * error.sum(0)
    s = scores()[held]
    grid = np.geomspace(0.25, 4, 25)
    loss = [-np.log(np.maximum(1e-12, _softmax(s / t)[np.arange(len(s)), y[held]])).mean() for t in grid]
    dense = np.zeros((1 << BITS, classes), np.float32)
    dense[used] = w
    templates = [[set(_triples(t)) for t in TEMPLATES[f]] for f in FAMILIES]
    return Model(dense, bias, float(grid[int(np.argmin(loss))]), templates)


def _triples(paragraph: str) -> list[tuple[str, ...]]:
    w = paragraph.lower().split()
    return [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))]


def train(docs: DataFrame, text: str = "text", sample_docs: int = 400, sample_paragraphs: int = 1500) -> Model:
    """Fits on the templates and a bounded sample: paragraphs of 20 to 2000 characters of the sample_docs documents with the least text hash, and of these paragraphs the sample_paragraphs with the least hash, so
    that every run takes the same.

    The hashes are compared first, so that no text but those of the sample is moved.
    """
    line = F.explode(F.split(F.col(text), "\n")).alias("p")
    h = F.xxhash64(text)
    last = docs.filter(F.col(text).isNotNull()).select(h.alias("h")).distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = docs.filter(F.col(text).isNotNull() & (h <= (-(1 << 63) if last is None else last))).select(text).distinct().select(line)
    found = sorted(r.p for r in rows.filter(F.length("p").between(20, 2000)).orderBy(F.xxhash64("p"), "p").limit(sample_paragraphs).collect())
    return fit(*wordings([p for p in found if not looks_like_notice(p)]))


def looks_like_notice(p: str) -> bool:
    q = p.lower()
    return any(x in q for x in ("license", "licence", "copyright", "rights reserved", "licensed"))


def confirmed(model: Model, family: int, paragraph: str, least: float) -> bool:
    """Enough of some template's word triples in the paragraph."""
    own = set(_triples(paragraph))
    return any(len(own & t) >= least * len(t) for t in model.templates[family])


def _scanned(model: Model, doc_id: str, text: str, sure: float, least: float, doubt: float = 0.1):
    kinds = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
    names = ["doc_id", "n_paragraphs", "n_license", "n_unknown", "families", "paragraphs"]

    def run(batches):
        for batch in pieces(batches, text):
            data, offsets = bytes_and_offsets(batch.column(batch.schema.get_field_index(text)))
            cuts, lines = paragraph_offsets(data, offsets)
            texts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            hashes, before = _word_numbers(texts)
            p = _softmax(_scores(model, hashes, before))
            filled = np.diff(before) > 0
            hits = np.flatnonzero(filled & (p[:, 0] < 0.5))
            found: dict[int, list] = {}
            for i in hits.tolist():
                k = int(p[i, 1:].argmax())
                if p[i, 0] >= doubt and (k == len(FAMILIES) or not confirmed(model, k, texts[i].as_py(), least)):
                    continue
                sure_one = k < len(FAMILIES) and p[i, k + 1] >= sure and confirmed(model, k, texts[i].as_py(), least)
                d = int(np.searchsorted(lines, i, "right")) - 1
                found.setdefault(d, []).append({"paragraph": i - int(lines[d]), "family": FAMILIES[k] if sure_one else "unknown", "probability": round(float(p[i, k + 1]), 6)})
            n = np.add.reduceat(np.append(filled, False).astype(np.int64), lines[:-1]) if len(filled) else np.zeros(batch.num_rows, np.int64)
            n[lines[1:] == lines[:-1]] = 0
            rows = [found.get(d, []) for d in range(batch.num_rows)]
            known = [[x for x in r if x["family"] != "unknown"] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(doc_id)),
                    pa.array(n, pa.int64()),
                    pa.array(map(len, known), pa.int64()),
                    pa.array((len(r) - len(k) for r, k in zip(rows, known, strict=True)), pa.int64()),
                    pa.array((",".join(sorted({x["family"] for x in k})) for k in known), pa.string()),
                    pa.array(rows, kinds),
                ],
                names=names,
            )

    return run


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", sure: float = 0.6, least: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs, n_license, n_unknown, families (comma-joined) and paragraphs (number, family, probability)."""
    bound_batches(docs.sparkSession)
    shape = "doc_id long, n_paragraphs long, n_license long, n_unknown long, families string, paragraphs array<struct<paragraph:int,family:string,probability:double>>"
    return docs.select(doc_id, text).mapInArrow(_scanned(model, doc_id, text, sure, least), shape)
