"""Licence scans: a trained paragraph classifier whose finds are confirmed by comparison with templates."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Wording of public licences and of the notices that name them, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Proprietary": [
        "Copyright (c) 2024 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary and may not be copied without permission.",
    ],
}
# Ordinary sentences that use the same words, for the class of unknown paragraphs.
OTHERS = [
    "She renewed her driver's license last week and paid the fee at the counter.",
    "The city may permit street vendors who hold a valid business license.",
    "He asked for permission to leave the room before the lecture ended.",
    "The company was granted a broadcasting licence by the regulator in 1994.",
    "Copyright law has changed a great deal since the printing press.",
    "The free museum is open to any person on the first Sunday of the month.",
    "The warranty covers parts and labour for two years from purchase.",
    "By all means bring your own lunch and a copy of the map.",
    "The Apache helicopter was first flown in September 1975.",
    "Conditions on the road were met with caution by the drivers.",
    "The software update was distributed to all users on Monday.",
    "Permission slips must be signed by a parent before the trip.",
    "The public domain of the lake shore is kept by the county.",
    "A licensed electrician has to check the wiring.",
    "The terms of the agreement were published in the newspaper.",
    "MIT is a university in Cambridge, and its students publish widely.",
    "The GNU is an antelope, and BSD stands for many things.",
    "Version 2.0 of the game was released in the spring.",
    "The driver was licensed under the old law of the state.",
    "He studied under the terms of a grant from the Mozilla foundation.",
    "The general public was licensed to fish in the lake from version to version of the law.",
    "The BSD and the GPL are older than many people who write software.",
    "Creative people share their work in the commons room.",
    "The film was released under the title of the book.",
]

UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Buckets of hashed word n-grams (n up to 3).
BUCKETS = 1 << 13
#: Sentences and lines that are read together: no template needs more when wrapped at 40 columns.
SENTENCES, LINES = 4, 16
# The year and holder made up in a template, and what marks comments.
_PLACEHOLDER = re.compile(r"2024 Example Corporation")
_MARKS = re.compile(r"^\s*(?:/\*+|\*+/?|//+!?|#+!?|;+|--+|<!--+|%+|>+|\"\"\"|dnl\b|rem\b)+|(?:\*+/|--+>)\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.:;])\s+(?=[A-Z])")
# Words that may follow a licence's name in a notice.
_GOES_ON = set("along and as at available but by can for found from has if in included instead is or see shall text that the this under unless v version we which while with without you".split())
_CALLED = re.compile(r"\blicen[cs]e\b(?:[\"'”’)\]]*(?=$|[^\w\s])|\s+([A-Za-z]+)|\s*$|\s+(?=\W|\d))", re.I)
_TOKEN = re.compile(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a paragraph: log counts of n-grams, scaled to length one."""
    found = np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams(tokens(text))], np.int64)
    at, n = np.unique(found, return_counts=True)
    v = 1 + np.log(n)
    return at, v / max(np.sqrt((v * v).sum()), 1e-9)


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        at, v = sparse(text)
        z = (self.bias + v @ self.weights[at]) / self.temperature if len(at) else np.where(np.arange(len(self.bias)) == 0, 30.0, 0.0)
        e = np.exp(z - z.max())
        return e / e.sum()


def _variants(text: str, rng: np.random.Generator, count: int) -> list[str]:
    """Copies of a paragraph as people write them: words lost, numbers changed, text around, another case."""
    words, out = text.split(), [text, text.upper(), text.lower()]
    for _ in range(count):
        w = [x for x in words if rng.random() > 0.06] or words
        w = [re.sub(r"20\d\d", str(rng.integers(1990, 2027)), x) for x in w]
        noise = ["".join(rng.choice(list("abdeghinorstu"), rng.integers(2, 8))) for _ in range(rng.integers(0, 6))]
        cut = rng.integers(0, len(noise) + 1)
        out.append(" ".join([*noise[:cut], *w, *noise[cut:]]))
    return out


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, rounds: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on sparse rows by adaptive gradient steps over shuffled rows."""
    rng, w, b = np.random.default_rng(5), np.zeros((BUCKETS, classes)), np.zeros(classes)
    seen = np.full((BUCKETS, classes), 1e-3)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            z = b + v @ w[at]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p + ridge * w[at]
            seen[at] += g * g
            w[at] -= 0.5 * g / np.sqrt(seen[at])
            b -= 0.05 * p
    return w, b


@lru_cache(maxsize=1)
def train(seed: int = 11) -> Model:
    """Fits variants of TEMPLATES against OTHERS and made-up prose; a third of them is held out to set the
    temperature (least log loss) and the probability under which a paragraph stays unknown (no held-out ordinary
    paragraph passes it)."""
    rng, texts, y = np.random.default_rng(seed), [], []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, OTHERS):
            found = _variants(t, rng, 12)
            texts += found
            y += [k] * len(found)
    for _ in range(400):
        texts.append(" ".join("".join(rng.choice(list("abdeghinorstu"), rng.integers(2, 9))) for _ in range(rng.integers(3, 40))))
        y.append(0)
    rows, target = [sparse(t) for t in texts], np.array(y)
    held = rng.random(len(rows)) < 1 / 3
    learn = np.flatnonzero(~held)
    w, b = _fit([rows[i] for i in learn], target[learn], len(FAMILIES), rounds=25)
    z = np.stack([b + v @ w[at] for at, v in (rows[i] for i in np.flatnonzero(held))])
    losses = {}
    for temperature in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        e = np.exp((z - z.max(1, keepdims=True)) / temperature)
        p = e / e.sum(1, keepdims=True)
        losses[temperature] = (-np.log(np.maximum(p[np.arange(len(p)), target[held]], 1e-12)).mean(), p)
    temperature = min(losses, key=lambda t: losses[t][0])
    p = losses[temperature][1]
    threshold = max(0.5, float(p[target[held] == 0, 1:].max(initial=0.0)))
    return Model(w, b, temperature, threshold)


@lru_cache(maxsize=1)
def _template_grams() -> dict[str, list[frozenset[str]]]:
    """Placeholders are no part of a template: grams stand on either side of them."""
    return {f: [frozenset(g for part in _PLACEHOLDER.split(t) for g in grams(tokens(part))) for t in ts] for f, ts in TEMPLATES.items()}


@lru_cache(maxsize=4)
def _cues(least: float) -> ahocorasick.Automaton:
    """Words of which a text holds one if its likeness with any template is at least `least`: of each template the
    longest ones, until the n-grams without them are a lesser share of all."""
    words = set()
    for templates in _template_grams().values():
        for t in templates:
            left = set(t)
            for w in sorted({w for g in t for w in g.split(" ")}, key=lambda w: (-len(w), w)):
                if len(left) < least * len(t):
                    break
                words.add(w)
                left = {g for g in left if w not in g.split(" ")}
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


def _cue_starts(text: str, least: float) -> list[int]:
    return sorted(end + 1 - n for end, n in _cues(least).iter(text.lower()))


def _has_cue(text: str, least: float) -> bool:
    return next(_cues(least).iter(text.lower()), None) is not None


def likeness(text: str, family: str) -> float:
    """The largest share of a family template's word n-grams that a stretch of the paragraph holds. The stretch is as
    long as the template and a quarter, as its words lie together where they are a licence."""
    words, best = tokens(text), 0.0
    found = [(i, g) for i in range(len(words)) for n in (1, 2, 3) if i + n <= len(words) and (g := " ".join(words[i : i + n])) in _all_grams()]
    for t, size in zip(_template_grams().get(family, []), _template_sizes().get(family, []), strict=True):
        held: dict[str, int] = {}
        first, width = 0, size + size // 4 + 3
        mine = [(i, g) for i, g in found if g in t]
        for i, g in mine:
            held[g] = held.get(g, 0) + 1
            while mine[first][0] <= i - width:
                g = mine[first][1]
                held[g] -= 1
                if not held[g]:
                    del held[g]
                first += 1
            best = max(best, len(held) / len(t))
    return best


@lru_cache(maxsize=1)
def _all_grams() -> frozenset[str]:
    return frozenset(g for ts in _template_grams().values() for t in ts for g in t)


@lru_cache(maxsize=1)
def _template_sizes() -> dict[str, list[int]]:
    return {f: [len(tokens(t)) for t in ts] for f, ts in TEMPLATES.items()}


@lru_cache(maxsize=1)
def _stretch() -> int:
    """Words of the longest stretch that is compared with a template."""
    size = max(n for sizes in _template_sizes().values() for n in sizes)
    return size + size // 4 + 3


def _windows(text: str) -> list[tuple[int, int]]:
    """Ranges of characters of twice the longest stretch, each beginning a stretch after the one before, so that each
    stretch lies in one; the whole text if it is no longer."""
    at = [m.start() for m in re.finditer(r"\S+", text)]
    step = _stretch()
    if len(at) <= 2 * step:
        return [(0, len(text))]
    return [(at[i], at[i + 2 * step] if i + 2 * step < len(at) else len(text)) for i in range(0, len(at) - step, step)]


def _named_to_the_end(text: str) -> bool:
    """Does a licence's name end where it says licence, somewhere in a paragraph? In `the X license of the town` or `the X
    license office` the word belongs to another thing. True where nothing is called a licence."""
    found = [m[1] for m in _CALLED.finditer(text)]
    return not found or any(not w or w.lower() in _GOES_ON for w in found)


def _judge(parts: Iterable[str], model: Model, least: float) -> tuple[str, float, float] | None:
    """(family, probability, likeness) of the likest part that the template comparison confirms."""
    best = None
    for part in dict.fromkeys(part[a:b] for part in parts for a, b in _windows(part)):
        # the comparison confirms nothing without a cue
        if not _has_cue(part, least):
            continue
        p = model.probabilities(part)
        k = int(p.argmax())
        if k and p[k] >= model.threshold and (s := likeness(part, FAMILIES[k])) > least and _named_to_the_end(part) and (best is None or (s, p[k]) > best[2:0:-1]):
            best = (FAMILIES[k], float(p[k]), s)
    return best


def _spans(joined: str, starts: list[int]) -> set[tuple[int, int]]:
    """Ranges of characters of joined lines: each run of up to SENTENCES sentences, and of up to LINES lines, as not
    all text has full stops; of long runs windows in which every stretch lies."""
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(joined)), starts[-1]]
    found, windows = set(), _windows(joined)
    longest = max(b - a for a, b in windows)
    for places, most in ((cuts, SENTENCES), (starts, LINES)):
        for i in range(len(places) - 1):
            for j in range(i + 1, min(i + most, len(places) - 1) + 1):
                if places[j] - places[i] > longest:
                    break
                found.add((places[i], places[j]))
    return found.union(windows)


def _wrapped(lines: list[str], found: dict[int, tuple], model: Model, least: float) -> list[tuple[int, int, tuple]]:
    """(first line, line after the last, find) of what lines hold only together, found being what they hold alone.
    Where lines have finds of their own, the new one has to be likelier and to need them. Of finds that share a line
    the likest is taken, then the shortest."""
    joined, hits = " ".join(lines), []
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    cues = _cue_starts(joined, least)
    for a, b in _spans(joined, starts):
        first, last, cue = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, bisect_left(cues, a)
        if first == last or cue == len(cues) or cues[cue] >= b or not (hit := _judge([joined[a:b]], model, least)):
            continue
        alone = [found[n][2] for n in range(first, last + 1) if n in found]
        if alone and (hit[2] <= max(alone) or likeness(" ".join(lines[n] for n in range(first, last + 1) if n not in found), hit[0]) >= hit[2]):
            continue
        hits.append((-hit[2], b - a, first, last + 1, hit))
    out, taken = [], set()
    for _, _, first, end, hit in sorted(hits):
        if taken.isdisjoint(range(first, end)):
            taken.update(range(first, end))
            out.append((first, end, hit))
    return out


def _scan_run(start: int, lines: list[str], model: Model, least: float) -> list[tuple[int, str, float, float]]:
    """The finds in neighbouring lines, the first of which is line number start."""
    # a licence sentence can stand inside a long paragraph, so sentences are looked at as well
    found = {n: hit for n, line in enumerate(lines) if (hit := _judge([line, *_SENTENCE.split(line)], model, least))}
    for first, end, hit in _wrapped(lines, found, model, least) if len(lines) > 1 else []:
        found = {n: x for n, x in found.items() if not first <= n < end} | {first: hit}
    return [(start + n, *found[n]) for n in sorted(found)]


def scan_text(text: str, model: Model, least: float) -> list[tuple[int, str, float, float]]:
    """(line number, family, probability, likeness) of the confirmed paragraphs of a text, in order of lines.

    A paragraph is a line, or what stands in several lines without a blank one between them (comment marks are no
    text); its number is that of its first line. The likeliest family that the template comparison confirms is taken.
    """
    out: list[tuple[int, str, float, float]] = []
    if not _has_cue(text, least):
        return out
    run: list[str] = []
    for n, line in enumerate([*text.split("\n"), ""]):
        if bare := _MARKS.sub("", line).strip():
            run.append(bare)
            continue
        if run and _has_cue(" ".join(run), least):
            out += _scan_run(n - len(run), run, model, least)
        run = []
    return out


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, family, probability, likeness, n_paragraphs, families, lines) of every row of docs.

    family is that of the paragraph with the greatest likeness ('unknown' where none is confirmed, with 0 for the
    numbers); families lists all found, lines their line numbers. A paragraph counts if the classifier gives its
    family at least the calibrated probability and holds more than `least` of a template's n-grams in one stretch. Null and empty
    texts are unknown; of ties the first paragraph wins. No shuffle; other columns of docs are not read.
    """
    rows = docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py() or "", model, least) for t in batch.column(1)]
            top = [max(f, key=lambda x: x[3]) if f else (0, UNKNOWN, 0.0, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([t[1] for t in top], pa.string()), pa.array([t[2] for t in top], pa.float64()), pa.array([t[3] for t in top], pa.float64()),
                pa.array([len(f) for f in found], pa.int64()), pa.array([sorted({x[1] for x in f}) for f in found], pa.list_(pa.string())), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.int64())),
            ], names=["__key", "family", "probability", "likeness", "n_paragraphs", "families", "lines"])

    schema = f"__key {kind}, family string, probability double, likeness double, n_paragraphs long, families array<string>, lines array<long>"
    return rows.mapInArrow(run, schema).withColumnRenamed("__key", key)
