"""License scans: a trained paragraph classifier with a calibrated unknown class and template checks.

A paragraph is the lines of a text up to a blank one; marks of comments are no words, so wrapped and
commented notices read on. Logistic regressions over hashed word unigrams, bigrams and trigrams (each
vector has length 1) judge its lines and overlapping windows of SCALES words: one tells a licence from
none, the unknown class, and one tells the families apart. They are trained on spoken variants of the
templates below, against denials of them and a bounded sample of the corpus's own lines. The unknown
class is calibrated: the margin by which a window must beat it is set on held-out lines that hold no
licence, and on their windows of each size. Of a window that beats it, every family that is at all
likely counts once its templates confirm it: enough of a template's words, in order, are in the
paragraph about the window, with no word among them that denies it or names another licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, shingles

# Licence families (SPDX identifiers) with the names that texts give them, without versions' forms.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "Affero General Public License version 3", "GNU AGPL version 3", "AGPL version 3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache Software License, Version 2.0", "Apache 2.0 License", "Apache 2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Perl Artistic License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-style license"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0", "Creative Commons CC0 1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License, version 1.0", "CDDL version 1.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL 2.0"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2", "EUPL version 1.2"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPL version 3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPL version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPL version 3"],
    "MIT": ["MIT License", "MIT/Expat License", "Expat License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "Open Font License 1.1"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License version 2"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
# The parts of Creative Commons names; the families follow from them by rule.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in COMMONS.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        NAMES[f"CC-{_short}-{_v}"] = [f"CC {_short} {_v}", f"Creative Commons {_long} {_v}", f"Creative Commons {_short} {_v}"]
# Sentences of usual notices that grant a licence without naming it, or with more words.
NOTICES = {
    "AGPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "LGPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright Example. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this work may be reproduced without prior written permission"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
# How texts grant a licence by its name, and how they speak of one without granting it.
GRANTS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "Use of this source code is governed by the {}.", "This file is covered by the {}.", "subject to the terms of the {}"]
DENIALS = ["This work is not licensed under the {}.", "It was never released under the {}.", "Unlike others it is not covered by the {}.", "They discussed the {} at the meeting.", "This text discusses the {} and others at length."]
# Sentences near the subject that grant nothing.
OTHER = [
    "The license was discussed at the meeting.", "You need a driving license to work here.", "He reserved a table for two.", "All rights and duties were explained to them.", "He said all rights reserved for members of the club were kept.",
    "The public library opens at nine.", "The version released last week is faster.", "Open source software is popular.", "She works at MIT on a free program.", "A copy of the map is in the file.", "He was released under strict conditions.", "The area is covered by the forest.",
]
NONE = "none"
BUCKETS = 1 << 15
#: Paragraphs of the corpus that train the class of those without a licence, at most, and characters of each.
SAMPLE, LONGEST = 4000, 5000
#: Changed copies of each spoken form to train on.
VARIANTS = 6
#: Share of a notice's words that must be in the paragraph, in order; a short template must be there whole.
CONFIRM, SHORT = 0.75, 12
#: Other words that may stand among those of a short template in all, and in a row among those of a long one.
STRAY, GAP = 4, 8
#: Words that make another licence of the one whose words they stand among or before.
APART = frozenset("affero lesser library nc nd noncommercial noderivatives noderivs sa sharealike commercial derivatives alike".split())
#: Words that deny what follows them in a sentence.
DENY = frozenset("not never no isn aren cannot neither nor unlike without except instead longer formerly previously whether if".split())
#: A family of a window that is less likely than this is not looked for.
LIKELY = 0.01
#: Words of a window; windows begin a quarter of their size apart, and lines up to the largest are windows too.
SCALES = (4, 8, 16, 32, 64)
#: Words that are scored at once.
STEP = 1 << 12
#: Long lines are tokenised in pieces of about so many characters.
PIECE = 400
#: Rate of held-out paragraphs without a licence that may pass the margin before confirmation.
FALSE = 0.001


def spoken(family: str) -> list[str]:
    """The forms in which texts grant a family: identifiers, grants by name, and notices."""
    identifier = [f"SPDX-License-Identifier: {family}"] if family not in ("Proprietary", "BSD") else []
    return NOTICES.get(family, []) + identifier + [g.format(n) for n in NAMES.get(family, []) for g in GRANTS]


FAMILIES = sorted({*NAMES, *NOTICES})


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of each line's word n-grams, n from 1 to 3."""
    h, at = shingles.words(lines)
    n = np.diff(at)
    own = np.repeat(np.arange(len(lines)), n)
    grams, doc = [], []
    for k, gram in enumerate(_grams(h), 1):
        same = own[k - 1 :] == own[: len(gram)]
        grams.append(gram[same])
        doc.append(own[: len(gram)][same])
    doc, grams = np.concatenate(doc), np.concatenate(grams)
    order = np.argsort(doc, kind="stable")
    return grams[order], np.searchsorted(doc[order], np.arange(len(lines) + 1))


def _grams(h: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that begin at each word, as far as there are enough words."""
    out = []
    for k in range(1, min(3, max(len(h), 1)) + 1):
        total = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            total = shingles.mix(total) * np.uint64(31) + h[j : len(h) - k + 1 + j]
        out.append((shingles.mix(total + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int64))
    return out


@dataclass
class Model:
    families: list[str]
    #: Per bucket the weight for a licence, whichever, and those of the families.
    any: np.ndarray
    weights: np.ndarray
    margin: float
    #: The margin of windows of each of SCALES, beside that of whole lines.
    margins: tuple[float, ...] = ()

    def odds(self, lines: list[str]) -> np.ndarray:
        """Per line the log-odds of a licence; a line without words has none."""
        index, at = features(lines)
        out = np.full(len(lines), -1e9)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            out[full] = np.add.reduceat(self.any[index], at[:-1][full]) / np.sqrt(np.diff(at)[full])
        return out

    def likely(self, grams: list[np.ndarray], begin: int, end: int) -> np.ndarray:
        """The families that are at all likely for a window of the words whose buckets are grams."""
        index = np.concatenate([g[begin : max(begin, end - k)] for k, g in enumerate(grams)])
        z = self.weights[index].sum(0) / np.sqrt(max(1, len(index)))
        p = np.exp(z - z.max())
        return np.flatnonzero(p / p.sum() >= LIKELY)

    def windows(self, h: np.ndarray, lines: np.ndarray, paragraphs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(scale, begins, ends, odds) of windows of the words h; lines and paragraphs are the words' offsets.

        The scale is an index of SCALES, or -1 for whole lines. A paragraph that is shorter than a
        scale, but not than the one below, is one window.
        """
        size = np.diff(paragraphs)
        first, last = np.repeat(paragraphs[:-1], size), np.repeat(paragraphs[1:], size)
        short = np.diff(lines)
        short = np.flatnonzero((short > 0) & (short <= SCALES[-1]))
        for a in range(0, len(h), STEP):
            b = min(len(h), a + STEP)
            total = [np.concatenate([[0.0], np.cumsum(self.any[g])]) for g in _grams(h[a : b + SCALES[-1]])]
            total = [np.pad(t, (0, len(total[0]) - len(t)), "edge") for t in total]
            at = np.arange(a, b)
            before, left = at - first[a:b], last[a:b] - at
            own = short[slice(*np.searchsorted(lines[short], [a, b]))]
            spans = [(-1, lines[own], lines[own + 1])]
            for i, n in enumerate(SCALES):
                whole = (before == 0) & (left < n) & (left >= (SCALES[i - 1] if i else 1))
                begin = at[(left >= n) & (before % (n // 4) == 0) | (left == n) | whole]
                spans.append((i, begin, np.minimum(begin + n, last[begin])))
            for i, begin, end in spans:
                n = end - begin
                odds = sum(t[np.maximum(end - k, begin) - a] - t[begin - a] for k, t in enumerate(total))
                yield i, begin, end, odds / np.sqrt(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0))


def variants(seed: int = 7, copies: int = VARIANTS) -> tuple[list[str], list[str]]:
    """(lines, families): the spoken forms, changed in the ways that texts change them."""
    rng = np.random.default_rng(seed)
    filler = "please note see file notice work code project document the a of our year 2019 2021 2024 author by".split()
    lines, own = [], []
    for family in FAMILIES:
        for t in spoken(family):
            for i in range(copies if family in NAMES else 5 * copies):
                w = t.split()
                if i % 3 == 1:
                    w = list(rng.choice(filler, rng.integers(1, 5))) + w
                if i % 3 == 2:
                    w = w + list(rng.choice(filler, rng.integers(1, 5)))
                if i % 2 and len(w) > 8:
                    del w[rng.integers(0, len(w))]
                lines.append(" ".join(w))
                own.append(family)
    return lines, own


def _fit(index: np.ndarray, at: np.ndarray, y: np.ndarray, k: int, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Weights (BUCKETS, k) of a multinomial logistic regression by full-batch adaptive gradients."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    value = (1 / np.sqrt(np.maximum(np.diff(at), 1)))[row]
    # Each class weighs as much in sum, so that the many lines without a licence do not drown the rest.
    weight = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y] / k
    used, small = np.unique(index, return_inverse=True)
    order = np.argsort(small, kind="stable")
    starts = np.searchsorted(small[order], np.arange(len(used)))
    w, grad2 = np.zeros((len(used), k), np.float32), np.full((len(used), 1), 1e-8, np.float32)
    ends, full = at[:-1][np.diff(at) > 0], np.diff(at) > 0
    rows, values = row[order], value[order].astype(np.float32)[:, None]
    for _ in range(rounds):
        z = np.zeros((n, k), np.float32)
        z[full] = np.add.reduceat(w[small] * value[:, None].astype(np.float32), ends, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        g = p / p.sum(1, keepdims=True)
        g[np.arange(n), y] -= 1
        g *= weight[:, None].astype(np.float32)
        step = np.add.reduceat(g[rows] * values, starts, axis=0) + decay * w
        grad2 += (step**2).mean(1, keepdims=True)
        w -= rate * step / np.sqrt(grad2) / np.sqrt(k)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = w
    return weights


def train(without: list[str], rounds: int = 40, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Fit on variants of the spoken forms against denials and lines without a licence; a fifth of those calibrates the margin."""
    # Lines that a template confirms are not "without", whatever the sample says.
    rest = [x for x in without if not any(_matches(_tokens(x), f) for f in FAMILIES)]
    denied = [d.format(n) for names in NAMES.values() for n in names for d in DENIALS]
    hold, fit = rest[::5], [x for i, x in enumerate(rest) if i % 5] + OTHER * 20 + denied
    lines, own = variants()
    index, at = features(lines + fit)
    two = _fit(index, at, np.array([1] * len(lines) + [0] * len(fit)), 2, rounds, rate, decay)
    cut = int(at[len(lines)])
    families = _fit(index[:cut], at[: len(lines) + 1], np.array([FAMILIES.index(f) for f in own]), len(FAMILIES), rounds, rate, decay)
    model = Model(FAMILIES, (two[:, 1] - two[:, 0]).astype(np.float64), families, 0.0)
    model.margin = _margin(model.odds(hold))
    h, at = shingles.words(hold)
    over: list[list[np.ndarray]] = [[] for _ in SCALES]
    for i, _, _, odds in model.windows(h, at, at):
        if i >= 0:
            over[i].append(odds)
    # Equal windows count once, or a line that repeats one word would set the margin.
    model.margins = tuple(_margin(np.unique(np.concatenate([np.zeros(0), *x]).round(9))) for x in over)
    return model


def _margin(over: np.ndarray) -> float:
    return float(max(0.0, np.sort(over)[min(len(over) - 1, int(len(over) * (1 - FALSE)))])) if len(over) else 0.0


#: A sentence's end, and a line's; neither is a word.
STOP, LINE = ".", "\n"
_TOKEN = re.compile(r"[^\W_]+|(?<=[^\W\d_]{3})[.!?;](?=\s|$)")
_VERSION = re.compile(r"(?:(a?l?gpl|mpl|epl|eupl|cddl|apache|by|cc)?v?)?(\d+)")
#: Words that mean the same to the check, and words that it passes over.
_SAME = {w: "licensed" for w in "released distributed available governed covered published provided offered licenced dedicated subject".split()} | dict.fromkeys(("by", "to", "with"), "under") | {"licence": "license", "licences": "license", "licenses": "license", "international": "", "unported": "", "universal": "", "public": ""}
_EMPTY = frozenset("the a an of terms version v ver this is are its conditions".split())
#: Words that would lose their sense after "cc" or "commons" if they were taken for "under".
_COMMONS = frozenset(("cc", "commons", "attribution"))
#: Words of Creative Commons names, among which any other word makes another licence.
_PARTS = frozenset("by attribution sa nc nd sharealike noncommercial noderivatives".split())


def _tokens(text: str) -> list[str]:
    """Words of a line in one spelling, with marks at sentences' ends and at the line's."""
    out: list[str] = []
    for t in _TOKEN.findall(text.lower()):
        if t in ".!?;":
            out.append(STOP)
            continue
        m = _VERSION.fullmatch(t) if t[-1].isdigit() else None
        for w in [x for x in (m[1], m[2]) if x] if m else (t,):
            last = out[-1] if out else ""
            if w == "by" and last in _COMMONS:
                out.append(w)
                continue
            w = _SAME.get(w, w)
            if not w or w in _EMPTY or w == "0" and last.isdigit():
                continue
            out.append(w)
    return [*out, LINE]


def _marks(word: str) -> bool:
    return word == STOP or word == LINE


_WORDS = {family: sorted({tuple(w for w in _tokens(t) if not _marks(w)) for t in spoken(family)}) for family in FAMILIES}
_LONGEST = 2 * max(len(t) for ts in _WORDS.values() for t in ts)


def _align(have: list[str], want: tuple[str, ...], at: int) -> tuple[int, int]:
    """(words of the template want, in order, in have from a word on; the end of the last of them).

    It is none if a word of APART, a denial or another number than the template's is among them or
    follows them, or a word of APART is missing. A short template lies within a sentence.
    """
    i = hit = gap = stray = 0
    end, short, digits = at, len(want) <= SHORT, any(x.isdigit() for x in want)
    for p in range(at, len(have)):
        word, near = have[p], want[i : i + (1 if short else 3)]
        if word == LINE or word == STOP and not short:
            continue
        if word == STOP:
            break
        if word in near:
            to = want.index(word, i)
            if not APART.isdisjoint(want[i:to]):
                return 0, at
            i, hit, gap, end = to + 1, hit + 1, 0, p + 1
            if i == len(want):
                break
        elif word in APART or word in DENY or i and want[i - 1] in _PARTS or word.isdigit() and digits and (short or any(x.isdigit() for x in near)):
            return 0, at
        else:
            gap, stray = gap + 1, stray + 1
            if gap > GAP or short and stray > STRAY:
                break
    after = [w for w in have[end : end + 2] if w != LINE][:1]
    if after and (after[0] in APART or after[0].isdigit() and (digits or short) and len(after[0]) < 3):
        return 0, at
    return (hit, end) if APART.isdisjoint(want[i:]) else (0, at)


def _matches(have: list[str], family: str) -> list[tuple[float, int, int]]:
    """(share, begin, end) of the words of have that hold enough of a template of the family, the largest shares first; none overlap.

    Short templates must be whole, and their sentence must not deny them before they begin. "All
    rights reserved" alone must be a sentence or a line.
    """
    own, found = set(have), []
    for want in _WORDS[family]:
        short = len(want) <= SHORT
        need = 1.0 if short else CONFIRM
        if sum(w in own for w in want) < need * len(want):
            continue
        first = want[: 1 if short else 3]
        for p, word in enumerate(have):
            if word not in first:
                continue
            hit, end = _align(have, want, p)
            if hit / len(want) < need:
                continue
            if short:
                before = have[max(0, p - 8) : p]
                stop = max((i for i, w in enumerate(before) if w == STOP), default=-1)
                if not DENY.isdisjoint(before[stop + 1 :]):
                    continue
                if want == ("all", "rights", "reserved") and (p and not _marks(have[p - 1]) or end < len(have) and not _marks(have[end]) or end - p > 3):
                    continue
            found.append((hit / len(want), p, end))
    out: list[tuple[float, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if all(x[2] <= y[1] or x[1] >= y[2] for y in out):
            out.append(x)
    return out


def confirmed(line: str, family: str) -> float:
    """The largest share of a template of the family that the line holds in order, if it is enough, else 0."""
    return max((x[0] for x in _matches(_tokens(line), family)), default=0.0)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(line, text) of the lines, the long ones cut before white space."""
    for j, line in enumerate(text.split("\n")):
        for x in re.findall(rf"(?s).{{1,{PIECE}}}\S*", line) if len(line) > PIECE else (line,):
            yield j, x


def _findings(model: Model, texts: list[str | None]) -> list[list[dict]]:
    pieces = [(i, j, x) for i, t in enumerate(texts) for j, x in _pieces(t or "")]
    h, at = shingles.words([x for _, _, x in pieces])
    doc, line = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]))
    lines = at[np.append(begins, len(pieces))]
    blank = np.array([not pieces[k][2].strip() for k in begins])
    new = np.concatenate([[True], (doc[begins][1:] != doc[begins][:-1]) | blank[:-1]])
    paragraphs = np.append(lines[:-1][new], len(h))
    paragraphs = paragraphs[np.concatenate([[True], np.diff(paragraphs) > 0])]
    spans: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    grams = None
    for i, begin, end, odds in model.windows(h, lines, paragraphs):
        for w in np.flatnonzero(odds > (model.margins[i] if i >= 0 else model.margin)):
            grams = _grams(h) if grams is None else grams
            p = int(np.searchsorted(paragraphs, begin[w], "right")) - 1
            for f in model.likely(grams, int(begin[w]), int(end[w])):
                spans.setdefault((p, int(f)), []).append((int(begin[w]), int(end[w]), float(odds[w])))
    best: dict[tuple[int, int, str], dict] = {}
    known: dict[int, list[str]] = {}
    for (p, f), windows in spans.items():
        family, joined = model.families[f], []
        for begin, end, odds in sorted(windows):
            begin, end = max(begin - _LONGEST, int(paragraphs[p])), min(end + _LONGEST, int(paragraphs[p + 1]))
            if joined and begin <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(end, joined[-1][1]), max(odds, joined[-1][2]))
            else:
                joined.append((begin, end, odds))
        for begin, end, odds in joined:
            a, b = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end, "left"))
            have = [known[k] if k in known else known.setdefault(k, _tokens(pieces[k][2])) for k in range(a, b)]
            ends = np.cumsum([len(x) for x in have])
            for share, word, _ in _matches([w for x in have for w in x], family):
                i, j, _ = pieces[a + int(np.searchsorted(ends, word, "right"))]
                key = (i, j, family)
                if key not in best or (best[key]["template"], best[key]["odds"]) < (share, odds):
                    best[key] = {"line": j, "family": family, "odds": odds, "template": share}
    found: list[list[dict]] = [[] for _ in texts]
    for key in sorted(best):
        found[key[0]].append(best[key])
    return found


def _scan(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("odds", pa.float64()), ("template", pa.float64())]))
        for part in parts:
            texts = part.column("text").to_pylist()
            for a, b in shingles.batches(texts):
                found = _findings(model, texts[a:b])
                names = [sorted({x["family"] for x in f}) for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(a, b - a), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], ["doc_id", "families", "findings"])

    return run


def sample(docs: DataFrame, limit: int = SAMPLE) -> list[str]:
    """At most `limit` lines of docs: one line of each of those documents with the least hash."""
    rows = shared.pick(docs.select("doc_id", "text").where("text is not null"), limit, "doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text"))
    pick = F.split("text", "\n")
    line = F.element_at(pick, (F.pmod(F.col("h"), F.size(pick)) + 1).cast("int"))
    picked = rows.select("h", F.substring(line, 1, LONGEST).alias("line")).collect()
    return [r["line"] for r in sorted(picked, key=lambda r: (r["h"], r["line"]))[:limit]]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, families array<string>, findings array<struct<line, family, odds, template>>) per row of docs.

    families are in the alphabet's order; a null, empty or licence-free text has none. A very long text
    is judged in pieces, all of it. Every row is decided on its own, so repeated rows and null ids stay
    as they are; no documents give no rows. A finding's line is that on which the template's words
    begin, counted from 0; a line has one finding a family at most (of ties the first), with the odds of
    a licence. Other columns are not read, whatever their names.
    """
    model = model or train(sample(docs))
    return docs.select("doc_id", "text").mapInArrow(_scan(model), f"doc_id {dict(docs.dtypes)['doc_id']}, families array<string>, findings array<struct<line: int, family: string, odds: double, template: double>>")
