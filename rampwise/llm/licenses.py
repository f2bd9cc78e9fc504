"""Licence scans: a trained paragraph classifier whose predictions are confirmed by comparison with templates.

A paragraph is a line; lines of more than ``WIDTH`` words are looked at in windows of ``WIDTH`` words that overlap by half.
Notices among other words are looked for in shorter windows of every line (``SIZES``); of these, only windows that hold enough
bigrams of templates to be confirmed are scored, which leaves out none that could be found. Hashed word unigrams and bigrams, as shares of the paragraph's, go through a multinomial logistic regression over the
licence families and a class of none. It is learned by stochastic gradient descent in numpy from the templates (whole, cut,
with words left out, with other words around them, and as the windows of longer lines hold them) and from all paragraphs of a bounded sample of documents (``SAMPLE``) that
hold little of any template. A held-back part sets the softmax's temperature and the least score (``FALSE_SHARE`` of the held-back
paragraphs of other text may pass it): what scores less is unknown. A predicted family holds only where the paragraph's best
template of that family shares at least ``CONFIRM`` of the shorter one's word bigrams, and a shorter window's only where it
holds ``CONFIRM`` of the template's own. Of windows that share half of their matched bigrams or more, the one with the most is the notice, and others of its family add their words to it. A
paragraph in which a family was predicted and that holds no part of a notice counts as unconfirmed.

Notices that are wrapped over several lines are looked for in the same way in windows that cross line feeds, over the words of
neighbouring lines that all hold words: marks of comments are no words, and a line without words ends a block. A notice's
line is that of its first matched word.

Too short for shares of bigrams are lines that name a licence and hold nothing else (``SHORT``), and SPDX tags, alone or inside
a line: these are notices by the equality of all their words. Their score is the classifier's for their family, of any height.

Scanning sends the model (its size is fixed) to all executors and reads every whole text once, without a shuffle. Null,
empty and wordless texts have no paragraphs; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import column
from rampwise.llm.langid import softmax
from rampwise.llm.minhash import mixed, words_at

WIDTH, BUCKETS, EPOCHS = 48, 1 << 14, 20
#: Words of the windows inside lines; they begin a third of their size apart, so that one of them holds any two thirds of it whole.
SIZES = (6, 8, 12, 18, 27, 36)
#: About how many documents' paragraphs the class of none is learned from, all of them.
SAMPLE = 400
FALSE_SHARE, CONFIRM = 0.002, 0.6
#: Bytes of text that are looked at together.
STRIPE = 2 << 20

#: The wording of licence notices, by SPDX family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
}
FAMILIES = ["", *TEMPLATES]

_CC = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: SPDX identifiers by family, and those that begin with another's words but are of no family here.
SPDX = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL-3.0": [f"GPL-3.0{x}" for x in ("", "-only", "-or-later")],
    "GPL-2.0": [f"GPL-2.0{x}" for x in ("", "-only", "-or-later")],
    "LGPL": [f"LGPL-{v}{x}" for v in ("2.0", "2.1", "3.0") for x in ("", "-only", "-or-later")],
    "AGPL-3.0": [f"AGPL-3.0{x}" for x in ("", "-only", "-or-later")],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"],
    "ISC": ["ISC"],
    "MPL-2.0": ["MPL-2.0"],
    "CC-BY": [f"CC-BY-{v}" for v in _CC],
    "CC-BY-SA": [f"CC-BY-SA-{v}" for v in _CC],
    "CC-BY-NC": [f"CC-BY-NC-{v}" for v in _CC],
    "CC0": ["CC0-1.0"],
    "Unlicense": ["Unlicense"],
    "": ["MIT-0", "MIT-CMU", "MIT-advertising", "MIT-enna", "MIT-feh"],
}
#: Further short names of each family.
NAMES = {
    "Apache-2.0": ["Apache 2", "Apache License 2.0", "Apache License, Version 2.0", "Apache v2", "Apache v2.0"],
    "GPL-3.0": [f"{a}{b}" for a in ("GPL", "GNU GPL", "GNU General Public License") for b in ("v3", " v3", " v3.0", " 3", " 3.0", ", version 3", ", version 3.0")],
    "GPL-2.0": [f"{a}{b}" for a in ("GPL", "GNU GPL", "GNU General Public License") for b in ("v2", " v2", " v2.0", " 2", " 2.0", ", version 2", ", version 2.0")],
    "LGPL": [f"{a}{b}" for a in ("LGPL", "GNU LGPL", "GNU Lesser General Public License") for b in ("", "v3", " v3", "v2.1", " v2.1", " 2.1", " 3.0")],
    "AGPL-3.0": [f"{a}{b}" for a in ("AGPL", "GNU AGPL", "GNU Affero General Public License") for b in ("v3", " v3", " v3.0", " 3.0", ", version 3")],
    "BSD": ["BSD", "New BSD", "Simplified BSD", "Modified BSD", "2-Clause BSD", "3-Clause BSD"],
    "MPL-2.0": ["MPL 2", "MPL v2", "MPL v2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC-BY": ["CC BY", *(f"Creative Commons Attribution {v}" for v in _CC)],
    "CC-BY-SA": ["CC BY-SA", *(f"Creative Commons Attribution-ShareAlike {v}" for v in _CC)],
    "CC-BY-NC": ["CC BY-NC", *(f"Creative Commons Attribution-NonCommercial {v}" for v in _CC)],
    "CC0": ["CC0"],
}
_FORMS = ("{} license", "{} licence", "the {} license", "the {} licence", "the {} license {}", "license {}", "licence {}", "licensed under {}", "licensed under the {}", "licensed under the {} license", "released under {}", "released under the {}")
#: Names that are words of other meaning when they stand alone.
_AMBIGUOUS = {"MIT", "ISC", "BSD"}
SHORT = {f: sorted({x for n in (*SPDX[f], *NAMES.get(f, [])) for x in (*([] if n in _AMBIGUOUS else [n]), *(form.format(n, n) for form in _FORMS))}) for f in TEMPLATES}
TAG = "SPDX-License-Identifier"

#: Lower-cases A-Z and turns all but line feeds and the bytes of words (0-9, a-z, 0x80 and above) to spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def bigrams(h: np.ndarray) -> np.ndarray:
    """The hash of each word with the next one; the last stands for itself."""
    out = h.copy()
    out[:-1] = mixed(h[:-1] * _PAIR + h[1:])
    return out


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def windows(hits: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of the windows of ``width`` words, a third of it apart, inside longer ranges of words that have ``least`` of the running number ``hits``."""
    own = np.flatnonzero((size > width) & (hits[start + size] - hits[start] >= least))
    n = -(-(size[own] - width) // (width // 3)) + 1
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(own, n)
    first = start[own] + np.minimum(k * (width // 3), size[own] - width)
    first = first[hits[first + width - 1] - hits[first] >= least]
    return first, np.full(len(first), width)


class Paragraphs:
    """The paragraphs of texts: ``h`` and ``pair`` of all words; per paragraph its first word, its size, its text and line."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).translate(_WORDS)
        self.h, starts = words_at(joined)
        feeds = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        line = np.searchsorted(feeds, starts)
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(line)])
        windows = np.maximum(1, -(-(size - WIDTH // 2) // (WIDTH // 2)))
        ends = np.cumsum(windows)
        k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - windows, windows)
        self.first = np.repeat(first, windows) + k * (WIDTH // 2)
        self.size = np.minimum(WIDTH, np.repeat(first + size, windows) - self.first)
        lines = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
        at = np.repeat(line[first], windows)
        self.heads, self.sizes = ends - windows, size
        self.text = np.searchsorted(lines, at, side="right") - 1
        self.line = at - lines[self.text]
        self.starts = first
        own = line[first] if len(first) else first
        text = np.searchsorted(lines, own, side="right") - 1
        self.blocks = np.flatnonzero(np.r_[True, (own[1:] != own[:-1] + 1) | (text[1:] != text[:-1])]) if len(own) else own
        self.pair = bigrams(self.h)
        self.total = None

    def part_of(self, word: np.ndarray) -> np.ndarray:
        """The paragraphs (of those of a line, the one that begins last) that words are in."""
        i = np.searchsorted(self.starts, word, side="right") - 1
        last = np.r_[self.heads[1:], len(self.first)] - 1
        return np.minimum(self.heads[i] + (word - self.starts[i]) // (WIDTH // 2), last[i])

    def inner(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and sizes of the windows that hold ``least`` bigrams of templates: those inside lines, and those that cross line feeds."""
        near = np.flatnonzero(_MARKED[slots(self.pair)])
        hits = np.zeros(len(self.pair) + 1, np.int64)
        hits[1 + near] = _ALL[np.minimum(np.searchsorted(_ALL, self.pair[near]), len(_ALL) - 1)] == self.pair[near]
        hits = np.cumsum(hits)
        stops = self.starts + self.sizes
        block_stops = stops[np.r_[self.blocks[1:], len(stops)] - 1] if len(stops) else stops
        several = block_stops > stops[self.blocks]
        start, size = self.starts[self.blocks][several], (block_stops - self.starts[self.blocks])[several]
        out = [(np.zeros(0, np.int64),) * 2]
        out += [windows(hits, self.starts, self.sizes, width, least) for width in SIZES]
        for width in (*SIZES, WIDTH):
            first, n = windows(hits, start, size, width, least)
            cross = first + n > stops[np.searchsorted(self.starts, first, side="right") - 1]
            out.append((first[cross], n[cross]))
        short = (size <= SIZES[0]) & (hits[start + size - 1] - hits[start] >= least)
        out.append((start[short], size[short]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def named(self) -> list[tuple[int, int, np.ndarray]]:
        """The notices that all their words make: family, paragraph and words."""
        out = []
        key = np.zeros(len(self.heads), np.uint64)
        start = self.first[self.heads]
        for n in range(1, _LONGEST + 1):
            own = np.flatnonzero(self.sizes >= n)
            key[own] = mixed(key[own] * _PAIR + self.h[start[own] + n - 1])
            some = own[(self.sizes[own] == n) & np.isin(key[own], _SHORT_KEYS)]
            out += [(_SHORT[int(key[i])], int(self.heads[i]), np.arange(start[i], start[i] + n)) for i in some.tolist()]
        for at in np.flatnonzero(self.h == _TAG[0]).tolist():
            i = int(np.searchsorted(start, at, side="right")) - 1
            end, to = int(start[i] + self.sizes[i]), at + len(_TAG)
            while to < end and self.h[at : at + len(_TAG)].tolist() == _TAG:
                keys = named_keys(self.h[to : min(end, to + _LONGEST)])
                n = max((n for n, x in enumerate(keys, 1) if x in _IDS), default=0)
                if n and _IDS[keys[n - 1]]:
                    part = min(self.heads[i] + (to - start[i]) // (WIDTH // 2), np.r_[self.heads, len(self.first)][i + 1] - 1)
                    out.append((_IDS[keys[n - 1]], int(part), np.r_[at : at + len(_TAG), to : to + n]))
                # of an expression, the identifiers after OR and AND; an unknown one has a few words
                joint = [j for j in range(to + n, min(end, to + n + (1 if n else _LONGEST))) if int(self.h[j]) in _JOINTS]
                if not joint:
                    break
                to = joint[0] + 1
        return out

    def logits(self, table: np.ndarray, bias: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The mean of each window's features' rows of ``table``, and the bias."""
        if self.total is None:
            self.total = np.zeros((len(self.h) + 1, table.shape[1]))
            np.cumsum(table[slots(self.h)] + table[slots(self.pair)], axis=0, out=self.total[1:])
        last = first + size - 1  # the pair that begins with a window's last word isn't of the window
        mean = self.total[last + 1] - self.total[first] - table[slots(self.pair[last])]
        return mean / np.maximum(1, 2 * size - 1)[:, None] + bias

    def bigrams(self, first: int, size: int) -> np.ndarray:
        """The bigrams of ``size`` words (the word, if it is only one)."""
        return self.pair[first : first + size - 1] if size > 1 else self.h[first : first + 1]

    def hashes(self, k: int) -> np.ndarray:
        """The distinct bigrams of paragraph k (its word, if it has only one)."""
        return np.unique(self.bigrams(self.first[k], self.size[k]))


def named_keys(h: np.ndarray) -> list[int]:
    """A hash of each of the first words' sequences."""
    out, key = [], np.zeros(1, np.uint64)
    for i in range(len(h)):
        key = mixed(key * _PAIR + h[i : i + 1])
        out.append(int(key[0]))
    return out


def _words(text: str) -> np.ndarray:
    return Paragraphs([text.encode()]).h


_SHORT = {named_keys(_words(x))[-1]: FAMILIES.index(f) for f, texts in SHORT.items() for x in texts}
_SHORT_KEYS = np.array(sorted(_SHORT), np.uint64)
_IDS = {named_keys(_words(x))[-1]: FAMILIES.index(f) for f, texts in SPDX.items() for x in texts}
_LONGEST = max(len(_words(x)) for texts in SHORT.values() for x in texts)
_TAG, _JOINTS = _words(TAG).tolist(), set(_words("or and").tolist())


def _sets(texts: list[str]) -> list[np.ndarray]:
    p = Paragraphs([t.encode() for t in texts])
    return [np.unique(np.concatenate([p.hashes(k) for k in np.flatnonzero(p.text == i)])) for i in range(len(texts))]


SETS = {family: _sets(texts) for family, texts in TEMPLATES.items()}
_ALL = np.unique(np.concatenate([s for own in SETS.values() for s in own]))


_MARKED = np.zeros(BUCKETS, bool)
_MARKED[slots(_ALL)] = True
#: The fewest bigrams that a window inside a line has in common with a template it holds.
_FEWEST = min(int(np.ceil(CONFIRM * len(s))) for own in SETS.values() for s in own)


def matched(own: np.ndarray, family: str, inner: bool = False) -> tuple[float, int, np.ndarray]:
    """Of the template of ``family`` that the bigrams ``own`` (three distinct ones at least) hold the largest share of: the share of
    the shorter one's bigrams (the template's, if ``inner``), the number of distinct common ones, and their places in ``own``."""
    n = len(np.unique(own))
    if n < 3:
        return 0.0, 0, np.zeros(0, np.int64)
    found = []
    for s in SETS[family]:
        at = np.flatnonzero(np.isin(own, s))
        common = len(np.unique(own[at]))
        found.append((common / (len(s) if inner else min(n, len(s))), common, at))
    return max(found, key=lambda f: f[:2])


def _examples(others: list[bytes], seed: int = 13) -> list[tuple[bytes, int]]:
    """Paragraphs and their class: variants of each template, and the others."""
    random = np.random.RandomState(seed)
    noise = [w for t in others for w in t.split()] or [b"and", b"of", b"one", b"zu", b"que"]
    out = [(t, 0) for t in others]
    for y, texts in enumerate(TEMPLATES.values(), 1):
        for text in texts:
            words = text.encode().split()
            for k in range(40):
                own = words
                if k % 4 == 1 and len(words) > 14:
                    n = random.randint(8, len(words))
                    at = random.randint(0, len(words) - n + 1)
                    own = words[at : at + n]
                if k % 4 >= 2:
                    own = [w for w in own if random.rand() > 0.08]
                if k % 4 == 3:
                    extra = [noise[random.randint(len(noise))] for _ in range(random.randint(1, 12))]
                    at = random.randint(0, len(extra) + 1)
                    own = [*extra[:at], *own, *extra[at:]]
                out.append((b" ".join(own[:WIDTH]), y))
            for _ in range(20):
                n = random.randint(10, 101)
                at, width = random.randint(0, n + 1), min((w for w in SIZES if w >= len(words)), default=WIDTH)
                line = [noise[random.randint(len(noise))] for _ in range(n)]
                line[at:at] = words
                start = random.randint(max(0, at + min(len(words), width) - width), min(at, len(line) - width) + 1) if len(line) > width else 0
                out.append((b" ".join(line[start : start + width]), y))
    for y, family in enumerate(TEMPLATES, 1):
        out += [(x.encode(), y) for x in (*SHORT[family], *(f"{TAG}: {i}" for i in SPDX[family]))]
    return out


class Model:
    """The table of each feature's logits, the bias, the temperature and the least score of a known family."""

    def __init__(self, others: list[bytes]):
        data = _examples(others)
        rows, random = [], np.random.RandomState(17)
        for text, y in data:
            p = Paragraphs([text])
            if len(p.h):
                rows.append((np.concatenate([slots(p.h), slots(p.pair[:-1])]), y))
        kept, back = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if k % 5 == 0]
        self.table, self.bias = np.zeros((BUCKETS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        at, steps = 0, EPOCHS * len(kept)
        for _ in range(EPOCHS):
            for k in random.permutation(len(kept)):
                slot, y = kept[k]
                rate, at = 1 - at / steps, at + 1
                g = softmax(self.table[slot].mean(axis=0) + self.bias)
                g[y] -= 1
                np.subtract.at(self.table, slot, (30 * rate / len(slot) * g).astype(np.float32))
                self.bias -= 0.05 * rate * g
        logits, truth = np.array([self.table[s].mean(axis=0) + self.bias for s, _ in back]), np.array([y for _, y in back])
        fits = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
        self.temperature = float(min(fits, key=fits.get))
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        none = np.where(best == 0, 0.0, p.max(axis=1))[truth == 0]
        self.least = max(0.5, float(np.quantile(none, 1 - FALSE_SHARE))) if len(none) else 0.5
        self.accuracy = float((best == truth).mean())

    def scan(self, texts: list[bytes]) -> list[dict]:
        """Of each text: the number of its paragraphs, those with a confirmed licence, and the number of unconfirmed ones."""
        own = Paragraphs(texts)
        out = [{"n_paragraphs": int(n), "found": [], "n_unconfirmed": 0} for n in np.bincount(own.text, minlength=len(texts))]
        if not len(own.first):
            return out
        first, size = (np.concatenate(x) for x in zip((own.first, own.size), own.inner(_FEWEST), strict=True))
        part = np.r_[np.arange(len(own.first)), own.part_of(first[len(own.first) :])]
        p = softmax(own.logits(self.table, self.bias, first, size) / self.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
        known = np.flatnonzero((best > 0) & (score >= self.least))
        notices = [(-np.inf, -1.0, -float(p[k, y]), int(at[0]), -int(at[-1]), y, k, at) for y, k, at in own.named()]
        for k in known.tolist():
            share, common, at = matched(own.bigrams(first[k], size[k]), FAMILIES[best[k]], k >= len(own.first))
            if share >= CONFIRM:
                notices.append((-common, -share, -float(score[k]), int(first[k]), k, int(best[k]), int(part[k]), first[k] + at))
        taken, part_of_one, found = np.zeros(len(own.h), np.int64), np.zeros(len(own.h), bool), []
        for common, share, minus, _, _, y, k, at in sorted(notices, key=lambda x: x[:5]):
            part_of_one[at if common == -np.inf else np.r_[at, at + 1]] = True  # a bigram is two words
            if common > -np.inf and 2 * (taken[at] > 0).sum() >= len(at):
                if np.bincount(taken[at])[1:].argmax() + 1 == y:
                    taken[at[taken[at] == 0]] = y  # the same notice, further on
            else:
                taken[at] = y
                found.append((int(at[0]), int(at[-1]), y, k, -minus, -share))
        for at, _, y, k, own_score, share in sorted(found):
            out[own.text[k]]["found"].append({"family": FAMILIES[y], "line": int(own.line[own.part_of(np.int64(at))]), "score": own_score, "similarity": float(share)})
        ends = (own.starts + own.sizes)[np.searchsorted(own.starts, first[known], side="right") - 1]
        for k in np.unique(part[known[first[known] + size[known] <= ends]]).tolist():  # of windows across lines, each line is judged alone
            if not part_of_one[own.first[k] : own.first[k] + own.size[k]].any():
                out[own.text[k]]["n_unconfirmed"] += 1
        return out


def _others(frames):
    for pdf in frames:
        out = []
        for text in pdf["text"].tolist():
            for words in map(bytes.split, text.translate(_WORDS).split(b"\n")):
                for own in (words[i : i + WIDTH] for i in range(0, len(words), WIDTH)):
                    if not len(np.intersect1d(Paragraphs([b" ".join(own)]).hashes(0), _ALL)):
                        out.append(b" ".join(own))
        yield pd.DataFrame({"text": out})


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """The model of the templates and of all paragraphs of about ``sample`` documents, those whose texts have the smallest hashes.

    A count gives the hash to cut at, so that no texts meet in one task; texts of equal hash go together.
    """
    own = docs.select(column(text_col).cast("binary").alias("text")).filter("length(text) > 0").withColumn("h", F.xxhash64("text"))
    n = own.count()
    least = F.lit(2.0**64 * sample / max(n, 1) - 2.0**63)
    chosen = (own.filter(F.col("h") <= least) if n > sample else own).select("text").mapInPandas(_others, "text binary").distinct()
    return Model(sorted({bytes(r[0]) for r in chosen.collect()}))


def scan(docs: DataFrame, model: Model, text_col: str = "text", to: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``to``, which replaces a column of that name: n_paragraphs, found (family, line, score, similarity), n_unconfirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_paragraphs long, found array<struct<family string, line long, score double, similarity double>>, n_unconfirmed long")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out, held, n = [], [], 0
        for t in texts:
            held.append(t if t is not None else b"")
            n += len(held[-1])
            if n >= STRIPE:
                out += shared.value.scan(held)
                held, n = [], 0
        out += shared.value.scan(held) if held else []
        return pd.DataFrame(out, columns=["n_paragraphs", "found", "n_unconfirmed"])

    return docs.select(*(column(c) for c in docs.columns if c.lower() != to.lower()), scanned(column(text_col).cast("binary")).alias(to))
