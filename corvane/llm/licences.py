"""Licence scans: a trained paragraph classifier with template comparison.

A paragraph is a line of a text. Its features are the word uni- and bigrams of the
families' templates that hold a telling word; softmax regression over them gives one
of the families or ``unknown``. It is trained on varied templates and on at most
``most`` paragraphs of the corpus that resemble no template, chosen evenly, calibrated by one
temperature on samples that training did not see, and the chance from which a family is
accepted is set there too. Which words are telling is decided by counts over all lines of
all documents that resemble no template. An accepted prediction is confirmed if enough of one of the
family's templates is found in the paragraph, and with it half of what that template
shares with no other family. Lines without a telling word have no
feature and are ``unknown`` without being scored one by one.

Notices that go over several lines, or name several families, are found by windows of
about a template's length over the words of consecutive lines that are not blank. A
window that holds enough of a template and that the classifier gives to its family (or,
if to none, finds likeliest to be of it, given something that family alone has) is a
confirmed finding at the line where it begins, unless a better one covers most of it.

Defined results: null and empty texts have no findings; texts are scanned whole; rows
are judged one by one, so repeated rows repeat their findings; an empty table gives an
empty one; without corpus paragraphs the varied templates alone train. A column that has
the name of the new one is replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import alnum_words, map_arrow, texts, tidy, with_columns

# Usual short notices of each family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL-3.0."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.", "Dedicated to the public domain under CC0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL-3.0."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0."],
    "proprietary": ["Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Notices of licences that are none of these families, all of them ``unknown``.
OTHERS = [
    "Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Artistic License 2.0.", "This package is free software under the Artistic License.", "Released under the zlib License.", "This software is provided as is, without any express or implied warranty",
    "Distributed under the Boost Software License, Version 1.0.", "This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "Licensed under the EUPL, Version 1.2.",
    "Licensed under the European Union Public Licence, version 1.2.", "Do what the fuck you want to public license, version 2.", "Licensed under the Common Development and Distribution License, Version 1.0.", "Released under the PostgreSQL License.",
    "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License.", "Licensed under the Open Software License version 3.0.", "Released under the Python Software Foundation License.",
    "Licensed under the Academic Free License version 3.0.", "This work is licensed under the GNU Free Documentation License, version 1.3.", "Licensed under the Mulan PSL v2.", "Licensed under the Open Database License.", "Licensed under the Business Source License 1.1.",
    "Licensed under the Server Side Public License, version 1.", "Licensed under the Universal Permissive License, Version 1.0.", "Released under the Vim License.", "Licensed under the Ruby License.", "Released under the Beerware License.", "Licensed under the NCSA Open Source License.",
]
UNKNOWN = "unknown"
#: Fixed: spellings that count as one.
SPELT = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed"}
CLASSES = (*TEMPLATES, UNKNOWN)


def words_of(line: bytes) -> list[bytes]:
    """The words of a line, those with two spellings in one of them."""
    return [SPELT.get(w, w) for w in alnum_words(line)]


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {*((w,) for w in words), *zip(words, words[1:])}


def varied(seed: int, copies: int, filler: list[bytes], notices: dict[str, list[str]] = TEMPLATES) -> list[tuple[list[bytes], int]]:
    """Labelled paragraphs: notices with words dropped, others around them."""
    rng = np.random.default_rng(seed)
    out = []
    for family, some in notices.items():
        for notice in some:
            words = words_of(notice.encode())
            for i in range(copies):
                # short notices say their family in one or two words, so they are varied around, not inside
                kept = [w for w in words if i % 2 == 0 or len(words) < 12 or rng.random() > 0.1]
                around = [filler[x] for x in rng.integers(0, len(filler), rng.integers(0, 12))] if filler else []
                at = rng.integers(0, len(around) + 1)
                out.append((around[:at] + kept + around[at:], CLASSES.index(family)))
    return out


@dataclass
class Model:
    features: dict[tuple[bytes, ...], int]
    telling: frozenset
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def rows(self, paragraphs: Iterable[list[bytes]]) -> np.ndarray:
        x = np.zeros((len(paragraphs), len(self.features)), np.float32)
        for r, words in enumerate(paragraphs):
            x[r, [self.features[g] for g in grams(words) if g in self.features]] = 1
        return x

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def judge(self, words: list[bytes]) -> tuple[str, float, float, bool] | None:
        """Family, its chance, and ``compared`` with its templates; None if unknown."""
        if self.telling.isdisjoint(words):
            return None
        p = self.chances(self.rows([words]))[0]
        i = int(p[:-1].argmax())
        if p[i] < self.least or p[i] < p[-1]:
            return None
        return CLASSES[i], float(p[i]), *compared(CLASSES[i], words)

    def among_known(self, words: list[bytes]) -> tuple[str, float, float, bool] | None:
        """As ``judge`` where the words are known to hold a template; None if they lack what is that family's alone."""
        if self.telling.isdisjoint(words):
            return None
        p = self.chances(self.rows([words]))[0]
        family = CLASSES[int(p[:-1].argmax())]
        share, own = compared(family, words)
        return (family, float(p[:-1].max() / p[:-1].sum()), share, own) if own else None


def compared(family: str, words: list[bytes]) -> tuple[float, bool]:
    """The share of the family's best template that is there, and whether half of what that template has alone is.

    Templates with that half go first: a notice of another licence may share all the rest.
    """
    here = grams(words)
    found = [(len(here & t) / len(t), 2 * len(here & t & OWN_GRAMS[family]) >= max(1, len(t & OWN_GRAMS[family]))) for t in TEMPLATE_GRAMS[family]]
    return max((f for f in found if f[1]), default=max(found))


TEMPLATE_GRAMS = {f: [grams(words_of(t.encode())) for t in notices] for f, notices in TEMPLATES.items()}


#: Grams that one family's templates alone have.
OWN_GRAMS = {f: set().union(*ts) - set().union(*(t for g, others in TEMPLATE_GRAMS.items() if g != f for t in others)) for f, ts in TEMPLATE_GRAMS.items()}
#: The number of words of each template beside its grams.
WINDOWS = [(f, len(words_of(t.encode())), g) for f, notices in TEMPLATES.items() for t, g in zip(notices, TEMPLATE_GRAMS[f], strict=True)]


def _best_windows(words: list[bytes], size: int, template: set[tuple[bytes, ...]], least: float) -> list[tuple[float, int, int]]:
    """(share, from, to) of the windows of ``size`` words that hold most of the template: one for each stretch over ``least``.

    Words at its ends that add nothing are not counted in.
    """
    held: dict[tuple[bytes, ...], int] = {}
    out, best = [], None
    for end in range(1, len(words) + 1):
        start = end - size
        # the bigrams that begin at the word before the last are complete now
        new = [tuple(words[end - 1 : end]), *([tuple(words[end - 2 : end])] if end > 1 and size > 1 else [])]
        for g in new:
            if g in template:
                held[g] = held.get(g, 0) + 1
        if start > 0:
            for g in (tuple(words[start - 1 : start]), tuple(words[start - 1 : start + 1])):
                if g in template:
                    held[g] -= 1
                    if not held[g]:
                        del held[g]
        share = len(held) / len(template)
        if share >= least and (best is None or share > best[0]):
            best = (share, max(0, start), end)
        if best and (end == len(words) or start >= best[2] - 1 or share < least):
            share, a, b = best
            while len(grams(words[a + 1 : b]) & template) >= share * len(template) - 1e-9:
                a += 1
            while len(grams(words[a : b - 1]) & template) >= share * len(template) - 1e-9:
                b -= 1
            out.append((share, a, b))
            best = None
    return out


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(classes, dtype=np.float32)[y]
    for step in range(1, steps + 1):
        z = x @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - hot) / len(x)
        g = x.T @ d + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 2 * d.sum(0)
    return w, b


#: Fixed: function words.
SHORT = frozenset(b"the a an of in to and or is it this for by with are be that all any under".split())
#: The templates' words that may tell a notice from other lines.
TOLD = sorted({w for ts in TEMPLATE_GRAMS.values() for t in ts for (w, *rest) in t if not rest and w not in SHORT})


def is_plain(words: list[bytes]) -> bool:
    """The line resembles no template."""
    here = grams(words)
    return all(len(here & t) / len(t) < 0.3 for ts in TEMPLATE_GRAMS.values() for t in ts)


@dataclass
class Corpus:
    paragraphs: list[list[bytes]]
    plain: int  # lines of all documents that resemble no template, a document's equal ones once
    df: dict[bytes, int]  # in how many of these each word of ``TOLD`` is


def corpus(docs: DataFrame, text: str = "text", most: int = 5_000) -> Corpus:
    """At most ``most`` lines of the documents, of each value of a hash the least by another one, and counts over all lines.

    Lines of more than 2,000 bytes are counted but don't serve as samples.
    """
    number = {w: i for i, w in enumerate(TOLD)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, bytes]] = {}
        counts = np.zeros(len(TOLD) + 1, np.int64)
        for batch in batches:
            for t in texts(batch["text"]):
                for line in set(t.split(b"\n")):
                    words = words_of(line)
                    here = number.keys() & set(words)
                    if words and (not here or is_plain(words)):
                        counts[-1] += 1
                        for w in here:
                            counts[number[w]] += 1
                    if line and len(line) <= 2000:
                        h, rank = xxhash.xxh64_intdigest(line) % most, xxhash.xxh64_intdigest(line, 1) >> 1
                        if h not in best or (rank, line) < best[h]:
                            best[h] = (rank, line)
        h = [*best, *range(-1, -2 - len(TOLD), -1)]  # below 0 the counts
        none = [None] * len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([*(r for r, _ in best.values()), *none], pa.int64()), pa.array([*(x for _, x in best.values()), *none], pa.binary()), pa.array([*([0] * len(best)), *counts.tolist()], pa.int64())], ["h", "rank", "line", "c"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "h long, rank long, line binary, c long").groupBy("h").agg(F.min_by("line", F.struct("rank", "line")).alias("line"), F.sum("c").alias("c")).collect()
    counts = {-1 - r.h: r.c for r in rows if r.h < 0}
    return Corpus([words_of(bytes(r.line)) for r in sorted(rows, key=lambda r: r.h) if r.h >= 0], counts.get(len(TOLD), 0), {w: counts.get(i, 0) for w, i in number.items()})


def train(found: Corpus, copies: int = 30, common: float = 0.01, precision: float = 0.99) -> Model:
    """Fit on one half of the samples, calibrate on the other.

    ``unknown`` has corpus lines, words of templates alone, and notices of other licences;
    those that calibrate are of licences that the fit has not seen. The bound is the least
    chance down to which acceptances are right in a share of ``precision``. Beside the
    samples it is set on the families themselves: a quarter of them is left out of a fit
    at a time, and what that fit makes of their notices must be rejected; these count as
    much as the notices of other licences. Words around the notices come from 500 of the
    sampled lines.
    """
    plain = [p for p in found.paragraphs if is_plain(p)]
    filler = sorted({w for p in plain[:500] for w in p})
    every = {g for ts in TEMPLATE_GRAMS.values() for t in ts for g in t}
    telling = frozenset(w for w, n in found.df.items() if n <= common * max(1, found.plain))
    features = {g: i for i, g in enumerate(sorted(g for g in every if telling & set(g)))}
    model = Model(features, telling, np.zeros((len(features), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32))
    half = len(plain) // 2
    unknown = len(CLASSES) - 1

    def samples(seed: int, some: list[list[bytes]], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = varied(seed, copies, filler) + [(p, unknown) for p in some] + varied(seed + 5, copies, filler, {UNKNOWN: others})
        # single telling words say little: parts of templates are unknown
        rng = np.random.default_rng(seed + 9)
        words = sorted(telling)
        rows += [([*(filler[i] for i in rng.integers(0, len(filler), 6)), words[rng.integers(len(words))]] if filler else [words[rng.integers(len(words))]], unknown) for _ in range(20 * copies if words else 0)]
        return model.rows([r for r, _ in rows]), np.array([c for _, c in rows])

    x, y = samples(1, plain[:half], OTHERS[::2])
    model.weights, model.bias = _softmax_fit(x, y, len(CLASSES))
    held, h = samples(2, plain[half:], OTHERS[1::2])
    best = None
    for t in np.geomspace(0.5, 8, 25):
        model.temperature = float(t)
        loss = -np.log(np.maximum(model.chances(held)[np.arange(len(h)), h], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]

    def judged(by: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest family's chance, 0 where ``unknown`` is likelier, and that family."""
        p = by.chances(x)
        top = p[:, :-1].max(1)
        return np.where(top >= p[:, -1], top, 0), p[:, :-1].argmax(1)

    top, family = judged(model, held)
    found_top, right = [top], [family == h]
    for part in range(4):
        gone = np.isin(y, np.arange(part, unknown, 4))
        without = Model(features, telling, *_softmax_fit(x[~gone], y[~gone], len(CLASSES), steps=100), model.temperature)
        top, _ = judged(without, held[np.isin(h, np.arange(part, unknown, 4))][::10])
        found_top.append(top)
        right.append(np.zeros(len(top), bool))
    top, right = np.concatenate(found_top), np.concatenate(right)
    for least in np.linspace(0.99, 0.05, 95):  # from above, down to where acceptances begin to be wrong
        said = top >= least
        if said.any() and right[said].mean() < precision:
            break
        model.least = float(least)
    return model


class _Taken:
    """Stretches of words, looked up by the places that they cover."""

    def __init__(self, size: int = 64):
        self.size, self.at = size, {}

    def add(self, a: int, b: int) -> None:
        for k in range(a // self.size, (b - 1) // self.size + 1):
            self.at.setdefault(k, []).append((a, b))

    def covers(self, a: int, b: int) -> bool:
        """Whether some stretch and this one share most of the shorter of both."""
        return any(2 * (min(b, y) - max(a, x)) > min(b - a, y - x) for k in range(a // self.size, (b - 1) // self.size + 1) for x, y in self.at.get(k, ()))


def block_findings(model: Model, block: list[tuple[int, list[bytes]]], confirm: float) -> list[dict]:
    """Findings in consecutive lines (number, words): of each line, then of windows over all words.

    A window is as long as a template and spans few lines, so work follows the words.
    """
    telling = [i for i, (_, words) in enumerate(block) if not model.telling.isdisjoint(words)]
    if not telling:
        return []
    words = [w for _, ws in block for w in ws]
    starts = np.cumsum([0, *(len(ws) for _, ws in block)])
    lines, taken, more = {}, _Taken(), []

    def finding(line: int, family: str, chance: float, share: float, own: bool) -> dict:
        return {"line": line, "family": family, "chance": chance, "share": share, "confirmed": share >= confirm and own}

    for i in telling:
        if said := model.judge(block[i][1]):
            lines[i] = finding(block[i][0], *said)
            if lines[i]["confirmed"]:  # the words that say so; others of the line may tell of another family
                cores = [c for f, n, t in WINDOWS if f == said[0] for c in _best_windows(block[i][1], n + max(2, n // 4), t, confirm)]
                _, a, b = max(cores, default=(0, 0, len(block[i][1])))
                taken.add(int(starts[i]) + a, int(starts[i]) + b)
    here, candidates = grams(words), []
    for family, n, t in WINDOWS:
        if len(here & t) >= confirm * len(t):
            candidates += [(share, b - a, family, a, b) for share, a, b in _best_windows(words, n + max(2, n // 4), t, confirm)]
    for share, _, family, a, b in sorted(candidates, key=lambda c: (-c[0], -c[1], c[3], c[2])):
        if taken.covers(a, b):
            continue
        said = model.judge(words[a:b]) or model.among_known(words[a:b])
        if said and said[0] == family and said[3]:
            taken.add(a, b)
            i = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, b - 1, "right")) - 1
            for k in range(i, last + 1):
                if k in lines and not lines[k]["confirmed"] and lines[k]["family"] == family:
                    del lines[k]
            more.append((i, finding(block[i][0], family, said[1], share, True)))
    return [x for _, x in sorted([*lines.items(), *more], key=lambda x: (x[0], x[1]["family"]))]


def licence_findings(docs: DataFrame, model: Model, text: str = "text", found: str = "licences", confirm: float = 0.6) -> DataFrame:
    """Add ``found``: struct(line, family, chance, share, confirmed) of each paragraph of a known family."""
    docs = docs.drop(found)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = {"line": pa.int32(), "family": pa.string(), "chance": pa.float64(), "share": pa.float64(), "confirmed": pa.bool_()}
    kind = pa.list_(pa.struct(list(fields.items())))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, out = sent.value, []
        for t in texts(batch[text]):
            own, block = [], []
            for i, line in enumerate((*t.split(b"\n"), b"")):
                words = words_of(line)
                if words:
                    block.append((i, words))
                elif block:
                    own += block_findings(model, block, confirm)
                    block = []
            out.append(own)
        return with_columns(batch, **{found: pa.array(out, kind)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, per_batch, f"{schema}, `{found}` array<struct<line:int,family:string,chance:double,share:double,confirmed:boolean>>")


def families(found: str = "licences") -> Column:
    """The confirmed families, sorted and joined by commas."""
    confirmed = F.filter(found, lambda x: x["confirmed"])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))), ",")


def model(docs: DataFrame, text: str = "text", most: int = 5_000) -> Model:
    return train(corpus(docs, text, most))
