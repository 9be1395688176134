"""Licences outside the families, blocks of many lines, and findings against a plain search of all windows."""

import random
import time

import pytest

from corvane.llm import licences, queries
from corvane.llm.licences import TEMPLATE_GRAMS, WINDOWS, block_findings, compared, grams, words_of

OTHER = [
    "Licensed under the Eclipse Public License 2.0", "Licensed under the Artistic License 2.0", "released under the zlib license", "This is licensed under the zlib/libpng license", "Distributed under the Boost Software License, Version 1.0",
    "This is free and unencumbered software released into the public domain.", "Licensed under the EUPL v1.2", "European Union Public Licence v. 1.2", "a BSD-style license", "Licensed under the CeCILL license version 2.1", "the license of the driver",
]
KNOWN = {
    "mit": "made available under the MIT licence", "gpl": "GNU GENERAL PUBLIC LICENSE Version 2", "lgpl": "licensed under the GNU Lesser General Public License, version 3", "isc": "Released under the ISC licence.", "cc-by-nc": "CC BY-NC 4.0",
    "proprietary": "(c) 2020. All rights reserved.", "mpl": "Licensed under the MPL 2.0",
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def block(text):
    return [(i, words_of(line.encode())) for i, line in enumerate(text.split("\n"))]


def test_other_licences_are_unknown_and_known_ones_confirmed(model):
    for text in OTHER:
        assert not [x for x in block_findings(model, block(text), 0.6) if x["confirmed"]], text
    for family, text in KNOWN.items():
        assert [x["family"] for x in block_findings(model, block(text), 0.6) if x["confirmed"]] == [family], text
    assert model.least > 0.1


def test_a_block_of_many_notices_takes_seconds(model):
    start = time.monotonic()
    found = block_findings(model, [(i, words_of(b"Licensed under the MIT License and more")) for i in range(8000)], 0.6)
    assert time.monotonic() - start < 20 and len(found) == 8000 and all(x["confirmed"] for x in found)


def plain_windows(words, size, template, least):
    """Each maximal stretch of windows over ``least``, its best window, cut to the words that count."""
    shares = [len(grams(words[max(0, e - size) : e]) & template) / len(template) for e in range(1, len(words) + 1)]
    out, best = [], None
    for end, share in enumerate(shares, 1):
        if share >= least and (best is None or share > best[0]):
            best = (share, max(0, end - size), end)
        if best and (end == len(words) or end - size >= best[2] - 1 or share < least):
            share, a, b = best
            enough = lambda a, b: len(grams(words[a:b]) & template) >= share * len(template) - 1e-9  # noqa: B023, E731
            a = max(x for x in range(a, b) if enough(x, b))
            b = min(y for y in range(a + 1, b + 1) if enough(a, y))
            out.append((share, a, b))
            best = None
    return out


def plain_findings(model, block, confirm):
    """As ``block_findings``, with every stretch compared with all others."""
    words = [w for _, ws in block for w in ws]
    place = [i for i, (_, ws) in enumerate(block) for _ in ws]
    offset = [sum(len(ws) for _, ws in block[:i]) for i in range(len(block))]
    lines, taken, more, candidates = [], [], [], []
    for i, (number, ws) in enumerate(block):
        if not model.telling.isdisjoint(ws) and (said := model.judge(ws)):
            family, chance, share, own = said
            assert (share, own) == compared(family, ws)
            lines.append([i, family, chance, share, share >= confirm and own, number])
            if lines[-1][4]:
                cores = [c for f, n, t in WINDOWS if f == family for c in plain_windows(ws, n + max(2, n // 4), t, confirm)]
                _, a, b = max(cores, default=(0, 0, len(ws)))
                taken.append((offset[i] + a, offset[i] + b))
    if model.telling.isdisjoint(words):
        return []
    for f, n, t in WINDOWS:
        candidates += [(share, b - a, f, a, b) for share, a, b in plain_windows(words, n + max(2, n // 4), t, confirm)]
    for share, _, f, a, b in sorted(candidates, key=lambda c: (-c[0], -c[1], c[3], c[2])):
        if any(2 * (min(b, y) - max(a, x)) > min(b - a, y - x) for x, y in taken):
            continue
        said = model.judge(words[a:b]) or model.among_known(words[a:b])
        if said and said[0] == f and said[3]:
            taken.append((a, b))
            lines = [x for x in lines if x[4] or x[1] != f or not place[a] <= x[0] <= place[b - 1]]
            more.append([place[a], f, said[1], share, True, block[place[a]][0]])
    return [tuple(x[1:]) for x in sorted(lines + more, key=lambda x: (x[0], x[1]))]


def test_blocks_against_the_plain_search(model):
    r = random.Random(3)
    notices = [n for ns in licences.TEMPLATES.values() for n in ns] + OTHER
    some = sorted({w.decode() for ts in TEMPLATE_GRAMS.values() for t in ts for (w, *rest) in t if not rest})
    for _ in range(60):
        words = []
        for _ in range(r.randrange(1, 6)):
            own = r.choice(notices).split()
            words += [w for w in own if r.random() > 0.1] + r.choices(some, k=r.randrange(4)) + ["quite"] * r.randrange(5)
        text = "".join(w + ("\n" if r.random() < 0.15 else " ") for w in words)
        own = [(i, ws) for i, ws in block(text) if ws]
        found = [(x["family"], x["chance"], x["share"], x["confirmed"], x["line"]) for x in block_findings(model, own, 0.6)]
        assert found == plain_findings(model, own, 0.6), text


def test_query_against_the_plain_search(spark, sf="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    own = licences.model(docs)
    rows = {r.doc_id: r for r in queries.op5_licences(spark, sf).collect()}
    for r in docs.collect():
        want, some = [], []
        for i, ws in [*block(r.text or ""), (0, [])]:
            if ws:
                some.append((i, ws))
            elif some:
                want, some = want + [x for x in plain_findings(own, some, 0.6) if x[3]], []
        assert rows[r.doc_id].lines == [f"{x[4]}:{x[0]}" for x in want]
        assert rows[r.doc_id].families == ",".join(sorted({x[0] for x in want}))
