"""Licence notices among other words."""

import textwrap

import numpy as np
import pandas as pd
import pytest

from rampwise.llm import licenses

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def others():
    texts = [(t or "").encode() for t in pd.read_parquet(f"{SF}/documents.parquet")["text"]]
    return sorted({bytes(t) for pdf in licenses._others([pd.DataFrame({"text": texts})]) for t in pdf["text"]})


@pytest.fixture(scope="module")
def model(others):
    return licenses.Model(others)


def families(model, text):
    return {x["family"] for x in model.scan([text])[0]["found"]}


@pytest.mark.parametrize("n", [10, 20, 40, 100])
def test_notices_inside_lines(model, others, n):
    words, random = [w for t in others for w in t.split()], np.random.RandomState(n)
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for _ in range(3):
                k, at = random.randint(len(words) - n), random.randint(0, n + 1)
                line = words[k : k + n]
                assert families(model, b" ".join(line)) == set()
                line[at:at] = text.encode().split()
                assert families(model, b" ".join(line)) == {family}


@pytest.mark.parametrize(("columns", "mark"), [(40, ""), (40, "# "), (60, " * "), (76, "// ")])
def test_notices_wrapped_over_lines(model, others, columns, mark):
    before, after = (b" ".join(others[k].split()[:8]).decode("utf8", "ignore") for k in (0, 1))
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            lines = [mark + x for x in (before, *textwrap.wrap(text, columns, break_on_hyphens=False), after)]
            got = model.scan(["\n".join(lines).encode()])[0]
            assert {x["family"] for x in got["found"]} == {family} and got["n_unconfirmed"] == 0, (text, got)
            assert got["found"][0]["line"] in (1, 2)
            # a line without words ends the block, as does the end of a text
            head, tail = lines[: len(lines) // 2], lines[len(lines) // 2 :]
            texts_apart = ["\n".join(x).encode() for x in (head, tail)]
            one, two = model.scan(texts_apart)
            apart = model.scan([b"\n".join([texts_apart[0], mark.encode(), texts_apart[1]])])[0]
            want = [(x["family"], x["line"]) for x in one["found"]] + [(x["family"], x["line"] + len(head) + 1) for x in two["found"]]
            assert [(x["family"], x["line"]) for x in apart["found"]] == want
            assert [one["n_paragraphs"], two["n_paragraphs"]] == [len(head), len(tail)]
            assert apart["n_unconfirmed"] == one["n_unconfirmed"] + two["n_unconfirmed"]
    assert families(model, "\n".join(mark + x for x in (before, after, before)).encode()) == set()


def test_notices_side_by_side(model):
    line = b"Released under the MIT License. Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."
    got = model.scan([b"first line\n" + line])[0]
    assert {(x["family"], x["line"]) for x in got["found"]} == {("MIT", 1), ("Apache-2.0", 1), ("CC-BY-NC", 1)}
    assert len(got["found"]) == 3 and got["n_unconfirmed"] == 0


@pytest.mark.parametrize(
    ("text", "family"),
    [("MIT License", "MIT"), ("License: MIT", "MIT"), ("CC0 1.0", "CC0"), ("ISC License", "ISC"), ("GNU GPL v3", "GPL-3.0"), ("BSD-3-Clause", "BSD"), ("LGPLv3", "LGPL"), ("CC BY-NC 4.0", "CC-BY-NC")],
)
def test_short_notices_alone(model, text, family):
    got = model.scan([b"first line\n// " + text.encode() + b"\nlast line"])[0]
    assert [(x["family"], x["line"], x["similarity"]) for x in got["found"]] == [(family, 1, 1.0)] and got["n_unconfirmed"] == 0


def test_every_short_notice(model):
    for family, texts in licenses.SHORT.items():
        for text in texts:
            assert families(model, text.encode()) == {family}, text


def test_spdx_tags(model, others):
    noise = b" ".join(others[0].split()[:20])
    for family, names in licenses.SPDX.items():
        for name in names:
            tag = b"SPDX-License-Identifier: " + name.encode()
            for text in (tag, b"/* " + tag + b" */", noise + b" " + tag + b" " + noise):
                assert families(model, text) == ({family} - {""}), text
    assert families(model, b"SPDX-License-Identifier: Zlib") == set()
    assert families(model, b"SPDX-License-Identifier: Zlib OR (GPL-2.0-or-later AND MIT)") == {"GPL-2.0", "MIT"}
    assert families(model, b"komm mit") == families(model, b"mit") == families(model, b"license") == set()
