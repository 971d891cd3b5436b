import random
import re

import pytest

from sward.llm.license_texts import LIBRARY, TEMPLATES
from sward.llm.licenses import SHARE, SHINGLE, scan
from llm_cases import edge, none, small  # noqa: F401


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)


def _shingles(words):
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _expected(text):
    """Every window of every size class against every template, by exact containment."""
    found, out = _shingles(_words(text)), {}
    for name, texts in TEMPLATES.items():
        for template in texts:
            own = _shingles(_words(template))
            span = 1 << (len(own) - 1).bit_length()
            for first in range(0, max(len(found), 1), span):
                part = found[first : first + 2 * span]
                if len(set(part) & set(own)) / len(set(own)) >= SHARE:
                    at = [i for i, s in enumerate(part) if s in set(own)]
                    out.setdefault(name, []).append((first + at[0], first + at[-1] + SHINGLE))
    merged = []
    for name, spans in out.items():
        ends = []
        for a, b in sorted(set(spans)):
            if ends and a < ends[-1][1]:
                ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
            else:
                ends.append((a, b))
        merged += [(a, name, b) for a, b in ends]
    return [(n, a, b) for a, n, b in sorted(merged)]


@pytest.fixture(scope="module")
def notices(spark):
    rng = random.Random(5)
    flat = [t for texts in TEMPLATES.values() for t in texts]
    filler = "some plain words that stand between notices and under the terms of nothing".split()
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(flat).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = "edited"
            parts += [rng.choice(filler) for _ in range(rng.randint(0, 80))] + words
        rows.append((i, "  ".join(parts)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_all_windows(notices, small, edge):
    seen = 0
    for docs in (notices, small, edge):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r["doc_id"], set()).add(str(_expected(r["text"])))
        for r in scan(docs).collect():
            found = [(m["license"], m["start"], m["end"]) for m in r["found"]]
            assert str(found) in texts[r["doc_id"]]
            seen += len(found)
    assert seen > 100


def test_empty_table(none):
    assert scan(none).count() == 0


def test_versions_and_families(spark):
    gpl = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 7.", None),
        (gpl.format("This program", "", 2), "GPL-2.0"), (gpl.format("This program", "", 3), "GPL-3.0"),
        (gpl.format("This library", "Lesser ", "2.1"), "LGPL-2.1"), (gpl.format("This program", "Affero ", 3), "AGPL-3.0"),
        ("Licensed under the MIT License.", "MIT"), ("Available under the Eclipse Public License v2.0", "EPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        (LIBRARY["BSD-2-Clause"][0], "BSD-2-Clause"), (LIBRARY["BSD-3-Clause"][0], "BSD-3-Clause"),
        *[(LIBRARY[name][-1], name) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "MPL-1.1", "Apache-2.0")],
    ]
    docs = spark.createDataFrame([(i, f"some words before {text} and after") for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: {m["license"] for m in r["found"]} for r in scan(docs, best=True).collect()}
    assert [found[i] for i in range(len(cases))] == [{name} if name else set() for _, name in cases]
