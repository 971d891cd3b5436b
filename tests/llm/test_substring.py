import random
import re
from collections import Counter

import pytest

from sward.llm import substring
from sward.llm.substring import COVER, PERIOD, WINDOW, remove_repeats
from llm_cases import edge, none, small  # noqa: F401


def _expected(rows):
    """Rows by id (null last) and text hash order are settled by the caller: ids are unique here."""
    seen, out = set(), []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            if key in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(key)
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def test_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("held", [1 << 22, 200])
def test_dense_repeats(spark, held, monkeypatch):
    monkeypatch.setattr(substring, "HELD", held)
    rng = random.Random(held)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(120, " ".join(["x"] * 200)), (121, " ".join(["x"] * 19)), (122, None), (123, " ".join(["x", "y"] * 40))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(6)
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == _expected(rows)


def test_whole_texts(small):
    rows = sorted((r["doc_id"], r["text"]) for r in small.collect())
    assert Counter(tuple(r) for r in remove_repeats(small).collect()) == _expected(rows)


def test_edge_cases(edge, none):
    found = remove_repeats(edge)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"] and remove_repeats(none).count() == 0
    rows = found.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in edge.collect())
    some = [r for r in rows if r["n_words"] == 60]
    # Given twice with one id: the first occurrence, kept in both; later ids and the null id lose it.
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_removed"]) for r in some) == [((False, 5), 0), ((False, 5), 0), ((False, 9), 60), ((True, 0), 60)]
