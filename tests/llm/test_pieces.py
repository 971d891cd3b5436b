import random

import numpy as np
import pytest

from sward.llm.pieces import MARK, PieceModel, decode, encode, encode_and_decode
from sward.llm.queries import QUERIES, tokenizer_path
from llm_cases import edge, none, small  # noqa: F401

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(PATH)


def _best(model, text):
    """Largest sum of scores over all cuts of the whole text, every piece tried at every position."""
    text = MARK + text.replace(" ", MARK)
    best = [0.0]
    for end in range(1, len(text) + 1):
        sums = [best[s] + model.scores[text[s:end]] for s in range(max(0, end - 16), end) if text[s:end] in model.scores]
        if text[end - 1] not in model.scores:
            sums.append(best[end - 1] + model.worst)
        best.append(max(sums))
    return best[-1]


def _sum(model, ids):
    names = {i: s for i, s in ((v[2], v[1]) for v in model.automaton.values())}
    total, at = 0.0, 0
    while at < len(ids):
        if ids[at] in names:
            total, at = total + names[ids[at]], at + 1
        else:  # the bytes of one unknown character
            first = model.pieces[ids[at]][0]
            total, at = total + model.worst, at + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
    return total


def test_best_cut_and_round_trip(pieces):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("abethe  THio.\nn中é🙂%ś") for _ in range(rng.randint(1, 25)))
        ids = np.frombuffer(pieces.encode(text), "<i4")
        assert _sum(pieces, ids.tolist()) == _best(pieces, text)
        assert pieces.decode(ids.astype(np.int64), np.array([len(ids)])) == [text]


def test_edge_cases(edge, none, small):
    coded, ids = encode(edge, PATH)
    back, text = decode(coded, PATH, ids)
    assert back.columns == edge.columns + ["ids", "decoded"]
    for r in back.collect():
        assert r[text] == (r["text"] or "") and (len(r[ids]) == 0) == (not r["text"])
    assert encode(none, PATH)[0].count() == 0
    coded, ids = encode(small, PATH)
    assert all(r["decoded"] == r["text"] for r in decode(coded, PATH, ids)[0].collect())
    clash, name = encode(small.withColumnRenamed("lang", "IDS"), PATH)
    assert name != "IDS" and clash.count() == small.count()


def test_encodes_once(spark, small):
    found, name = encode_and_decode(small.withColumnRenamed("lang", "coded"), PATH)
    assert name == "coded_" and all(r[name]["decoded"] == r["text"] for r in found.collect())
    plan = QUERIES["op4_sentencepiece"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(steps) == 1 and steps[0].count("run(") == 1


def test_long_text_without_spaces(spark):
    rng = random.Random(8)
    part = "".join(rng.choice("thequickabcde中文字한글xyz.") for _ in range(20_000))
    text = part * 190
    assert len(text.encode()) > 5 << 20
    docs = spark.createDataFrame([(1, text), (2, part)], "doc_id long, text string")
    coded, ids = encode(docs, PATH)
    back, decoded = decode(coded, PATH, ids)
    assert all(r.same for r in back.selectExpr(f"{decoded} = text AS same").collect())


def test_long_units_are_cut_like_short_ones(pieces, monkeypatch):
    rng = random.Random(6)
    units = ["▁" + "".join(rng.choice("abethe中é🙂%ś") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    expected = [pieces.best_cut(u) for u in units]
    monkeypatch.setattr("sward.llm.pieces.LONG", 0)
    assert [pieces.best_cut(u) for u in units] == expected
