import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sward.llm import topk
from sward.llm.topk import top_inner_products


def _expected(rows, k=5):
    valid = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(valid):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(valid) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return Counter(out)


def _found(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).repartition(4)
    return Counter(tuple(r) for r in top_inner_products(docs, F.col("vec_id") % 50 == 0).collect())


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.normal(0, 0.2, (300, 12)))]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # a crowd of equal vectors
    rows += [(350, [0.0] * 12), (400, np.float32(rng.normal(0, 3, 12)).tolist())]
    for block, group in ((4096, 256), (16, 2)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "GROUP", group)
        assert _found(spark, rows) == _expected(rows)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (50, [1.0, -2.0]), (50, [1.0, -2.0]), (5, []), (6, [3.0])]
    assert _found(spark, rows) == _expected(rows)
    assert _found(spark, []) == Counter() and _found(spark, [(0, [1.0])]) == Counter()
    large = [(i, [1e12 * (i + 1), -1e6]) for i in range(3)]
    assert sum(_found(spark, large).values()) == 2


def test_search_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-5, 6, (4000, 4))
    vectors[5] = [900, 900, 900, 900]
    lists = topk.Lists(vectors, np.arange(4000), np.arange(4000))
    scored = []
    take = lists.vectors

    class Counting(np.ndarray):
        def __getitem__(self, at):
            scored.append(np.size(at))
            return np.asarray(take)[at]

    lists.vectors = take.view(Counting)
    top, scores = lists.best(np.array([1, 1, 1, 1]), -1, 1)
    assert top.tolist() == [5] and sum(scored) < 400


def test_small_vectors_and_a_very_large_query():
    import numpy as np

    from sward.llm.topk import Lists

    vectors = np.array([[1, 0], [1, 1], [1, 2], [0, 1]], dtype=np.int64)
    query = np.array([1 << 60, 1], dtype=np.int64)
    found = Lists(vectors, np.arange(4), np.arange(4)).best(query, -1, 3)
    assert [int(v) for v in found[0]] == [2, 1, 0] and [int(v) for v in found[1]] == [(1 << 60) + 2, (1 << 60) + 1, 1 << 60]
