import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sward.llm.mixing import balance, mix, mix_report, share_targets
from llm_cases import edge, none  # noqa: F401


def test_targets():
    found = share_targets([("b", 100), (None, 10), ("a", 10), ("c", 880)])
    assert found["a"] == 30 and found[None] == 30 and math.isclose(sum(found.values()), 1000)
    assert math.isclose(found["b"], 300) and math.isclose(found["c"], 640)
    assert share_targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0} and share_targets([]) == {}


def test_newton_meets_crossed_constraints(spark):
    rng = np.random.default_rng(1)
    cells = [([i, 3 + j], float(rng.integers(50, 900))) for i in range(3) for j in range(4)]
    wanted_rates = np.exp(rng.normal(0, 0.7, 7))
    moved = [t * wanted_rates[k[0]] * wanted_rates[k[1]] for k, t in cells]
    targets = [sum(m for m, (k, _) in zip(moved, cells) if i in k) for i in range(7)]
    dual = balance(spark.createDataFrame(cells, "keys array<int>, tokens double"), targets)
    rates = [math.exp(dual[k[0]] + dual[k[1]]) for k, _ in cells]
    for i in range(7):
        assert math.isclose(sum(r * t for r, (k, t) in zip(rates, cells) if i in k), targets[i], rel_tol=1e-9)
    # Exponentially tilted: the rates of crossed cells are products.
    assert math.isclose(rates[0] * rates[5], rates[1] * rates[4], rel_tol=1e-9)


def test_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_report(docs).join(docs.select("doc_id", "source"), "doc_id")
    per = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.sum("size").alias("size"), F.first("source_size").alias("source_size"))
    for r in per.collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"] and r["over"] <= 0 and r["size"] == r["source_size"]
    again = mix_report(docs.repartition(13))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix_report(docs).collect()))
    assert mix(docs).columns == docs.columns


def test_edge_cases(edge, none):
    rows = mix_report(edge)
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken"] and rows.count() == edge.count()
    taken = {}
    for r in rows.collect():
        assert r["taken"] <= 3 * r["size"]
        taken[(r["doc_id"], r["size"])] = r["taken"]
    mixed = mix(edge)
    assert mixed.columns == edge.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in rows.collect())
    assert mix_report(none).count() == 0 and mix(none).count() == 0


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 5), ("b", 5), ("c", 5), ("d", 5)]])
def test_targets_add_up(sizes):
    assert math.isclose(sum(share_targets(sizes).values()), sum(s for _, s in sizes))
