"""Boosted trees against a plain version that looks at every cut of every node."""

import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sward.operators import boosting, models
from sward.sources.readers import load_model
from sward.sources.writers import save_model

CFG = models.ModelConfig(kind="gbt", rounds=3, boost_depth=2, subsample=1.0, holdout=0.0)


def _plain(rows, cfg, n_classes):
    """Probabilities of ``rows``, pairs of values and label, after all rounds."""
    margins = [[0.0] * n_classes for _ in rows]

    def worth(nodes):
        return sum(g for g, _ in nodes) ** 2 / (sum(h for _, h in nodes) + cfg.penalty)

    def grow(at, slopes, depth):
        best = None
        if depth:
            for j in range(len(rows[0][0])):
                for cut in sorted({rows[i][0][j] for i in at})[:-1]:
                    low = [i for i in at if rows[i][0][j] <= cut]
                    high = [i for i in at if rows[i][0][j] > cut]
                    if min(sum(slopes[i][1] for i in side) for side in (low, high)) < cfg.min_child:
                        continue
                    gain = round(sum(worth([slopes[i] for i in s]) for s in (low, high)) - worth([slopes[i] for i in at]), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, low, high
        if best is None:
            g, h = (sum(slopes[i][k] for i in at) for k in (0, 1))
            return {i: -g / (h + cfg.penalty) for i in at}
        return {**grow(best[1], slopes, depth - 1), **grow(best[2], slopes, depth - 1)}

    def shares(m):
        total = sum(math.exp(x) for x in m)
        return [math.exp(x) / total for x in m]

    for _ in range(cfg.rounds):
        now = [shares(m) for m in margins]
        for c in range(n_classes):
            slopes = [(p[c] - (rows[i][1] == c), 2 * p[c] * (1 - p[c])) for i, p in enumerate(now)]
            for i, value in grow(list(range(len(rows))), slopes, cfg.boost_depth).items():
                margins[i][c] += cfg.boost_rate * value
    return [shares(m) for m in margins]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    out = []
    for i in range(90):
        label = i % 3
        out.append(([round(rng.gauss(label, 1), 1), float(rng.randrange(3)), 0.0 if rng.random() < 0.6 else float(label - 1)], label))
    return out


def _vectors(spark, cases, parts=3):
    sparse = [(i, c, Vectors.sparse(3, [(j, x) for j, x in enumerate(v) if x])) for i, (v, c) in enumerate(cases)]
    return spark.createDataFrame(sparse, ["row_id", "label_id", "features"]).repartition(parts)


def _scores(model, df):
    return [list(r["probability"]) for r in model.transform(df).orderBy("row_id").collect()]


def test_equal_to_looking_at_every_cut(spark, cases, tmp_path):
    df = _vectors(spark, cases)
    model = models.fit(df, CFG, 3, 3)
    got = _scores(model, df)
    assert np.allclose(got, _plain(cases, CFG, 3), atol=1e-9)
    # The same from a stored model, from other partitions and from dense vectors.
    save_model(model, str(tmp_path / "m"))
    assert _scores(load_model(str(tmp_path / "m")), df) == got
    assert np.allclose(_scores(models.fit(_vectors(spark, cases, 1), CFG, 3, 3), df), got, atol=1e-9)
    dense = spark.createDataFrame([(i, Vectors.dense(v)) for i, (v, _) in enumerate(cases)], ["row_id", "features"])
    assert _scores(model, dense) == got


def test_margins_written_again_change_nothing(spark, cases, monkeypatch):
    df = _vectors(spark, cases)
    wanted = _scores(models.fit(df, CFG, 3, 3), df)
    monkeypatch.setattr(boosting, "PENDING", 1)
    assert np.allclose(_scores(models.fit(df, CFG, 3, 3), df), wanted, atol=1e-12)


def test_parameters_change_the_fit_and_errors_end_it(spark, cases):
    df = _vectors(spark, cases)
    base = _scores(models.fit(df, replace(CFG, rounds=1), 3, 3), df)
    for change in ({"penalty": 9.0}, {"subsample": 0.5}, {"boost_rate": 0.5}, {"min_child": 12.0}):
        assert not np.allclose(_scores(models.fit(df, replace(CFG, rounds=1, **change), 3, 3), df), base)
    # Labels by chance: held-out errors do not fall for long.
    chance = df.withColumn("label_id", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    fitted = models.fit(chance, replace(CFG, rounds=30, boost_depth=1, holdout=0.3, stop_after=2), 3, 3).stages[0]
    assert len(fitted.rounds) < 28


def test_empty_and_zero_rows(spark):
    df = _vectors(spark, [([0.0, 0.0, 0.0], i % 2) for i in range(6)])
    assert np.allclose(_scores(models.fit(df, CFG, 3, 2), df), 0.5)
    none = models.fit(df.where("false"), replace(CFG, penalty=0.0), 3, 2)
    assert np.allclose(_scores(none, df), 0.5)


def test_zeros_count_without_being_stored():
    cells = pa.table({"class": [0, 0], "node": [0, 0], "feature": [2, 2], "bin": [0, 0], "g": [-2.0, -1.0], "h": [1.0, 1.0]})
    found = boosting.best_splits(cells, {(0, 0): (1.0, 5.0)}, np.array([0, 0, 1]), 1.0, 1.0).to_pylist()
    gain = 9 / 3 + 16 / 4 - 1 / 6
    assert found == [{"class": 0, "node": 0, "feature": 2, "bin": 0, "gain": round(gain, 9), "g": -3.0, "h": 2.0}]


def test_branches_of_small_nodes_take_one_job_a_round(spark, cases, monkeypatch):
    df, cfg = _vectors(spark, cases), replace(CFG, rounds=2, boost_depth=5, min_child=0.2)
    found, jobs = {}, {}
    # No node is small, some are, all are.
    for local in (0, 60, 10_000):
        monkeypatch.setattr(boosting, "LOCAL", local, raising=False)
        spark.sparkContext.setJobGroup(f"branches-{local}", "fit")
        found[local] = models.fit(df, cfg, 3, 3)
        jobs[local] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"branches-{local}"))
    spark.sparkContext.setJobGroup("", "")
    assert np.allclose(_scores(found[0], df), _plain(cases, cfg, 3), atol=1e-9)
    assert max(len(t.feature) for t in found[0].stages[0].rounds[0]) > 5
    for local in (60, 10_000):
        assert np.allclose(_scores(found[local], df), _scores(found[0], df), atol=1e-12)
    assert jobs[10_000] < jobs[0] / 2


def test_batches_without_rows_in_open_nodes(spark):
    """A class whose open nodes have no rows in a batch gives an empty batch of the same types."""
    from types import SimpleNamespace

    cfg, n_classes = replace(CFG, subsample=1.0), 2
    binned = boosting._Binned(cfg, 1, n_classes, np.zeros(1, dtype=np.int64))
    tree, other = boosting.Tree(), boosting.Tree()
    left, right = tree.split(0, 0, 1, 1.0)
    held = lambda x: SimpleNamespace(value=x)
    batches = []
    for bins in ([0, 1], [2, 3]):
        batches.append(pa.RecordBatch.from_arrays([
            pa.array([1, 2]), pa.array([0, 1], pa.int32()), pa.array([[0], [0]], pa.list_(pa.int32())),
            pa.array([[b] for b in bins], pa.list_(pa.int32())), pa.array([[0.0, 0.0]] * 2),
        ], ["key", "label", "ids", "bins", "margins"]))
    growing = held(([tree, other], [[right], [0]]))
    for found in (boosting._weights(binned, held([]), growing, 0)(batches), boosting._histograms(binned, held([]), growing, 0, 4)(batches)):
        found = list(found)
        assert [b.num_rows > 0 for b in found] == [False, True, True, True] and len({str(b.schema) for b in found}) == 1
