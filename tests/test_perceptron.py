"""Perceptron against a plain version with gradients from differences of the loss."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sward.operators import models, perceptron
from sward.sources.readers import load_model
from sward.sources.writers import save_model

CFG = models.ModelConfig(
    kind="mlp", hidden_layers=2, neurons=3, activation="tanh", epochs=2, updates=1, holdout=0.0, optimizer="sgd",
    learning_rate=0.4, weight_decay=0.01,
)


def _loss(flat, rows, sizes):
    total = 0.0
    for values, label in rows:
        at, h = 0, values
        for layer, (n, m) in enumerate(zip(sizes, sizes[1:])):
            matrix, bias = flat[at : at + n * m], flat[at + n * m : at + n * m + m]
            z = [sum(h[i] * matrix[i * m + j] for i in range(n)) + bias[j] for j in range(m)]
            at += n * m + m
            h = z if layer == len(sizes) - 2 else [math.tanh(x) for x in z]
        total += math.log(sum(math.exp(x) for x in h)) - h[label]
    return total / len(rows)


def _slope(flat, rows, sizes, d=1e-5):
    out = []
    for i in range(len(flat)):
        up, down = list(flat), list(flat)
        up[i] += d
        down[i] -= d
        out.append((_loss(up, rows, sizes) - _loss(down, rows, sizes)) / (2 * d))
    return np.array(out)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    return [([0.0 if rng.random() < 0.4 else rng.gauss(i % 3, 1) for _ in range(3)], i % 3) for i in range(60)]


def _vectors(spark, cases, parts=3):
    sparse = [(i, c, Vectors.sparse(3, [(j, x) for j, x in enumerate(v) if x])) for i, (v, c) in enumerate(cases)]
    return spark.createDataFrame(sparse, ["row_id", "label_id", "features"]).repartition(parts)


def _scores(model, df):
    return [list(r["probability"]) for r in model.transform(df).orderBy("row_id").collect()]


def _weights(model):
    return model.stages[0].weights


def test_two_steps_equal_differences_of_the_loss(spark, cases, tmp_path, monkeypatch):
    monkeypatch.setattr(perceptron, "CHUNK", 7)
    sizes = [3, 3, 3, 3]
    flat = perceptron.Network(sizes, "tanh").start(None, CFG.seed)
    speed = 0.0
    for _ in range(2):
        g = _slope(flat, cases, sizes) + CFG.weight_decay * flat
        speed = CFG.momentum * speed + g
        flat = flat - CFG.learning_rate * (g + CFG.momentum * speed)
    df = _vectors(spark, cases)
    model = models.fit(df, CFG, 3, 3)
    assert np.allclose(_weights(model), flat, atol=1e-7)
    # The same from other partitions, in smaller blocks, from dense vectors and from a stored model.
    assert np.allclose(_weights(models.fit(_vectors(spark, cases, 1), CFG, 3, 3)), flat, atol=1e-7)
    dense = spark.createDataFrame([(i, c, Vectors.dense(v)) for i, (v, c) in enumerate(cases)], ["row_id", "label_id", "features"])
    assert np.allclose(_weights(models.fit(dense, CFG, 3, 3)), flat, atol=1e-7)
    save_model(model, str(tmp_path / "m"))
    assert np.allclose(_scores(load_model(str(tmp_path / "m")), dense), _scores(model, df), atol=1e-12)
    shares = np.array(_scores(model, df))
    own = -np.log(shares[np.arange(len(cases)), [c for _, c in cases]]).mean()
    assert abs(own - _loss(flat, cases, sizes)) < 1e-6


def test_adam_by_hand():
    cfg = replace(CFG, optimizer="adam", weight_decay=0.0, learning_rate=0.1)
    optimizer = perceptron.Optimizer(cfg, 2)
    weights = optimizer.step(np.zeros(2), np.array([0.5, -2.0]))
    assert np.allclose(weights, [-0.1, 0.1])
    weights = optimizer.step(weights, np.array([0.5, 2.0]))
    mean = (0.9 * -0.2 + 0.1 * 2.0) / (1 - 0.81)
    spread = (0.999 * 0.004 + 0.001 * 4.0) / (1 - 0.999**2)
    assert np.allclose(weights, [-0.2, 0.1 - 0.1 * mean / math.sqrt(spread)])


def test_parameters_change_the_fit(spark, cases):
    df = _vectors(spark, cases)
    base = _weights(models.fit(df, CFG, 3, 3))
    changes = (
        {"learning_rate": 0.1}, {"activation": "relu"}, {"activation": "sigmoid"}, {"optimizer": "adam"}, {"momentum": 0.0},
        {"weight_decay": 0.0}, {"weight_init": "kaiming"}, {"weight_init": "xavier"}, {"seed": 4}, {"updates": 8, "batch_size": 20},
        {"holdout": 0.3},
    )
    for change in changes:
        assert not np.allclose(_weights(models.fit(df, replace(CFG, **change), 3, 3)), base), change
    for wrong in ({"optimizer": "x"}, {"activation": "x"}, {"weight_init": "x"}):
        with pytest.raises(ValueError, match="unknown"):
            models.fit(df, replace(CFG, **wrong), 3, 3)


def test_plateau_cuts_the_rate():
    plateau = perceptron.Plateau(replace(CFG, patience=1, factor=0.5))
    rates = [0.4]
    for accuracy in (0.5, 0.5, 0.5, 0.6, 0.6, 0.6, 0.6):
        rates.append(plateau.rate(rates[-1], accuracy))
    assert rates[1:] == [0.4, 0.4, 0.2, 0.2, 0.2, 0.1, 0.1]


def test_held_out_rows_end_the_fit(spark, cases, monkeypatch):
    judged = []
    rate = perceptron.Plateau.rate
    monkeypatch.setattr(perceptron.Plateau, "rate", lambda self, r, a: (judged.append(a), rate(self, r, a))[1])
    # Labels by chance: held-out accuracy does not rise for long.
    df = _vectors(spark, cases).withColumn("label_id", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    for patience in (0, 50):
        judged.clear()
        models.fit(df, replace(CFG, epochs=25, holdout=0.3, stop_after=3, patience=patience, factor=0.0), 3, 3)
        best = int(np.argmax(judged))
        assert len(judged) < 25 and len(judged) == best + 1 + 3
        # A rate of zero changes nothing any more.
        assert patience or len(set(judged[best + 1 :])) == 1


def test_learns_where_classes_differ(spark):
    rng = random.Random(1)
    rows = [([rng.gauss(3 * (i % 3 == j), 0.5) for j in range(3)], i % 3) for i in range(300)]
    df = _vectors(spark, rows)
    cfg = models.ModelConfig(kind="mlp", neurons=8, epochs=20, learning_rate=0.05)
    shares = np.array(_scores(models.fit(df, cfg, 3, 3), df))
    assert (shares.argmax(axis=1) == [c for _, c in rows]).mean() > 0.97


def test_empty_tables_and_rows(spark):
    df = _vectors(spark, [([0.0, 0.0, 0.0], i % 2) for i in range(6)])
    model = models.fit(df.where("false"), replace(CFG, hidden_layers=0, weight_init="zeros"), 3, 2)
    assert np.allclose(_scores(model, df), 0.5) and _scores(model, df.where("false")) == []
    even = models.fit(df, replace(CFG, hidden_layers=0, weight_init="zeros"), 3, 2)
    assert np.allclose(_scores(even, df), 0.5)


def test_a_step_is_one_job_over_blocks_that_are_kept(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [0, 2], [float(rng.normal()), float(i % 3)], perceptron.HELD if i % 10 == 0 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, perceptron.BATCHES)
    network = perceptron.Network([3, 4, 3], "tanh")
    weights = network.start(None, 5)
    found = [perceptron.gradient(perceptron.blocks(df.repartition(n)), network, weights) for n in (1, 3)]
    assert np.allclose(found[0][0], found[1][0], atol=1e-12) and found[0][0].any()
    assert found[0][1].tolist() == found[1][1].tolist() and found[0][1][:2].tolist() == [54.0, 6.0]
    kept = perceptron.blocks(df)
    first = perceptron.gradient(kept, network, weights)
    spark.sparkContext.setJobGroup("one-step", "step")
    again = perceptron.gradient(kept, network, weights)
    spark.sparkContext.setJobGroup("", "")
    assert np.array_equal(first[0], again[0])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-step")) == 1
    # No rows at all: no gradient.
    none = perceptron.gradient(perceptron.blocks(df.where("false")), network, weights)
    assert not none[0].any() and not none[1].any()
