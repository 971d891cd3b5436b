"""Classifiers on sparse vectors."""

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from sward.operators.boosting import BoostedTrees
from sward.operators.perceptron import Perceptron

# Deepest tree the library can build.
MAX_DEPTH = 30


@dataclass(frozen=True)
class ModelConfig:
    """Classifier and its parameters; the defaults are those of the training job."""

    kind: str = "mlp"
    seed: int = 123
    # Perceptron.
    hidden_layers: int = 1
    neurons: int = 200
    epochs: int = 100
    batch_size: int = 256
    # Most steps of an epoch; beyond it batches hold more rows than ``batch_size``.
    updates: int = 8
    activation: str = "relu"
    weight_init: object = None
    optimizer: str = "adam"
    learning_rate: float = 0.001
    weight_decay: float = 0.0001
    momentum: float = 0.9
    # Epochs without better accuracy before the learning rate is cut, and the cut.
    patience: int = 5
    factor: float = 0.1
    # Forest.
    trees: int = 200
    criterion: str = "gini"
    max_depth: int = MAX_DEPTH
    min_leaf: int = 1
    max_features: str = "sqrt"
    bootstrap: bool = True
    # Boosted trees.
    rounds: int = 200
    boost_depth: int = MAX_DEPTH
    boost_rate: float = 0.1
    subsample: float = 0.8
    bins: int = 256
    # Added to the curvature of a leaf, and the least curvature of a side of a split.
    penalty: float = 1.0
    min_child: float = 1.0
    # Of perceptron and boosted trees: share of the training rows that only judges epochs or rounds, and how
    # many of those without fewer errors end the fit.
    holdout: float = 0.1
    stop_after: int = 10


def _depth(depth):
    if depth is None or depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} deep; asked for {depth}")
    return depth


def classifier(cfg, n_features, n_classes):
    """Unfitted estimator for ``features`` and ``label`` columns."""
    cols = dict(featuresCol="features", labelCol="label")
    if cfg.kind == "mlp":
        return Perceptron(cfg, n_features, n_classes)
    if cfg.kind == "rf":
        impurity = {"log_loss": "entropy"}.get(cfg.criterion, cfg.criterion)
        return RandomForestClassifier(
            numTrees=cfg.trees, impurity=impurity, maxDepth=_depth(cfg.max_depth),
            minInstancesPerNode=cfg.min_leaf, featureSubsetStrategy=cfg.max_features or "all",
            bootstrap=cfg.bootstrap, seed=cfg.seed, cacheNodeIds=True, **cols,
        )
    if cfg.kind == "gbt":
        _depth(cfg.boost_depth)
        return BoostedTrees(cfg, n_features, n_classes)
    raise ValueError(f"unknown model kind: {cfg.kind}")


def with_label(df, n_classes):
    """Label column with the number of classes as metadata, which trees need beyond 100."""
    meta = {"ml_attr": {"type": "nominal", "num_vals": n_classes, "name": "label"}}
    return df.withColumn("label", F.col("label_id").cast("double").alias("label", metadata=meta))


def fit(df, cfg, n_features, n_classes):
    """Fitted pipeline of the configured classifier; perceptron and boosted trees need a ``row_id``."""
    return Pipeline(stages=[classifier(cfg, n_features, n_classes)]).fit(with_label(df, n_classes))


def score_column(scored):
    """Column with a score per class: probabilities where the model gives them."""
    return "probability" if "probability" in scored.columns else "rawPrediction"
