"""Order of the feature transforms in training, evaluation and prediction."""

from pyspark.sql import functions as F

from sward.operators import features as X
from sward.operators.cleaning import of_plots
from sward.operators.oversample import borderline_smote


def base_transforms(features, layout, cfg):
    """Transforms that look at one row only and come first in every job."""
    n = layout.count("species")
    if cfg.rank:
        features = X.inverse_rank(features, n)
    if cfg.binarization:
        features = X.binarise(features, n)
    if cfg.normalization:
        features = X.l1_normalise(features, n)
    return features


def features_of(features, rows):
    return of_plots(features, rows, "row_id")


def augment(rows, features, layout, cfg, labels=None):
    """Training rows and features with synthetic ones appended."""
    ids = None if labels is None else [r["id"] for r in labels.select("id").collect()]
    new_rows, new_features = borderline_smote(rows, features, layout.size, ids, cfg.seed)
    return (
        rows.unionByName(new_rows, allowMissingColumns=True),
        features.unionByName(new_features),
    )


def disturb(features, layout, cfg):
    """Dropout, then noise, on species entries."""
    n = layout.count("species")
    if cfg.dropout > 0:
        features = X.drop_entries(features, n, cfg.dropout, cfg.seed)
    if cfg.noise:
        features = X.add_noise(features, n, cfg.seed)
    return features


def finish(features, layout, cfg):
    """Logarithm and feature-group slice."""
    if cfg.log:
        features = X.log_values(features, layout.count("species"))
    return X.select_feature_groups(features, layout, cfg.features)


def scaled(features, rows, layout, cfg, scaler=None):
    """Standardised features and the scaler, fitted here unless given."""
    if not cfg.standardization:
        return features, scaler
    if scaler is None:
        n = rows.agg(F.count(F.lit(1)).cast("double")).scalar()
        scaler = X.fit_scaler(features, n)
    return X.apply_scaler(features, scaler, layout.size), scaler


def preprocess_training(rows, features, layout, cfg, endangered=None):
    """Training order.  Returns rows, features, layout and scaler."""
    features = base_transforms(features, layout, cfg)
    labels = endangered if cfg.endangered else None
    if labels is not None:
        rows = X.keep_labels(rows, labels)
        features = features_of(features, rows)
    if cfg.augmentation:
        rows, features = augment(rows, features, layout, cfg, labels)
    features, layout = finish(disturb(features, layout, cfg), layout, cfg)
    features, scaler = scaled(features, rows, layout, cfg)
    return rows, features, layout, scaler


def preprocess_fold(train, test, layout, cfg, endangered=None):
    """Evaluation order within one fold, for pairs ``(rows, features)`` after the base transforms.

    Selection, dropout and noise hit the test rows only, augmentation the training rows only.
    Returns both pairs and the layout.
    """
    (train, of_train), (test, of_test) = train, test
    labels = endangered if cfg.endangered else None
    if labels is not None:
        test = X.keep_labels(test, labels)
    if cfg.rare:
        test = X.keep_rarest(train, test)
    if labels is not None or cfg.rare:
        of_test = features_of(of_test, test)
    if cfg.augmentation:
        train, of_train = augment(train, of_train, layout, cfg, labels)
    of_test = disturb(of_test, layout, cfg)
    of_train, new_layout = finish(of_train, layout, cfg)
    of_test, _ = finish(of_test, layout, cfg)
    of_train, scaler = scaled(of_train, train, new_layout, cfg)
    of_test, _ = scaled(of_test, test, new_layout, cfg, scaler)
    return (train, of_train), (test, of_test), new_layout


def preprocess_prediction(features, layout, cfg, scaler=None):
    """Prediction order, with the stored scaler."""
    features, layout = finish(base_transforms(features, layout, cfg), layout, cfg)
    if cfg.standardization:
        if scaler is None:
            raise ValueError("prediction needs the scaler stored in training")
        features = X.apply_scaler(features, scaler, layout.size)
    return features, layout
