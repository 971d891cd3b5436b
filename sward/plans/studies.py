"""Studies over variants of the features."""

from dataclasses import replace

from pyspark.sql import functions as F

from sward.operators import features as X
from sward.operators import metrics as M
from sward.plans.evaluation import cross_validate_variants, predict, train

# Feature-group subsets of the ablation study.
ABLATION_SUBSETS = {
    "All": "all",
    "Species + Location": "species,location",
    "Species + Environmental": "species,altitude,country,ecoregion,dune,coast",
    "Location + Environmental": "location,altitude,country,ecoregion,dune,coast",
    "Species": "species",
    "Location": "location",
    "Environmental": "altitude,country,ecoregion,dune,coast",
}


def ablation_study(rows, features, layout, cfg, subsets=None):
    """Cross-validation summary for each subset of feature groups."""
    subsets, out = subsets or ABLATION_SUBSETS, None
    variants = [replace(cfg, preprocess=replace(cfg.preprocess, features=groups)) for groups in subsets.values()]
    for name, found in zip(subsets, cross_validate_variants(rows, features, layout, variants)):
        part = M.cv_summary(found).select(F.lit(name).alias("subset"), "mean", "std", "best_fold")
        out = part if out is None else out.unionByName(part)
    return out


def disturbed_species(species, mode, seed=123, fraction=0.3, constant=10.0):
    """Species table of a robustness study.

    ``presence`` sets every cover to 1 above 1 and drops the rest, ``constant`` replaces covers
    by one value, ``dropout`` zeroes an exact share of them.
    """
    if mode == "presence":
        return species.where(F.col("cover") > 1).withColumn("cover", F.lit(1.0))
    if mode == "constant":
        return species.withColumn("cover", F.lit(float(constant)))
    if mode == "dropout":
        return X.zero_sample(species, ["plot_id", "species"], fraction, seed)
    raise ValueError(f"unknown mode: {mode}")


# Changes of the job in each mode of the robustness study.
ROBUSTNESS_MODES = {
    "as is": {}, "presence": {"binarization": True}, "constant": {}, "dropout": {}, "species": {"features": "species"},
}


def disturbed_features(features, layout, mode, seed=123, fraction=0.3, constant=10.0):
    """Long features of a mode; only species entries change.

    ``constant`` replaces values by one, ``dropout`` removes an exact share of the entries.  The other modes leave
    the features as they are: their transforms belong to the job.
    """
    n = layout.count("species")
    if mode == "constant":
        value = F.when(F.col("feature_id") < n, F.lit(float(constant))).otherwise(F.col("value"))
        return features.withColumn("value", value)
    if mode == "dropout":
        return X.drop_entries(features, n, fraction, seed)
    if mode not in ROBUSTNESS_MODES:
        raise ValueError(f"unknown mode: {mode}")
    return features


def robustness_study(fitted, judged, layout, cfg, encoder, modes=tuple(ROBUSTNESS_MODES)):
    """Hit rate on ``judged`` rows, predicted anew in each mode: ``(variant, hit_rate)``.

    ``fitted`` and ``judged`` are pairs of rows and long features.  Modes whose job is the same share one model.
    """
    rows, features = judged
    names = encoder.select(F.col("id").alias("label_id"), F.array("value").alias("truth"))
    truth = rows.select(F.col("row_id").alias("plot_id"), "label_id").join(names, "label_id")
    models, predictions = {}, {}
    for mode in modes:
        variant = replace(cfg, preprocess=replace(cfg.preprocess, **ROBUSTNESS_MODES[mode]))
        if variant not in models:
            models[variant] = train(*fitted, layout, variant)
        model, scaler, _ = models[variant]
        disturbed = disturbed_features(features, layout, mode, cfg.preprocess.seed)
        predictions[mode] = predict(model, rows, disturbed, layout, variant, encoder, scaler)
    return robustness(predictions, truth)


def robustness(predictions, truth):
    """Hit rate of each variant's predictions: ``predictions`` maps variant to frame."""
    out = None
    for name, frame in predictions.items():
        judged = frame.join(truth.select("plot_id", "truth"), "plot_id")
        part = M.hit_rate(judged).select(F.lit(name).alias("variant"), "hit_rate")
        out = part if out is None else out.unionByName(part)
    return out
