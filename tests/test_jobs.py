"""Jobs end to end on the small tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks import learning as L
from checks.views import use, view
from conftest import SMALL
from sward.operators import features as X
from sward.operators import models
from sward.plans import dataset as D
from sward.plans import evaluation as V
from sward.plans import preprocess as R
from sward.plans import studies as U
from sward.plans.config import DatasetConfig, PreprocessConfig

FOREST = models.ModelConfig(kind="rf", trees=5, max_depth=4)


@pytest.fixture(scope="module")
def ready(spark):
    use(spark, SMALL)
    return spark


def test_cross_validation_is_reproducible_and_learns(ready):
    cfg = L.config(FOREST)
    folds = [
        sorted(map(tuple, V.cross_validate(L.rows(ready), L.entries(ready), L.VECTOR_LAYOUT, cfg).collect()))
        for _ in range(2)
    ]
    assert folds[0] == folds[1] and [f for f, _ in folds[0]] == list(range(5))
    assert all(0 <= a <= 100 for _, a in folds[0])
    wide = replace(cfg, k=10)
    assert {a for _, a in map(tuple, V.cross_validate(L.rows(ready), L.entries(ready), L.VECTOR_LAYOUT, wide).collect())} == {100.0}


def test_stored_model_predicts_the_same(ready, tmp_path):
    cfg = L.config(FOREST)
    model, scaler, accuracy = V.train(L.rows(ready), L.entries(ready), L.VECTOR_LAYOUT, cfg, str(tmp_path))
    assert accuracy > 30
    stored = V.load_trained(ready, str(tmp_path), cfg)
    def predicted(m, s):
        out = V.predict(m, L.rows(ready), L.entries(ready), L.VECTOR_LAYOUT, cfg, L.label_encoder(ready), s)
        return sorted(map(tuple, out.collect()))

    first = predicted(model, scaler)
    assert first == predicted(*stored)
    assert len(first) == L.rows(ready).count() and all(p.startswith("class ") for _, p, _ in first)
    with pytest.raises(ValueError, match="scaler"):
        V.predict(model, L.rows(ready), L.entries(ready), L.VECTOR_LAYOUT, cfg, L.label_encoder(ready))


def test_test_rows_alone_are_disturbed(ready):
    rows = L.rows(ready)
    tagged = L.entries(ready).join(rows.select("row_id", "fold"), "row_id")
    train, test = V.fold_pairs(rows, tagged, 1)
    cfg = PreprocessConfig(dropout=0.5, standardization=False)
    n_train, n_test = train[1].count(), test[1].where("feature_id < 40").count()
    a, b, _ = R.preprocess_fold(train, test, L.VECTOR_LAYOUT, cfg)
    assert a[1].count() == n_train
    assert b[1].where("feature_id < 40").count() == n_test - int(n_test * 0.5)
    listed = rows.select(F.col("label_id").alias("id")).where("id < 3").distinct()
    a, b, _ = R.preprocess_fold(train, test, L.VECTOR_LAYOUT, PreprocessConfig(endangered=True), listed)
    assert a[0].count() == train[0].count()
    assert b[0].where("label_id >= 3").count() == 0 and b[0].count() > 0


def test_many_classes_get_metadata(ready):
    rows = ready.range(240).select(
        F.col("id").alias("row_id"), (F.col("id") % 120).cast("int").alias("label_id")
    )
    values = rows.select("row_id", F.lit(0).alias("feature_id"), (F.col("label_id") + 1.0).alias("value"))
    vectors = X.to_vector(rows, values, 2)
    model = models.fit(vectors, models.ModelConfig(kind="rf", trees=1, max_depth=2), 2, 120)
    assert model.stages[0].numClasses == 120
    assert models.classifier(models.ModelConfig(kind="rf", criterion="log_loss"), 2, 3).getImpurity() == "entropy"
    with pytest.raises(ValueError):
        models.classifier(models.ModelConfig(kind="svm"), 2, 3)


def test_dataset_is_saved_and_read_back(ready, tmp_path):
    cfg = DatasetConfig(location_features=False, occurrences=2)
    args = [view(ready, v) for v in ("v_header", "v_species", "v_codes", "v_backbone")]
    data = D.build_dataset(*args, cfg=cfg)
    assert data.plots.count() == data.plots.select("row_id").distinct().count() > 0
    assert data.features.groupBy("row_id", "feature_id").count().where("count > 1").count() == 0
    assert data.features.select("row_id").distinct().count() == data.plots.count()
    data.save(str(tmp_path))
    back = D.load_dataset(ready, str(tmp_path), data.layout)
    assert back.features.count() == data.features.count()
    test_header = view(ready, "v_location")
    plots, observed, features = D.build_prediction_set(
        test_header, view(ready, "v_species"), data, view(ready, "v_backbone"), cfg=cfg
    )
    assert features.count() > 0
    assert features.agg(F.max("feature_id")).first()[0] < data.layout.size
    known = data.encoders["species"].select(F.col("value").alias("species"))
    assert observed.count() > 0 and observed.join(known, "species", "left_anti").count() == 0
    # From the stored parts alone: layout, dictionaries and accepted names.
    _, stored, shape = D.predict_from_stored(
        test_header, view(ready, "v_species"), str(tmp_path), f"{tmp_path}-second", view(ready, "v_backbone"), cfg=cfg
    )
    assert shape == data.layout and sorted(map(tuple, stored.collect())) == sorted(map(tuple, features.collect()))


def test_robustness_modes(ready):
    species = view(ready, "v_species")
    n = species.count()
    assert U.disturbed_species(species, "constant").where("cover = 10").count() == n
    assert U.disturbed_species(species, "presence").where("cover <> 1").count() == 0
    unique = species.groupBy("plot_id", "species").agg(F.sum("cover").alias("cover")).where("cover > 0")
    gone = U.disturbed_species(unique, "dropout").where("cover = 0").count()
    assert gone == int(unique.count() * 0.3)
    assert set(U.ABLATION_SUBSETS) == {
        "All", "Species + Location", "Species + Environmental", "Location + Environmental",
        "Species", "Location", "Environmental",
    }


def test_forest_keeps_the_node_of_each_row():
    """Otherwise every level sends all trees to all tasks and walks each row down from the root."""
    from sward.operators import models

    assert models.classifier(models.ModelConfig(kind="rf"), 4, 2).getCacheNodeIds()


def test_ablation_prepares_the_features_once(ready, monkeypatch):
    rows, features = L.rows(ready), L.bit_entries(ready)
    subsets = {"All": "all", "Species": "species"}
    wanted = {
        name: [r["accuracy"] for r in V.cross_validate(rows, features, L.VECTOR_LAYOUT, replace(
            L.STUMP_CONFIG, n_folds=2, preprocess=replace(L.STUMP_CONFIG.preprocess, features=groups))).orderBy("fold").collect()]
        for name, groups in subsets.items()
    }
    calls, plain = [], V.base_transforms
    monkeypatch.setattr(V, "base_transforms", lambda *args: calls.append(1) or plain(*args))
    found = U.ablation_study(rows, features, L.VECTOR_LAYOUT, replace(L.STUMP_CONFIG, n_folds=2), subsets).collect()
    assert len(calls) == 1
    assert {r["subset"]: round(r["mean"], 9) for r in found} == {n: round(sum(a) / 2, 9) for n, a in wanted.items()}
