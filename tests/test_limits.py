"""No silent limits: large keys, repeated rows, ties, small covers, fine grids, deep trees."""

import types

import pytest
from pyspark.sql import functions as F
from conftest import SMALL
from test_geography import lonlat, shapes

from checks import all_queries
from sward import session
from sward.operators import cleaning as C
from sward.operators import features as X
from sward.operators import models
from sward.operators import regions as G
from sward.operators.ordering import flag_sample, row_ids
from sward.plans import dataset as D
from sward.plans.config import DatasetConfig

HEADER = "plot_id string, cover_scale string, recorded string, label string, lon double, lat double"


@pytest.fixture(scope="module")
def survey(spark):
    rows = [("1", "a", "01.01.2001", "Q11,Q11", 5.0, 50.0), ("2", "a", "01.01.2001", "Q11", 6.0, 50.0),
            ("2", "a", "01.01.2002", "Q11,R11", 6.0, 50.0), (str(2**50), "a", "01.01.2001", "R11", 7.0, 50.0)]
    header = spark.createDataFrame(rows, HEADER)
    species = spark.createDataFrame(
        [(p, s, c) for p in ("1", "2", str(2**50)) for s, c in (("Aus bus", 5.0), ("Cus dus", 2e-7))],
        "plot_id string, species string, cover double")
    codes = spark.createDataFrame([("Q11", 3), ("R11", 3)], "code string, level int")
    return header, species, codes


CONFIG = DatasetConfig(occurrences=1, name_normalisation=False, location_features=False, folds=2, cover_digits=9)


def test_row_keys_are_unique_and_dense(spark, survey):
    header, species, codes = survey
    built = D.build_dataset(header, species, codes, cfg=CONFIG)
    rows = built.plots.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(6))
    assert sorted((r["plot_id"], r["label"]) for r in rows) == [
        (1, "Q11"), (1, "Q11"), (2, "Q11"), (2, "Q11"), (2, "R11"), (2**50, "R11")]
    per_row = built.features.groupBy("row_id", "feature_id").count().collect()
    assert len(per_row) == 12 and all(r["count"] == 1 for r in per_row)
    assert X.to_vector(built.plots.select("row_id"), built.features, built.layout.size).count() == 6


def test_many_labels_keep_plots_apart(spark):
    rows = spark.createDataFrame([(1, 65536), (2, 0), (2**60, 3)], "plot_id long, label_id int")
    assert D.keyed_rows(rows, ["plot_id", "label_id"]).select("row_id").distinct().count() == 3


def test_row_ids_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    found = row_ids(rows, ["k"]).orderBy("k").collect()
    assert [r["id"] for r in found] == list(range(1000))


def test_stored_dataset_encodes_a_second_survey(spark, survey, tmp_path):
    header, species, codes = survey
    built = D.build_dataset(header, species, codes, cfg=CONFIG)
    built.save(f"{tmp_path}/first")
    again = D.load_dataset(spark, f"{tmp_path}/first")
    assert again.layout == built.layout and again.names is None
    plots, features, layout = D.predict_from_stored(header.drop("label"), species, f"{tmp_path}/first", f"{tmp_path}/second", cfg=CONFIG)
    assert plots.count() == 4 and features.groupBy("row_id").count().where("count = 2").count() == 4
    assert layout.size == 2


def test_small_covers_stay(spark, survey):
    _, species, _ = survey
    plots = spark.createDataFrame([(1,)], "plot_id long")
    kept = C.prediction_species(species, plots, digits=6).collect()
    assert sorted((r["species"], r["cover"]) for r in kept) == [("Aus bus", 5.0), ("Cus dus", 0.0)]


@pytest.mark.parametrize("n, share, expected", [(10, 0.3, 3), (10, 0.0, 0), (10, 1.0, 10), (0, 0.5, 0)])
def test_samples_of_equal_keys_are_exact(spark, n, share, expected):
    rows = spark.createDataFrame([(1, i) for i in range(n)], "k long, v long")
    assert flag_sample(rows, ["k"], share, 5).where("sampled").count() == expected
    mixed = rows.union(spark.range(100, 100 + n).select("id", "id"))
    flagged = flag_sample(mixed, ["k"], 0.5, 5)
    assert flagged.where("sampled").count() == n and flagged.count() == 2 * n


def test_fine_grids_lose_no_site(spark):
    square = shapes(spark, ("A", [[(0, 0), (900, 0), (900, 900), (0, 900)]]))
    sites = spark.createDataFrame([lonlat(450, 450), lonlat(9e6, 6e6)], "lon double, lat double")
    for size in (1000.0, 100_000.0, 1e9):
        assert G.nearest_region(G.projected(sites), square, cell_size=size).count() == 2


def test_depth_beyond_the_library_is_refused():
    with pytest.raises(ValueError, match="at most 30"):
        models.classifier(models.ModelConfig(kind="rf", max_depth=31), 2, 2)
    with pytest.raises(ValueError, match="at most 30"):
        models.classifier(models.ModelConfig(kind="gbt", boost_depth=100), 2, 2)


def test_cluster_needs_a_shared_folder(monkeypatch):
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


FITS = {
    "cross_validate_forest": "rf", "cross_validate_perceptron": "mlp", "train_boosted": "gbt", "train_and_predict": "rf",
    "occlusion_attribution": "rf", "group_ablation": "mlp", "ablation_study": "rf", "predicted_group_counts_forest": "rf",
}


@pytest.mark.parametrize("name", sorted(FITS))
def test_fits_have_the_defaults_of_the_job(spark, monkeypatch, name):
    asked = []

    def stop(cfg, *_):
        asked.append(cfg)
        raise InterruptedError

    monkeypatch.setattr(models, "classifier", stop)
    with pytest.raises(InterruptedError):
        all_queries.QUERIES[name](spark, SMALL).collect()
    assert asked and set(asked) == {models.ModelConfig(kind=FITS[name])}


def test_tasks_after_a_shuffle_are_cut_by_size(spark):
    """Few shuffle partitions in the session's settings do not make large tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        counted = spark.range(2_000_000).groupBy("id").count()
        assert counted.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_observations_of_a_second_survey_are_worked_out_once(spark, survey):
    header, species, codes = survey
    trained = D.build_dataset(header, species, codes, cfg=CONFIG)
    _, observed, _ = D.build_prediction_set(header.drop("label"), species, trained, cfg=CONFIG)
    # Stored and encoded from a written table: no sums are left in its plan.
    assert "Aggregate" not in observed._jdf.queryExecution().optimizedPlan().toString()
