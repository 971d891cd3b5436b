import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sward.operators import attribution as A
from sward.operators import features as X
from sward.operators import metrics as M
from sward.operators import ordering as O
from sward.operators import reports as P
from sward.plans.config import PreprocessConfig


def long(spark, *entries):
    return spark.createDataFrame(list(entries), "row_id long, feature_id int, value double")


def test_inverse_rank_with_ties(spark, rows):
    df = long(spark, (1, 0, 5.0), (1, 1, 5.0), (1, 2, 3.0), (1, 3, 1.0), (1, 9, 7.0))
    assert [v for *_, v in rows(X.inverse_rank(df, 5))] == [1.0, 1.0, 0.5, 1 / 3, 7.0]


def test_binarise_and_l1(spark, rows):
    df = long(spark, (1, 0, 0.5), (1, 1, 1.0), (1, 2, 1.01), (1, 9, 0.2))
    assert rows(X.binarise(df, 5)) == [(1, 2, 1.0), (1, 9, 0.2)]
    df = long(spark, (1, 0, 1.0), (1, 1, 3.0), (1, 9, 8.0))
    assert [v for *_, v in rows(X.l1_normalise(df, 5))] == [0.25, 0.75, 8.0]


def test_scaler(spark, rows):
    df = long(spark, (1, 0, 0.1), (2, 0, 0.1), (3, 0, 0.1), (1, 1, 1.0), (2, 1, 3.0), (1, 2, 4.0))
    got = dict(rows(X.fit_scaler(df, 3)))
    dense = np.array([[0.1, 1, 4], [0.1, 3, 0], [0.1, 0, 0]])
    assert got[0] == 1.0
    assert [got[1], got[2]] == pytest.approx(dense.std(0)[1:])
    assert rows(X.apply_scaler(long(spark, (1, 7, 2.0)), X.fit_scaler(df, 3)), "value") == [(2.0,)]


def test_dropout_is_exact_and_stable(spark):
    df = spark.range(7).select(F.col("id").alias("row_id"), F.lit(0).alias("feature_id"), F.lit(1.0).alias("value"))
    assert X.drop_entries(df, 1, 0.5, seed=3).count() == 4
    big = spark.range(5000).select("id", F.lit(1.0).alias("cover"))
    a = X.zero_sample(big, ["id"], 0.3, 9).where("cover = 0")
    b = X.zero_sample(big.repartition(13), ["id"], 0.3, 9).where("cover = 0")
    assert a.count() == 1500
    assert {r[0] for r in a.select("id").collect()} == {r[0] for r in b.select("id").collect()}
    assert X.zero_sample(big, ["id"], 0.0, 9).where("cover = 0").count() == 0
    assert X.zero_sample(big, ["id"], 1.0, 9).where("cover = 0").count() == 5000


def test_hash_position_is_a_permutation(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2000, "hot").otherwise("cold"))
    assert sorted(r["position"] for r in O.hash_position(df, ["id"], 1).collect()) == list(range(3000))
    by = O.hash_position(df, ["id"], 1, by=["g"]).groupBy("g").agg(
        F.min("position"), F.max("position"), F.countDistinct("position")
    )
    assert {tuple(r) for r in by.collect()} == {("hot", 0, 1999, 2000), ("cold", 0, 999, 1000)}


def test_noise_depends_on_keys_only(spark):
    df = long(spark, *[(i, i % 3, 1.0 + i % 7) for i in range(200)], (1, 9, 5.0))
    a = sorted(map(tuple, X.add_noise(df, 5, 1).collect()))
    b = sorted(map(tuple, X.add_noise(df.repartition(11), 5, 1).collect()))
    assert [r[1:2] for r in a] == [r[1:2] for r in b]
    assert np.allclose([r[2] for r in a], [r[2] for r in b])
    assert (9, 5.0) in [(r[1], r[2]) for r in a] or (1, 9, 5.0) in [(r[1], r[0], r[2]) for r in a]
    assert all(r["value"] > 0 for r in X.add_noise(df, 5, 1, clip=True).collect())


def test_feature_groups_keep_layout_order(spark, rows):
    layout = X.Layout.of(species=3, location=2, altitude=1)
    df = long(spark, *[(1, i, float(i)) for i in range(6)])
    out, new = X.select_feature_groups(df, layout, "altitude,species")
    assert rows(out, "feature_id", "value") == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 5.0)]
    assert new.size == 4
    with pytest.raises(ValueError):
        layout.keep("soil")


def test_vectors_keep_empty_rows(spark):
    rows_ = spark.createDataFrame([(1,), (2,)], "row_id long")
    out = X.to_vector(rows_, long(spark, (1, 2, 5.0), (1, 0, 1.0)), 4)
    got = {r["row_id"]: r["a"] for r in out.select("row_id", vector_to_array("features").alias("a")).collect()}
    assert got == {1: [1.0, 0.0, 5.0, 0.0], 2: [0.0] * 4}


def test_rank_and_binarise_exclude_each_other():
    with pytest.raises(ValueError):
        PreprocessConfig(rank=True, binarization=True)


def test_topk_ties_go_to_the_lower_class(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2], 1), ([0.4, 0.4, 0.2], 0), ([0.1, 0.1, 0.8], 2)], "probability array<double>, label_id int")
    assert M.topk_accuracy(df, 1).first()[0] == pytest.approx(200 / 3)
    assert M.topk_accuracy(df, 2).first()[0] == 100.0
    assert M.topk_accuracy(df, 1, "macro").first()[0] == pytest.approx(200 / 3)


def test_cv_summary_uses_the_sample_deviation(spark):
    r = M.cv_summary(spark.createDataFrame([(0, 80.0), (1, 90.0)], "fold int, accuracy double")).first()
    assert (r["mean"], round(r["std"], 4), r["best_fold"]) == (85.0, 7.0711, 1)


def test_cumulative_cutoff(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 2.0)], "rank int, score double")
    assert A.cumulative_cutoff(df, 0.5).first()[0] == 1
    assert A.cumulative_cutoff(df, 0.51).first()[0] == 2


def test_richness_buckets(spark, rows):
    counts = {1: 10, 2: 11, 3: 30, 4: 31, 5: 45, 6: 61, 7: 60}
    species = spark.createDataFrame([(p, s) for p, n in counts.items() for s in range(n)], "plot_id long, species int")
    header = spark.createDataFrame([(p,) for p in [*counts, 1]], "plot_id long")
    got = {(a, b): (n, s) for a, b, n, s in rows(P.richness_histogram(header, species))}
    assert got[("all", "<=10")] == (2, 0.25) and got[("all", "11-30")] == (2, 0.25)
    assert got[("all", ">=31")] == (4, 0.5) and got[(">=31", "51-60")] == (1, 0.25)
    assert got[(">=31", ">=61")] == (1, 0.25)


def test_mean_attribution_over_folds(spark, rows):
    df = spark.createDataFrame(
        [(0, "a", 1, 0, -2.0), (0, "a", 2, 1, 4.0), (1, "a", 3, 0, 6.0), (1, "b", 4, 0, 1.0)],
        "fold int, class string, row_id long, feature_id int, score double",
    )
    assert rows(A.mean_attribution(df)) == [("a", 0, 3.5), ("a", 1, 1.0), ("b", 0, 1.0)]
