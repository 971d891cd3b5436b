"""Hot keys: one value holds a third or more of the rows and results stay whole."""

import numpy as np
from pyspark.sql import functions as F

from sward.operators import cleaning as C
from sward.operators import encoding as E
from sward.operators import regions as G
from sward.operators.neighbours import nearest_neighbours
from sward.operators.oversample import borderline_smote, oversampling_targets
from sward.operators import neighbours as N


def test_hot_plot_and_hot_species(spark):
    hot = F.col("id") % 3 == 0
    df = spark.range(30000).select(
        F.when(hot, 0).otherwise(F.col("id")).alias("plot_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("species"),
        F.lit(1.0).alias("cover"),
    )
    total = C.sum_cover(df)
    assert total.where("plot_id = 0 AND species = 'hot'").first()["cover"] == 10000.0
    assert total.agg(F.sum("cover")).first()[0] == 30000.0
    kept = C.min_support(df, "species", 500)
    assert kept.count() == df.groupBy("species").count().where("count >= 500").agg(F.sum("count")).first()[0]
    enc = E.fit_encoder(df, "species")
    assert E.encode(df, enc, "species").count() == 30000


def test_hot_coordinate(spark):
    hot = F.col("id") % 3 == 0
    df = spark.range(9000).select(
        F.col("id").alias("plot_id"),
        F.when(hot, 0.0).otherwise(F.col("id") / 1000.0).alias("lon"), F.lit(45.0).alias("lat"),
    )
    lines = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 2e7)], "grp string, x1 double, y1 double, x2 double, y2 double")
    out = G.locate(df, coasts=lines)
    assert out.count() == 9000
    assert out.where("coast = 'A'").count() == df.where("abs(radians(lon)) * 6378137 <= 5000").count()


def items(spark, matrix, labels=None):
    data = [
        (i, 0 if labels is None else int(labels[i]), [(j, float(v)) for j, v in enumerate(row) if v])
        for i, row in enumerate(matrix)
    ]
    return spark.createDataFrame(data, "row_id long, grp int, items array<struct<feature_id:int,value:double>>")


def test_neighbours_with_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_ROWS", 40)
    monkeypatch.setattr(N, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 6)).round(3)
    matrix[:100] = matrix[0]
    df = items(spark, matrix)
    near = nearest_neighbours(df, df, 4, 6, pivots=7)
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["row_id"]))
    far = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(2)).round(9)
    for i in range(300):
        want = sorted((far[i, j], j) for j in range(300) if j != i)[:4]
        assert [row for _, row in sorted(got[i])] == [j for _, j in want]


def test_neighbours_stay_within_the_group(spark):
    rng = np.random.default_rng(4)
    labels = np.arange(60) % 3
    df = items(spark, rng.normal(size=(60, 3)), labels)
    for r in nearest_neighbours(df, df, 5, 3, pivots=4).collect():
        assert labels[r["query_id"]] == labels[r["row_id"]]


def test_oversampling_reaches_the_target(spark):
    rng = np.random.default_rng(6)
    big, small = rng.normal(size=(300, 4)), rng.normal(size=(12, 4)) * 0.5
    matrix = np.vstack([big, small])
    rows = spark.createDataFrame([(i, int(i >= 300)) for i in range(312)], "row_id long, label_id int")
    values = spark.createDataFrame(
        [(i, j, float(matrix[i, j])) for i in range(312) for j in range(4)], "row_id long, feature_id int, value double"
    )
    assert oversampling_targets({0: 300, 1: 12}) == {1: 18}
    new, made = borderline_smote(rows, values, 4, seed=2)
    ids = [r["row_id"] for r in new.collect()]
    assert sorted(ids) == list(range(-18, 0)) and {r["label_id"] for r in new.collect()} == {1}
    low, high = small.min(0), small.max(0)
    for r in made.collect():
        assert low[r["feature_id"]] - 1e-9 <= r["value"] <= high[r["feature_id"]] + 1e-9
    again, _ = borderline_smote(rows.repartition(5), values, 4, seed=2)
    assert sorted(r["row_id"] for r in again.collect()) == sorted(ids)


def test_a_query_goes_to_a_unit_once(spark, monkeypatch):
    """Without anything to prune, queries are written once per unit, not once per cell."""
    written = []
    cut = N.cut_lineage

    def counting(df, *args):
        out = cut(df, *args)
        if "unit" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(N, "cut_lineage", counting)
    monkeypatch.setattr(N, "CHUNK_ROWS", 150)
    matrix = np.random.default_rng(5).normal(size=(300, 32)).round(3)
    near = nearest_neighbours(items(spark, matrix), items(spark, matrix), 3, 32, pivots=20)
    assert near.count() == 900
    assert written and written[0] <= 300 * 4
