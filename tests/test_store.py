from pyspark.sql import functions as F

from sward.operators.features import with_entries
from sward.sources.readers import load_by_row
from sward.sources.writers import write_by_row


def test_bucketed_store_needs_no_exchange(spark, tmp_path, rows):
    features = spark.range(4000).select(
        (F.col("id") % 500).alias("row_id"), (F.col("id") / 500).cast("int").alias("feature_id"), F.col("id").cast("double").alias("value"))
    plots = spark.range(520).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label_id"))
    paths = {k: str(tmp_path / k) for k in ("plots", "features")}
    write_by_row(plots, "store_plots", paths["plots"], buckets=8)
    write_by_row(features, "store_features", paths["features"], buckets=8)
    wanted = rows(with_entries(plots, features).select("row_id", "label_id", F.col("_ids").cast("string"), F.col("_values").cast("string")))
    # As another session would find them.
    found = [load_by_row(spark, f"other_{k}", paths[k], buckets=8) for k in ("plots", "features")]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = with_entries(*found)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert rows(df.select("row_id", "label_id", F.col("_ids").cast("string"), F.col("_values").cast("string"))) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in ("store_plots", "store_features", "other_plots", "other_features"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
