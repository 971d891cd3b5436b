"""Writers: processed tables, features, dictionaries, models, predictions and exports."""

from pyspark.sql import functions as F

# Layout expected by the external rule system, header and species tables.
EXPORT_HEADER = {
    "plot_id": "RELEVE_NR",
    "country": "Country",
    "altitude": "Altitude (m)",
    "lon": "DEG_LON",
    "lat": "DEG_LAT",
    "GESELLSCH": "GESELLSCH",
    "dataset": "dataset",
    "ecoregion": "Ecoreg",
    "dune": "Dunes_Bohn",
    "coast": "Coast_EEA",
}
EXPORT_HEADER_CONSTANTS = {"GESELLSCH": "GESELLSCH", "dataset": "dataset"}
EXPORT_SPECIES = {"plot_id": "RELEVE_NR", "species": "TaxonName", "cover": "Cover_Perc"}


def write_table(df, path, fmt="parquet", mode="overwrite"):
    """Write a processed table; ``fmt`` is parquet, csv or tsv."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        sep = {"csv": ",", "tsv": "\t"}[fmt]
        df.write.mode(mode).csv(path, header=True, sep=sep, escape='"')


def write_features(df, path, mode="overwrite"):
    """Write long-form features, one directory per fold so that folds prune."""
    fold = ["fold"] if "fold" in df.columns else []
    df.write.mode(mode).partitionBy(*fold).parquet(path)


def write_by_row(df, name, path, key="row_id", buckets=64):
    """Write a table in buckets of ``key``, sorted by it, and register it under ``name``.

    Tables in the same number of buckets are joined and gathered by ``key`` without an exchange.  The exchange
    that makes the buckets leaves one file per bucket.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def save_encoder(df, path, mode="overwrite"):
    """Persist a dictionary, name map or scaler table."""
    df.write.mode(mode).parquet(path)


def save_layout(layout, spark, path, mode="overwrite"):
    """Persist the feature groups and their sizes, a row per group."""
    spark.createDataFrame(list(layout.sizes), "name string, size int").coalesce(1).write.mode(mode).parquet(path)


def save_model(model, path):
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def write_predictions(df, path, fmt="parquet", mode="overwrite"):
    """Persist ``(plot_id, prediction, score)``."""
    write_table(df.select("plot_id", "prediction", "score"), path, fmt, mode)


def export_view(df, rename, constants=None):
    """Rename and reorder to another schema, with constant columns added or replaced."""
    constants = constants or {}
    return df.select(
        [(F.lit(constants[c]) if c in constants else F.col(c)).alias(n) for c, n in rename.items()]
    )


def write_export(df, path, mode="overwrite"):
    """Write an exported view as csv with every field quoted."""
    df.write.mode(mode).csv(path, header=True, quoteAll=True, escape='"')
