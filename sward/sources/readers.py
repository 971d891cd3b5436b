"""Readers: survey tables, reference tables, polygons, rasters and stored artefacts."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sward.functions import geo, text

# Column names of the survey exports and the names used from here on.
HEADER_COLUMNS = {
    "PlotObservationID": "plot_id",
    "Cover abundance scale": "cover_scale",
    "Date of recording": "recorded",
    "Expert System": "label",
    "Longitude": "lon",
    "Latitude": "lat",
}
PREDICT_HEADER_COLUMNS = {
    "PlotObservationID": "plot_id",
    "Longitude": "lon",
    "Latitude": "lat",
}
SPECIES_COLUMNS = {
    "PlotObservationID": "plot_id",
    "Matched concept": "species",
    "Cover %": "cover",
}
HEADER_NULL = "?"


def _delimited(spark, path, sep):
    # Without a schema every column is read as a string and found by its header name.
    return spark.read.csv(path, sep=sep, header=True, escape='"')


def read_header(spark, path, mode="train"):
    """Plot header, tab separated, all columns as strings; ``?`` also counts as missing."""
    columns = {"train": HEADER_COLUMNS, "predict": PREDICT_HEADER_COLUMNS}[mode]
    raw = _delimited(spark, path, "\t")
    return raw.select(
        [text.null_tokens(F.col(f"`{c}`"), [HEADER_NULL]).alias(n) for c, n in columns.items()]
    )


def read_species(spark, path):
    """Species observations, tab separated, all columns as strings."""
    raw = _delimited(spark, path, "\t")
    return raw.select(
        [text.null_tokens(F.col(f"`{c}`")).alias(n) for c, n in SPECIES_COLUMNS.items()]
    )


def read_table(spark, path, columns, sep=","):
    """Named columns of a delimited table; ``columns`` is a list or an old-to-new mapping."""
    if not isinstance(columns, dict):
        columns = {c: c for c in columns}
    raw = _delimited(spark, path, sep)
    return raw.select([text.null_tokens(F.col(f"`{c}`")).alias(n) for c, n in columns.items()])


def read_reference_table(spark, path, columns=None, fmt="parquet"):
    """Class list, crosswalk or threat sheet, from parquet or csv."""
    df = spark.read.parquet(path) if fmt == "parquet" else _delimited(spark, path, ",")
    if columns:
        df = df.select([F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    return df


RING_JSON = "array<array<struct<lon:double,lat:double>>>"


def load_polygons(df, name_col, geom_col="rings", id_col="geom_id"):
    """Polygons with lon/lat rings (array or JSON text) projected to Web-Mercator rings."""
    rings = F.col(geom_col)
    if df.schema[geom_col].dataType.typeName() == "string":
        rings = F.from_json(rings, RING_JSON)

    def project(point):
        return F.struct(
            geo.mercator_x(point["lon"]).alias("x"), geo.mercator_y(point["lat"]).alias("y")
        )

    return df.select(
        F.col(id_col).alias("geom_id"),
        F.col(name_col).alias("name"),
        F.transform(rings, lambda ring: F.transform(ring, project)).alias("rings"),
    )


RASTER_NODATA = 32767


def load_raster_cells(df, nodata=RASTER_NODATA):
    """Raster cells (row, col, value) with the no-data marker read as 0."""
    value = F.when(F.col("value") == nodata, 0).otherwise(F.col("value"))
    return df.select("row", "col", value.alias("value"))


#: Rows and columns of a raster tile.
TILE = 64


def tile_raster(cells, tile=TILE):
    """Raster cells as tiles: ``(tile_row, tile_col, tile, values)``, values row by row in an array.

    Cells that the raster lacks are null.  Meant to be written once; lookups then read a row per tile.
    """
    place = F.col("row") % tile * tile + F.col("col") % tile
    own = cells.select(
        F.expr(f"row div {tile}").cast("int").alias("tile_row"), F.expr(f"col div {tile}").cast("int").alias("tile_col"),
        place.cast("int").alias("at"), "value",
    )
    blank = own.select("tile_row", "tile_col").distinct().select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(tile * tile - 1))).alias("at"), F.lit(None).alias("value")
    )
    each = own.unionByName(blank).groupBy("tile_row", "tile_col", "at").agg(F.max("value").alias("value"))
    # At most tile x tile entries a list.
    rows = each.groupBy("tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("values"))
    return rows.select("tile_row", "tile_col", F.lit(tile).alias("tile"), "values")


def load_features(spark, path, fold=None):
    """Stored long-form features; a fold number prunes to one partition."""
    df = spark.read.parquet(path)
    return df if fold is None else df.where(F.col("fold") == fold)


def load_by_row(spark, name, path, key="row_id", buckets=64):
    """A table of ``write_by_row`` that another session wrote, registered here under ``name``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE `{name}` ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def load_encoder(spark, path):
    """Stored dictionary ``(value, id)``, name map or scaler table."""
    return spark.read.parquet(path)


def load_layout(spark, path):
    """Stored feature groups."""
    from sward.operators.features import Layout

    return Layout.of(**{r["name"]: r["size"] for r in spark.read.parquet(path).collect()})


def load_optional(spark, path):
    """A stored table, or None where none was stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if known else None


def load_model(path):
    """Stored fitted pipeline."""
    return PipelineModel.load(path)


def read_predictions(spark, path, fmt="parquet"):
    """Predictions keyed by plot: ``(plot_id, prediction, score)``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _delimited(spark, path, ",").select(
        F.col("plot_id").cast("long").alias("plot_id"),
        "prediction",
        F.col("score").cast("double").alias("score"),
    )


def split_truth(df, col="truth"):
    """Turn ``', '``-separated codes into an array of codes."""
    return df.withColumn(col, F.split(F.col(col), ", "))


def read_truth(spark, path, fmt="parquet"):
    """Multi-label truth keyed by plot: ``(plot_id, truth array)``."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = _delimited(spark, path, ",").select(
            F.col("plot_id").cast("long").alias("plot_id"), "truth"
        )
    return split_truth(df)
