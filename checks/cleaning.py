"""Queries: sources, cleaning, joins and aggregates of the survey tables."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import oracle, table, view
from sward.functions import geo, text
from sward.operators import cleaning as C
from sward.session import scratch_path
from sward.sources import readers as R
from sward.sources import writers as K

CLEAN = """
SELECT plot_id, coalesce(cover_scale, '0') AS cover_scale, coalesce(recorded, '0') AS recorded, label, lon, lat,
  cast(right(replace(coalesce(recorded, '0'), ':', ''), 4) AS int) AS year
FROM v_header WHERE label IS NOT NULL AND coalesce(cover_scale, '0') <> 'Presence/Absence'"""
LABELLED = "SELECT plot_id, unnest(string_split(label, ',')) AS label, lon, lat, year FROM clean"
ALLOWED = """
SELECT code FROM v_codes WHERE length(code) = CASE WHEN starts_with(code, 'MA2') THEN 5 ELSE 3 END"""
IN_LIST = "SELECT * FROM labelled WHERE label IN (SELECT code FROM allowed)"
TRAIN = """
SELECT plot_id, label, round_even(lon * 1e4, 0) / 1e4 AS lon, round_even(lat * 1e4, 0) / 1e4 AS lat
FROM inlist WHERE label IN (SELECT label FROM inlist GROUP BY label HAVING count(*) >= 10)"""
HEADER_PARTS = dict(clean=CLEAN, labelled=LABELLED, allowed=ALLOWED, inlist=IN_LIST, train=TRAIN)
SUMMED = """
SELECT plot_id, species, round(sum(cover), 6) AS cover FROM v_species
WHERE plot_id IN (SELECT plot_id FROM train) GROUP BY plot_id, species"""
SUPPORTED = """
SELECT * FROM summed WHERE cover > 0 AND species IN
  (SELECT species FROM summed WHERE cover > 0 GROUP BY species HAVING count(*) >= 10)"""
SPECIES_PARTS = dict(**HEADER_PARTS, summed=SUMMED, supported=SUPPORTED)
NORMALISED = """
SELECT s.plot_id, b.accepted_name AS species, round(sum(s.cover), 6) AS cover
FROM supported s JOIN v_backbone b ON s.species = b.raw_name
WHERE b.phylum = 'Tracheophyta' AND b.accepted_name IS NOT NULL GROUP BY s.plot_id, b.accepted_name"""
NAME_PARTS = dict(**SPECIES_PARTS, normalised=NORMALISED)
RANKED = """
SELECT plot_id, species, 1.0e0 / dense_rank() OVER (PARTITION BY plot_id ORDER BY cover DESC) AS value
FROM normalised"""


def training_header(spark, **kw):
    codes = C.codes_at_level(view(spark, "v_codes"), 3)
    return C.training_header(view(spark, "v_header"), codes, **kw)


def training_species(spark, header=None):
    header = training_header(spark) if header is None else header
    return C.training_species(view(spark, "v_species"), header, digits=6)


def _stored(spark, df, name, fmt="tsv"):
    path = scratch_path(spark, name)
    K.write_table(df, path, fmt)
    return path


def _as_columns(df, names):
    return df.select([F.col(new).alias(old) for old, new in names.items()])


# Sources and sinks: each query writes the whole table and reads it back.


@query("read_header", oracle("SELECT plot_id, cover_scale, recorded, label, round(lon, 5) AS lon FROM v_header", "v_header"))
def _(spark):
    raw = _as_columns(view(spark, "v_header"), R.HEADER_COLUMNS).fillna("?")
    df = R.read_header(spark, _stored(spark, raw, "header"))
    return df.select(
        F.col("plot_id").cast("long").alias("plot_id"), "cover_scale", "recorded", "label",
        F.round(F.col("lon").cast("double"), 5).alias("lon"),
    )


@query("read_species", oracle("SELECT plot_id, species, round(cover, 6) AS cover FROM v_species", "v_species"))
def _(spark):
    raw = _as_columns(view(spark, "v_species"), R.SPECIES_COLUMNS)
    df = C.clean_species(R.read_species(spark, _stored(spark, raw, "species")))
    return df.withColumn("cover", F.round("cover", 6))


@query("read_prediction_header", oracle(
    "SELECT plot_id, round_even(lon * 1e4, 0) / 1e4 AS lon, round_even(lat * 1e4, 0) / 1e4 AS lat FROM v_header", "v_header"))
def _(spark):
    raw = _as_columns(view(spark, "v_header"), R.PREDICT_HEADER_COLUMNS)
    return C.prediction_header(R.read_header(spark, _stored(spark, raw, "plots"), mode="predict"))


@query("read_table_columns", oracle("SELECT plot_id, habitat AS habitat_name FROM v_attributes", "v_attributes"))
def _(spark):
    path = _stored(spark, view(spark, "v_attributes"), "attributes", "csv")
    df = R.read_table(spark, path, {"plot_id": "plot_id", "habitat": "habitat_name"})
    return df.withColumn("plot_id", F.col("plot_id").cast("long"))


@query("read_reference_table", oracle("SELECT ord, new_code AS code, old_codes FROM v_crosswalk", "v_crosswalk"))
def _(spark):
    path = _stored(spark, view(spark, "v_crosswalk"), "crosswalk", "parquet")
    return R.read_reference_table(
        spark, path, {"ord": "ord", "new_code": "code", "old_codes": "old_codes"}
    )


@query("load_raster_cells", oracle(
    "SELECT row, col, CASE WHEN value = 32767 THEN 0 ELSE value END AS value FROM v_raster", "v_raster"))
def _(spark):
    return R.load_raster_cells(view(spark, "v_raster"))


@query("read_truth", oracle("""
SELECT plot_id, len(string_split(truth, ', ')) AS n_codes, string_split(truth, ', ')[2] AS second FROM v_predictions""", "v_predictions"))
def _(spark):
    path = _stored(spark, view(spark, "v_predictions").select("plot_id", "truth"), "truth", "csv")
    df = R.read_truth(spark, path, "csv")
    return df.select("plot_id", F.size("truth").cast("long").alias("n_codes"), F.get("truth", F.lit(1)).alias("second"))


@query("write_predictions", oracle(
    "SELECT plot_id, prediction, 1.0e0 / (1 + fold) AS score FROM v_predictions", "v_predictions"))
def _(spark):
    path = scratch_path(spark, "predictions")
    df = view(spark, "v_predictions").withColumn("score", 1.0 / (1 + F.col("fold")))
    K.write_predictions(df, path)
    return R.read_predictions(spark, path)


@query("write_features_by_fold", oracle("""
SELECT row_id, feature_id, value, cast(row_id % 10 AS int) AS fold FROM v_features WHERE row_id % 10 = 3""", "v_features"))
def _(spark):
    path = scratch_path(spark, "features")
    fold = (F.col("row_id") % 10).cast("int")
    K.write_features(view(spark, "v_features").withColumn("fold", fold), path)
    return R.load_features(spark, path, fold=3)


@query("export_view", oracle("""
SELECT plot_id AS "RELEVE_NR", species AS "TaxonName", cast(trunc(cover) AS int) AS "Cover_Perc", 'dataset' AS dataset
FROM v_species""", "v_species"))
def _(spark):
    df = view(spark, "v_species").withColumn("cover", C.truncate_int("cover"))
    out = K.export_view(df, {**K.EXPORT_SPECIES, "dataset": "dataset"}, {"dataset": "dataset"})
    path = scratch_path(spark, "export")
    K.write_export(out, path)
    names = {c: c for c in out.columns}
    back = R.read_table(spark, path, names)
    return back.select(
        F.col("RELEVE_NR").cast("long").alias("RELEVE_NR"), "TaxonName",
        F.col("Cover_Perc").cast("int").alias("Cover_Perc"), "dataset",
    )


@query("export_header", oracle("""
SELECT plot_id AS "RELEVE_NR", 'Region ' || (plot_id % 7) AS "Country", cast(plot_id % 900 AS int) AS "Altitude (m)", round(lon, 5) AS "DEG_LON",
  round(lat, 5) AS "DEG_LAT", 'GESELLSCH' AS "GESELLSCH", 'dataset' AS dataset, cast(plot_id % 50 AS varchar) AS "Ecoreg",
  CASE WHEN plot_id % 2 = 0 THEN 'Y_DUNES' ELSE 'N_DUNES' END AS "Dunes_Bohn", 'N_COAST' AS "Coast_EEA"
FROM v_location""", "v_location"))
def _(spark):
    plots = view(spark, "v_location").select(
        "plot_id", "lon", "lat", F.concat(F.lit("Region "), F.col("plot_id") % 7).alias("country"),
        (F.col("plot_id") % 900).cast("int").alias("altitude"), (F.col("plot_id") % 50).cast("string").alias("ecoregion"),
        F.when(F.col("plot_id") % 2 == 0, "Y_DUNES").otherwise("N_DUNES").alias("dune"), F.lit("N_COAST").alias("coast"),
    )
    out = K.export_view(plots, K.EXPORT_HEADER, K.EXPORT_HEADER_CONSTANTS)
    path = scratch_path(spark, "export")
    K.write_export(out, path)
    back = R.read_table(spark, path, {c: c for c in out.columns})
    return back.select(*[
        F.round(F.col(f"`{c}`").cast("double"), 5).alias(c) if c.startswith("DEG") else F.col(f"`{c}`").cast(t).alias(c)
        for c, t in out.dtypes
    ])


# Projections, filters, predicates.


@query("clean_header", oracle(
    "SELECT plot_id, cover_scale, recorded, label, year FROM clean", "v_header", clean=CLEAN))
def _(spark):
    return C.clean_header(view(spark, "v_header")).select("plot_id", "cover_scale", "recorded", "label", "year")


@query("year_filter", oracle("SELECT plot_id, year FROM clean WHERE year >= 1995", "v_header", clean=CLEAN))
def _(spark):
    return C.clean_header(view(spark, "v_header"), min_year=1995).select("plot_id", "year")


@query("explode_labels", oracle("SELECT plot_id, label, year FROM labelled", "v_header", clean=CLEAN, labelled=LABELLED))
def _(spark):
    return C.explode_labels(C.clean_header(view(spark, "v_header"))).select("plot_id", "label", "year")


@query("codes_at_level", oracle("SELECT code FROM allowed", "v_codes", allowed=ALLOWED))
def _(spark):
    return C.codes_at_level(view(spark, "v_codes"), 3)


@query("codes_at_each_level", oracle("""
SELECT level, count(*) AS codes FROM v_codes, (SELECT unnest([1, 2, 3]) AS level) l
WHERE length(code) = CASE WHEN starts_with(code, 'MA2') THEN level + 2 ELSE level END GROUP BY level""", "v_codes"))
def _(spark):
    codes = view(spark, "v_codes")
    parts = [C.codes_at_level(codes, n).select(F.lit(n).alias("level")) for n in (1, 2, 3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("codes"))


@query("round_coordinates", oracle("""
SELECT plot_id, round_even(lon * 1e4, 0) / 1e4 AS lon, round_even(lat * 1e4, 0) / 1e4 AS lat FROM v_header""", "v_header"))
def _(spark):
    return C.round_coordinates(view(spark, "v_header").select("plot_id", "lon", "lat"))


@query("mercator_projection", oracle("""
SELECT plot_id, round(6378137 * radians(lon), 2) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS y
FROM v_header""", "v_header"))
def _(spark):
    return view(spark, "v_header").select(
        "plot_id",
        F.round(geo.mercator_x(F.col("lon")), 2).alias("x"),
        F.round(geo.mercator_y(F.col("lat")), 2).alias("y"),
    )


@query("positive_cover", oracle("SELECT plot_id, species, round(cover, 6) AS cover FROM v_species WHERE cover > 0", "v_species"))
def _(spark):
    return C.filter_positive(view(spark, "v_species")).withColumn("cover", F.round("cover", 6))


@query("keep_allowed_regions", oracle("""
SELECT s.plot_id, s.species, p.region FROM v_species s JOIN v_predictions p USING (plot_id)
WHERE p.region IN ('F', 'O')""", "v_species", "v_predictions"))
def _(spark):
    plots, species = C.keep_regions(
        view(spark, "v_predictions").select("plot_id", "region"), view(spark, "v_species"),
        "F, O", "region",
    )
    return species.join(plots, "plot_id").select("plot_id", "species", "region")


@query("scale_and_truncate_cover", oracle("""
SELECT plot_id, species, cast(trunc(midpoint * 100) AS int) AS cover
FROM v_occurrences JOIN v_scale USING (scale_code)""", "v_occurrences", "v_scale"))
def _(spark):
    df = C.cover_from_scale(view(spark, "v_occurrences"), view(spark, "v_scale"))
    return df.withColumn("cover", C.truncate_int("cover"))


@query("attribute_value_filter", oracle("""
SELECT plot_id, habitat FROM v_attributes WHERE caption = 'Survey class' AND habitat <> 'Not in scheme'""", "v_attributes"))
def _(spark):
    df = view(spark, "v_attributes").where((F.col("caption") == "Survey class") & (F.col("habitat") != "Not in scheme"))
    return df.select("plot_id", "habitat")


@query("code_parts", oracle("""
SELECT DISTINCT label, left(label, length(label) - 1) AS parent, left(label, length(label) - 2) AS root,
  CASE WHEN starts_with(label, 'MA2') THEN 'MA2' ELSE left(label, 1) END AS top_group FROM labelled""",
    "v_header", clean=CLEAN, labelled=LABELLED))
def _(spark):
    label = F.col("label")
    df = C.explode_labels(C.clean_header(view(spark, "v_header")))
    return df.select(
        "label", text.parent_code(label).alias("parent"), text.parent_code(label, 2).alias("root"),
        text.top_group(label).alias("top_group"),
    ).distinct()


@query("strip_list_marks", oracle("""
SELECT s_suppkey, replace(replace(replace(concat('[''', s_name, ''']'), '[', ''), ']', ''), '''', '') AS name
FROM supplier"""))
def _(spark):
    marked = F.concat(F.lit("['"), F.col("s_name"), F.lit("']"))
    return table(spark, "supplier").select("s_suppkey", text.strip_list_marks(marked).alias("name"))


@query("genus_of_name", oracle("SELECT p_partkey, string_split(p_name, ' ')[1] AS genus FROM part"))
def _(spark):
    return table(spark, "part").select("p_partkey", text.genus(F.col("p_name")).alias("genus"))


# Joins.


@query("species_of_known_plots", oracle("""
SELECT plot_id, species, round(cover, 6) AS cover FROM v_species WHERE plot_id IN (SELECT plot_id FROM train)""",
    "v_header", "v_codes", "v_species", **HEADER_PARTS))
def _(spark):
    return C.of_plots(view(spark, "v_species"), training_header(spark)).withColumn("cover", F.round("cover", 6))


@query("plots_with_species", oracle("""
SELECT plot_id, label, lon, lat FROM train WHERE plot_id IN (SELECT plot_id FROM supported)""",
    "v_header", "v_codes", "v_species", **SPECIES_PARTS))
def _(spark):
    header = training_header(spark)
    return C.of_plots(header, training_species(spark, header))


@query("labels_in_class_list", oracle(
    "SELECT plot_id, label FROM inlist", "v_header", "v_codes", clean=CLEAN, labelled=LABELLED, allowed=ALLOWED, inlist=IN_LIST))
def _(spark):
    codes = C.codes_at_level(view(spark, "v_codes"), 3).withColumnRenamed("code", "label")
    df = C.explode_labels(C.clean_header(view(spark, "v_header")))
    return df.join(codes, "label", "left_semi").select("plot_id", "label")


@query("plots_not_on_list", oracle("""
SELECT plot_id FROM v_header WHERE plot_id NOT IN (SELECT plot_id FROM v_species WHERE cover > 45)""", "v_header", "v_species"))
def _(spark):
    reject = view(spark, "v_species").where(F.col("cover") > 45)
    return C.not_of_plots(view(spark, "v_header").select("plot_id"), reject)


@query("attributes_with_location", oracle("""
SELECT plot_id, habitat, round(lon, 5) AS lon, round(lat, 5) AS lat
FROM v_attributes LEFT JOIN v_location USING (plot_id)""", "v_attributes", "v_location"))
def _(spark):
    df = view(spark, "v_attributes").join(view(spark, "v_location"), "plot_id", "left")
    return df.select("plot_id", "habitat", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query("retained_plots", oracle("""
SELECT plot_id, kept FROM
  (SELECT plot_id, count(*) AS kept FROM (SELECT DISTINCT v.plot_id, b.accepted_name FROM v_species v
     JOIN v_backbone b ON v.species = b.raw_name
     WHERE b.phylum = 'Tracheophyta' AND b.accepted_name IS NOT NULL) t GROUP BY plot_id) a
JOIN (SELECT plot_id, count(*) AS had FROM v_species GROUP BY plot_id) b USING (plot_id)
WHERE kept >= 0.75 * had""", "v_species", "v_backbone"))
def _(spark):
    from sward.operators.taxonomy import normalise_names

    before = view(spark, "v_species")
    after = C.retention_filter(normalise_names(before, view(spark, "v_backbone")), before)
    return after.groupBy("plot_id").agg(F.count(F.lit(1)).alias("kept"))


# Aggregations.


@query("sum_cover", oracle("""
SELECT plot_id, species, round(sum(cover), 6) AS cover FROM v_species GROUP BY plot_id, species""", "v_species"))
def _(spark):
    return C.sum_cover(view(spark, "v_species"), digits=6)


@query("label_min_support", oracle(
    "SELECT plot_id, label, lon, lat FROM train", "v_header", "v_codes", **HEADER_PARTS))
def _(spark):
    return training_header(spark)


@query("species_min_support", oracle(
    "SELECT plot_id, species, cover FROM supported", "v_header", "v_codes", "v_species", **SPECIES_PARTS))
def _(spark):
    return training_species(spark)


@query("prediction_species", oracle("""
SELECT plot_id, species, round(sum(cover), 6) AS cover FROM v_species
WHERE plot_id IN (SELECT plot_id FROM v_location) GROUP BY plot_id, species HAVING sum(cover) > 0""",
    "v_species", "v_location"))
def _(spark):
    return C.prediction_species(view(spark, "v_species"), view(spark, "v_location"), digits=6)
