"""Queries: names and codes, encoders, folds and long-form features."""

from pyspark.sql import functions as F

from checks.cleaning import (
    CLEAN, HEADER_PARTS, LABELLED, NAME_PARTS, RANKED, training_header, training_species,
)
from checks.registry import query
from checks.views import oracle, table, view
from sward.functions import geo, hashing, text
from sward.operators import attribution as A
from sward.operators import cleaning as C
from sward.operators import encoding as E
from sward.operators import features as X
from sward.operators import folds as S
from sward.operators import taxonomy as T
from sward.session import scratch_path
from sward.sources import readers as R
from sward.sources import writers as K

RAW = ("v_header", "v_codes", "v_species", "v_backbone")
N_SPECIES = 150  # ids of v_features below this act as species


def normalised(spark):
    return T.normalise_names(training_species(spark), view(spark, "v_backbone"), digits=6)


@query("ranked_composition", oracle("SELECT plot_id, species, value FROM ranked", *RAW, **NAME_PARTS, ranked=RANKED))
def _(spark):
    species = normalised(spark).select(
        F.col("plot_id").alias("row_id"), F.lit(0).alias("feature_id"), F.col("cover").alias("value"), "species"
    )
    return X.inverse_rank(species, 1).select(F.col("row_id").alias("plot_id"), "species", "value")


# Names and codes.

NAME_MAP = """
SELECT raw_name, CASE WHEN phylum = 'Tracheophyta' AND accepted_name IS NOT NULL THEN accepted_name ELSE '?' END AS accepted_name
FROM v_backbone"""


@query("name_map", oracle("SELECT * FROM m WHERE raw_name IN (SELECT species FROM v_species)", "v_backbone", "v_species", m=NAME_MAP))
def _(spark):
    return T.observed_name_map(view(spark, "v_species"), view(spark, "v_backbone"))


@query("normalise_names", oracle("SELECT plot_id, species, cover FROM normalised", *RAW, **NAME_PARTS))
def _(spark):
    return normalised(spark)


@query("normalise_names_for_prediction", oracle("""
SELECT plot_id, accepted_name AS species, round(sum(cover), 6) AS cover FROM v_species JOIN m ON species = raw_name
WHERE accepted_name <> '?' AND accepted_name IN (SELECT accepted_name FROM v_accepted WHERE accepted_name <> '?')
GROUP BY plot_id, accepted_name""", "v_species", "v_backbone", "v_accepted", m=NAME_MAP))
def _(spark):
    return T.normalise_names(
        view(spark, "v_species"), view(spark, "v_backbone"), view(spark, "v_accepted"), digits=6
    )


EDGES = """
SELECT trim(unnest(string_split(old_codes, ';'))) AS old_code, new_code, ord FROM v_crosswalk WHERE old_codes IS NOT NULL"""
MAPPED = """
SELECT plot_id, codes FROM (SELECT plot_id, habitat FROM v_attributes) a JOIN v_habitat_codes USING (habitat)"""
OLD_CODES = """
SELECT plot_id, trim(code) AS old_code FROM (SELECT plot_id, unnest(string_split(codes, ', ')) AS code FROM mapped) t"""
NEW_CODES = """
SELECT plot_id, coalesce(new_code, '~') AS code FROM old LEFT JOIN edges USING (old_code)"""
DEEP = """
SELECT plot_id, code FROM new WHERE code NOT IN (SELECT code FROM v_codes)
UNION ALL
SELECT plot_id, code FROM new WHERE code IN (SELECT code FROM v_codes)
  AND length(code) = CASE WHEN starts_with(code, 'MA2') THEN 5 ELSE 3 END
UNION ALL
SELECT n.plot_id, c.code FROM new n JOIN v_codes c ON starts_with(c.code, n.code)
WHERE n.code IN (SELECT code FROM v_codes)
  AND CASE WHEN starts_with(n.code, 'MA2') THEN length(n.code) IN (3, 4) AND length(c.code) = 5
           ELSE length(n.code) IN (1, 2) AND length(c.code) = 3 END"""
CODE_PARTS = dict(edges=EDGES, mapped=MAPPED, old=OLD_CODES, new=NEW_CODES, deep=DEEP)
CODE_VIEWS = ("v_crosswalk", "v_attributes", "v_habitat_codes", "v_codes")


def mapped_codes(spark):
    lookup = view(spark, "v_habitat_codes")
    df = T.map_column(view(spark, "v_attributes"), lookup, "habitat", "habitat", "codes")
    return df.select("plot_id", F.col("habitat").alias("codes"))


def crossed(spark):
    """What the crosswalk makes of code lists."""
    edges = T.crosswalk_edges(view(spark, "v_crosswalk"))
    return lambda cells: T.crosswalk_codes(T.split_codes(cells, key="codes"), edges)


def deepened(spark):
    """What the crosswalk and the class list make of code lists."""
    cross, codes = crossed(spark), view(spark, "v_codes")
    return lambda cells: T.expand_to_level(cross(cells), codes)


@query("map_column", oracle("SELECT plot_id, codes FROM mapped", *CODE_VIEWS, mapped=MAPPED))
def _(spark):
    return mapped_codes(spark)


@query("crosswalk_codes", oracle("SELECT plot_id, code FROM new", *CODE_VIEWS, **CODE_PARTS))
def _(spark):
    return T.codes_of_cells(mapped_codes(spark), crossed(spark)).select("plot_id", "code")


@query("expand_to_level", oracle("SELECT plot_id, code FROM deep", *CODE_VIEWS, **CODE_PARTS))
def _(spark):
    return T.codes_of_cells(mapped_codes(spark), deepened(spark)).select("plot_id", "code")


@query("label_noise", oracle("""
SELECT plot_id, round(avg(CASE WHEN code IN (SELECT DISTINCT label FROM train) THEN 0.0e0 ELSE 1.0e0 END) * 100, 6) AS noise_pct
FROM deep GROUP BY plot_id""", *CODE_VIEWS, "v_header", **CODE_PARTS, **HEADER_PARTS))
def _(spark):
    known = training_header(spark).select(F.col("label").alias("code")).distinct()
    sets = T.label_sets_of_cells(mapped_codes(spark), deepened(spark), known, "plot_id")
    return sets.select("plot_id", F.round("noise_pct", 6).alias("noise_pct"))


@query("clean_label_sets", oracle("""
SELECT plot_id, string_agg(DISTINCT code, ', ' ORDER BY code) FILTER (code IN (SELECT label FROM train)) AS codes
FROM deep GROUP BY plot_id
HAVING avg(CASE WHEN code IN (SELECT label FROM train) THEN 0.0e0 ELSE 1.0e0 END) * 100 <= 50
  AND count(DISTINCT code) FILTER (code IN (SELECT label FROM train)) <= 5""",
    *CODE_VIEWS, "v_header", **CODE_PARTS, **HEADER_PARTS))
def _(spark):
    known = training_header(spark).select(F.col("label").alias("code")).distinct()
    kept = T.keep_clean_labels(T.label_sets_of_cells(mapped_codes(spark), deepened(spark), known, "plot_id"))
    return kept.select("plot_id", F.array_join("codes", ", ").alias("codes"))


@query("endangered_labels", oracle("""
SELECT code, id FROM (SELECT new_code AS code, threat_code, row_number() OVER (PARTITION BY new_code ORDER BY ord DESC) AS rn FROM v_crosswalk) x
JOIN (SELECT threat_code, category, row_number() OVER (PARTITION BY threat_code ORDER BY ord DESC) AS rn FROM v_threats) t USING (threat_code)
JOIN (SELECT label AS code, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM labelled) d) l USING (code)
WHERE x.rn = 1 AND t.rn = 1 AND t.category LIKE '%Endangered%'""",
    "v_crosswalk", "v_threats", "v_header", clean=CLEAN, labelled=LABELLED))
def _(spark):
    labels = E.fit_encoder(C.explode_labels(C.clean_header(view(spark, "v_header"))), "label")
    labels = labels.select(F.col("value").alias("code"), F.col("id").cast("long").alias("id"))
    crosswalk = view(spark, "v_crosswalk").withColumnRenamed("new_code", "code")
    return T.endangered_labels(crosswalk, view(spark, "v_threats"), labels)


FIXED = """
SELECT code, CASE category WHEN 'Least concern' THEN 'Least Concern' WHEN 'Near threatened' THEN 'Near Threatened'
  WHEN 'Critically EndangeredR' THEN 'Critically Endangered' ELSE category END AS category FROM v_threats"""
HIGHEST = """
SELECT code, category FROM (SELECT code, category, row_number() OVER (PARTITION BY code ORDER BY list_position(
  ['Data Deficient', 'Least Concern', 'Near Threatened', 'Vulnerable', 'Endangered', 'Critically Endangered'], category) DESC) AS rn
  FROM fixed) t WHERE rn = 1"""
THREAT_PLOTS = """
SELECT plot_id, label, coalesce(category, 'Data Deficient') AS category,
  CASE coalesce(category, 'Data Deficient') WHEN 'Data Deficient' THEN 'Incomplete Category' WHEN 'Least Concern' THEN 'Stable Category'
    WHEN 'Near Threatened' THEN 'Stable Category' ELSE 'Threatened Category' END AS threat_group
FROM labelled LEFT JOIN highest ON label = code"""
THREAT_PARTS = dict(clean=CLEAN, labelled=LABELLED, fixed=FIXED, highest=HIGHEST, threat_plots=THREAT_PLOTS)


@query("canonical_category", oracle("SELECT code, category, count(*) AS n FROM fixed GROUP BY ALL", "v_threats", fixed=FIXED))
def _(spark):
    df = view(spark, "v_threats").withColumn("category", T.canonical_category(F.col("category")))
    return df.groupBy("code", "category").agg(F.count(F.lit(1)).alias("n"))


@query("highest_category", oracle("SELECT code, category FROM highest", "v_threats", fixed=FIXED, highest=HIGHEST))
def _(spark):
    return T.highest_category(view(spark, "v_threats").select("code", "category"))


@query("plots_with_threat_group", oracle("SELECT plot_id, label, category, threat_group FROM threat_plots", "v_header", "v_threats", **THREAT_PARTS))
def _(spark):
    plots = C.explode_labels(C.clean_header(view(spark, "v_header"))).select("plot_id", "label")
    return T.with_category(plots, T.highest_category(view(spark, "v_threats").select("code", "category")))


ONE_CHILD = "SELECT DISTINCT broad, fine FROM v_habitat_lookup WHERE broad IN (SELECT broad FROM v_habitat_lookup GROUP BY broad HAVING count(DISTINCT fine) = 1)"


@query("single_child", oracle("SELECT broad, fine FROM one", "v_habitat_lookup", one=ONE_CHILD))
def _(spark):
    return T.single_child(view(spark, "v_habitat_lookup"), "broad", "fine").distinct()


@query("coalesce_join", oracle("""
SELECT plot_id, coalesce(fine, habitat) AS habitat FROM v_attributes LEFT JOIN one ON habitat = broad""",
    "v_attributes", "v_habitat_lookup", one=ONE_CHILD))
def _(spark):
    one = T.single_child(view(spark, "v_habitat_lookup"), "broad", "fine").distinct()
    return T.coalesce_join(view(spark, "v_attributes"), one, "habitat", "broad", "fine").select("plot_id", "habitat")


# Encoders.


@query("fit_label_encoder", oracle(
    "SELECT label AS value, cast(row_number() OVER (ORDER BY label) - 1 AS int) AS id FROM (SELECT DISTINCT label FROM train) t",
    "v_header", "v_codes", **HEADER_PARTS))
def _(spark):
    return E.fit_encoder(training_header(spark), "label")


@query("encode_species", oracle("""
SELECT plot_id, cast(id AS int) AS species_id, cover FROM v_sum JOIN
  (SELECT species, row_number() OVER (ORDER BY species) - 1 AS id FROM (SELECT DISTINCT species FROM v_sum) t) e USING (species)""",
    "v_species", v_sum="SELECT plot_id, species, round(sum(cover), 6) AS cover FROM v_species GROUP BY plot_id, species"))
def _(spark):
    species = C.sum_cover(view(spark, "v_species"), digits=6)
    encoder = E.fit_encoder(view(spark, "v_species"), "species")
    return E.encode(species, encoder, "species", "species_id").drop("species")


@query("encode_then_decode", oracle("SELECT plot_id, label FROM train", "v_header", "v_codes", **HEADER_PARTS))
def _(spark):
    header = training_header(spark).select("plot_id", "label")
    encoder = E.fit_encoder(header, "label")
    path = scratch_path(spark, "encoder")
    K.save_encoder(encoder, path)
    stored = R.load_encoder(spark, path)
    return E.decode(E.encode(header, stored, "label"), stored, "label")


@query("one_hot_unseen", oracle("""
SELECT row_id, cast(150 + id AS int) AS feature_id, 1.0e0 AS value FROM
  (SELECT plot_id AS row_id, region FROM v_predictions) p JOIN
  (SELECT region, row_number() OVER (ORDER BY region) - 1 AS id FROM (SELECT DISTINCT region FROM v_predictions WHERE region <> 'P') t) e
  USING (region)""", "v_predictions"))
def _(spark):
    plots = view(spark, "v_predictions").select(F.col("plot_id").alias("row_id"), "region")
    encoder = E.fit_encoder(plots.where(F.col("region") != "P"), "region")
    return E.one_hot(plots, encoder, "region", offset=150)


# Blocks and folds.

# Meridian-arc factors printed with full precision, and the two circumferences.
ARC = [repr(v) for v in geo.meridian_terms()]
KM = f"""
SELECT plot_id, lon, lat,
  CASE WHEN lon < 0 THEN 40075.017e0 - 6378.137e0 * radians(abs(lon)) ELSE 6378.137e0 * radians(abs(lon)) END AS east,
  CASE WHEN lat < 0 THEN 40007.863e0 ELSE 0 END + CASE WHEN lat < 0 THEN -1 ELSE 1 END * (
    {ARC[0]} * radians(abs(lat)) + ({ARC[1]}) * sin(2 * radians(abs(lat))) + ({ARC[2]}) * sin(4 * radians(abs(lat)))
    + ({ARC[3]}) * sin(6 * radians(abs(lat))) + ({ARC[4]}) * sin(8 * radians(abs(lat)))) AS north
FROM train"""
BLOCKS = "SELECT plot_id, printf('e%04dn%04d', cast(floor(east / 10) AS bigint), cast(floor(north / 10) AS bigint)) AS block_id FROM km"
FOLDS = """
SELECT block_id, cast(ntile(10) OVER (ORDER BY md5('123:' || block_id), block_id) - 1 AS int) AS fold
FROM (SELECT DISTINCT block_id FROM blocks) t"""
FOLD_PARTS = dict(**HEADER_PARTS, km=KM, blocks=BLOCKS, folds=FOLDS)


@query("grid_kilometres", oracle("SELECT plot_id, round(east, 4) AS east, round(north, 4) AS north FROM km",
    "v_header", "v_codes", **HEADER_PARTS, km=KM))
def _(spark):
    return training_header(spark).select(
        "plot_id", F.round(geo.easting_km(F.col("lon")), 4).alias("east"),
        F.round(geo.northing_km(F.col("lat")), 4).alias("north"),
    )


@query("grid_blocks", oracle("SELECT plot_id, block_id FROM blocks", "v_header", "v_codes", **FOLD_PARTS))
def _(spark):
    return S.with_blocks(training_header(spark)).select("plot_id", "block_id")


@query("assign_folds", oracle("SELECT plot_id, block_id, fold FROM blocks JOIN folds USING (block_id)", "v_header", "v_codes", **FOLD_PARTS))
def _(spark):
    return S.assign_folds(training_header(spark)).select("plot_id", "block_id", "fold")


@query("block_summary", oracle("""
SELECT fold, count(DISTINCT block_id) AS blocks, count(*) AS plots FROM blocks JOIN folds USING (block_id) GROUP BY fold""",
    "v_header", "v_codes", **FOLD_PARTS))
def _(spark):
    return S.block_summary(S.assign_folds(training_header(spark)))


@query("block_count", oracle("SELECT count(DISTINCT block_id) AS blocks FROM blocks", "v_header", "v_codes", **FOLD_PARTS))
def _(spark):
    return S.block_count(S.with_blocks(training_header(spark)))


@query("split_fold", oracle("""
SELECT part, count(*) AS rows FROM (SELECT CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS part FROM v_classified) t GROUP BY part""",
    "v_classified"))
def _(spark):
    train, test = S.split_fold(view(spark, "v_classified"), 2)
    both = A.tag_union({"train": train, "test": test}, "part")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


# Long-form features.

SP = f"feature_id < {N_SPECIES}"


def features(spark):
    return view(spark, "v_features")


@query("inverse_rank", oracle(f"""
SELECT row_id, feature_id, CASE WHEN {SP} THEN 1.0e0 / dense_rank() OVER (PARTITION BY row_id, {SP} ORDER BY value DESC) ELSE value END AS value
FROM v_features""", "v_features"))
def _(spark):
    return X.inverse_rank(features(spark), N_SPECIES)


@query("l1_normalise", oracle(f"""
SELECT row_id, feature_id, round(CASE WHEN {SP} AND n > 0 THEN value / n ELSE value END, 12) AS value
FROM (SELECT *, sum(abs(value)) OVER (PARTITION BY row_id, {SP}) AS n FROM v_features) t""", "v_features"))
def _(spark):
    return X.l1_normalise(features(spark), N_SPECIES).withColumn("value", F.round("value", 12))


@query("binarise", oracle(f"""
SELECT row_id, feature_id, CASE WHEN {SP} THEN 1.0e0 ELSE value END AS value FROM v_features WHERE NOT ({SP}) OR value > 1""", "v_features"))
def _(spark):
    return X.binarise(features(spark), N_SPECIES)


@query("log_values", oracle(f"""
SELECT row_id, feature_id, round(CASE WHEN {SP} THEN ln(value) ELSE value END, 9) AS value FROM v_features WHERE value > 0""", "v_features"))
def _(spark):
    return X.log_values(features(spark).where(F.col("value") > 0), N_SPECIES).withColumn("value", F.round("value", 9))


@query("dominance_rank", oracle(f"""
SELECT row_id, feature_id, value, cast(row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature_id) AS int) AS rank
FROM v_features WHERE {SP}""", "v_features"))
def _(spark):
    return X.dominance_rank(features(spark), N_SPECIES)


@query("nonzero_stats", oracle("""
SELECT feature_id, round(avg(value), 11) AS mean, round(stddev_pop(value), 8) AS std FROM v_features GROUP BY feature_id""", "v_features"))
def _(spark):
    return X.nonzero_stats(features(spark)).select(
        "feature_id", F.round("mean", 11).alias("mean"), F.round("std", 8).alias("std")
    )


UNIFORM = "cast(('0x' || left(md5(%s), 13)) AS bigint) / pow(16.0e0, 13)"
NOISED = """
SELECT f.row_id, f.feature_id, CASE WHEN f.feature_id < 150 THEN
  value + CASE WHEN {s} < 0.5 THEN -1 ELSE 1 END * (mean + std * sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b})) ELSE value END AS value
FROM v_features f LEFT JOIN (SELECT feature_id, avg(value) AS mean, stddev_pop(value) AS std FROM v_features WHERE feature_id < 150 GROUP BY feature_id) m
  USING (feature_id)""".format(**{
    k: UNIFORM % f"concat('7.{k}:', f.row_id, ':', f.feature_id)" for k in "sab"
})


@query("add_noise", oracle("SELECT row_id, feature_id, round(value, 6) AS value FROM noised WHERE value <> 0", "v_features", noised=NOISED))
def _(spark):
    return X.add_noise(features(spark), N_SPECIES, seed=7).withColumn("value", F.round("value", 6))


@query("drop_entries", oracle(f"""
SELECT row_id, feature_id, value FROM (SELECT *, row_number() OVER (PARTITION BY {SP} ORDER BY md5(concat('5:', row_id, ':', feature_id))) AS rn
  FROM v_features) t WHERE NOT ({SP}) OR rn > (SELECT floor(count(*) * 0.3e0) FROM v_features WHERE {SP})""", "v_features"))
def _(spark):
    return X.drop_entries(features(spark), N_SPECIES, 0.3, seed=5)


@query("zero_sample", oracle("""
SELECT plot_id, species, CASE WHEN rn <= (SELECT floor(count(*) * 0.3e0) FROM s) THEN 0.0e0 ELSE cover END AS cover
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('11:', plot_id, ':', species))) AS rn FROM s) t""",
    "v_species", s="SELECT plot_id, species, round(sum(cover), 6) AS cover FROM v_species GROUP BY plot_id, species"))
def _(spark):
    return X.zero_sample(C.sum_cover(view(spark, "v_species"), digits=6), ["plot_id", "species"], 0.3, seed=11)


SCALER = """
SELECT feature_id, CASE WHEN v > 0 THEN sqrt(v) ELSE 1.0e0 END AS scale FROM (
  SELECT feature_id, (count(*) * var_pop(value) + avg(value) * avg(value) * count(*) * (n - count(*)) / n) / n AS v
  FROM v_features, (SELECT count(DISTINCT row_id) * 1.0e0 AS n FROM v_features) t GROUP BY feature_id, n) u"""


def row_count(spark):
    return features(spark).agg(F.countDistinct("row_id").alias("n")).scalar().cast("double")


@query("fit_scaler", oracle("SELECT feature_id, round(scale, 8) AS scale FROM scaler", "v_features", scaler=SCALER))
def _(spark):
    return X.fit_scaler(features(spark), row_count(spark)).withColumn("scale", F.round("scale", 8))


@query("apply_scaler", oracle("SELECT row_id, feature_id, round(value / scale, 7) AS value FROM v_features JOIN scaler USING (feature_id)",
    "v_features", scaler=SCALER))
def _(spark):
    df = features(spark)
    return X.apply_scaler(df, X.fit_scaler(df, row_count(spark))).select("row_id", "feature_id", F.round("value", 7).alias("value"))


LAYOUT = X.Layout.of(species=140, location=2, altitude=1, country=17, ecoregion=30, dune=2, coast=8)


@query("select_feature_groups", oracle("""
SELECT row_id, cast(CASE WHEN feature_id < 140 THEN feature_id WHEN feature_id = 142 THEN 140 ELSE feature_id - 190 + 141 END AS int) AS feature_id, value
FROM v_features WHERE feature_id < 140 OR feature_id = 142 OR feature_id IN (190, 191)""", "v_features"))
def _(spark):
    return X.select_feature_groups(features(spark), LAYOUT, "dune, altitude, species")[0]


@query("assemble_composition", oracle("""
SELECT h.plot_id, h.label, coalesce(string_agg(s.species || '=' || s.cover, ';' ORDER BY s.species), '') AS items
FROM train h LEFT JOIN (SELECT plot_id, species, cast(cast(round(sum(cover)) AS bigint) AS varchar) AS cover FROM v_species GROUP BY plot_id, species) s
  USING (plot_id) GROUP BY h.plot_id, h.label""", "v_header", "v_codes", "v_species", **HEADER_PARTS))
def _(spark):
    species = C.sum_cover(view(spark, "v_species"))
    species = species.withColumn("cover", F.round("cover").cast("long"))
    encoder = E.fit_encoder(species, "species")
    coded = E.encode(species, encoder, "species", "species_id").select(
        "plot_id", "species_id", F.col("cover").cast("double").alias("cover"), "species"
    )
    rows = X.assemble(training_header(spark), coded)
    flat = rows.select("plot_id", "label", F.explode_outer("items").alias("i")).select("plot_id", "label", "i.*")
    named = E.decode(flat, encoder, "species_id", "species")
    item = F.concat("species", F.lit("="), F.col("cover").cast("long").cast("string"))
    return named.groupBy("plot_id", "label").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("species", item.alias("item"))))["item"], ";").alias("items")
    )


@query("numeric_features", oracle("""
SELECT plot_id AS row_id, cast(150 AS int) AS feature_id, round(lon, 5) AS value FROM v_location WHERE lon IS NOT NULL
UNION ALL SELECT plot_id, 151, round(lat, 5) FROM v_location""", "v_location"))
def _(spark):
    df = view(spark, "v_location").withColumnRenamed("plot_id", "row_id")
    return X.numeric_features(df, {"lon": 150, "lat": 151}).withColumn("value", F.round("value", 5))


@query("keep_listed_labels", oracle("""
SELECT row_id, label_id FROM v_vectors WHERE label_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""", "v_vectors"))
def _(spark):
    listed = table(spark, "nation").where(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("id"))
    return X.keep_labels(view(spark, "v_vectors"), listed).select("row_id", "label_id")


@query("keep_rarest_labels", oracle("""
SELECT row_id, truth FROM v_classified WHERE fold = 0 AND truth IN
  (SELECT truth FROM v_classified WHERE fold <> 0 GROUP BY truth ORDER BY count(*), truth LIMIT 10)""", "v_classified"))
def _(spark):
    train, test = S.split_fold(view(spark, "v_classified"), 0)
    return X.keep_rarest(train, test, 10, "truth").select("row_id", "truth")


@query("feature_catalogue", oracle("""
SELECT cast(row_number() OVER (ORDER BY species) - 1 AS int) AS feature_id, 'species' AS grp, species AS name FROM (SELECT DISTINCT p_name AS species FROM part) t
UNION ALL SELECT cast((SELECT count(DISTINCT p_name) FROM part) + k AS int), 'location', name FROM (SELECT 0 AS k, 'Longitude' AS name UNION ALL SELECT 1, 'Latitude') l
UNION ALL SELECT cast((SELECT count(DISTINCT p_name) FROM part) + 2 + row_number() OVER (ORDER BY r) - 1 AS int), 'ecoregion', 'Ecoregion ' || r
  FROM (SELECT DISTINCT r_name AS r FROM region) e"""))
def _(spark):
    species = E.fit_encoder(table(spark, "part"), "p_name")
    regions = E.fit_encoder(table(spark, "region"), "r_name")
    layout = X.Layout.of(species=species.count(), location=2, ecoregion=regions.count())
    names = {"species": species, "location": ["Longitude", "Latitude"], "ecoregion": regions}
    return X.catalogue(layout, names)


@query("seeded_uniform", oracle(f"SELECT o_orderkey, round({UNIFORM % "concat('3:', o_orderkey)"}, 12) AS u FROM orders"))
def _(spark):
    return table(spark, "orders").select("o_orderkey", F.round(hashing.uniform(3, F.col("o_orderkey")), 12).alias("u"))


@query("clean_code_list", oracle("""
SELECT plot_id, coalesce((SELECT string_agg(c, ', ' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(truth, ', ')) AS c) t
  WHERE c IN (SELECT code FROM v_codes)), '') AS codes FROM v_predictions""", "v_predictions", "v_codes"))
def _(spark):
    # The dictionary of codes is joined, not gathered into an array.
    listed = view(spark, "v_predictions").select("plot_id", F.explode(F.split("truth", ", ")).alias("code"))
    known = listed.join(view(spark, "v_codes").select("code").distinct(), "code", "left_semi")
    codes = known.groupBy("plot_id").agg(F.collect_set("code").alias("known"))
    return view(spark, "v_predictions").join(codes, "plot_id", "left").select(
        "plot_id", text.clean_code_list(F.split("truth", ", "), F.coalesce("known", F.array().cast("array<string>"))).alias("codes")
    )
