"""Deterministic views that reshape the driver tables into survey-shaped inputs.

Each text runs unchanged in Spark SQL and in DuckDB.
"""

import re

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    # Plot headers: unknown scale, date and label, presence-only plots, several labels.
    "v_header": """
SELECT o_orderkey AS plot_id,
  CASE o_orderpriority WHEN '5-LOW' THEN 'Presence/Absence'
       WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Percentage (%)' END AS cover_scale,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       ELSE concat(lpad(cast(extract(day FROM o_orderdate) AS string),2,'0'), ':',
                   lpad(cast(extract(month FROM o_orderdate) AS string),2,'0'), ':',
                   cast(extract(year FROM o_orderdate) AS string)) END AS recorded,
  CASE WHEN o_custkey % 13 = 0 THEN NULL
       WHEN o_custkey % 7 = 0 THEN concat('MA2', cast(1 + o_custkey % 3 AS string), cast(1 + o_custkey % 2 AS string), ',',
            substr('NQRSTUV', cast(1 + o_custkey % 7 AS int), 1), cast(1 + o_custkey % 4 AS string), cast(1 + o_custkey % 5 AS string))
       ELSE concat(substr('NQRSTUV', cast(1 + o_custkey % 7 AS int), 1), cast(1 + o_custkey % 4 AS string), cast(1 + o_custkey % 5 AS string)) END AS label,
  -10 + (o_orderkey * 7919 % 4000037) / 1e5 AS lon,
  36 + (o_orderkey * 104729 % 3400043) / 1e5 AS lat
FROM orders""",
    # Observations: zero covers, covers up to 1, repeated plot and species pairs.
    "v_species": """
SELECT l_orderkey AS plot_id, concat('P', cast(l_partkey AS string)) AS species,
       l_quantity * l_discount * 10 AS cover
FROM lineitem""",
    # Backbone: rejected phylum, missing match.
    "v_backbone": """
SELECT concat('P', cast(p_partkey AS string)) AS raw_name,
  CASE WHEN p_type = 'SMALL' THEN 'Bryophyta' ELSE 'Tracheophyta' END AS phylum,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS accepted_name
FROM part""",
    # Accepted names of training, with the reject marker among them.
    "v_accepted": """
SELECT CASE WHEN p_size % 9 = 0 THEN '?' ELSE p_name END AS accepted_name
FROM part WHERE p_size <= 40 AND p_name NOT LIKE 'red%'""",
    # Class codes of all depths, from customers.
    "v_codes": """
SELECT DISTINCT code FROM (
  SELECT concat(substr('NQRSTUV', cast(1 + c_custkey % 7 AS int), 1),
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE cast(1 + c_custkey % 4 AS string) END,
    CASE WHEN c_custkey % 3 < 2 THEN '' ELSE cast(1 + c_custkey % 5 AS string) END,
    CASE WHEN c_custkey % 41 = 0 AND c_custkey % 3 = 2 THEN '1' ELSE '' END) AS code
  FROM customer
  UNION ALL
  SELECT concat('MA2', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE cast(1 + c_custkey % 3 AS string) END,
    CASE WHEN c_custkey % 5 < 2 THEN '' ELSE cast(1 + c_custkey % 2 AS string) END) AS code
  FROM customer) AS c""",
    # Crosswalk cells: new code with a list of old codes, some without.
    "v_crosswalk": """
SELECT p_partkey AS ord,
  concat(substr('NQRSTUV', cast(1 + p_partkey % 7 AS int), 1), cast(1 + p_partkey % 4 AS string),
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE cast(1 + p_partkey % 5 AS string) END) AS new_code,
  CASE WHEN p_partkey % 10 = 0 THEN NULL
       WHEN p_partkey % 4 = 0 THEN concat('X', cast(p_partkey % 499 AS string), '; X', cast(p_partkey % 487 AS string))
       ELSE concat('X', cast(p_partkey % 499 AS string)) END AS old_codes,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE concat('RL', cast(p_partkey % 53 AS string)) END AS threat_code
FROM part WHERE p_size <= 12""",
    # Threat list with repeated codes and spelling variants.
    "v_threats": """
SELECT concat('RL', cast(s_suppkey % 53 AS string)) AS threat_code, s_suppkey AS ord,
  concat(substr('NQRSTUV', cast(1 + s_suppkey % 7 AS int), 1), cast(1 + s_suppkey % 4 AS string), cast(1 + s_suppkey % 5 AS string)) AS code,
  CASE s_suppkey % 9 WHEN 0 THEN 'Data Deficient' WHEN 1 THEN 'Least Concern' WHEN 2 THEN 'Least concern'
    WHEN 3 THEN 'Near threatened' WHEN 4 THEN 'Near Threatened' WHEN 5 THEN 'Vulnerable'
    WHEN 6 THEN 'Endangered' WHEN 7 THEN 'Critically EndangeredR' ELSE 'Critically Endangered' END AS category
FROM supplier""",
    # Second survey: occurrences on an abundance scale, the scale, plot attributes, locations.
    "v_occurrences": """
SELECT l_orderkey AS plot_id, concat('P', cast(l_partkey AS string)) AS species,
       concat(l_returnflag, cast(l_linenumber AS string)) AS scale_code
FROM lineitem""",
    "v_scale": """
SELECT DISTINCT concat(l_returnflag, cast(l_linenumber AS string)) AS scale_code, l_linenumber / 8.0E0 AS midpoint
FROM lineitem WHERE l_linenumber < 7""",
    "v_attributes": """
SELECT o_orderkey AS plot_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 'Other caption' ELSE 'Survey class' END AS caption,
  CASE WHEN o_custkey % 23 = 0 THEN 'Not in scheme'
       WHEN o_custkey % 4 = 0 THEN concat('Broad ', cast(o_custkey % 12 AS string))
       ELSE concat('Fine ', cast(o_custkey % 60 AS string)) END AS habitat
FROM orders""",
    "v_location": """
SELECT o_orderkey AS plot_id,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE -6 + (o_orderkey * 7919 % 700001) / 1e5 END AS lon,
  50 + (o_orderkey * 104729 % 800011) / 1e5 AS lat
FROM orders""",
    "v_habitat_lookup": """
SELECT concat('Broad ', cast(s_suppkey % 12 AS string)) AS broad,
  concat('Fine ', cast(CASE WHEN s_suppkey % 12 < 6 THEN s_suppkey % 12 ELSE s_suppkey % 60 END AS string)) AS fine
FROM supplier""",
    "v_habitat_codes": """
SELECT concat('Fine ', cast(n AS string)) AS habitat,
  concat('X', cast(n AS string), ', X', cast(n + 30 AS string), CASE WHEN n % 5 = 0 THEN ', X999' ELSE '' END) AS codes
FROM (SELECT DISTINCT c_custkey % 70 AS n FROM customer WHERE c_custkey % 70 <> 13) AS t""",
    # Plots with prediction, second prediction and multi-label truth.
    "v_predictions": """
SELECT o_orderkey AS plot_id,
  concat(substr('NQRSTUV', cast(1 + o_custkey % 7 AS int), 1), cast(1 + o_custkey % 4 AS string), cast(1 + o_custkey % 5 AS string)) AS prediction,
  concat(substr('NQRSTUV', cast(1 + o_custkey % 7 AS int), 1), cast(1 + o_custkey % 4 AS string), cast(1 + o_orderkey % 5 AS string)) AS prediction_b,
  concat(substr('NQRSTUV', cast(1 + o_custkey % 7 AS int), 1), cast(1 + o_custkey % 4 AS string), cast(1 + o_orderkey % 3 AS string), ', ',
         substr('NQRSTUV', cast(1 + o_orderkey % 7 AS int), 1), cast(1 + o_orderkey % 4 AS string), cast(1 + o_custkey % 5 AS string)) AS truth,
  o_orderkey % 10 AS fold, o_orderstatus AS region
FROM orders""",
    # Single-label truth and prediction with fold.
    "v_classified": """
SELECT l_orderkey * 10 + l_linenumber AS row_id, cast(l_orderkey % 10 AS int) AS fold,
  concat(substr('NQRSTUV', cast(1 + l_partkey % 7 AS int), 1), cast(1 + l_partkey % 4 AS string), cast(1 + l_suppkey % 3 AS string)) AS truth,
  concat(substr('NQRSTUV', cast(1 + l_partkey % 7 AS int), 1), cast(1 + l_partkey % 4 AS string), cast(1 + (l_suppkey + CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) % 3 AS string)) AS prediction
FROM lineitem""",
    # Attribution scores per row and feature; features of all seven groups.
    "v_scores": """
SELECT l_orderkey AS row_id, cast(l_orderkey % 3 AS int) AS fold,
  concat(CASE WHEN l_suppkey % 8 = 0 THEN 'MA2' ELSE substr('NQRSTUV', cast(l_suppkey % 8 AS int), 1) END, cast(1 + l_suppkey % 3 AS string), '1') AS class,
  cast(l_partkey % 200 AS int) AS feature_id, l_linenumber AS line,
  (l_quantity - 25) * (0.01E0 + l_discount) AS score
FROM lineitem""",
    "v_catalogue": """
SELECT cast(n AS int) AS feature_id,
  CASE WHEN n < 140 THEN 'species' WHEN n < 142 THEN 'location' WHEN n < 143 THEN 'altitude'
       WHEN n < 160 THEN 'country' WHEN n < 190 THEN 'ecoregion' WHEN n < 192 THEN 'dune' ELSE 'coast' END AS grp,
  CASE WHEN n < 140 THEN concat('Genus', cast(n % 23 AS string), ' epithet', cast(n AS string))
       ELSE concat('feature ', cast(n AS string)) END AS name,
  n % 5 = 0 AS woody
FROM (SELECT DISTINCT p_partkey % 200 AS n FROM part) AS t""",
    # Long features: ids below 150 act as species.
    "v_features": """
SELECT l_orderkey AS row_id, cast(l_partkey % 200 AS int) AS feature_id,
  round(sum(l_quantity * (0.01E0 + l_discount)), 6) AS value
FROM lineitem GROUP BY l_orderkey, l_partkey % 200""",
    # Four-cornered overlapping polygons with gaps between them, in lon/lat.
    "v_corners": """
SELECT n_nationkey AS geom_id, n_name AS name, concat('P', cast(n_nationkey AS string)) AS code, k,
  -9.0E0 + 9.0E0 * (n_nationkey % 5) + (5.0E0 + n_nationkey % 6) * fx AS lon,
  37.0E0 + 6.5E0 * floor(n_nationkey / 5) + (4.0E0 + n_nationkey % 4) * fy AS lat
FROM nation, (SELECT 0 AS k, 0.0E0 AS fx, 0.0E0 AS fy UNION ALL SELECT 1, 1.0E0, 0.25E0
  UNION ALL SELECT 2, 0.75E0, 1.0E0 UNION ALL SELECT 3, 0.125E0, 0.875E0) AS c""",
    # Elevation cells: a full raster of 50 columns.
    "v_raster": """
SELECT cast(floor(p_partkey / 50) AS int) AS row, cast(p_partkey % 50 AS int) AS col,
  CASE WHEN p_partkey % 37 = 0 THEN 32767 ELSE p_size * 10 END AS value
FROM part""",
    "v_vectors": """
SELECT vec_id AS row_id, label AS label_id, cast(vec_id % 5 AS int) AS fold, embedding FROM embeddings""",
}

_FRAMES = {}
_FOLDER = {}


def use(spark, sf_dir):
    """Choose the folder the driver tables are read from."""
    _FOLDER[spark.sparkContext.applicationId] = sf_dir


def table(spark, name):
    """A driver table, also available as a temporary view from now on."""
    app = spark.sparkContext.applicationId
    key = (app, _FOLDER[app], name)
    if key not in _FRAMES:
        _FRAMES[key] = spark.read.parquet(f"{_FOLDER[app]}/{name}.parquet")
    _FRAMES[key].createOrReplaceTempView(name)
    return _FRAMES[key]


def view(spark, name):
    """One view as a DataFrame."""
    for word in set(re.findall(r"[a-z]+", VIEWS[name])) & set(TABLES):
        table(spark, word)
    return spark.sql(VIEWS[name])


def oracle(body, *names, **parts):
    """SQL text with the named views, then extra parts, as common table expressions."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names]
    ctes += [f"{n} AS ({text})" for n, text in parts.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
