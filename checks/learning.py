"""Queries: jobs built from the operators, classifiers and studies.

Results of seeded fits have no SQL counterpart; the jobs before the model boundary do.
"""

import uuid
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.cleaning import HEADER_PARTS, NAME_PARTS
from checks.composition import (
    ARC, BLOCKS, CODE_PARTS, FOLDS, LAYOUT, N_SPECIES, NAME_MAP, ONE_CHILD,
)
from checks.evaluation import rounded
from checks.geography import GEO, LINE_GROUPS, polygons, raster
from checks.registry import query
from checks.views import oracle, view
from sward.functions.text import top_group
from sward.operators import attribution as A
from sward.operators import features as X
from sward.operators import metrics as M
from sward.operators import models
from sward.operators import regions as G
from sward.operators import reports as P
from sward.operators.cleaning import codes_at_level, training_header
from sward.operators.neighbours import nearest_neighbours
from sward.operators.oversample import borderline_smote
from sward.plans import dataset as D
from sward.plans import evaluation as V
from sward.plans import external_set as Q
from sward.plans import preprocess as R
from sward.plans import studies as U
from sward.plans.config import DatasetConfig, EvaluationConfig, PreprocessConfig
from sward.session import scratch_path
from sward.sources.readers import load_encoder, load_model
from sward.sources.writers import save_model, write_by_row

# Models at the defaults of the training job; the README says what is measured.
FOREST = models.ModelConfig(kind="rf")
PERCEPTRON = models.ModelConfig(kind="mlp")
BOOSTED = models.ModelConfig(kind="gbt")
VECTOR_LAYOUT = X.Layout.of(species=40, location=2, altitude=1, country=9, ecoregion=6, dune=2, coast=4)
N_CLASSES = 10


def config(model, **kw):
    return EvaluationConfig(n_folds=5, model=model, preprocess=PreprocessConfig(**kw))


def rows(spark):
    return view(spark, "v_vectors").select("row_id", F.col("label_id"), "fold")


def entries(spark):
    df = view(spark, "v_vectors").select("row_id", F.posexplode("embedding").alias("feature_id", "value"))
    return df.withColumn("value", F.col("value").cast("double"))


def label_encoder(spark):
    ids = rows(spark).select("label_id").distinct()
    return ids.select(F.concat(F.lit("class "), "label_id").alias("value"), F.col("label_id").alias("id"))


VECTOR_SUMS = """
SELECT row_id, count(*) AS stored, round(sum(value), 6) AS total, round(sum(value * feature_id), 4) AS moment
FROM v_features GROUP BY row_id"""


@query("to_vector", oracle(VECTOR_SUMS, "v_features"))
def _(spark):
    df = view(spark, "v_features")
    return vector_sums(X.to_vector(df.select("row_id").distinct(), df, 200))


@query("vectors_of_bucketed_store", oracle(VECTOR_SUMS, "v_features"))
def _(spark):
    df, name = view(spark, "v_features"), f"sward_{uuid.uuid4().hex}"
    parts = {"rows": df.select("row_id").distinct(), "features": df}
    stored = {k: write_by_row(v, f"{name}_{k}", scratch_path(spark, k), buckets=16) for k, v in parts.items()}
    return vector_sums(X.to_vector(stored["rows"], stored["features"], 200))


def vector_sums(vectors):
    entries = X.vector_entries(vectors)
    zipped = F.explode(F.arrays_zip(F.col("entries.indices").alias("i"), F.col("entries.values").alias("v")))
    flat = entries.select("row_id", zipped.alias("e")).select("row_id", "e.i", "e.v")
    return flat.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("stored"), F.round(F.sum("v"), 6).alias("total"),
        F.round(F.sum(F.col("v") * F.col("i")), 4).alias("moment"),
    )


@query("nearest_neighbours", oracle("""
SELECT query_id, row_id, cast(pos AS int) AS pos FROM (
  SELECT a.row_id AS query_id, b.row_id, row_number() OVER (PARTITION BY a.row_id ORDER BY
    list_distance([cast(x AS double) FOR x IN a.embedding], [cast(x AS double) FOR x IN b.embedding]), b.row_id) AS pos
  FROM v_vectors a JOIN v_vectors b ON a.row_id <> b.row_id) t WHERE pos <= 5""", "v_vectors"))
def _(spark):
    entry = F.transform("embedding", lambda v, i: F.struct(i.alias("feature_id"), v.cast("double").alias("value")))
    df = view(spark, "v_vectors").select("row_id", F.lit(0).alias("grp"), entry.alias("items"), "label_id")
    near = nearest_neighbours(df, df, 5, 64)
    return near.select("query_id", "row_id", "pos")


OVERSAMPLED = dict(
    r="SELECT row_id, CASE WHEN label_id <= 1 AND fold = 0 THEN label_id ELSE 2 END AS label, [cast(x AS double) FOR x IN embedding] AS e FROM v_vectors",
    counts="SELECT label, count(*) AS n FROM r GROUP BY label",
    limits="SELECT cast(floor(max(n) * 0.1e0) AS bigint) AS goal, cast(floor(min(n) / 2.0e0) AS bigint) AS k FROM counts",
    need="SELECT label, goal - n AS need FROM counts, limits WHERE goal > n",
    near="""
SELECT a.row_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.e, b.e), 9), b.row_id) AS pos
FROM r a JOIN need USING (label) JOIN r b ON a.row_id <> b.row_id""",
    danger="""
SELECT row_id, label FROM near, limits WHERE pos <= 2 * k GROUP BY row_id, label, k
HAVING count(*) FILTER (WHERE other <> label) >= k AND count(*) FILTER (WHERE other <> label) < 2 * k""",
    same="""
SELECT * FROM (SELECT a.row_id, b.row_id AS other_id, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(x.e, b.e), 9), b.row_id) AS pos
  FROM danger a JOIN r x USING (row_id) JOIN r b ON b.label = a.label AND b.row_id <> a.row_id) t WHERE pos <= (SELECT k FROM limits)""",
    sizes="SELECT label, count(*) AS danger FROM danger GROUP BY label",
    quota="SELECT label, need, danger, coalesce(sum(need) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM need JOIN sizes USING (label)",
    placed="SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('123:', row_id))) - 1 AS position FROM danger",
    drawn="""
SELECT row_id, label, -(before + copy * danger + position + 1) AS new_id, copy FROM (
  SELECT *, unnest(range(0, cast((need - position + danger - 1) // danger AS bigint))) AS copy FROM placed JOIN quota USING (label) WHERE position < need) t""",
    have="SELECT row_id, count(*) AS have FROM same GROUP BY row_id",
    picked="""
SELECT d.*, cast(('0x' || left(md5(concat('123.n:', d.row_id, ':', copy)), 8)) AS bigint) % have + 1 AS pos,
  cast(('0x' || left(md5(concat('123.t:', d.row_id, ':', copy)), 13)) AS bigint) / pow(16.0e0, 13) AS step
FROM drawn d JOIN have h ON d.row_id = h.row_id""",
)


@query("borderline_oversampling", oracle("""
SELECT cast(p.new_id AS bigint) AS row_id, p.label AS label_id, len(a.e) AS stored, round(list_sum(a.e) * (1 - step) + list_sum(b.e) * step, 6) AS total
FROM picked p JOIN same s ON s.row_id = p.row_id AND s.pos = p.pos JOIN r a ON a.row_id = p.row_id JOIN r b ON b.row_id = s.other_id""",
    "v_vectors", **OVERSAMPLED))
def _(spark):
    # Most rows of two classes are relabelled, so that these fall below the target share.
    rare = (F.col("label_id") <= 1) & (F.col("fold") == 0)
    r = rows(spark).withColumn("label_id", F.when(rare, F.col("label_id")).otherwise(2))
    new_rows, values = borderline_smote(r, entries(spark), 64)
    sums = values.groupBy("row_id").agg(F.count(F.lit(1)).alias("stored"), F.round(F.sum("value"), 6).alias("total"))
    return new_rows.join(sums, "row_id", "left")


def relabelled(spark):
    """Most rows of two classes get another label, so that these fall below the target share."""
    rare = (F.col("label_id") <= 1) & (F.col("fold") == 0)
    return rows(spark).withColumn("label_id", F.when(rare, F.col("label_id")).otherwise(2))


def sums_by_row(rows, features):
    sums = features.groupBy("row_id").agg(F.count(F.lit(1)).alias("stored"), F.round(F.sum("value"), 6).alias("total"))
    return rows.join(sums, "row_id", "left").select("row_id", "label_id", "stored", "total")


NEW_ROWS = """
SELECT cast(p.new_id AS bigint) AS row_id, p.label AS label_id, len(a.e) AS stored, round(list_sum(a.e) * (1 - step) + list_sum(b.e) * step, 6) AS total
FROM picked p JOIN same s ON s.row_id = p.row_id AND s.pos = p.pos JOIN r a ON a.row_id = p.row_id JOIN r b ON b.row_id = s.other_id"""
OWN_ROWS = "SELECT row_id, label AS label_id, len(e) AS stored, round(list_sum(e), 6) AS total FROM {}"
AUGMENTED = PreprocessConfig(augmentation=True, standardization=False)


@query("augmented_training", oracle(OWN_ROWS.format("r") + " UNION ALL " + NEW_ROWS, "v_vectors", **OVERSAMPLED))
def _(spark):
    r, features = R.preprocess_training(relabelled(spark), entries(spark), VECTOR_LAYOUT, AUGMENTED)[:2]
    return sums_by_row(r, features)


@query("augmented_fold", oracle(
    f"SELECT 'train' AS part, * FROM ({OWN_ROWS.format('r')} UNION ALL {NEW_ROWS}) t UNION ALL SELECT 'test', * FROM ({OWN_ROWS.format('judged')}) u",
    "v_vectors", **{**OVERSAMPLED, "r": OVERSAMPLED["r"] + " WHERE fold <> 1"}, judged=OVERSAMPLED["r"] + " WHERE fold = 1"))
def _(spark):
    r = relabelled(spark)
    train, test = V.fold_pairs(r, entries(spark).join(r.select("row_id", "fold"), "row_id"), 1)
    fitted, judged, _ = R.preprocess_fold(train, test, VECTOR_LAYOUT, AUGMENTED)
    return A.tag_union({"train": sums_by_row(*fitted), "test": sums_by_row(*judged)}, "part")


PRE = f"""
SELECT row_id, feature_id, ln(r / sum(r) OVER (PARTITION BY row_id)) AS value FROM (
  SELECT row_id, feature_id, 1.0e0 / dense_rank() OVER (PARTITION BY row_id ORDER BY value DESC) AS r
  FROM v_features WHERE feature_id < {N_SPECIES}) t
UNION ALL SELECT row_id, feature_id, value FROM v_features WHERE feature_id >= {N_SPECIES}"""


@query("preprocess_for_prediction", oracle("SELECT row_id, feature_id, round(value, 9) AS value FROM p", "v_features", p=PRE))
def _(spark):
    layout = X.Layout.of(species=N_SPECIES, location=200 - N_SPECIES)
    cfg = PreprocessConfig(rank=True, normalization=True, log=True, standardization=False)
    return rounded(R.preprocess_prediction(view(spark, "v_features"), layout, cfg)[0], value=9)


TRAIN_SCALED = """
SELECT row_id, feature_id, value / CASE WHEN v > 0 THEN sqrt(v) ELSE 1.0e0 END AS value FROM b JOIN (
  SELECT feature_id, (count(*) * var_pop(value) + avg(value) * avg(value) * count(*) * (n - count(*)) / n) / n AS v
  FROM b, (SELECT count(DISTINCT row_id) * 1.0e0 AS n FROM v_features) r GROUP BY feature_id, n) s USING (feature_id)"""
BINARY = "SELECT row_id, feature_id, CASE WHEN feature_id < 140 THEN 1.0e0 ELSE value END AS value FROM v_features WHERE value > 1 OR feature_id >= 140"


@query("preprocess_for_training", oracle("SELECT row_id, feature_id, round(value, 7) AS value FROM t", "v_features", b=BINARY, t=TRAIN_SCALED))
def _(spark):
    df = view(spark, "v_features")
    r = df.select("row_id").distinct()
    out = R.preprocess_training(r, df, LAYOUT, PreprocessConfig(binarization=True))[1]
    return rounded(out.select("row_id", "feature_id", "value"), value=7)


@query("preprocess_for_fold", oracle("""
SELECT row_id, feature_id, round(value / CASE WHEN v > 0 THEN sqrt(v) ELSE 1.0e0 END, 7) AS value
FROM v_features JOIN (
  SELECT feature_id, (count(*) * var_pop(value) + avg(value) * avg(value) * count(*) * (n - count(*)) / n) / n AS v
  FROM v_features, (SELECT count(DISTINCT row_id) * 1.0e0 AS n FROM v_features WHERE row_id % 5 <> 1) r
  WHERE row_id % 5 <> 1 GROUP BY feature_id, n) s USING (feature_id)
WHERE row_id % 5 = 1""", "v_features"))
def _(spark):
    df = view(spark, "v_features")
    r = df.select("row_id", (F.col("row_id") % 5).alias("fold")).distinct()
    train, test = V.fold_pairs(r, df.join(r, "row_id"), 1)
    _, judged, _ = R.preprocess_fold(train, test, LAYOUT, PreprocessConfig())
    return rounded(judged[1].select("row_id", "feature_id", "value"), value=7)


# All steps of a job in their order; every random step is a hash of its seed and row.
UNIFORM = "cast(('0x' || left(md5(%s), 13)) AS bigint) / pow(16.0e0, 13)"
DRAW = {k: UNIFORM % f"concat('7.{k}:', d.row_id, ':', d.feature_id)" for k in "sab"}
DROPPED = """
SELECT row_id, feature_id, value FROM (SELECT *, row_number() OVER (PARTITION BY feature_id < 140 ORDER BY md5(concat('7:', row_id, ':', feature_id))) AS rn
  FROM {0}) t WHERE feature_id >= 140 OR rn > (SELECT floor(count(*) * 0.3e0) FROM {0} WHERE feature_id < 140)"""
SPREAD = """
SELECT feature_id, CASE WHEN v > 0 THEN sqrt(v) ELSE 1.0e0 END AS scale FROM (
  SELECT feature_id, (count(*) * var_pop(value) + avg(value) * avg(value) * count(*) * (n - count(*)) / n) / n AS v
  FROM {0}, (SELECT count(DISTINCT row_id) * 1.0e0 AS n FROM {1}) r GROUP BY feature_id, n) u"""


def labelled(spark):
    df = view(spark, "v_features")
    r = df.select("row_id", (F.col("row_id") % 3).cast("int").alias("label_id"), (F.col("row_id") % 5).alias("fold")).distinct()
    return r, df, spark.createDataFrame([(0,), (1,)], "id int")


@query("training_order", oracle("""
SELECT row_id, feature_id, round(value / scale, 7) AS value FROM ready JOIN spread USING (feature_id)""", "v_features",
    kept="SELECT * FROM v_features WHERE row_id % 3 <> 2", dropped=DROPPED.format("kept"),
    ready="SELECT row_id, feature_id, CASE WHEN feature_id < 140 THEN ln(value) ELSE value END AS value FROM dropped WHERE feature_id < 142",
    spread=SPREAD.format("ready", "kept")))
def _(spark):
    r, df, endangered = labelled(spark)
    cfg = PreprocessConfig(endangered=True, dropout=0.3, log=True, features="species,location", seed=7)
    out = R.preprocess_training(r, df, LAYOUT, cfg, endangered)[1]
    return rounded(out.select("row_id", "feature_id", "value"), value=7)


@query("evaluation_order", oracle("""
SELECT row_id, feature_id, round(value / coalesce(scale, 1.0e0), 6) AS value FROM noised LEFT JOIN spread USING (feature_id)
WHERE value <> 0 AND feature_id < 142""", "v_features",
    kept="SELECT * FROM v_features WHERE row_id % 5 = 1 AND row_id % 3 <> 2", dropped=DROPPED.format("kept"),
    noised=f"""
SELECT d.row_id, d.feature_id, CASE WHEN d.feature_id < 140 THEN
  value + CASE WHEN {DRAW['s']} < 0.5 THEN -1 ELSE 1 END * (mean + std * sqrt(-2 * ln(1 - {DRAW['a']})) * cos(2 * pi() * {DRAW['b']})) ELSE value END AS value
FROM dropped d LEFT JOIN (SELECT feature_id, avg(value) AS mean, stddev_pop(value) AS std FROM dropped WHERE feature_id < 140 GROUP BY feature_id) m USING (feature_id)""",
    train="SELECT * FROM v_features WHERE row_id % 5 <> 1",
    spread=SPREAD.format("train", "train")))
def _(spark):
    r, df, endangered = labelled(spark)
    train, test = V.fold_pairs(r, df.join(r.select("row_id", "fold"), "row_id"), 1)
    cfg = PreprocessConfig(endangered=True, dropout=0.3, noise=True, features="species,location", seed=7)
    _, judged, _ = R.preprocess_fold(train, test, LAYOUT, cfg, endangered)
    return rounded(judged[1].select("row_id", "feature_id", "value"), value=6)


@query("cross_validate_forest")
def _(spark):
    return V.cross_validate(rows(spark), entries(spark), VECTOR_LAYOUT, config(FOREST))


@query("cross_validate_perceptron")
def _(spark):
    return V.cross_validate(rows(spark), entries(spark), VECTOR_LAYOUT, replace(config(PERCEPTRON), k=3))


@query("train_boosted")
def _(spark):
    cfg = replace(config(BOOSTED), average="macro")
    _, scaler, accuracy = V.train(rows(spark), entries(spark), VECTOR_LAYOUT, cfg)
    return scaler.agg(F.count(F.lit(1)).alias("features"), F.lit(accuracy).alias("accuracy"))


@query("train_and_predict")
def _(spark):
    path = scratch_path(spark, "trained")
    cfg = config(FOREST)
    V.train(rows(spark), entries(spark), VECTOR_LAYOUT, cfg, path)
    model, scaler = V.load_trained(spark, path, cfg)
    return V.predict(model, rows(spark), entries(spark), VECTOR_LAYOUT, cfg, label_encoder(spark), scaler)


# One step of a network without hidden units from zero weights: all shares are equal, so sums give the gradient.
PERCEPTRON_STEP = replace(
    PERCEPTRON, hidden_layers=0, epochs=1, updates=1, holdout=0.0, weight_init="zeros", optimizer="sgd", learning_rate=0.5,
    momentum=0.0, weight_decay=0.0,
)


@query("perceptron_step", oracle("""
SELECT row_id, round(max(share) FILTER (c = label_id), 9) AS own, round(max(share), 9) AS best
FROM (SELECT row_id, label_id, c, exp(margin) / sum(exp(margin)) OVER (PARTITION BY row_id) AS share FROM margins) t GROUP BY row_id""",
    "v_vectors", items="""
SELECT row_id, label_id, j, cast(v AS double) AS v FROM (
  SELECT row_id, label_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM v_vectors) t
UNION ALL SELECT row_id, label_id, 0 AS j, 1e0 AS v FROM v_vectors""",
    classes="SELECT unnest(range(0, 10)) AS c",
    weights="""
SELECT c, j, -0.5e0 * (sum(v) * 0.1e0 - coalesce(sum(v) FILTER (label_id = c), 0)) / (SELECT count(*) FROM v_vectors) AS w
FROM items, classes GROUP BY c, j""",
    margins="SELECT row_id, label_id, c, sum(v * w) AS margin FROM items JOIN weights USING (j) GROUP BY row_id, label_id, c"))
def _(spark):
    return stored_shares(spark, PERCEPTRON_STEP, entries(spark))


# One round of depth 1 on 0/1 features from equal shares: counts give all gradients and curvatures.
BOOSTED_STUMP = replace(BOOSTED, rounds=1, boost_depth=1, subsample=1.0, holdout=0.0)


@query("boosted_stump", oracle("""
SELECT row_id, round(max(share) FILTER (c = label_id), 9) AS own, round(max(share), 9) AS best
FROM (SELECT row_id, label_id, c, exp(margin) / sum(exp(margin)) OVER (PARTITION BY row_id) AS share FROM margins) t GROUP BY row_id""",
    "v_vectors", bits="""
SELECT row_id, label_id, j FROM (
  SELECT row_id, label_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM v_vectors) t WHERE v > 0""",
    classes="SELECT unnest(range(0, 10)) AS c",
    whole="SELECT c, count(*) * 0.1e0 - count(*) FILTER (label_id = c) AS g, count(*) * 0.18e0 AS h FROM v_vectors, classes GROUP BY c",
    sides="SELECT c, j, count(*) * 0.1e0 - count(*) FILTER (label_id = c) AS g1, count(*) * 0.18e0 AS h1 FROM bits, classes GROUP BY c, j",
    gains="""
SELECT *, round(g1 * g1 / (h1 + 1) + (g - g1) * (g - g1) / (h - h1 + 1) - g * g / (h + 1), 9) AS gain
FROM sides JOIN whole USING (c) WHERE h1 >= 1 AND h - h1 >= 1""",
    best="SELECT c, arg_max(j, {'q': gain, 'j': -j}) AS j FROM gains WHERE gain > 0 GROUP BY c",
    margins="""
SELECT v.row_id, v.label_id, w.c, 0.1e0 * CASE WHEN b.j IS NULL THEN -w.g / (w.h + 1)
  WHEN x.row_id IS NULL THEN -(w.g - s.g1) / (w.h - s.h1 + 1) ELSE -s.g1 / (s.h1 + 1) END AS margin
FROM v_vectors v CROSS JOIN whole w LEFT JOIN best b ON b.c = w.c LEFT JOIN sides s ON s.c = b.c AND s.j = b.j
LEFT JOIN bits x ON x.row_id = v.row_id AND x.j = b.j"""))
def _(spark):
    return stored_shares(spark, BOOSTED_STUMP, bit_entries(spark))


def stored_shares(spark, cfg, features):
    """Share of the true and of the best class of each row, by a model that was stored and read again."""
    vectors = X.to_vector(rows(spark), features, VECTOR_LAYOUT.size)
    path = scratch_path(spark, "fitted")
    save_model(models.fit(vectors, cfg, VECTOR_LAYOUT.size, N_CLASSES), path)
    scored = load_model(path).transform(vectors)
    own = F.get("probability", F.col("label_id"))
    return scored.select("row_id", F.round(own, 9).alias("own"), F.round(F.array_max("probability"), 9).alias("best"))


# A single split over 0/1 features: its leaves are class shares per side, which SQL can count.
STUMP = models.ModelConfig(kind="rf", trees=1, max_depth=1, max_features="all", bootstrap=False)
STUMP_CONFIG = config(STUMP, standardization=False)
BITS = """
SELECT row_id, label_id, fold, j FROM (
  SELECT row_id, label_id, fold, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM v_vectors) t WHERE v > 0"""
# Held-out fold -1 trains on all rows.
STUMP_PARTS = dict(
    bits=BITS,
    outs="SELECT -1 AS h UNION ALL SELECT DISTINCT fold FROM v_vectors",
    whole="SELECT h, label_id, count(*) AS n FROM v_vectors, outs WHERE fold <> h GROUP BY h, label_id",
    ones="SELECT h, j, label_id, count(*) AS n FROM bits, outs WHERE fold <> h GROUP BY h, j, label_id",
    grid="SELECT w.h, f.j, w.label_id, coalesce(o.n, 0) AS n1, w.n - coalesce(o.n, 0) AS n0 FROM whole w CROSS JOIN (SELECT DISTINCT j FROM bits) f LEFT JOIN ones o ON w.h = o.h AND f.j = o.j AND w.label_id = o.label_id",
    best="SELECT h, arg_max(j, {'q': q, 'j': -j}) AS j FROM (SELECT h, j, coalesce(sum(n1 * n1) * 1e0 / nullif(sum(n1), 0), 0) + coalesce(sum(n0 * n0) * 1e0 / nullif(sum(n0), 0), 0) AS q FROM grid GROUP BY h, j) t GROUP BY h",
    leaves="""
SELECT h, side, label_id, n * 1e0 / sum(n) OVER (PARTITION BY h, side) AS share, row_number() OVER (PARTITION BY h, side ORDER BY n DESC, label_id) AS rank
FROM (SELECT h, 1 AS side, label_id, n1 AS n FROM grid JOIN best USING (h, j) UNION ALL SELECT h, 0, label_id, n0 FROM grid JOIN best USING (h, j)) t""",
    sides="SELECT o.h, v.row_id, v.label_id, v.fold, CASE WHEN b.row_id IS NULL THEN 0 ELSE 1 END AS side FROM v_vectors v CROSS JOIN best o LEFT JOIN bits b ON b.row_id = v.row_id AND b.j = o.j",
)


def bit_entries(spark):
    return entries(spark).where(F.col("value") > 0).withColumn("value", F.lit(1.0))


@query("cross_validate_stump", oracle("""
SELECT fold, round(avg(CASE WHEN s.label_id = l.label_id THEN 1e0 ELSE 0e0 END) * 100, 9) AS accuracy
FROM sides s JOIN leaves l ON s.h = l.h AND s.side = l.side AND l.rank = 1 WHERE s.fold = s.h GROUP BY fold""", "v_vectors", **STUMP_PARTS))
def _(spark):
    return rounded(V.cross_validate(rows(spark), bit_entries(spark), VECTOR_LAYOUT, STUMP_CONFIG), accuracy=9)


@query("predict_stump", oracle("""
SELECT row_id AS plot_id, concat('class ', l.label_id) AS prediction, round(share, 9) AS score
FROM sides s JOIN leaves l ON s.h = l.h AND s.side = l.side AND l.rank = 1 WHERE s.h = -1""", "v_vectors", **STUMP_PARTS))
def _(spark):
    path = scratch_path(spark, "stump")
    V.train(rows(spark), bit_entries(spark), VECTOR_LAYOUT, STUMP_CONFIG, path)
    model, scaler = V.load_trained(spark, path, STUMP_CONFIG)
    out = V.predict(model, rows(spark), bit_entries(spark), VECTOR_LAYOUT, STUMP_CONFIG, label_encoder(spark), scaler)
    return rounded(out, score=9)


@query("group_ablation_stump", oracle("""
SELECT s.label_id AS class, c.criterion, round(avg(CASE WHEN (c.criterion = 'Internal') = (o.j < 40) AND s.side = 1 THEN abs(a.share - z.share) ELSE 0e0 END), 9) AS score
FROM sides s JOIN best o ON s.h = o.h JOIN leaves a ON a.h = s.h AND a.side = s.side AND a.label_id = s.label_id
JOIN leaves z ON z.h = s.h AND z.side = 0 AND z.label_id = s.label_id CROSS JOIN (SELECT unnest(['Internal', 'External']) AS criterion) c
WHERE s.h = -1 GROUP BY s.label_id, c.criterion""", "v_vectors", **STUMP_PARTS))
def _(spark):
    vectors = X.to_vector(rows(spark), bit_entries(spark), VECTOR_LAYOUT.size)
    model = models.fit(vectors, STUMP, VECTOR_LAYOUT.size, N_CLASSES)
    return rounded(A.group_ablation(model, rows(spark), bit_entries(spark), VECTOR_LAYOUT), score=9)


ALLOWED = ", ".join(
    f"('{name}', {j})" for name, groups in U.ABLATION_SUBSETS.items() for group, n in VECTOR_LAYOUT.keep(groups).sizes
    for j in range(VECTOR_LAYOUT.start(group), VECTOR_LAYOUT.start(group) + n)
)
STUDY = dict(
    bits=BITS, outs="SELECT DISTINCT fold AS h FROM v_vectors", whole=STUMP_PARTS["whole"], ones=STUMP_PARTS["ones"], grid=STUMP_PARTS["grid"],
    allowed=f"SELECT * FROM (VALUES {ALLOWED}) t(subset, j)",
    quality="SELECT subset, h, j, coalesce(sum(n1 * n1) * 1e0 / nullif(sum(n1), 0), 0) + coalesce(sum(n0 * n0) * 1e0 / nullif(sum(n0), 0), 0) AS q FROM grid JOIN allowed USING (j) GROUP BY subset, h, j",
    best="SELECT subset, h, arg_max(j, {'q': q, 'j': -j}) AS j FROM quality GROUP BY subset, h",
    leaves="""
SELECT subset, h, side, arg_max(label_id, {'n': n, 'c': -label_id}) AS label_id FROM (
  SELECT subset, h, 1 AS side, label_id, n1 AS n FROM grid JOIN best USING (h, j) UNION ALL SELECT subset, h, 0, label_id, n0 FROM grid JOIN best USING (h, j)) t
GROUP BY subset, h, side""",
    accuracies="""
SELECT o.subset, o.h AS fold, avg(CASE WHEN v.label_id = l.label_id THEN 1e0 ELSE 0e0 END) * 100 AS accuracy
FROM best o JOIN v_vectors v ON v.fold = o.h LEFT JOIN bits b ON b.row_id = v.row_id AND b.j = o.j
JOIN leaves l ON l.subset = o.subset AND l.h = o.h AND l.side = CASE WHEN b.row_id IS NULL THEN 0 ELSE 1 END GROUP BY o.subset, o.h""",
)
SUMMARY = "round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS std, arg_max(fold, {'a': round(accuracy, 9), 'f': -fold}) AS best_fold FROM accuracies"


@query("ablation_study_stump", oracle(f"SELECT subset, {SUMMARY} GROUP BY subset", "v_vectors", **STUDY))
def _(spark):
    return rounded(U.ablation_study(rows(spark), bit_entries(spark), VECTOR_LAYOUT, STUMP_CONFIG), mean=9, std=9)


@query("evaluate_stump", oracle(f"SELECT {SUMMARY} WHERE subset = 'All'", "v_vectors", **STUDY))
def _(spark):
    return rounded(V.evaluate(rows(spark), bit_entries(spark), VECTOR_LAYOUT, STUMP_CONFIG), mean=9, std=9)


@query("cluster_points")
def _(spark):
    plots = view(spark, "v_location").select("plot_id", "lon", "lat")
    return P.cluster_summary(P.cluster_points(plots, k=50))


# Points around far centres: the clusters are the groups they were made from.
@query("cluster_separated", oracle("""
SELECT round(avg(cast(plot_id % 6 AS double) * 20 - 50 + (plot_id % 10) / 100.0e0), 6) AS lat,
  round(avg(cast(plot_id % 6 AS double) * -25 + 60 + (plot_id % 7) / 100.0e0), 6) AS lon, count(*) AS size
FROM v_location GROUP BY plot_id % 6""", "v_location"))
def _(spark):
    home = (F.col("plot_id") % 6).cast("double")
    plots = view(spark, "v_location").select(
        "plot_id", (home * 20 - 50 + (F.col("plot_id") % 10) / 100).alias("lat"), (home * -25 + 60 + (F.col("plot_id") % 7) / 100).alias("lon"))
    return rounded(P.cluster_summary(P.cluster_points(plots, k=6)).select("lat", "lon", "size"), lat=6, lon=6)


def fitted(spark, cfg):
    vectors = X.to_vector(rows(spark), entries(spark), VECTOR_LAYOUT.size)
    return models.fit(vectors, cfg, VECTOR_LAYOUT.size, N_CLASSES)


@query("group_ablation")
def _(spark):
    return A.group_ablation(fitted(spark, PERCEPTRON), rows(spark), entries(spark), VECTOR_LAYOUT)


@query("occlusion_attribution")
def _(spark):
    scores = A.occlusion(fitted(spark, FOREST), rows(spark), entries(spark), VECTOR_LAYOUT.size)
    return A.mean_attribution(scores)


@query("ablation_study")
def _(spark):
    return U.ablation_study(rows(spark), entries(spark), VECTOR_LAYOUT, config(FOREST))


# Bits of the held-out fold 0 in each mode; values of 2 stay beyond the limit of presence.
ROBUST = {
    **{k: STUMP_PARTS[k] for k in ("bits", "outs", "whole", "ones", "grid")}, "outs": "SELECT 0 AS h",
    "quality": "SELECT j, coalesce(sum(n1 * n1) * 1e0 / nullif(sum(n1), 0), 0) + coalesce(sum(n0 * n0) * 1e0 / nullif(sum(n0), 0), 0) AS q FROM grid GROUP BY j",
    "best": "SELECT 0 AS h, 'all' AS kind, arg_max(j, {'q': q, 'j': -j}) AS j FROM quality UNION ALL SELECT 0, 'species', arg_max(j, {'q': q, 'j': -j}) FROM quality WHERE j < 40",
    "leaves": """
SELECT kind, side, arg_max(label_id, {'n': n, 'c': -label_id}) AS label_id FROM (
  SELECT kind, 1 AS side, label_id, n1 AS n FROM grid JOIN best USING (h, j) UNION ALL SELECT kind, 0, label_id, n0 FROM grid JOIN best USING (h, j)) t
GROUP BY kind, side""",
    "judged": "SELECT row_id, j FROM bits WHERE fold = 0",
    "dropped": """
SELECT row_id, j FROM (SELECT *, row_number() OVER (PARTITION BY j < 40 ORDER BY md5(concat('123:', row_id, ':', j))) AS rn FROM judged) t
WHERE j >= 40 OR rn > (SELECT floor(count(*) * 0.3e0) FROM judged WHERE j < 40)""",
    "variants": "SELECT unnest(['as is', 'presence', 'constant', 'dropout', 'species']) AS variant, unnest(['all', 'all', 'all', 'all', 'species']) AS kind",
    "sides": """
SELECT t.variant, t.kind, v.label_id, CASE WHEN t.variant = 'dropout' THEN d.j IS NOT NULL ELSE a.j IS NOT NULL END AS has
FROM v_vectors v CROSS JOIN variants t JOIN best o ON o.kind = t.kind
LEFT JOIN judged a ON a.row_id = v.row_id AND a.j = o.j LEFT JOIN dropped d ON d.row_id = v.row_id AND d.j = o.j WHERE v.fold = 0""",
}


@query("robustness_study_stump", oracle("""
SELECT variant, round(avg(CASE WHEN s.label_id = l.label_id THEN 1e0 ELSE 0e0 END) * 100, 2) AS hit_rate
FROM sides s JOIN leaves l ON l.kind = s.kind AND l.side = CASE WHEN s.has THEN 1 ELSE 0 END GROUP BY variant""", "v_vectors", **ROBUST))
def _(spark):
    twos = bit_entries(spark).withColumn("value", F.lit(2.0))
    r = rows(spark)
    fitted, judged = V.fold_pairs(r, twos.join(r.select("row_id", "fold"), "row_id"), 0)
    return U.robustness_study(fitted, judged, VECTOR_LAYOUT, STUMP_CONFIG, label_encoder(spark))


@query("robustness_inputs", oracle("""
SELECT 'constant' AS mode, count(*) AS rows, cast(sum(10) AS double) AS total FROM v_species
UNION ALL SELECT 'presence', count(*), cast(count(*) AS double) FROM v_species WHERE cover > 1""", "v_species"))
def _(spark):
    species = view(spark, "v_species")
    parts = {m: U.disturbed_species(species, m).select("cover") for m in ("constant", "presence")}
    both = A.tag_union(parts, "mode")
    return both.groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.sum("cover").alias("total"))


@query("robustness", oracle("""
SELECT 'a' AS variant, round(avg(cast(list_contains(string_split(truth, ', '), prediction) AS double)) * 100, 2) AS hit_rate FROM v_predictions
UNION ALL SELECT 'b', round(avg(cast(list_contains(string_split(truth, ', '), prediction_b) AS double)) * 100, 2) FROM v_predictions""", "v_predictions"))
def _(spark):
    df = view(spark, "v_predictions").withColumn("truth", F.split("truth", ", "))
    b = df.select("plot_id", F.col("prediction_b").alias("prediction"))
    return U.robustness({"a": df.select("plot_id", "prediction"), "b": b}, df)


# Whole jobs.

KEPT = "SELECT * FROM train WHERE plot_id IN (SELECT plot_id FROM normalised)"
POINTS = "SELECT DISTINCT plot_id, lon, lat, 6378137 * radians(lon) AS x, 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM kept"
KM = f"""
SELECT plot_id, label, 6378.137e0 * radians(abs(lon)) + CASE WHEN lon < 0 THEN 40075.017e0 - 2 * 6378.137e0 * radians(abs(lon)) ELSE 0 END AS east,
  {ARC[0]} * radians(lat) + ({ARC[1]}) * sin(2 * radians(lat)) + ({ARC[2]}) * sin(4 * radians(lat)) + ({ARC[3]}) * sin(6 * radians(lat)) + ({ARC[4]}) * sin(8 * radians(lat)) AS north
FROM kept"""
COAST = """
SELECT plot_id, coalesce(grp, 'N_COAST') AS coast FROM (SELECT DISTINCT plot_id FROM kept) k LEFT JOIN (
  SELECT plot_id, arg_min(grp, {'d': edge_dist, 'g': grp}) AS grp FROM (
    SELECT plot_id, edge_dist, CASE WHEN geom_id >= 20 THEN NULL ELSE concat('SEA_', geom_id % 5) END AS grp FROM measured) m
  WHERE grp IS NOT NULL AND edge_dist <= 5000 GROUP BY plot_id) c USING (plot_id)"""


def built(spark):
    shapes = polygons(spark)
    places = D.Places(
        raster=raster(spark), countries=shapes, dunes=G.dune_polygons(polygons(spark, "code")),
        coasts=G.dissolve(G.ring_edges(shapes), LINE_GROUPS),
    )
    return D.build_dataset(
        view(spark, "v_header"), view(spark, "v_species"), view(spark, "v_codes"),
        view(spark, "v_backbone"), places,
    )


@query("build_dataset_plots", oracle("""
SELECT k.plot_id, label, lon, lat, fold, coast, bool_or(inside AND regexp_full_match(code, 'P([1-9]|1[0-6])')) AS dune
FROM kept k JOIN blocks b USING (plot_id, label) JOIN folds USING (block_id) JOIN coast USING (plot_id) JOIN measured USING (plot_id)
GROUP BY ALL""", "v_header", "v_codes", "v_species", "v_backbone", "v_corners",
    **NAME_PARTS, kept=KEPT, km=KM, blocks=BLOCKS.replace("plot_id,", "plot_id, label,", 1), folds=FOLDS,
    **{**GEO, "points": POINTS}, coast=COAST))
def _(spark):
    plots = built(spark).plots
    return plots.select("plot_id", "label", "lon", "lat", "fold", "coast", (F.col("dune") == "Y_DUNES").alias("dune"))


@query("build_dataset_features", oracle("""
SELECT k.plot_id, k.label, count(*) AS species, round(sum(cover), 5) AS cover, round(lon + lat, 6) AS place
FROM kept k JOIN normalised n USING (plot_id) GROUP BY k.plot_id, k.label, lon, lat""", "v_header", "v_codes", "v_species", "v_backbone", **NAME_PARTS, kept=KEPT))
def _(spark):
    data = built(spark)
    group = data.layout.group_of(F.col("feature_id"))
    sums = data.features.groupBy("row_id").agg(
        F.count(F.when(group == "species", 1)).alias("species"),
        F.round(F.sum(F.when(group == "species", F.col("value"))), 5).alias("cover"),
        F.round(F.sum(F.when(group == "location", F.col("value"))), 6).alias("place"),
    )
    return data.plots.select("row_id", "plot_id", "label").join(sums, "row_id").drop("row_id")


# Species of a second survey, coded with the stored names and dictionary of the first.
@query("predict_from_stored", oracle("""
SELECT plot_id, accepted_name AS species, round(sum(cover), 6) AS cover FROM seen JOIN m ON species = raw_name
WHERE accepted_name IN (SELECT species FROM normalised) GROUP BY plot_id, accepted_name""",
    "v_header", "v_codes", "v_species", "v_backbone", "v_location", **NAME_PARTS, m=NAME_MAP, seen="""
SELECT plot_id, species, round(sum(cover), 6) AS cover FROM v_species
WHERE plot_id IN (SELECT plot_id FROM v_location WHERE lon IS NOT NULL AND lat IS NOT NULL) GROUP BY plot_id, species HAVING round(sum(cover), 6) > 0"""))
def _(spark):
    path, cfg = scratch_path(spark, "stored"), DatasetConfig(location_features=False)
    species, backbone = view(spark, "v_species"), view(spark, "v_backbone")
    D.build_dataset(view(spark, "v_header"), species, view(spark, "v_codes"), backbone, cfg=cfg).save(path)
    plots, features, _ = D.predict_from_stored(view(spark, "v_location"), species, path, f"{path}-second", backbone, cfg=cfg)
    names = load_encoder(spark, f"{path}/encoder_species").select(F.col("id").alias("feature_id"), F.col("value").alias("species"))
    coded = features.select("row_id", "feature_id", F.round("value", 6).alias("cover")).join(names, "feature_id")
    return coded.join(plots.select("row_id", "plot_id"), "row_id").select("plot_id", "species", "cover")


SECOND = ("v_occurrences", "v_scale", "v_attributes", "v_location", "v_habitat_lookup", "v_habitat_codes", "v_crosswalk",
          "v_codes", "v_backbone", "v_accepted", "v_header")
SECOND_PARTS = dict(
    m=NAME_MAP,
    before="SELECT plot_id, species, midpoint * 100 AS cover FROM v_occurrences JOIN v_scale USING (scale_code)",
    renamed="""
SELECT plot_id, accepted_name AS species, round(sum(cover), 6) AS cover FROM before JOIN m ON species = raw_name
WHERE accepted_name IN (SELECT accepted_name FROM v_accepted WHERE accepted_name <> '?') GROUP BY ALL""",
    observed="""
SELECT r.* FROM renamed r JOIN (SELECT plot_id FROM (SELECT plot_id, count(*) AS kept FROM renamed GROUP BY plot_id) a
  JOIN (SELECT plot_id, count(*) AS had FROM before GROUP BY plot_id) b USING (plot_id) WHERE kept >= 0.75 * had) g USING (plot_id)""",
    one=ONE_CHILD.replace("SELECT DISTINCT broad", "SELECT broad"),
    sites="""
SELECT plot_id, lon, lat, coalesce(fine, habitat) AS habitat FROM v_attributes JOIN v_location USING (plot_id) LEFT JOIN one ON habitat = broad
WHERE caption = 'Survey class' AND lon IS NOT NULL AND coalesce(fine, habitat) <> 'Not in scheme'""",
    **{**CODE_PARTS, "mapped": "SELECT DISTINCT plot_id, codes FROM sites JOIN v_habitat_codes USING (habitat)"},
    **HEADER_PARTS,
    good="""
SELECT plot_id, string_agg(DISTINCT code, ', ' ORDER BY code) FILTER (code IN (SELECT label FROM train)) AS truth FROM deep GROUP BY plot_id
HAVING avg(CASE WHEN code IN (SELECT label FROM train) THEN 0.0e0 ELSE 1.0e0 END) * 100 <= 50
  AND count(DISTINCT code) FILTER (code IN (SELECT label FROM train)) <= 5""",
)


def second_survey(spark):
    lookup = view(spark, "v_habitat_lookup").distinct()
    survey = Q.SecondSurvey(
        view(spark, "v_occurrences"), view(spark, "v_scale"), view(spark, "v_attributes"),
        view(spark, "v_location"), lookup, view(spark, "v_habitat_codes"), view(spark, "v_crosswalk"),
    )
    known = training_header(view(spark, "v_header"), codes_at_level(view(spark, "v_codes"), 3))
    known = known.select(F.col("label").alias("code")).distinct()
    return Q.build_test_set(
        survey, view(spark, "v_backbone"), view(spark, "v_accepted"), view(spark, "v_codes"), known, "Survey class"
    )


@query("test_set_plots", oracle("""
SELECT DISTINCT plot_id, round(lon, 5) AS lon, round(lat, 5) AS lat, truth FROM sites JOIN good USING (plot_id)
WHERE plot_id IN (SELECT plot_id FROM observed)""", *SECOND, **SECOND_PARTS))
def _(spark):
    plots, _, _ = second_survey(spark)
    truth = F.array_join("truth", ", ").alias("truth")
    return plots.select("plot_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), truth)


@query("test_set_species", oracle("""
SELECT plot_id, species, cover FROM observed WHERE plot_id IN (SELECT plot_id FROM sites) AND plot_id IN (SELECT plot_id FROM good)""",
    *SECOND, **SECOND_PARTS))
def _(spark):
    return second_survey(spark)[1]


@query("test_set_rule_species", oracle("""
SELECT plot_id, accepted_name AS species, cast(trunc(round(sum(cover), 6)) AS int) AS cover FROM before JOIN m ON species = raw_name
WHERE accepted_name <> '?' AND plot_id IN (SELECT plot_id FROM observed WHERE plot_id IN (SELECT plot_id FROM sites) AND plot_id IN (SELECT plot_id FROM good))
GROUP BY ALL""", *SECOND, **SECOND_PARTS))
def _(spark):
    return second_survey(spark)[2]


@query("predicted_group_counts", oracle("""
SELECT substr('NQRSTUV', cast(1 + l.label_id % 7 AS int), 1) AS top_group, count(*) AS count
FROM sides s JOIN leaves l ON s.h = l.h AND s.side = l.side AND l.rank = 1 WHERE s.h = -1 GROUP BY ALL""", "v_vectors", **STUMP_PARTS))
def _(spark):
    return predicted_groups(spark, bit_entries(spark), STUMP_CONFIG)


@query("predicted_group_counts_forest")
def _(spark):
    return predicted_groups(spark, entries(spark), config(FOREST))


def predicted_groups(spark, features, cfg):
    model, scaler, _ = V.train(rows(spark), features, VECTOR_LAYOUT, cfg)
    code = F.concat(F.expr("substr('NQRSTUV', cast(1 + id % 7 AS int), 1)"), F.lit("11"))
    encoder = label_encoder(spark).withColumn("value", code)
    out = V.predict(model, rows(spark), features, VECTOR_LAYOUT, cfg, encoder, scaler)
    return M.class_counts(out.withColumn("top_group", top_group(F.col("prediction"))), "top_group")
