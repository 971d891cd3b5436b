"""Queries: measures, reports and importance tables."""

from pyspark.sql import functions as F

from checks.cleaning import CLEAN, HEADER_PARTS, LABELLED, SPECIES_PARTS, training_header, training_species
from checks.composition import THREAT_PARTS
from checks.registry import query
from checks.views import oracle, table, view
from sward.operators import attribution as A
from sward.operators import cleaning as C
from sward.operators import features as X
from sward.operators import metrics as M
from sward.operators import reports as P
from sward.operators import taxonomy as T
from sward.sources.readers import split_truth

TRUTH = "SELECT plot_id, prediction, prediction_b, string_split(truth, ', ') AS truth, region, fold FROM v_predictions"


def judged(spark):
    return split_truth(view(spark, "v_predictions"))


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("hit_rate", oracle(
    "SELECT round(avg(CASE WHEN list_contains(truth, prediction) THEN 1.0e0 ELSE 0.0e0 END) * 100, 2) AS hit_rate FROM t", "v_predictions", t=TRUTH))
def _(spark):
    return M.hit_rate(judged(spark))


@query("hit_rate_at_parent_level", oracle("""
SELECT round(avg(CASE WHEN list_contains([left(c, length(c) - 1) FOR c IN truth], left(prediction, length(prediction) - 1)) THEN 1.0e0 ELSE 0.0e0 END) * 100, 2) AS hit_rate
FROM t""", "v_predictions", t=TRUTH))
def _(spark):
    return M.hit_rate(judged(spark), level_drop=1)


@query("hit_rate_by_region", oracle("""
SELECT region, test_plots, coalesce(train_plots, 0) AS train_plots, hit_rate_a, hit_rate_b FROM (
  SELECT region, count(*) AS test_plots, round(avg(cast(list_contains(truth, prediction) AS double)) * 100, 2) AS hit_rate_a,
    round(avg(cast(list_contains(truth, prediction_b) AS double)) * 100, 2) AS hit_rate_b FROM t WHERE fold = 0 GROUP BY region) a
LEFT JOIN (SELECT region, count(*) AS train_plots FROM t WHERE fold <> 0 GROUP BY region) b USING (region)""", "v_predictions", t=TRUTH))
def _(spark):
    df = judged(spark)
    return M.hit_rate_by(df.where("fold = 0"), df.where("fold <> 0"))


@query("compare_predictions", oracle("""
SELECT count(*) AS plots, round(avg(cast(list_contains(truth, prediction) AS double)) * 100, 2) AS hit_rate_a,
  round(avg(cast(list_contains(truth, prediction_b) AS double)) * 100, 2) AS hit_rate_b,
  round(avg(cast(prediction = prediction_b AS double)) * 100, 2) AS agreement FROM t""", "v_predictions", t=TRUTH))
def _(spark):
    df = judged(spark)
    b = df.select("plot_id", F.col("prediction_b").alias("prediction"))
    return M.compare_predictions(df, b, df)


# The first ten components of a vector act as class scores.
SCORED = """
SELECT row_id, label_id, fold, (SELECT count(*) FROM (SELECT unnest(embedding[1:10]) AS s, generate_subscripts(embedding[1:10], 1) - 1 AS i) u
  WHERE s > embedding[label_id + 1] OR (s = embedding[label_id + 1] AND i < label_id)) AS rank FROM v_vectors"""


def scored(spark):
    scores = F.slice("embedding", 1, 10).cast("array<double>")
    return view(spark, "v_vectors").withColumn("probability", scores)


@query("topk_accuracy_micro", oracle(
    "SELECT fold, round(avg(cast(rank < 3 AS double)) * 100, 9) AS accuracy FROM s GROUP BY fold", "v_vectors", s=SCORED))
def _(spark):
    return rounded(M.topk_accuracy(scored(spark), k=3, by=["fold"]), accuracy=9)


@query("topk_accuracy_macro", oracle("""
SELECT fold, round(avg(a) * 100, 9) AS accuracy FROM (
  SELECT fold, label_id, avg(cast(rank < 3 AS double)) AS a FROM s GROUP BY fold, label_id) t GROUP BY fold""", "v_vectors", s=SCORED))
def _(spark):
    return rounded(M.topk_accuracy(scored(spark), k=3, average="macro", by=["fold"]), accuracy=9)


FOLD_ACCURACY = "SELECT fold, avg(cast(truth = prediction AS double)) * 100 AS accuracy FROM v_classified GROUP BY fold"


@query("cv_summary", oracle("""
SELECT round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS std, arg_max(fold, accuracy) AS best_fold FROM f""", "v_classified", f=FOLD_ACCURACY))
def _(spark):
    hit = (F.col("truth") == F.col("prediction")).cast("double")
    folds = view(spark, "v_classified").groupBy("fold").agg((F.avg(hit) * 100).alias("accuracy"))
    return rounded(M.cv_summary(folds), mean=9, std=9)


@query("std_band", oracle("""
SELECT round(avg(accuracy) - stddev_samp(accuracy), 9) AS low, round(avg(accuracy) + stddev_samp(accuracy), 9) AS high FROM f""", "v_classified", f=FOLD_ACCURACY))
def _(spark):
    hit = (F.col("truth") == F.col("prediction")).cast("double")
    folds = view(spark, "v_classified").groupBy("fold").agg((F.avg(hit) * 100).alias("accuracy"))
    return rounded(P.band(M.cv_summary(folds)), low=9, high=9).select("low", "high")


@query("confusion", oracle("SELECT truth, prediction, count(*) AS count FROM v_classified GROUP BY truth, prediction", "v_classified"))
def _(spark):
    return M.confusion(view(spark, "v_classified"))


@query("confusion_at_parent_level", oracle("""
SELECT left(truth, 2) AS truth, left(prediction, 2) AS prediction, count(*) AS count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY left(truth, 2)), 12) AS share FROM v_classified GROUP BY 1, 2""", "v_classified"))
def _(spark):
    return rounded(M.confusion(view(spark, "v_classified"), level_drop=1, normalise=True), share=12)


RECALL = "SELECT truth AS class, avg(cast(truth = prediction AS double)) AS recall, count(*) AS support FROM v_classified GROUP BY truth"


@query("class_recall", oracle("SELECT class, round(recall, 12) AS recall, support FROM r", "v_classified", r=RECALL))
def _(spark):
    return rounded(M.class_recall(view(spark, "v_classified")), recall=12)


@query("recall_extremes", oracle("""
SELECT (SELECT class FROM r ORDER BY recall DESC, class LIMIT 1) AS best_class, round(max(recall) * 100, 2) AS best_pct,
  (SELECT class FROM r ORDER BY recall, class LIMIT 1) AS worst_class, round(min(recall) * 100, 2) AS worst_pct FROM r""", "v_classified", r=RECALL))
def _(spark):
    return M.recall_extremes(M.class_recall(view(spark, "v_classified")))


@query("quality_confusion", oracle("SELECT quality AS truth, toxic AS prediction, count(*) AS count FROM labels GROUP BY quality, toxic"))
def _(spark):
    return M.confusion(table(spark, "labels"), "quality", "toxic")


@query("class_counts", oracle("SELECT label, count(*) AS count FROM labelled GROUP BY label", "v_header", clean=CLEAN, labelled=LABELLED))
def _(spark):
    return M.class_counts(C.explode_labels(C.clean_header(view(spark, "v_header"))), "label")


@query("majority_count", oracle("SELECT max(n) AS count FROM (SELECT count(*) AS n FROM labelled GROUP BY label) t",
    "v_header", clean=CLEAN, labelled=LABELLED))
def _(spark):
    return M.majority_count(C.explode_labels(C.clean_header(view(spark, "v_header"))), "label")


@query("class_presence", oracle("SELECT truth, count(DISTINCT fold) AS folds FROM v_classified GROUP BY truth", "v_classified"))
def _(spark):
    return M.class_presence(view(spark, "v_classified"), "truth")


@query("top_class", oracle("""
SELECT row_id, cast(list_position(p, list_max(p)) - 1 AS int) AS prediction_id, round(list_max(p), 9) AS score FROM (
  SELECT row_id, [exp(cast(s AS double)) / list_sum([exp(cast(q AS double)) FOR q IN embedding[1:10]]) FOR s IN embedding[1:10]] AS p FROM v_vectors) t""",
    "v_vectors"))
def _(spark):
    df = scored(spark).withColumn("probability", M.softmax(F.col("probability")))
    return rounded(M.top_class(df).select("row_id", "prediction_id", "score"), score=9)


# Reports.


@query("value_counts", oracle("SELECT species, count(*) AS count FROM supported GROUP BY species",
    "v_header", "v_codes", "v_species", **SPECIES_PARTS))
def _(spark):
    return P.value_counts(training_species(spark), "species")


@query("year_counts", oracle("""
SELECT year, count(*) AS count FROM (SELECT plot_id FROM train) t JOIN
  (SELECT plot_id, cast(right(replace(coalesce(recorded, '0'), ':', ''), 4) AS int) AS year FROM v_header) y USING (plot_id)
WHERE year <> 0 GROUP BY year""", "v_header", "v_codes", **HEADER_PARTS))
def _(spark):
    return P.year_counts(P.with_year(training_header(spark), view(spark, "v_header")))


@query("original_year", oracle("""
SELECT plot_id, label, year FROM train JOIN
  (SELECT plot_id, cast(right(replace(coalesce(recorded, '0'), ':', ''), 4) AS int) AS year FROM v_header) y USING (plot_id)""",
    "v_header", "v_codes", **HEADER_PARTS))
def _(spark):
    df = P.with_year(training_header(spark), view(spark, "v_header"))
    return df.select("plot_id", "label", "year")


@query("group_counts", oracle("""
SELECT CASE WHEN starts_with(label, 'MA2') THEN 'MA2' ELSE left(label, 1) END AS top_group, label, count(*) AS count,
  cast(sum(count(*)) OVER (PARTITION BY CASE WHEN starts_with(label, 'MA2') THEN 'MA2' ELSE left(label, 1) END) AS bigint) AS group_count
FROM train GROUP BY 1, 2""", "v_header", "v_codes", **HEADER_PARTS))
def _(spark):
    return P.group_counts(training_header(spark))


RICHNESS = """
SELECT items, count(*) AS rows FROM train JOIN (SELECT plot_id, count(*) AS items FROM v_species GROUP BY plot_id) s USING (plot_id) GROUP BY items"""


@query("richness_histogram", oracle("""
SELECT part, bucket, cast(sum(rows) AS bigint) AS rows, round(sum(rows) / sum(sum(rows)) OVER (PARTITION BY part), 2) AS share FROM (
  SELECT 'all' AS part, CASE WHEN items <= 10 THEN '<=10' WHEN items <= 30 THEN '11-30' ELSE '>=31' END AS bucket, rows FROM h
  UNION ALL
  SELECT '>=31', CASE WHEN items <= 40 THEN '31-40' WHEN items <= 50 THEN '41-50' WHEN items <= 60 THEN '51-60' ELSE '>=61' END, rows
  FROM h WHERE items >= 31) t GROUP BY part, bucket""", "v_header", "v_codes", "v_species", **HEADER_PARTS, h=RICHNESS))
def _(spark):
    return P.richness_histogram(training_header(spark), view(spark, "v_species"))


@query("threat_summary", oracle("""
SELECT threat_group, category, count(*) AS count, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 9) AS pct
FROM threat_plots GROUP BY threat_group, category""", "v_header", "v_threats", **THREAT_PARTS))
def _(spark):
    plots = C.explode_labels(C.clean_header(view(spark, "v_header"))).select("plot_id", "label")
    categories = T.highest_category(view(spark, "v_threats").select("code", "category"))
    return rounded(P.threat_summary(T.with_category(plots, categories)), pct=9)


@query("pct_of_total", oracle("""
SELECT event_type, count(*) AS count, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 9) AS pct FROM events GROUP BY event_type"""))
def _(spark):
    counts = table(spark, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))
    return rounded(P.pct_of_total(counts), pct=9)


@query("cluster_summary", oracle("""
SELECT cast(plot_id % 50 AS int) AS cluster, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon, count(*) AS size FROM v_header GROUP BY 1""", "v_header"))
def _(spark):
    df = view(spark, "v_header").withColumn("cluster", (F.col("plot_id") % 50).cast("int"))
    return rounded(P.cluster_summary(df), lat=8, lon=8)


@query("rescale_range", oracle("""
SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) + 1, 9) AS size FROM customer"""))
def _(spark):
    df = table(spark, "customer").select("c_custkey", F.col("c_acctbal").alias("size"))
    return rounded(P.rescale(df, "size"), size=9)


@query("keep_first_by_priority", oracle("""
SELECT threat_code, category, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY threat_code ORDER BY CASE category WHEN 'Vulnerable' THEN 3 WHEN 'Endangered' THEN 4
    WHEN 'Critically EndangeredR' THEN 5 WHEN 'Critically Endangered' THEN 5 WHEN 'Data Deficient' THEN 0
    WHEN 'Least concern' THEN 1 WHEN 'Least Concern' THEN 1 ELSE 2 END DESC, ord) AS rn FROM v_threats) t WHERE rn = 1""",
    "v_threats"))
def _(spark):
    priority = T.category_priority(T.canonical_category(F.col("category")))
    return P.keep_first(view(spark, "v_threats").drop("code"), "threat_code", [-priority, F.col("ord")])


@query("rows_of_first_plot", oracle("""
SELECT part, count(*) AS rows FROM (
  SELECT 'header' AS part, plot_id FROM v_header UNION ALL SELECT 'species', plot_id FROM v_species) t
WHERE plot_id = (SELECT min(plot_id) FROM v_header) GROUP BY part""", "v_header", "v_species"))
def _(spark):
    header, species = P.rows_of_first_plot(view(spark, "v_header"), view(spark, "v_species"))
    both = A.tag_union({"header": header.select("plot_id"), "species": species.select("plot_id")}, "part")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query("distinct_names", oracle("SELECT DISTINCT p_name, p_type FROM part"))
def _(spark):
    return table(spark, "part").select("p_name", "p_type").distinct()


# Importance tables.

# One row per (row, feature): scores of repeated pairs are added.
CELLS = "SELECT row_id, fold, class, feature_id, sum(score) AS score FROM v_scores GROUP BY ALL"
MEAN_SCORES = """
SELECT class, feature_id, sum(m) / any_value(folds) AS score FROM (
  SELECT a.fold, a.class, a.feature_id, a.s / b.n AS m FROM
    (SELECT fold, class, feature_id, sum(abs(score)) AS s FROM cells GROUP BY ALL) a
    JOIN (SELECT fold, class, count(DISTINCT row_id) AS n FROM cells GROUP BY ALL) b USING (fold, class)) c
JOIN (SELECT class, count(DISTINCT fold) AS folds FROM cells GROUP BY class) d USING (class) GROUP BY class, feature_id"""
IMPORTANCE = "SELECT feature_id, sum(score) / (SELECT count(DISTINCT class) FROM mean_scores) AS score FROM mean_scores GROUP BY feature_id"
SCORE_PARTS = dict(cells=CELLS, mean_scores=MEAN_SCORES, importance=IMPORTANCE)
TOP = "CASE WHEN starts_with(class, 'MA2') THEN 'MA2' ELSE left(class, 1) END"


def cells(spark):
    return view(spark, "v_scores").groupBy("row_id", "fold", "class", "feature_id").agg(F.sum("score").alias("score"))


def mean_scores(spark):
    return A.mean_attribution(cells(spark))


@query("mean_attribution", oracle("SELECT class, feature_id, round(score, 9) AS score FROM mean_scores", "v_scores", **SCORE_PARTS))
def _(spark):
    return rounded(mean_scores(spark), score=9)


@query("five_number", oracle("""
SELECT class, round(min(score), 9) AS low, round(quantile_cont(score, 0.25), 9) AS q1, round(median(score), 9) AS median,
  round(quantile_cont(score, 0.75), 9) AS q3, round(max(score), 9) AS high FROM mean_scores GROUP BY class""", "v_scores", **SCORE_PARTS))
def _(spark):
    return rounded(P.five_number(mean_scores(spark), ["class"]), low=9, q1=9, median=9, q3=9, high=9)


@query("feature_importance", oracle("SELECT feature_id, round(score, 9) AS score FROM importance", "v_scores", **SCORE_PARTS))
def _(spark):
    return rounded(A.feature_importance(mean_scores(spark)), score=9)


@query("group_importance", oracle("""
SELECT CASE WHEN grp IN ('species', 'location') THEN grp ELSE 'environment' END AS criterion, round(sum(score), 8) AS score
FROM importance JOIN v_catalogue USING (feature_id) GROUP BY 1""", "v_scores", "v_catalogue", **SCORE_PARTS))
def _(spark):
    return rounded(A.group_importance(A.feature_importance(mean_scores(spark)), view(spark, "v_catalogue")), score=8)


@query("class_criteria", oracle(f"""
SELECT {TOP} AS top_group, class, CASE WHEN grp = 'species' THEN 'Internal' ELSE 'External' END AS criterion, round(sum(score), 8) AS score
FROM mean_scores JOIN v_catalogue USING (feature_id) GROUP BY ALL""", "v_scores", "v_catalogue", **SCORE_PARTS))
def _(spark):
    return rounded(A.class_criteria(mean_scores(spark), view(spark, "v_catalogue")), score=8)


TYPES = """
SELECT class, CASE WHEN grp <> 'species' THEN grp WHEN woody THEN 'arborescent' ELSE 'herbaceous' END AS type, score
FROM mean_scores JOIN v_catalogue USING (feature_id)"""
TYPE_SUMS = "SELECT class, " + ", ".join(
    f"coalesce(sum(score) FILTER (type = '{t}'), 0) AS {t}" for t in A.FEATURE_TYPES
) + " FROM types GROUP BY class"


@query("type_importance", oracle(
    f"SELECT {TOP} AS top_group, " + ", ".join(f"round(avg({t}), 8) AS {t}" for t in A.FEATURE_TYPES) + " FROM type_sums GROUP BY 1",
    "v_scores", "v_catalogue", **SCORE_PARTS, types=TYPES, type_sums=TYPE_SUMS))
def _(spark):
    catalogue = view(spark, "v_catalogue")
    woody = catalogue.where("woody AND grp = 'species'").select("name")
    out = A.type_importance(mean_scores(spark), catalogue.drop("woody"), woody)
    return rounded(out, **{t: 8 for t in A.FEATURE_TYPES})


GENERA = """
SELECT class, string_split(name, ' ')[1] AS genus, sum(score) AS score FROM mean_scores JOIN v_catalogue USING (feature_id)
WHERE grp = 'species' GROUP BY ALL"""


@query("rollup_genus", oracle("SELECT class, genus, round(score, 8) AS score FROM genera", "v_scores", "v_catalogue", **SCORE_PARTS, genera=GENERA))
def _(spark):
    return rounded(A.rollup_genus(mean_scores(spark), view(spark, "v_catalogue")), score=8)


@query("classes_per_group", oracle(f"SELECT {TOP} AS top_group, count(DISTINCT class) AS classes FROM v_scores GROUP BY 1", "v_scores"))
def _(spark):
    return A.classes_per_group(view(spark, "v_scores"))


RANKS = """
SELECT rank, sum(value) / count(*) AS score, count(*) AS plots FROM (
  SELECT value, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature_id) AS rank FROM v_features) t GROUP BY rank"""


@query("rank_importance", oracle("SELECT cast(rank AS int) AS rank, round(score, 8) AS score, plots FROM ranks", "v_features", ranks=RANKS))
def _(spark):
    return rounded(A.rank_importance(X.dominance_rank(view(spark, "v_features")), "value"), score=8)


@query("cumulative_cutoff", oracle("""
SELECT cast(min(rank) AS int) AS rank FROM (SELECT rank, sum(score) OVER (ORDER BY rank) AS run FROM ranks) t
WHERE run >= 0.5 * (SELECT sum(score) FROM ranks)""", "v_features", ranks=RANKS))
def _(spark):
    return A.cumulative_cutoff(A.rank_importance(X.dominance_rank(view(spark, "v_features")), "value"))


@query("top_features", oracle("SELECT feature_id, round(score, 8) AS score FROM importance ORDER BY importance.score DESC, feature_id LIMIT 20", "v_scores", **SCORE_PARTS))
def _(spark):
    return rounded(A.top_features(A.feature_importance(mean_scores(spark)), 20), score=8)


@query("top_features_of_class", oracle("""
SELECT feature_id, round(score, 8) AS score FROM mean_scores m WHERE class = 'R31' ORDER BY m.score DESC, feature_id LIMIT 10""", "v_scores", **SCORE_PARTS))
def _(spark):
    return rounded(A.top_features(mean_scores(spark), 10, "R31"), score=8).select("feature_id", "score")


@query("top_items_by_group", oracle(f"""
SELECT top_group, feature_id, round(score, 8) AS score, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY top_group ORDER BY score DESC, feature_id) AS rank FROM (
    SELECT {TOP} AS top_group, feature_id, sum(score) / any_value(n) AS score FROM mean_scores
    JOIN (SELECT {TOP} AS g, count(DISTINCT class) AS n FROM mean_scores GROUP BY 1) c ON g = {TOP} GROUP BY 1, 2) t) u WHERE rank <= 3""",
    "v_scores", **SCORE_PARTS))
def _(spark):
    return rounded(A.top_items_by_group(mean_scores(spark), "feature_id", 3), score=8)


@query("top_genus_by_group", oracle(f"""
SELECT top_group, genus, round(score, 8) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY top_group ORDER BY score DESC, genus) AS rank FROM (
    SELECT {TOP} AS top_group, genus, sum(score) / any_value(n) AS score FROM genera
    JOIN (SELECT {TOP} AS g, count(DISTINCT class) AS n FROM genera GROUP BY 1) c ON g = {TOP} GROUP BY 1, 2) t) u WHERE rank = 1""",
    "v_scores", "v_catalogue", **SCORE_PARTS, genera=GENERA))
def _(spark):
    genera = A.rollup_genus(mean_scores(spark), view(spark, "v_catalogue"))
    return rounded(A.top_items_by_group(genera, "genus", 1), score=8).select("top_group", "genus", "score")


@query("criteria_distribution", oracle(f"""
SELECT criterion, round(min(score), 8) AS low, round(quantile_cont(score, 0.25), 8) AS q1, round(median(score), 8) AS median,
  round(quantile_cont(score, 0.75), 8) AS q3, round(max(score), 8) AS high FROM (
  SELECT class, CASE WHEN grp = 'species' THEN 'Internal' ELSE 'External' END AS criterion, sum(score) AS score
  FROM mean_scores JOIN v_catalogue USING (feature_id) GROUP BY ALL) t GROUP BY criterion""", "v_scores", "v_catalogue", **SCORE_PARTS))
def _(spark):
    scores = A.class_criteria(mean_scores(spark), view(spark, "v_catalogue"))
    return rounded(P.five_number(scores, ["criterion"]), low=8, q1=8, median=8, q3=8, high=8)
