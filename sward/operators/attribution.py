"""Importance of features from per-row scores, kept as long tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sward.functions.text import genus, top_group
from sward.operators.features import to_vector, with_vector
from sward.operators.metrics import score_array


def mean_attribution(df, rows=None):
    """Mean absolute score per class and feature: within each fold, then over its folds.

    Entries absent from ``df`` are zero, so the sum is divided by the rows of the class in the
    fold; these come from ``rows (fold, class)`` if given, else from ``df``.
    """
    base = df.select("fold", "class", "row_id").distinct() if rows is None else rows
    support = base.groupBy("fold", "class").agg(F.count(F.lit(1)).alias("_rows"))
    folds = support.groupBy("class").agg(F.count(F.lit(1)).alias("_folds"))
    total = df.groupBy("fold", "class", "feature_id").agg(F.sum(F.abs("score")).alias("_sum"))
    per_fold = total.join(support, ["fold", "class"]).withColumn(
        "_mean", F.col("_sum") / F.col("_rows")
    )
    summed = per_fold.groupBy("class", "feature_id").agg(F.sum("_mean").alias("_mean"))
    return summed.join(folds, "class").select(
        "class", "feature_id", (F.col("_mean") / F.col("_folds")).alias("score")
    )


def feature_importance(scores, classes=None):
    """Mean score of each feature over all classes; a class without the feature counts as 0."""
    if classes is None:
        classes = scores.select("class")
    n = classes.agg(F.countDistinct("class").alias("n")).scalar()
    return scores.groupBy("feature_id").agg((F.sum("score") / n).alias("score"))


def criterion(grp):
    """Species, location or environment."""
    return (
        F.when(grp == "species", "species")
        .when(grp == "location", "location")
        .otherwise("environment")
    )


def group_importance(importance, catalogue):
    """Total importance of species, location and environment."""
    hit = importance.join(catalogue.select("feature_id", "grp"), "feature_id")
    return hit.groupBy(criterion(F.col("grp")).alias("criterion")).agg(
        F.sum("score").alias("score")
    )


def side(grp):
    """Internal for species, external for everything else."""
    return F.when(grp == "species", "Internal").otherwise("External")


def class_criteria(scores, catalogue):
    """Internal and external total per class, with the top group of the class."""
    hit = scores.join(catalogue.select("feature_id", "grp"), "feature_id")
    return hit.groupBy(
        top_group(F.col("class")).alias("top_group"), "class", side(F.col("grp")).alias("criterion")
    ).agg(F.sum("score").alias("score"))


def tag_union(frames, tag):
    """Concatenate frames, each marked with its name."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


FEATURE_TYPES = [
    "herbaceous", "arborescent", "location", "altitude", "country", "ecoregion", "dune", "coast",
]


def type_importance(scores, catalogue, woody):
    """Per top group: mean over its classes of the summed score of each feature type.

    ``woody`` lists the names of arborescent species.
    """
    woody = woody.select("name", F.lit(True).alias("_woody")).distinct()
    typed = catalogue.join(woody, "name", "left").select(
        "feature_id",
        F.when(F.col("grp") != "species", F.col("grp"))
        .when(F.col("_woody"), "arborescent")
        .otherwise("herbaceous")
        .alias("type"),
    )
    per_class = (
        scores.join(typed, "feature_id")
        .groupBy("class")
        .pivot("type", FEATURE_TYPES)
        .agg(F.sum("score"))
        .fillna(0.0, FEATURE_TYPES)
    )
    return per_class.groupBy(top_group(F.col("class")).alias("top_group")).agg(
        *[F.avg(t).alias(t) for t in FEATURE_TYPES]
    )


def rollup_genus(scores, catalogue):
    """Summed species score per class and genus."""
    sp = catalogue.where(F.col("grp") == "species").select(
        "feature_id", genus(F.col("name")).alias("genus")
    )
    return scores.join(sp, "feature_id").groupBy("class", "genus").agg(
        F.sum("score").alias("score")
    )


def classes_per_group(classes, col="class"):
    """Number of classes in each top group."""
    distinct = classes.select(F.col(col).alias("class")).distinct()
    return distinct.groupBy(top_group(F.col("class")).alias("top_group")).agg(
        F.count(F.lit(1)).alias("classes")
    )


def rank_importance(ranked, col="score"):
    """Mean absolute score of the item at each dominance rank, over the plots that reach it."""
    return ranked.groupBy("rank").agg(
        (F.sum(F.abs(col)) / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("plots")
    )


def cumulative_cutoff(ranks, share=0.5):
    """First rank at which the running score reaches ``share`` of the total.

    ``ranks`` has one row per rank, at most as many as the longest species list.
    """
    total = ranks.agg(F.sum("score")).scalar()
    running = F.sum("score").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    reached = ranks.withColumn("_run", running).where(F.col("_run") >= total * share)
    return reached.agg(F.min("rank").alias("rank"))


def top_features(scores, k, cls=None):
    """The ``k`` features of highest score, overall or for one class."""
    if cls is not None:
        scores = scores.where(F.col("class") == cls)
    return scores.orderBy(F.desc("score"), "feature_id").limit(k)


def top_items_by_group(scores, item, k):
    """Per top group the ``k`` items of highest mean score over the classes of the group.

    A class without the item counts as 0.
    """
    classes = classes_per_group(scores.select("class"))
    total = scores.groupBy(top_group(F.col("class")).alias("top_group"), item).agg(
        F.sum("score").alias("_sum")
    )
    mean = total.join(classes, "top_group").select(
        "top_group", item, (F.col("_sum") / F.col("classes")).alias("score")
    )
    order = W.partitionBy("top_group").orderBy(F.desc("score"), item)
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def raw_scores(model, rows, features, size):
    """Raw model output of each row as an array, from long features."""
    scored = model.transform(to_vector(rows, features, size))
    return scored.select("row_id", score_array(scored, "rawPrediction").alias("raw"))


def group_ablation(model, rows, features, layout):
    """Mean absolute change of the true-class output when a feature side is set to zero.

    Returns ``(class, criterion, score)`` for the internal (species) and external side.
    """
    full = raw_scores(model, rows, features, layout.size)
    internal = F.col("feature_id") < layout.count("species")
    parts = {}
    for name, kept in (("Internal", ~internal), ("External", internal)):
        cut = raw_scores(model, rows, features.where(kept), layout.size)
        parts[name] = cut.withColumnRenamed("raw", "raw0")
    label = F.col("label_id").cast("int")
    change = F.abs(F.get("raw", label) - F.get("raw0", label))
    both = (
        tag_union(parts, "criterion")
        .join(full, "row_id")
        .join(rows.select("row_id", "label_id"), "row_id")
    )
    return both.groupBy(F.col("label_id").alias("class"), "criterion").agg(
        F.avg(change).alias("score")
    )


def occlusion(model, rows, features, size):
    """Change of the true-class output when one stored feature of a row is set to zero.

    Each row is scored once in full and once per stored feature: ``(row_id, class, fold,
    feature_id, score)``.
    """
    entry = F.struct("feature_id", "value")
    lists = features.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    base = rows.join(lists, "row_id")
    single = base.withColumn("hidden", F.explode("items.feature_id"))
    left = F.filter("items", lambda e: e["feature_id"] != F.col("hidden"))
    cut_rows = single.select(
        "row_id", "fold", "label_id", "hidden", left["feature_id"].alias("_ids"), left["value"].alias("_values")
    )
    scored = model.transform(with_vector(cut_rows, F.col("_ids"), F.col("_values"), size))
    label = F.col("label_id").cast("int")
    cut = scored.select(
        "row_id", "fold", "label_id", "hidden",
        F.get(score_array(scored, "rawPrediction"), label).alias("_cut"),
    )
    full = raw_scores(model, rows, features, size)
    return cut.join(full, "row_id").select(
        "row_id", "fold", F.col("label_id").alias("class"), F.col("hidden").alias("feature_id"),
        (F.get("raw", label) - F.col("_cut")).alias("score"),
    )
