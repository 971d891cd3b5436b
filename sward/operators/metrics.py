"""Evaluation measures."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sward.functions.text import parent_code


def is_hit(prediction, truth, level_drop=0):
    """Whether the predicted code is among the true ones, after dropping last characters."""
    if not level_drop:
        return F.array_contains(truth, prediction)
    return F.exists(truth, lambda t: parent_code(t, level_drop) == parent_code(prediction, level_drop))


def percent(share, digits=2):
    return F.round(share * 100, digits)


def hit_rate(df, prediction="prediction", truth="truth", level_drop=0, digits=2):
    """Percentage of rows whose prediction is among the true codes."""
    hit = is_hit(F.col(prediction), F.col(truth), level_drop).cast("double")
    return df.agg(percent(F.avg(hit), digits).alias("hit_rate"))


def hit_rate_by(df, train, region="region", a="prediction", b="prediction_b", digits=2):
    """Per region: test rows, training rows and the hit rates of two predictors."""
    rate = {
        name: percent(F.avg(is_hit(F.col(c), F.col("truth")).cast("double")), digits).alias(name)
        for name, c in (("hit_rate_a", a), ("hit_rate_b", b))
    }
    test = df.groupBy(region).agg(F.count(F.lit(1)).alias("test_plots"), *rate.values())
    seen = train.groupBy(region).agg(F.count(F.lit(1)).alias("train_plots"))
    return test.join(seen, region, "left").withColumn(
        "train_plots", F.coalesce("train_plots", F.lit(0))
    )


def compare_predictions(a, b, truth, digits=2, key="plot_id"):
    """Hit rates of two predictors over the same plots, and how often they agree."""
    both = (
        a.select(key, F.col("prediction").alias("a"))
        .join(b.select(key, F.col("prediction").alias("b")), key)
        .join(truth.select(key, "truth"), key)
    )
    hit_a, hit_b = (is_hit(F.col(c), F.col("truth")).cast("double") for c in "ab")
    return both.agg(
        F.count(F.lit(1)).alias("plots"),
        percent(F.avg(hit_a), digits).alias("hit_rate_a"),
        percent(F.avg(hit_b), digits).alias("hit_rate_b"),
        percent(F.avg((F.col("a") == F.col("b")).cast("double")), digits).alias("agreement"),
    )


def class_rank(scores, label):
    """Zero-based rank of the true class among array scores; of equal scores lower ids first."""
    own = F.get(scores, label)

    def ahead(s, i):
        return (s > own) | ((s == own) & (i < label))

    return F.size(F.filter(scores, ahead))


def score_array(df, scores):
    """Scores per class as an array, from an array or a vector column."""
    values = F.col(scores)
    return values if df.schema[scores].dataType.typeName() == "array" else vector_to_array(values)


def topk_accuracy(df, k=1, average="micro", scores="probability", label="label_id", by=()):
    """Percentage of rows whose true class is among the ``k`` best, per ``by`` columns.

    ``macro`` averages over the classes that occur.
    """
    values = score_array(df, scores)
    by = list(by)
    hit = (class_rank(values, F.col(label).cast("int")) < k).cast("double")
    rows = df.select(*by, F.col(label).alias("_label"), hit.alias("_hit"))
    if average == "macro":
        rows = rows.groupBy(*by, "_label").agg(F.avg("_hit").alias("_hit"))
    elif average != "micro":
        raise ValueError("average is micro or macro")
    return rows.groupBy(*by).agg((F.avg("_hit") * 100).alias("accuracy"))


def cv_summary(folds, value="accuracy"):
    """Mean, sample standard deviation and best fold of per-fold values."""
    return folds.agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.max_by("fold", F.struct(F.col(value), -F.col("fold"))).alias("best_fold"),
    )


def confusion(df, truth="truth", prediction="prediction", level_drop=0, normalise=False):
    """Counts per true and predicted class; ``normalise`` adds the share within the truth."""
    t, p = F.col(truth), F.col(prediction)
    if level_drop:
        t, p = parent_code(t, level_drop), parent_code(p, level_drop)
    out = df.groupBy(t.alias("truth"), p.alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )
    if normalise:
        # Runs over the aggregated matrix: at most one row per pair of classes.
        total = F.sum("count").over(W.partitionBy("truth"))
        out = out.withColumn("share", F.col("count") / total)
    return out


def class_recall(df, truth="truth", prediction="prediction"):
    """Recall and support per true class."""
    hit = (F.col(truth) == F.col(prediction)).cast("double")
    return df.groupBy(F.col(truth).alias("class")).agg(
        F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("support")
    )


def recall_extremes(recall):
    """Classes recognised best and worst; of equal recalls the first class."""
    first = F.min_by("class", F.struct(-F.col("recall"), F.col("class")))
    last = F.min_by("class", F.struct(F.col("recall"), F.col("class")))
    return recall.agg(
        first.alias("best_class"), percent(F.max("recall")).alias("best_pct"),
        last.alias("worst_class"), percent(F.min("recall")).alias("worst_pct"),
    )


def class_counts(df, label="label_id"):
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def majority_count(df, label="label_id"):
    return class_counts(df, label).agg(F.max("count").alias("count"))


def class_presence(df, label="label_id", fold="fold"):
    """Number of folds each class occurs in."""
    return df.select(fold, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("folds"))


def top_class(df, scores="probability", encoder=None):
    """Best class of each row with its score; of equal scores the lower id."""
    values = score_array(df, scores)
    best = F.array_max(values)
    out = df.withColumns(
        {"prediction_id": (F.array_position(values, best) - 1).cast("int"), "score": best}
    )
    if encoder is None:
        return out
    names = encoder.select(F.col("id").alias("prediction_id"), F.col("value").alias("prediction"))
    return out.drop("prediction").join(names, "prediction_id", "left")


def softmax(values):
    """Softmax of an array column."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(raised, lambda v: v / total)
