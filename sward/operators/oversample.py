"""Borderline oversampling of rare classes."""

from pyspark.sql import functions as F

from sward.functions.hashing import order_key, uniform
from sward.operators.metrics import class_counts
from sward.operators.neighbours import nearest_neighbours
from sward.operators.ordering import hash_position
from sward.session import cut_lineage

SHARE_OF_MAJORITY = 0.1


def oversampling_targets(counts, labels=None, share=SHARE_OF_MAJORITY):
    """Rows to add per class so that it reaches ``share`` of the largest class.

    ``counts`` maps class to rows; with ``labels`` only these classes grow.
    """
    goal = int(max(counts.values()) * share)
    grow = counts if labels is None else {c: n for c, n in counts.items() if c in set(labels)}
    return {c: goal - n for c, n in sorted(grow.items()) if goal > n}


def neighbour_counts(counts):
    """Neighbours used for interpolation and for the danger rule."""
    k = int(min(counts.values()) / 2)
    if k == 0:
        raise ValueError("the smallest class has one row, so it has no neighbours")
    return k, 2 * k


def _items(features):
    entry = F.struct("feature_id", "value")
    return features.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))


def danger_rows(near, rows, m):
    """Queries of whose ``m`` nearest rows at least half but not all are of other classes."""
    own = rows.select(F.col("row_id").alias("query_id"), F.col("label_id").alias("own"))
    other = rows.select("row_id", "label_id")
    foreign = near.join(own, "query_id").join(other, "row_id").groupBy("query_id", "own").agg(
        F.count(F.when(F.col("own") != F.col("label_id"), 1)).alias("foreign")
    )
    return foreign.where((F.col("foreign") >= m / 2) & (F.col("foreign") < m)).select(
        F.col("query_id").alias("row_id"), F.col("own").alias("label_id")
    )


def borderline_smote(rows, features, size, labels=None, seed=123):
    """Synthetic rows for rare classes: ``(rows, features)`` to append to the training set.

    A synthetic row lies between a danger row and one of its nearest rows of the same class.
    New rows have negative ids.  ``rows`` holds ``row_id`` and ``label_id``.
    """
    rows = rows.select("row_id", "label_id")
    counts = {r["label_id"]: r["count"] for r in class_counts(rows).collect()}
    need = oversampling_targets(counts, labels)
    k, m = neighbour_counts(counts)
    vectors = cut_lineage(rows.join(_items(features), "row_id", "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<feature_id:int,value:double>>"))
    ))
    minority = vectors.where(F.col("label_id").isin(list(need)))
    whole = vectors.withColumn("grp", F.lit(0))
    near = nearest_neighbours(minority.withColumn("grp", F.lit(0)), whole, m, size, seed=seed)
    danger = cut_lineage(danger_rows(near, rows, m))

    by_class = minority.withColumn("grp", F.col("label_id"))
    same = nearest_neighbours(
        by_class.join(danger.select("row_id"), "row_id", "left_semi"), by_class, k, size, seed=seed
    )

    # Each class shares its new rows evenly among its danger rows, in seeded order.
    sizes = {r["label_id"]: r["count"] for r in class_counts(danger).collect()}
    quota, before = [], 0
    for label, n in need.items():
        if label in sizes:
            quota.append((label, n, sizes[label], before))
            before += n
    spark = rows.sparkSession
    label_type = rows.schema["label_id"].dataType.simpleString()
    quota = spark.createDataFrame(quota, f"label_id {label_type}, need long, danger long, before long")
    placed = hash_position(danger, ["row_id"], seed, by=["label_id"]).join(quota, "label_id")
    copies = F.floor((F.col("need") - F.col("position") + F.col("danger") - 1) / F.col("danger"))
    drawn = placed.where(F.col("position") < F.col("need")).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1))
    )
    number = F.col("before") + F.col("copy") * F.col("danger") + F.col("position")
    drawn = drawn.withColumn("new_id", -(number + 1))

    # Neighbour and step of each copy depend on its key only.
    have = same.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    drawn = drawn.join(have, drawn["row_id"] == have["query_id"]).drop("query_id")
    keys = (F.col("row_id"), F.col("copy"))
    digits = F.conv(F.left(order_key(f"{seed}.n", *keys), F.lit(8)), 16, 10).cast("long")
    drawn = drawn.withColumns({
        "pos": (F.pmod(digits, F.col("have")) + 1).cast("int"),
        "step": uniform(f"{seed}.t", *keys),
    })
    pick = same.select(
        F.col("query_id").alias("row_id"), "pos", F.col("row_id").alias("other_id")
    )
    drawn = cut_lineage(drawn.join(pick, ["row_id", "pos"]).select(
        "new_id", "label_id", "row_id", "other_id", "step"
    ))

    def part(id_col, weight):
        side = drawn.select("new_id", F.col(id_col).alias("row_id"), weight.alias("w"))
        return side.join(features, "row_id").select(
            F.col("new_id").alias("row_id"), "feature_id", (F.col("value") * F.col("w")).alias("value")
        )

    mixed = part("row_id", 1 - F.col("step")).unionByName(part("other_id", F.col("step")))
    values = mixed.groupBy("row_id", "feature_id").agg(F.sum("value").alias("value"))
    return drawn.select(F.col("new_id").alias("row_id"), "label_id"), values
