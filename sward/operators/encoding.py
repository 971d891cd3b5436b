"""Dictionaries between values and dense ids, and one-hot features."""

from pyspark.sql import functions as F

from sward.operators.ordering import sorted_ids


def fit_encoder(df, col):
    """Dictionary ``(value, id)`` of the sorted distinct values of a column."""
    return sorted_ids(df, col)


def encode(df, encoder, col, out=None, unseen="raise", size=None):
    """Replace values by ids.  ``unseen`` is ``raise``, ``drop`` or ``null``.

    ``size`` is the number of dictionary entries where known.
    """
    out = out or col
    right = encoder.select(F.col("value").alias("_value"), F.col("id").alias("_id"))
    if unseen == "drop":
        hit = df.join(right, df[col] == F.col("_value"))
        new = F.col("_id")
    else:
        hit = df.join(right, df[col] == F.col("_value"), "left")
        new = F.col("_id")
        if unseen == "raise":
            fail = F.raise_error(F.concat(F.lit("value not in encoder: "), F.col(col)))
            new = F.coalesce(new, F.when(F.col(col).isNotNull(), fail.cast("int")))
    return hit.withColumn(out, new).drop("_value", "_id")


def decode(df, encoder, col, out=None):
    """Replace ids by values; an id outside the dictionary raises."""
    out = out or col
    right = encoder.select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    hit = df.join(right, df[col] == F.col("_id"), "left")
    text = F.concat(F.lit("id not in encoder: "), F.col(col).cast("string"))
    fail = F.raise_error(text).cast("string")
    new = F.coalesce("_value", F.when(F.col(col).isNotNull(), fail))
    return hit.withColumn(out, new).drop("_value", "_id")


def one_hot(df, encoder, col, offset=0, key="row_id", size=None):
    """Indicator features of a categorical column; an unseen value gives no feature."""
    hit = encode(df.select(key, col), encoder, col, "_hot", unseen="drop", size=size)
    return hit.select(
        key,
        (F.col("_hot") + offset).cast("int").alias("feature_id"),
        F.lit(1.0).alias("value"),
    )
