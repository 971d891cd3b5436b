"""Long-form features ``(row_id, feature_id, value)``: assembly and transforms.

Species features come first, ids ``0 .. n_species - 1``; transforms that apply to species only
test the id against ``n_species``.  A row holds each feature at most once, so all per-row
windows and collected lists are bounded by the number of features.
"""

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.functions import hashing
from sward.operators.ordering import flag_sample
from sward.session import scratch_path

# Feature groups in layout order.
GROUPS = ["species", "location", "altitude", "country", "ecoregion", "dune", "coast"]


@dataclass(frozen=True)
class Layout:
    """Sizes of the feature groups, in layout order."""

    sizes: tuple

    @classmethod
    def of(cls, **sizes):
        unknown = set(sizes) - set(GROUPS)
        if unknown:
            raise ValueError(f"unknown feature groups: {sorted(unknown)}")
        return cls(tuple((g, sizes[g]) for g in GROUPS if g in sizes))

    @property
    def size(self):
        return sum(n for _, n in self.sizes)

    def start(self, group):
        at = 0
        for name, n in self.sizes:
            if name == group:
                return at
            at += n
        raise KeyError(group)

    def count(self, group):
        return dict(self.sizes).get(group, 0)

    def keep(self, groups):
        """Layout with only the requested groups; the request order does not matter."""
        groups = parse_groups(groups)
        if "all" in groups:
            return self
        unknown = set(groups) - set(GROUPS)
        if unknown:
            raise ValueError(f"unknown feature groups: {sorted(unknown)}")
        return Layout(tuple((g, n) for g, n in self.sizes if g in groups))

    def group_of(self, feature_id):
        """Name of the group of a feature id column."""
        out = None
        for name, n in self.sizes:
            first = self.start(name)
            hit = (feature_id >= first) & (feature_id < first + n)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out


def parse_groups(groups):
    """Feature groups as a list; a comma-separated string may contain blanks."""
    if isinstance(groups, str):
        return groups.replace(" ", "").split(",")
    return list(groups)


def is_species(n_species):
    return F.col("feature_id") < n_species


def species_features(plots, species):
    """Species features of every plot row; a repeated plot gets its full list each time."""
    obs = species.select(
        "plot_id",
        F.col("species_id").alias("feature_id"),
        F.col("cover").cast("double").alias("value"),
    )
    return plots.select("row_id", "plot_id").join(obs, "plot_id").drop("plot_id")


def assemble(plots, species):
    """Plot rows with their observations as one sorted list; empty for a plot without any."""
    lists = species.groupBy("plot_id").agg(
        F.array_sort(F.collect_list(F.struct("species_id", "cover"))).alias("items")
    )
    out = plots.join(lists, "plot_id", "left")
    empty = F.array().cast("array<struct<species_id:int,cover:double>>")
    return out.withColumn("items", F.coalesce("items", empty))


def numeric_features(df, columns, key="row_id"):
    """Numeric columns as features; ``columns`` maps column name to feature id."""
    pairs = ", ".join(f"{fid}, cast({name} as double)" for name, fid in columns.items())
    return df.selectExpr(key, f"stack({len(columns)}, {pairs}) as (feature_id, value)").where(
        F.col("value").isNotNull()
    )


def _by_row():
    """Window over the features of a row.

    It partitions by the row alone, as gathering vectors does, so that one shuffle by row serves
    ranking, normalising and the vectors.
    """
    return W.partitionBy("row_id")


def inverse_rank(df, n_species):
    """Replace species values by 1 / dense rank of the value within the row, largest first."""
    sp = is_species(n_species)
    # Species sort before everything else, so the other features do not enter their ranks.
    rank = F.dense_rank().over(_by_row().orderBy(F.desc(sp), F.desc("value")))
    return df.withColumn("value", F.when(sp, 1 / rank).otherwise(F.col("value")))


def l1_normalise(df, n_species):
    """Divide species values by the sum of their absolute values within the row."""
    sp = is_species(n_species)
    norm = F.sum(F.when(sp, F.abs("value"))).over(_by_row())
    return df.withColumn(
        "value", F.when(sp & (norm > 0), F.col("value") / norm).otherwise(F.col("value"))
    )


def dominance_rank(df, n_species=None):
    """Position of each item within its row by value, largest first, ties by feature id."""
    if n_species is not None:
        df = df.where(is_species(n_species))
    order = _by_row().orderBy(F.desc("value"), "feature_id")
    return df.withColumn("rank", F.row_number().over(order))


def binarise(df, n_species, threshold=1.0):
    """Species values above the threshold become 1, the others disappear."""
    sp = is_species(n_species)
    return df.where(~sp | (F.col("value") > threshold)).withColumn(
        "value", F.when(sp, 1.0).otherwise(F.col("value"))
    )


def log_values(df, n_species):
    """Natural logarithm of the stored species values."""
    return df.withColumn(
        "value", F.when(is_species(n_species), F.ln("value")).otherwise(F.col("value"))
    )


def nonzero_stats(df):
    """Mean and population standard deviation of the stored values of each feature."""
    return df.groupBy("feature_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def add_noise(df, n_species, seed, clip=False):
    """Add or subtract, with equal chance, a normal number with the mean and deviation of the
    feature's stored values; drop entries that become zero.

    ``clip`` also raises negative results to zero, which drops them.
    """
    sp = is_species(n_species)
    stats = nonzero_stats(df.where(sp))
    hit = df.join(stats, "feature_id", "left")
    keys = [F.col("row_id"), F.col("feature_id")]
    noise = F.col("mean") + F.col("std") * hashing.normal(seed, *keys)
    sign = F.when(hashing.uniform(f"{seed}.s", *keys) < 0.5, -1.0).otherwise(1.0)
    value = F.col("value") + sign * noise
    if clip:
        value = F.greatest(value, F.lit(0.0))
    value = F.when(sp, value).otherwise(F.col("value"))
    return hit.withColumn("value", value).where(F.col("value") != 0).drop("mean", "std")


def drop_entries(df, n_species, p, seed):
    """Remove exactly ``int(p * n)`` of the stored species entries, in seeded order."""
    sp = is_species(n_species)
    flagged = flag_sample(df.where(sp), ["row_id", "feature_id"], p, seed, "_drop")
    kept = flagged.where(~F.col("_drop")).drop("_drop")
    return kept.unionByName(df.where(~sp))


def zero_sample(df, keys, fraction, seed, col="cover"):
    """Set ``col`` to zero in exactly ``int(fraction * n)`` rows, in seeded order."""
    flagged = flag_sample(df, keys, fraction, seed, "_zero")
    zero = F.when(F.col("_zero"), 0.0).otherwise(F.col(col))
    return flagged.withColumn(col, zero).drop("_zero")


def fit_scaler(df, n_rows):
    """Population standard deviation of each feature over all rows, absent entries being 0.

    ``n_rows`` is a number or a column (a scalar subquery).  The variance of the stored values
    is merged with that of the zeros, which stays exact for constant features; those get 1.
    """
    n = n_rows if not isinstance(n_rows, (int, float)) else F.lit(float(n_rows))
    stats = df.groupBy("feature_id").agg(
        F.count("value").alias("_c"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")
    )
    between = F.col("_m") * F.col("_m") * F.col("_c") * (n - F.col("_c")) / n
    var = (F.col("_c") * F.col("_v") + between) / n
    return stats.select("feature_id", F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("scale"))


def apply_scaler(df, scaler, n_features=None):
    """Divide each feature by its scale; a feature unseen in fitting is constant there.

    ``n_features`` bounds the size of the scaler where known.
    """
    hit = df.join(scaler, "feature_id", "left")
    scale = F.coalesce("scale", F.lit(1.0))
    return hit.withColumn("value", F.col("value") / scale).drop("scale")


def select_feature_groups(df, layout, groups):
    """Features of the requested groups, renumbered in layout order, and the new layout."""
    new = layout.keep(groups)
    if new == layout:
        return df, layout
    fid = F.col("feature_id")
    moved = None
    for name, n in new.sizes:
        first = layout.start(name)
        hit = (fid >= first) & (fid < first + n)
        to = (fid - first + new.start(name)).cast("int")
        moved = F.when(hit, to) if moved is None else moved.when(hit, to)
    return df.withColumn("feature_id", moved).where(F.col("feature_id").isNotNull()), new


def catalogue(layout, names):
    """Feature catalogue ``(feature_id, grp, name)`` from dictionaries per group.

    ``names`` maps a group to its dictionary ``(value, id)`` or to a list of names.
    """
    spark = next(d for d in names.values() if not isinstance(d, list)).sparkSession
    out = None
    for group, _ in layout.sizes:
        source = names[group]
        if isinstance(source, list):
            source = spark.createDataFrame(
                [(v, i) for i, v in enumerate(source)], "value string, id int"
            )
        label = F.col("value").cast("string")
        if group == "ecoregion":
            label = F.concat(F.lit("Ecoregion "), label)
        part = source.select(
            (F.col("id") + layout.start(group)).cast("int").alias("feature_id"),
            F.lit(group).alias("grp"),
            label.alias("name"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# Stored form of a sparse vector: its type is 0.
SPARSE = T.StructType([
    T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()),
    T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
])


def with_vector(df, ids, values, size, name="features"):
    """Attach an ML sparse vector made of sorted parallel arrays of ids and values.

    The rows are written as plain structs and read back as vectors: no Python touches them, and
    what is fitted or scored several times is worked out once.
    """
    kind = F.lit(0).cast("tinyint").alias("type")
    parts = F.struct(kind, F.lit(size).alias("size"), ids.alias("indices"), values.alias("values"))
    plain = df.withColumn(name, parts.cast(SPARSE))
    fields = [T.StructField(f.name, VectorUDT() if f.name == name else f.dataType) for f in plain.schema]
    path = scratch_path(df.sparkSession, "vectors")
    plain.write.parquet(path)
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def vector_entries(df, name="features"):
    """The stored entries of sparse vectors as a struct ``entries`` of indices and values."""
    path = scratch_path(df.sparkSession, "entries")
    df.write.parquet(path)
    fields = [T.StructField(f.name, SPARSE if f.name == name else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path).withColumnRenamed(name, "entries")


def with_entries(rows, features, key="row_id"):
    """Plot rows with sorted parallel arrays ``_ids`` and ``_values`` of their features, empty where they have none.

    Rows and features in buckets of ``key`` (``writers.write_by_row``) need no exchange.
    """
    entry = F.struct("feature_id", "value")
    lists = features.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    out = rows.join(lists, key, "left")
    ids = F.coalesce(F.col("_e")["feature_id"], F.array().cast("array<int>"))
    values = F.coalesce(F.col("_e")["value"], F.array().cast("array<double>"))
    return out.select(*rows.columns, ids.alias("_ids"), values.alias("_values"))


def to_vector(rows, features, size, key="row_id"):
    """Plot rows with a sparse vector column ``features``; rows without features get zeros."""
    plain = with_entries(rows, features, key)
    return with_vector(plain, F.col("_ids"), F.col("_values"), size).drop("_ids", "_values")


def keep_labels(df, labels, col="label_id"):
    """Rows whose label is listed."""
    return df.join(labels.select(F.col("id").alias(col)), col, "left_semi")


def rarest_labels(train, n=10, col="label_id"):
    """The ``n`` labels with the fewest training rows, ties by label."""
    counts = train.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("count", col).limit(n)


def keep_rarest(train, test, n=10, col="label_id"):
    """Test rows of the rarest training labels."""
    return test.join(rarest_labels(train, n, col).select(col), col, "left_semi")
