"""Summary tables behind the reports."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sward.functions import geo
from sward.functions.text import top_group, year_of
from sward.operators.clusters import cluster_points  # noqa: F401
from sward.session import cut_lineage


def value_counts(df, col):
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def with_year(plots, original):
    """Recording year from the original header on processed plots; unknown is 0."""
    year = year_of(F.coalesce("recorded", F.lit("0"))).alias("year")
    return plots.join(original.select("plot_id", year), "plot_id", "left")


def year_counts(plots):
    """Rows per known year."""
    return value_counts(plots.where(F.col("year") != 0), "year")


def group_counts(df, label="label"):
    """Rows per top group and class, with the group total, largest group and class first."""
    out = df.groupBy(top_group(F.col(label)).alias("top_group"), label).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = F.sum("count").over(W.partitionBy("top_group"))
    return out.withColumn("group_count", total).orderBy(
        F.desc("group_count"), F.desc("count"), label
    )


# Richness buckets and, within the open one, its parts.
RICHNESS = [("<=10", 0, 10), ("11-30", 11, 30), (">=31", 31, None)]
RICHNESS_HIGH = [("31-40", 31, 40), ("41-50", 41, 50), ("51-60", 51, 60), (">=61", 61, None)]


def _bucket(c, buckets):
    out = None
    for name, low, high in buckets:
        hit = c >= low if high is None else (c >= low) & (c <= high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def richness_histogram(header, species):
    """Share of header rows by number of species in the plot; a repeated plot counts again."""
    items = species.groupBy("plot_id").agg(F.count(F.lit(1)).alias("items"))
    counted = header.join(items, "plot_id").groupBy("items").agg(F.count(F.lit(1)).alias("rows"))
    places = [
        F.struct(F.lit(part).alias("part"), _bucket(F.col("items"), buckets).alias("bucket"))
        for part, buckets in (("all", RICHNESS), (">=31", RICHNESS_HIGH))
    ]
    placed = counted.select("rows", F.inline(F.array(*places))).where(F.col("bucket").isNotNull())
    sums = placed.groupBy("part", "bucket").agg(F.sum("rows").alias("rows"))
    # At most one row per bucket is left.
    total = F.sum("rows").over(W.partitionBy("part"))
    return sums.withColumn("share", F.round(F.col("rows") / total, 2))


def pct_of_total(df, col="count"):
    """Add the percentage of the column total."""
    total = df.agg(F.sum(col)).scalar()
    return df.withColumn("pct", F.col(col) * 100.0 / total)


def threat_summary(plots):
    """Rows and percentage per threat group and category."""
    known = plots.where(F.col("category").isNotNull())
    counts = known.groupBy("threat_group", "category").agg(F.count(F.lit(1)).alias("count"))
    return pct_of_total(counts)


def cluster_summary(df):
    """Mean position and size of each cluster."""
    return df.groupBy("cluster").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("size")
    )


FIVE = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def quantiles(df, by, col, shares):
    """Exact quantiles per group, linear between neighbours: ``shares`` names them.

    Different values with their counts are dealt over tasks by range of group and value; counts of
    the ranges before tell each value its ranks.  No task or buffer holds a group: the most that comes
    together is one count per group and range, and two values per quantile.  Nulls do not count; a
    group without values has nulls.
    """
    value = F.col(col).cast("double").alias("_v")
    counted = df.groupBy(*by, value).agg(F.count(F.col(col)).alias("_n"))
    placed = cut_lineage(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.partitionBy(*by)).alias("_total"),
    )
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("_n").over(inside)).join(parts, same)
    end = F.col("_before") + F.col("_upto")
    start = end - F.col("_n")

    def at(rank):
        return F.max(F.when((rank >= start) & (rank < end), F.col("_v")))

    wanted = {name: F.lit(share) * (F.col("_total") - 1) for name, share in shares.items()}
    found = ranked.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(p)).alias(f"_lower_{n}") for n, p in wanted.items()],
        *[at(F.ceil(p)).alias(f"_upper_{n}") for n, p in wanted.items()],
    )

    def between(name, p):
        lower, upper = F.col(f"_lower_{name}"), F.col(f"_upper_{name}")
        mixed = (F.ceil(p) - p) * lower + (p - F.floor(p)) * upper
        return F.when(lower == upper, lower).otherwise(mixed).alias(name)

    return found.select(*by, *[between(n, p) for n, p in wanted.items()])


def five_number(df, by, col="score", exact=True):
    """Minimum, quartiles and maximum of the scores per group; ``exact=False`` estimates the quartiles."""
    if exact:
        return quantiles(df, by, col, FIVE)
    out = df.groupBy(*by).agg(F.percentile_approx(col, F.array(*map(F.lit, FIVE.values()))).alias("_q"))
    return out.select(*by, *[F.get("_q", i).alias(n) for i, n in enumerate(FIVE)])


def extent(df, margin=0.05):
    """Projected bounding box of the plots, widened by a share of its size."""
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    box = df.agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    )
    wide = (F.col("x1") - F.col("x0")) * margin
    high = (F.col("y1") - F.col("y0")) * margin
    return box.select(
        (F.col("x0") - wide).alias("x0"), (F.col("x1") + wide).alias("x1"),
        (F.col("y0") - high).alias("y0"), (F.col("y1") + high).alias("y1"),
    )


def rescale(df, col, low=1.0, high=2.0):
    """Rescale a column linearly so that its range becomes ``low .. high``."""
    least = df.agg(F.min(col)).scalar()
    most = df.agg(F.max(col)).scalar()
    return df.withColumn(col, (F.col(col) - least) / (most - least) * (high - low) + low)


def band(df, mean="mean", std="std"):
    """Mean plus and minus one standard deviation."""
    return df.withColumns({"low": F.col(mean) - F.col(std), "high": F.col(mean) + F.col(std)})


def keep_first(df, key, order):
    """One row per key: the first in the given order, which must not leave ties.

    A grouped minimum instead of a window, so that a frequent key is reduced map-side.
    """
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_best")
    return df.groupBy(key).agg(best).select("_best.*")


def first_plot(header, key="plot_id"):
    """Id of the first plot."""
    return header.agg(F.min(key).alias(key))


def rows_of_first_plot(header, *tables, key="plot_id"):
    """Rows of the first plot from the header and every other table."""
    first = first_plot(header, key).scalar()
    return [t.where(F.col(key) == first) for t in (header, *tables)]


def bbox_filter(df, center, half_width=0.5, half_height=0.25):
    """Plots in a map window round a coordinate."""
    return df.where(
        geo.in_window(F.col("lon"), F.col("lat"), center, half_width, half_height)
    )
