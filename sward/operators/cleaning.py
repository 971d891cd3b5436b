"""Header and species cleaning."""

from pyspark.sql import functions as F

from sward.functions import geo, text

PRESENCE_ONLY = "Presence/Absence"


def codes_at_level(codes, level, col="code"):
    """Class codes at one hierarchy level."""
    return codes.where(text.is_level(F.col(col), level))


def clean_header(header, min_year=0):
    """Fill unknown scale and date, drop incomplete and presence-only plots, filter by year."""
    df = header.fillna("0", subset=["cover_scale", "recorded"]).dropna()
    df = df.where(F.col("cover_scale") != PRESENCE_ONLY)
    df = df.withColumn("year", text.year_of(F.col("recorded")))
    return filter_min_year(df, min_year)


def filter_min_year(df, min_year, col="year"):
    return df.where(F.col(col) >= min_year)


def explode_labels(df, col="label", sep=",", trim=False):
    """One row per plot and label.  Labels are not trimmed unless asked for."""
    label = F.explode(F.split(F.col(col), sep))
    out = df.withColumn(col, label)
    return out.withColumn(col, F.trim(F.col(col))) if trim else out


def min_support(df, col, n):
    """Rows whose value of ``col`` occurs at least ``n`` times, counted once over ``df``."""
    keep = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return df.join(keep.select(col), col, "left_semi")


def round_coordinates(df, digits=4):
    return df.withColumns(
        {c: geo.round_even(F.col(c).cast("double"), digits) for c in ("lon", "lat")}
    )


def training_header(header, codes, min_year=0, occurrences=10, trim=False):
    """Full header cleaning: rows ``(plot_id, label, lon, lat)`` per plot and label."""
    df = explode_labels(clean_header(header, min_year), trim=trim)
    df = df.join(codes.select(F.col("code").alias("label")), "label", "left_semi")
    df = min_support(df, "label", occurrences)
    df = df.withColumn("plot_id", F.col("plot_id").cast("long"))
    return round_coordinates(df).select("plot_id", "label", "lon", "lat")


def prediction_header(header):
    """Prediction header: complete rows with cast and rounded coordinates."""
    df = header.dropna().withColumn("plot_id", F.col("plot_id").cast("long"))
    return round_coordinates(df).select("plot_id", "lon", "lat")


def clean_species(species):
    """Complete observations with proper types."""
    return species.dropna().select(
        F.col("plot_id").cast("long").alias("plot_id"),
        "species",
        F.col("cover").cast("double").alias("cover"),
    )


def of_plots(df, plots, key="plot_id"):
    """Rows whose plot occurs in ``plots``."""
    return df.join(plots.select(key), key, "left_semi")


def not_of_plots(df, plots, key="plot_id"):
    """Rows whose plot does not occur in ``plots``."""
    return df.join(plots.select(key), key, "left_anti")


def sum_cover(species, digits=None):
    """Total cover per plot and species.

    Sums of doubles depend on the order of addition in the last bit; ``digits`` rounds it
    away where equal covers must compare equal, as before ranking.
    """
    total = F.sum("cover")
    if digits is not None:
        total = F.round(total, digits)
    return species.groupBy("plot_id", "species").agg(total.alias("cover"))


def _positive_sums(species, digits):
    """Sums above zero, rounded only then: a small positive cover stays."""
    df = filter_positive(sum_cover(species))
    return df if digits is None else df.withColumn("cover", F.round("cover", digits))


def filter_positive(df, col="cover"):
    return df.where(F.col(col) > 0)


def training_species(species, header, occurrences=10, digits=None):
    """Full species cleaning for training: known plots, summed, positive, supported."""
    df = _positive_sums(of_plots(clean_species(species), header), digits)
    return min_support(df, "species", occurrences)


def prediction_species(species, header, digits=None):
    """Species cleaning for prediction: no support filter."""
    return _positive_sums(of_plots(clean_species(species), header), digits)


def to_percent(col, scale=100):
    """Share to percent."""
    return F.col(col) * scale


def truncate_int(col):
    """Integer part of a number, towards zero."""
    return F.col(col).cast("int")


def keep_regions(plots, species, allow="all", col="country"):
    """Plots of allowed regions and the species of those plots.

    ``allow`` is ``all``, a list, or a comma-separated string whose names are trimmed.
    """
    if isinstance(allow, str) and allow != "all":
        allow = [name.strip() for name in allow.split(",")]
    if allow == "all" or list(allow) == ["all"]:
        return plots, species
    plots = plots.where(F.col(col).isin(list(allow)))
    return plots, of_plots(species, plots)


def cover_from_scale(occurrences, scale, on="scale_code"):
    """Attach the midpoint of each abundance-scale code as percent, drop incomplete rows."""
    df = occurrences.join(scale.select(on, "midpoint"), on, "left")
    return df.withColumn("cover", to_percent("midpoint")).drop(on, "midpoint").dropna()


def retention_filter(after, before, share=0.75, key="plot_id"):
    """Rows of ``after`` whose plot kept at least ``share`` of its rows in ``before``."""
    kept = after.groupBy(key).agg(F.count(F.lit(1)).alias("_kept"))
    had = before.groupBy(key).agg(F.count(F.lit(1)).alias("_had"))
    good = kept.join(had, key).where(F.col("_kept") >= F.col("_had") * share)
    return of_plots(after, good, key)
