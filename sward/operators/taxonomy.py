"""Species names, class codes, crosswalks and threat categories."""

from pyspark.sql import functions as F

from sward.functions import text
from sward.operators.cleaning import sum_cover
from sward.session import cut_lineage

REJECTED = "?"
UNKNOWN_CODE = "~"
VASCULAR = "Tracheophyta"
# Rows a task of ``codes_of_cells`` aims at, and the most copies of a code written at a time.
TASK_ROWS = 20_000_000
REPEATS = 4096

# Spelling fixes of threat categories, categories from low to high priority,
# and the coarse group of each.
CATEGORY_FIXES = {
    "Least concern": "Least Concern",
    "Near threatened": "Near Threatened",
    "Critically EndangeredR": "Critically Endangered",
}
CATEGORIES = [
    "Data Deficient",
    "Least Concern",
    "Near Threatened",
    "Vulnerable",
    "Endangered",
    "Critically Endangered",
]
DEFAULT_CATEGORY = "Data Deficient"
INCOMPLETE = ["Data Deficient"]
STABLE = ["Least Concern", "Near Threatened"]
THREATENED = ["Vulnerable", "Endangered", "Critically Endangered"]


def name_map(backbone, accepted=None):
    """Raw name to accepted name, ``?`` where rejected.

    ``backbone`` holds one row per raw name.  With ``accepted`` (a column ``accepted_name`` of
    training names) names outside it are rejected as well.
    """
    ok = (F.col("phylum") == VASCULAR) & F.col("accepted_name").isNotNull()
    out = backbone.select("raw_name", F.when(ok, F.col("accepted_name")).alias("accepted_name"))
    if accepted is not None:
        known = (
            accepted.where(F.col("accepted_name") != REJECTED)
            .select("accepted_name", F.lit(True).alias("_known"))
            .distinct()
        )
        out = out.join(known, "accepted_name", "left").select(
            "raw_name", F.when(F.col("_known"), F.col("accepted_name")).alias("accepted_name")
        )
    return out.withColumn("accepted_name", F.coalesce("accepted_name", F.lit(REJECTED)))


def observed_name_map(species, backbone, accepted=None):
    """The part of the name map that is persisted: one row per name seen in ``species``."""
    seen = species.select(F.col("species").alias("raw_name")).distinct()
    mapped = seen.join(name_map(backbone, accepted), "raw_name", "left")
    return mapped.withColumn("accepted_name", F.coalesce("accepted_name", F.lit(REJECTED)))


def normalise_names(species, backbone, accepted=None, digits=None):
    """Replace raw names by accepted ones, drop rejected ones, sum cover again.

    A name without a backbone row is rejected, so an inner join with the usable names does.
    """
    usable = name_map(backbone, accepted).where(F.col("accepted_name") != REJECTED)
    joined = species.join(usable, species["species"] == usable["raw_name"]).select(
        "plot_id", F.col("accepted_name").alias("species"), "cover"
    )
    return sum_cover(joined, digits)


def crosswalk_edges(table, old_col="old_codes", new_col="new_code", ord_col="ord"):
    """Explode a ``;``-separated cell of old codes to edges ``(old_code, new_code, ord)``."""
    old = F.explode(F.split(F.col(old_col), ";")).alias("old_code")
    edges = table.select(old, F.col(new_col).alias("new_code"), F.col(ord_col).alias("ord"))
    return edges.withColumn("old_code", F.trim("old_code"))


def split_codes(df, col="codes", key="row_id", sep=", "):
    """One row per code of a separated list: ``(key, pos, code)``."""
    return df.select(key, F.posexplode(F.split(F.col(col), sep)).alias("pos", "code")).withColumn(
        "code", F.trim("code")
    )


def crosswalk_codes(coded, edges):
    """Translate exploded codes; an old code gives all its new codes, an unknown one ``~``."""
    hit = coded.join(edges, coded["code"] == edges["old_code"], "left")
    return hit.select(
        *[c for c in coded.columns if c != "code"],
        F.coalesce("ord", F.lit(0)).alias("ord"),
        F.coalesce("new_code", F.lit(UNKNOWN_CODE)).alias("code"),
    )


def descendants(codes, level=3):
    """Codes at the target level keyed by each shorter prefix: ``(ancestor, code)``.

    Codes of the long branch at the target level are reached from its own prefixes, all codes
    of plain target length from any shorter prefix.
    """
    code = F.col("code")
    branch = len(text.LONG_BRANCH)
    plain = F.when(F.length(code) == level, F.sequence(F.lit(1), F.lit(level - 1)))
    long_length = level + text.LONG_BRANCH_EXTRA
    branched = F.when(
        code.startswith(text.LONG_BRANCH) & (F.length(code) == long_length),
        F.sequence(F.lit(branch), F.lit(long_length - 1)),
    )
    cut = codes.select("code", F.explode(F.coalesce(plain, branched)).alias("_len"))
    return cut.select(F.expr("left(code, _len)").alias("ancestor"), F.col("code"))


def expansion_table(codes, level=3):
    """What each known code becomes at the target level: ``(code, new_code)``.

    A code already there stays, a shorter one gives its descendants, a deeper one nothing.
    """
    codes = codes.select("code").distinct()
    stay = codes.where(text.is_level(F.col("code"), level)).select(
        "code", F.col("code").alias("new_code")
    )
    wrong = codes.where(~text.is_level(F.col("code"), level))
    down = wrong.join(
        descendants(codes, level).withColumnRenamed("code", "new_code"),
        wrong["code"] == F.col("ancestor"),
    ).select(wrong["code"], "new_code")
    gone = wrong.select("code", F.lit(None).cast("string").alias("new_code"))
    return stay.unionByName(down).unionByName(gone)


def expand_to_level(coded, codes, level=3):
    """Replace known codes of the wrong depth; unknown codes pass through."""
    table = expansion_table(codes, level).withColumn("_known", F.lit(True))
    hit = coded.join(table, "code", "left")
    new = F.when(F.col("_known"), F.col("new_code")).otherwise(F.col("code"))
    # The null row of every wrong-depth code only marks it as known.
    return hit.select(*[c for c in coded.columns if c != "code"], new.alias("code")).where(
        F.col("code").isNotNull()
    )


def counted_codes(cells, translate, col="codes"):
    """Codes of each different code list with their number: ``(col, code, n)``.

    ``translate`` makes rows ``(col, code)`` of code lists.  They depend on the list alone, so they are worked
    out once per list, and written, so that the planner knows their size before it joins the plots.
    """
    codes = translate(cells.select(col).distinct())
    return cut_lineage(codes.groupBy(col, "code").agg(F.count(F.lit(1)).alias("n")))


def codes_of_cells(df, translate, col="codes"):
    """Rows of ``df`` repeated for each code that ``translate`` makes of their code list.

    Only the rows themselves are moved, dealt over as many tasks as their codes need; their copies are made last.
    """
    counted = counted_codes(df, translate, col)
    per_list = counted.groupBy(col).agg(F.sum("n").alias("_n"))
    total = df.groupBy(col).agg(F.count(F.lit(1)).alias("_rows")).join(per_list, col)
    total = total.agg(F.sum(F.col("_n").cast("double") * F.col("_rows"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(total / TASK_ROWS) + 1)
    # A code with very many copies stands in several rows.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long")))
    pieces = counted.select(col, "code", "n", first.alias("_first")).select(
        col, F.col("code").alias("_code"), F.least(F.lit(REPEATS), F.col("n") - F.col("_first")).cast("int").alias("_copies")
    )
    hit = df.repartition(tasks).join(pieces, col)
    copies = F.explode(F.array_repeat("_code", F.col("_copies"))).alias("code")
    return hit.select(*[c for c in df.columns if c != col], copies)


def label_sets_of_cells(df, translate, known, key="row_id", col="codes"):
    """``label_sets`` of rows with code lists, each of which ``translate`` makes codes of.

    The set of a key depends on its lists alone, so it is worked out once per combination of lists.
    """
    lists = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("m"))
    bags = lists.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(col, "m"))).alias("bag"))
    bags = cut_lineage(bags)
    counted = counted_codes(df, translate, col)
    kinds = bags.select("bag").distinct().select("bag", F.inline("bag"))
    coded = kinds.join(counted, col).withColumn("n", F.col("n") * F.col("m"))
    return bags.join(cut_lineage(label_sets(coded, known, "bag", "n")), "bag").drop("bag")


def label_sets(coded, known, key="row_id", count=None):
    """Per row: share of noise codes in percent and the clean, sorted, distinct code list.

    Noise is ``~`` or a code outside ``known``; it is counted before removing duplicates.  A row stands for as many
    codes as its column ``count`` says, if named.
    """
    marked = coded.join(
        known.select("code", F.lit(True).alias("_known")).distinct(), "code", "left"
    )
    good = F.coalesce("_known", F.lit(False)) & (F.col("code") != UNKNOWN_CODE)
    n = F.lit(1) if count is None else F.col(count)
    return marked.groupBy(key).agg(
        (F.sum(F.when(good, 0).otherwise(n)) / F.sum(n) * 100).alias("noise_pct"),
        F.array_sort(F.collect_set(F.when(good, F.col("code")))).alias("codes"),
    )


def keep_clean_labels(sets, max_noise=50, max_labels=5):
    """Rows with little noise and few labels; an empty list counts as one entry of length 0."""
    return sets.where((F.col("noise_pct") <= max_noise) & (F.size("codes") <= max_labels))


def endangered_labels(crosswalk, red_list, labels):
    """Codes (with id) whose threat category contains ``Endangered``.

    ``crosswalk (code, threat_code, ord)`` and ``red_list (threat_code, category, ord)`` may
    repeat a key; the row latest in ``ord`` wins.
    """
    edges = crosswalk.groupBy("code").agg(F.max_by("threat_code", "ord").alias("threat_code"))
    status = red_list.groupBy("threat_code").agg(F.max_by("category", "ord").alias("category"))
    danger = status.where(F.col("category").contains("Endangered")).select("threat_code")
    return (
        edges.where(F.col("threat_code").isNotNull())
        .join(danger, "threat_code", "left_semi")
        .join(labels, "code")
        .select("code", "id")
    )


def canonical_category(c, fixes=None):
    """Apply the spelling fixes to a category column."""
    out = c
    for wrong, right in (fixes or CATEGORY_FIXES).items():
        out = F.when(c == wrong, right).otherwise(out)
    return out


def category_priority(c):
    """Position of a category in the priority order; null for other strings."""
    return F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), c).cast("int") - 1


def highest_category(threats):
    """One category per code: the canonical one of highest priority, else null."""
    df = threats.dropna().select("code", canonical_category(F.col("category")).alias("category"))
    rank = category_priority(F.col("category"))
    rank = F.when(rank >= 0, rank)
    return df.groupBy("code").agg(
        F.max_by(F.when(rank.isNotNull(), F.col("category")), rank).alias("category")
    )


def threat_group(c):
    """Coarse group of a category."""
    return (
        F.when(c.isin(INCOMPLETE), "Incomplete Category")
        .when(c.isin(STABLE), "Stable Category")
        .when(c.isin(THREATENED), "Threatened Category")
        .otherwise("Unknown Category")
    )


def with_category(plots, categories, col="label"):
    """Attach category and group to plots; codes not listed count as data deficient."""
    right = categories.select(F.col("code").alias(col), "category", F.lit(True).alias("_listed"))
    df = plots.join(right, col, "left")
    category = F.when(F.col("_listed"), F.col("category")).otherwise(DEFAULT_CATEGORY)
    df = df.withColumn("category", category).drop("_listed")
    return df.withColumn("threat_group", threat_group(F.col("category")))


def single_child(lookup, parent, child):
    """Lookup rows whose parent has exactly one distinct child."""
    one = lookup.groupBy(parent).agg(F.countDistinct(child).alias("_n")).where(F.col("_n") == 1)
    return lookup.join(one.select(parent), parent, "left_semi")


def coalesce_join(df, lookup, col, parent, child):
    """Replace ``col`` by the child where it names a parent of the lookup."""
    right = lookup.select(F.col(parent).alias("_parent"), F.col(child).alias("_child"))
    out = df.join(right, df[col] == F.col("_parent"), "left")
    return out.withColumn(col, F.coalesce("_child", col)).drop("_parent", "_child")


def unique_lookup(lookup, key, value):
    """A lookup as ``(key, value)``; a repeated key raises, as its rows would be counted twice."""
    counted = lookup.groupBy(key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n"))
    fail = F.raise_error(F.concat(F.lit("lookup key occurs more than once: "), F.col(key)))
    checked = F.when(F.col("_n") == 1, F.col(value)).otherwise(fail)
    return counted.select(key, checked.alias(value))


def map_column(df, lookup, col, old, new):
    """Map a column through a lookup with unique keys, dropping unmapped rows."""
    right = unique_lookup(lookup, old, new).select(
        F.col(old).alias("_old"), F.col(new).alias("_new")
    )
    return (
        df.join(right, df[col] == F.col("_old")).withColumn(col, F.col("_new")).drop("_old", "_new")
    )
