"""Global positions and exact samples without a single-task sort."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sward.functions.hashing import order_key
from sward.session import cut_lineage

# Digits of the hash that name a bucket: 16**3 = 4096 buckets, evenly filled because the
# digest is uniform over unique keys.
BUCKET_DIGITS = 3

# The sampler orders one bucket only, so it can afford 65536 of them.
SAMPLE_DIGITS = 4


def _with_bucket(hashed, digits):
    return hashed.withColumn("_bucket", F.left("_hash", F.lit(digits)))


def _bucket_offsets(hashed, by=()):
    """Size of each bucket and rows before it; few enough rows for one task to order."""
    counts = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *by,
        "_bucket",
        F.col("_n").alias("_size"),
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
    )


def hash_position(df, keys, seed, by=()):
    """Zero-based position of each row in the seeded order of its unique ``keys``.

    With ``by`` positions start anew for each value of these columns.  Rows are ordered inside
    hash buckets and the bucket offsets come from a histogram, so no task sees more than about
    1/4096 of the rows, even if one value of ``by`` holds most of them.
    """
    by = list(by)
    cols = [F.col(k) for k in keys]
    hashed = _with_bucket(df.withColumn("_hash", order_key(seed, *cols)), BUCKET_DIGITS)
    within = W.partitionBy(*by, "_bucket").orderBy("_hash", *cols)
    placed = hashed.withColumn("_in", F.row_number().over(within) - 1)
    out = placed.join(_bucket_offsets(hashed, by).drop("_size"), [*by, "_bucket"])
    return out.withColumn("position", F.col("_before") + F.col("_in")).drop(
        "_hash", "_bucket", "_in", "_before"
    )


def flag_sample(df, keys, fraction, seed, name="sampled"):
    """Flag exactly ``int(fraction * n)`` rows, the first in the seeded order of their keys.

    The hashed rows are written once.  A histogram of hash buckets names the bucket that holds the
    boundary; only that bucket is ordered, to find the last digest of the sample.  Rows are not
    shuffled but for those with that digest: if keys repeat, they are taken in order of all columns.
    """
    cols = [F.col(k) for k in keys]
    hashed = cut_lineage(df.withColumn("_hash", order_key(seed, *cols)))
    offsets = _bucket_offsets(_with_bucket(hashed, SAMPLE_DIGITS))
    total = F.coalesce(F.max(F.col("_before") + F.col("_size")), F.lit(0))
    target = offsets.agg(F.floor(total * F.lit(float(fraction)))).scalar()
    room = (target - F.col("_before")).alias("_room")
    edge = offsets.select("_bucket", "_size", room).where(
        (F.col("_room") > 0) & (F.col("_room") <= F.col("_size"))
    )
    boundary = _with_bucket(hashed.select("_hash"), SAMPLE_DIGITS).join(edge, "_bucket")
    at = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash"))
    last = boundary.withColumn("_at", at).where(F.col("_at") == F.col("_room"))
    found = last.agg(F.max("_hash").alias("cut"), F.max("_room").alias("room")).first()
    if found["cut"] is None:
        return hashed.withColumn(name, F.lit(False)).drop("_hash")
    before = boundary.where(F.col("_hash") < found["cut"]).count()
    sure = hashed.where(F.col("_hash") != found["cut"]).withColumn(name, F.col("_hash") < found["cut"])
    tied = hashed.where(F.col("_hash") == found["cut"])
    order = W.partitionBy("_hash").orderBy(*[c for c, t in df.dtypes if not t.startswith("map")])
    tied = tied.withColumn(name, F.row_number().over(order) <= found["room"] - before)
    return sure.unionByName(tied).drop("_hash")


def sorted_ids(values, col):
    """Dense ids from 0 in sorted order of the distinct values of ``col``."""
    known = values.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    return row_ids(known, ["value"]).withColumn("id", F.col("id").cast("int"))


def row_ids(df, cols, name="id"):
    """Dense ids from 0 of the rows in order of ``cols``, which tell all rows apart.

    Rows are range-partitioned and written once; ids are partition offset plus position in the
    written partition.  Only the per-partition counts are ordered in one task.
    """
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    stored = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    # The generated number holds the partition in its upper bits, the position in the lower 33.
    stored = stored.select(
        *df.columns,
        F.shiftright("_at", 33).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"),
    )
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before")
    )
    return stored.join(offsets, "_part").select(
        *df.columns, (F.col("_before") + F.col("_in")).alias(name)
    )


def spread(position, total, parts):
    """Part of a position when ``total`` rows are cut into ``parts`` contiguous near-equal runs.

    The first ``total mod parts`` runs get one row more.
    """
    small = F.floor(total / parts)
    longer = total % parts
    cut = longer * (small + 1)
    late = longer + F.floor((position - cut) / F.greatest(small, F.lit(1)))
    return F.when(position < cut, F.floor(position / (small + 1))).otherwise(late).cast("int")
