"""Spatial blocks and cross-validation folds."""

from pyspark.sql import functions as F

from sward.functions import geo
from sward.operators.ordering import hash_position, spread
from sward.session import cut_lineage


def with_blocks(plots, east_km=10.0, north_km=10.0):
    """Attach the id of the grid block of each plot."""
    block = geo.block_id(F.col("lon"), F.col("lat"), east_km, north_km)
    return plots.withColumn("block_id", block)


def fold_of_blocks(plots, k, seed):
    """Fold per distinct block: seeded order of blocks, cut into ``k`` near-equal runs.

    The distinct blocks are written once, so the plots are read once for all steps on them.
    """
    blocks = cut_lineage(plots.select("block_id").distinct())
    total = blocks.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = hash_position(blocks, ["block_id"], seed)
    return placed.select("block_id", spread(F.col("position"), total, k).alias("fold"))


def assign_folds(plots, k=10, seed=123, east_km=10.0, north_km=10.0):
    """Attach block and fold; all plots of a block share its fold."""
    blocked = with_blocks(plots, east_km, north_km)
    return blocked.join(fold_of_blocks(blocked, k, seed), "block_id", "left")


def split_fold(df, fold):
    """Training and test rows of one fold."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def block_summary(df):
    """Blocks and plots per fold."""
    per_block = df.groupBy("fold", "block_id").agg(F.count(F.lit(1)).alias("plots"))
    return per_block.groupBy("fold").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("plots").alias("plots")
    )


def block_count(df):
    """Number of distinct blocks."""
    return df.agg(F.countDistinct("block_id").alias("blocks"))
