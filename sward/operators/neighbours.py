"""Exact nearest neighbours of sparse rows, pruned by pivots and worked in bounded blocks.

Rows are ``(row_id, grp, items)`` with ``items`` an array of ``(feature_id, value)``.  Each row
belongs to the cell of its nearest pivot.  From the cells' sizes and radii every query gets an
upper bound on the distance of its k-th neighbour and, by the triangle inequality, the cells
that can hold one.  Small cells that lie close together form a unit, to which a query goes once, and
units are cut into chunks and their queries into blocks of bounded size, so neither many equal rows
nor a crowded cell form a large task, and no pair beyond the k best of a query within a chunk is
ever emitted.  Where nothing can be pruned every row meets every query: what is moved is then rows
times queries by the rows of a block.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sward.functions.hashing import order_key
from sward.session import cut_lineage

# Most rows of a chunk and of a block; wide rows come fewer together, but not fewer than ``SLICE_ROWS``.
CHUNK_ROWS = 16384
BLOCK_ROWS = 16384
BLOCK_CELLS = 4_000_000
# Rows that become dense at a time for the pivots.
SLICE_ROWS = 1024
# Distances that a task holds at a time.
DISTANCES = 4_000_000
# Numbers in the dense pivot matrix that every task holds.
PIVOT_CELLS = 4_000_000


def _slices(batches):
    """Batches cut so that the dense matrix of one piece stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), SLICE_ROWS):
            yield pdf.iloc[at:at + SLICE_ROWS]


def _dense(pdf, size):
    """Dense matrix of the ``ids`` and ``vals`` arrays of a frame."""
    out = np.zeros((len(pdf), size))
    counts = pdf["ids"].map(len).to_numpy()
    if counts.sum():
        at = np.repeat(np.arange(len(pdf)), counts)
        out[at, np.concatenate(pdf["ids"].to_numpy())] = np.concatenate(pdf["vals"].to_numpy())
    return out


FIELDS = "row_id long, grp {grp}, ids array<int>, vals array<double>"


def _flat(df):
    """Item arrays as two plain arrays, which reach the tasks without an object per entry."""
    return df.select(
        F.col("row_id").cast("long").alias("row_id"), "grp",
        F.col("items.feature_id").cast("array<int>").alias("ids"),
        F.col("items.value").alias("vals"),
    )


def _fields(df):
    return FIELDS.format(grp=df.schema["grp"].dataType.simpleString())


def _distances(a, b):
    """Euclidean distances between the rows of two matrices."""
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _pivots(rows, size, count, seed):
    """The first rows in a seeded order; ``count`` bounds what reaches the driver."""
    picked = rows.orderBy(order_key(seed, F.col("row_id"))).limit(count).select("ids", "vals")
    return _dense(picked.toPandas(), size)


def _assign(rows, pivots, size):
    """Rows with the index of the nearest pivot and the distance to it."""

    def work(batches):
        for pdf in _slices(batches):
            far = _distances(_dense(pdf, size), pivots)
            cell = far.argmin(1)
            yield pdf.assign(cell=cell.astype("int32"), radius=far[np.arange(len(pdf)), cell])

    return rows.mapInPandas(work, f"{_fields(rows)}, cell int, radius double")


def _cell_table(assigned):
    """Per group: cells with their radius and size; at most pivots times groups entries."""
    stats = assigned.groupBy("grp", "cell").agg(
        F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")
    )
    out = {}
    for r in stats.collect():
        out.setdefault(r["grp"], []).append((r["cell"], r["radius"], r["n"]))
    return {
        g: (np.array([c for c, _, _ in v]), np.array([r for _, r, _ in v]), np.array([n for *_, n in v]))
        for g, v in out.items()
    }


def _units(cells, pivots, limit):
    """Number of the unit of each cell: cells of a group in order of place, up to ``limit`` rows together."""
    centred = pivots - pivots.mean(0)
    place = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(1)
    out = {}
    for grp, (cell, _, n) in cells.items():
        unit, held, number = np.zeros(len(cell), dtype=np.int32), 0, 0
        for i in np.argsort(place[cell], kind="stable"):
            if held and held + n[i] > limit:
                number, held = number + 1, 0
            unit[i], held = number, held + n[i]
        out[grp] = unit
    return out


def _route(queries, pivots, cells, units, k, size):
    """Queries repeated for each unit with a cell that can hold one of their ``k`` nearest rows."""

    def work(batches):
        for pdf in _slices(batches):
            parts = []
            far = _distances(_dense(pdf, size), pivots)
            for grp, at in pdf.groupby("grp").indices.items():
                if grp not in cells:
                    continue
                cell, radius, n = cells[grp]
                near = far[at][:, cell]
                reach = near + radius[None, :]
                order = np.argsort(reach, axis=1)
                filled = np.cumsum(n[order], axis=1)
                # One more than k, since the query itself may be among the rows.
                stop = np.minimum((filled < k + 1).sum(1), len(cell) - 1)
                bound = np.take_along_axis(reach, order, 1)[np.arange(len(at)), stop]
                slack = 1e-9 * (1.0 + bound)
                open_cells = near - radius[None, :] <= (bound + slack)[:, None]
                for unit in np.unique(units[grp]):
                    hit = open_cells[:, units[grp] == unit].any(1)
                    if hit.any():
                        parts.append(pdf.iloc[at[hit]].assign(unit=np.int32(unit)))
            if parts:
                yield pd.concat(parts)

    return queries.mapInPandas(work, f"{_fields(queries)}, unit int")


def _nearest_of(far, ids, k):
    """Row and column of the ``k`` least distances of each row of a matrix, ties to the lower id."""
    if far.shape[1] > k:
        last = np.partition(far, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(far <= last[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(far.shape))
    order = np.lexsort((ids[j], far[i, j], i))
    i, j = i[order], j[order]
    start = np.searchsorted(i, np.arange(len(far)))
    kept = (np.arange(len(i)) - start[i] < k) & np.isfinite(far[i, j])
    return i[kept], j[kept]


def _parts(count, limit):
    return F.greatest(F.lit(1), F.ceil(count / limit)).cast("int")


def _bin(parts):
    return F.pmod(F.xxhash64("row_id"), parts).cast("int")


def nearest_neighbours(queries, rows, k, size, pivots=None, seed=123):
    """The ``k`` rows nearest to each query within its group, the query itself left out.

    Returns ``(query_id, row_id, dist, pos)`` with ``pos`` from 1; equal distances go to the
    lower row id.  Queries and rows share the id space.
    """
    rows, queries = cut_lineage(_flat(rows)), cut_lineage(_flat(queries))
    if pivots is None:
        pivots = int(min(max(rows.count() ** 0.5, 8), 1024, max(PIVOT_CELLS // size, 8)))
    points = _pivots(rows, size, pivots, seed)
    assigned = cut_lineage(_assign(rows, points, size))
    cells = _cell_table(assigned)
    wide = max(BLOCK_CELLS // size, SLICE_ROWS)
    chunk_rows, block_rows = min(CHUNK_ROWS, wide), min(BLOCK_ROWS, wide)
    units = _units(cells, points, chunk_rows)
    routed = cut_lineage(_route(queries, points, cells, units, k, size))
    # At most pivots times groups entries.
    places = [(g, int(c), int(u)) for g, (cell, *_) in cells.items() for c, u in zip(cell, units[g])]
    grp = rows.schema["grp"].dataType.simpleString()
    places = rows.sparkSession.createDataFrame(places, f"grp {grp}, cell int, unit int")
    assigned = assigned.join(F.broadcast(places), ["grp", "cell"])

    unit = ["grp", "unit"]
    sizes = assigned.groupBy(*unit).agg(_parts(F.count(F.lit(1)), chunk_rows).alias("chunks"))
    loads = routed.groupBy(*unit).agg(_parts(F.count(F.lit(1)), block_rows).alias("blocks"))
    plan = sizes.join(loads, unit)

    def spread(df, own, other, own_name, other_name):
        steps = F.sequence(F.lit(0), F.col(other) - 1)
        return (
            df.join(plan, unit)
            .withColumn(own_name, _bin(F.col(own)))
            .withColumn(other_name, F.explode(steps))
            .select(*unit, "chunk", "block", "row_id", "ids", "vals")
        )

    left = spread(routed, "blocks", "chunks", "block", "chunk")
    right = spread(assigned, "chunks", "blocks", "chunk", "block")

    def best(q, r):
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "row_id": [], "dist": []})
        qid, rid = q["row_id"].to_numpy(), r["row_id"].to_numpy()
        against, step, parts = _dense(r, size), max(1, DISTANCES // len(r)), []
        for at in range(0, len(q), step):
            far = _distances(_dense(q.iloc[at:at + step], size), against)
            own = qid[at:at + step]
            far[own[:, None] == rid[None, :]] = np.inf
            # Round before comparing: equal rows may differ in the last bits of the product form.
            far = np.round(far, 9)
            i, j = _nearest_of(far, rid, k)
            parts.append(pd.DataFrame({"query_id": own[i], "row_id": rid[j], "dist": far[i, j]}))
        return pd.concat(parts)

    key = [*unit, "chunk", "block"]
    found = (
        left.groupBy(*key)
        .cogroup(right.groupBy(*key))
        .applyInPandas(best, "query_id long, row_id long, dist double")
    )
    order = W.partitionBy("query_id").orderBy("dist", "row_id")
    ranked = found.withColumn("pos", F.row_number().over(order))
    return ranked.where(F.col("pos") <= k)
