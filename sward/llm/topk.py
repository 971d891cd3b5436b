"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks and queries into groups; each pair of a block and a group is one bounded
task.  A block has one sorted list per dimension.  A query reads its lists from their favourable ends,
scores each vector it meets there, and stops when the best score that an unread vector could reach is
below its k-th score.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.session import cut_lineage

#: Vectors of a block and queries of a group, about.
BLOCK, GROUP = 4096, 256
#: Depth of the first reading, and its growth from one reading to the next.
FIRST, GROWTH = 16, 4
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


class Lists:
    """Sorted lists of a block of integer vectors, one for each dimension."""

    def __init__(self, vectors, ids, rows):
        # Sums of products of doubles are exact below 2^53; beyond it integers are slower and right.
        small = len(vectors) == 0 or float(np.abs(vectors).max()) ** 2 * max(1, vectors.shape[1]) < 2**53
        self.kind = np.float64 if small else np.int64
        self.vectors, self.ids, self.rows = vectors.astype(self.kind), ids, rows
        self.rising = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.rising, axis=0)

    def best(self, query, query_row, k):
        """Indices and scores of the ``k`` best, ties to the smaller id and then row; reads made."""
        kind, vectors, values, size = self.kind, self.vectors, self.values, len(self.vectors)
        if kind is np.float64 and size and float(np.abs(query).max()) * float(np.abs(vectors).max()) * max(1, vectors.shape[1]) >= 2**53:
            # Small vectors, but a query too large for doubles.
            kind, vectors, values = np.int64, vectors.astype(np.int64), values.astype(np.int64)
        query = query.astype(kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(size, dtype=bool)
        top, scores, depth, last = np.zeros(0, np.int64), np.zeros(0, kind), 0, FIRST
        while depth < size:
            last = min(last, size)
            met = np.zeros(size, dtype=bool)
            met[self.rising[size - last : size - depth, up].ravel()] = True
            met[self.rising[depth:last, down].ravel()] = True
            if last == size:
                met[:] = True  # also what no list shows: all of it for a query of zeros
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[self.rows[new] != query_row]
            top = np.concatenate((top, new))
            scores = np.concatenate((scores, vectors[new] @ query))
            if len(top) > k:
                near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                ranked = near[np.lexsort((self.rows[top[near]], self.ids[top[near]], -scores[near]))][:k]
                top, scores = top[ranked], scores[ranked]
            bound = values[size - last, up] @ query[up] + values[last - 1, down] @ query[down]
            # A vector not yet met may equal the bound and have a smaller id: only less ends the search.
            if len(top) >= k and scores.min() > bound:
                break
            depth, last = last, last * GROWTH
        return top, scores


def _matrix(table, width):
    lists = table.column("vector").combine_chunks()
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), within] = np.asarray(lists.flatten())
    return out


def _search(k):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            longest = [max(t.column("vector").combine_chunks().value_lengths().to_pylist()) for t in (vectors, queries)]
            lists = Lists(_matrix(vectors, max(longest)), np.asarray(vectors["vec_id"]), np.asarray(vectors["row"]))
            for query, row, own in zip(_matrix(queries, max(longest)), queries["row"].to_pylist(), queries["vec_id"].to_pylist()):
                top, scores = lists.best(query, row, k)
                found += [(row, own, int(lists.rows[t]), int(lists.ids[t]), int(s)) for t, s in zip(top, scores)]
        names = [f.split()[0] for f in FOUND.split(", ")]
        columns = list(zip(*found)) or [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return run


def quantised(column="embedding"):
    """floor(256 x) of each component; null for a vector that is null or has a null or non-finite one."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(column, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def top_inner_products(vectors, is_query, k=5, id_col="vec_id", vector_col="embedding"):
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each row where ``is_query`` holds.

    * Components are floor(256 x); rows whose vector is null or has null or non-finite components, and
      rows with a null id, take no part.  Missing components of a shorter vector count as 0.
    * A query's own row is no candidate; another row with its id is.  Ties go to the smaller id.
    * Fewer than ``k`` candidates give fewer rows, an empty table none; other columns are not read.
    """
    rows = cut_lineage(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col).alias("vector"), is_query.alias("is_query"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .withColumn("row", F.monotonically_increasing_id())
    )
    counted = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, groups = -(-counted["n"] // BLOCK) or 1, -(-counted["q"] // GROUP) or 1
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    listed = rows.select("row", "vec_id", "vector", block.alias("block"), every(groups).alias("group"))
    asked = rows.where("is_query").select("row", "vec_id", "vector", every(blocks).alias("block"), group.alias("group"))
    found = (
        listed.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(_search(k), FOUND)
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
