"""Exact duplicates found by an exchange of Golomb-coded fingerprints.

Partitions send sorted, Rice-coded fingerprints to the owners of hash ranges; an owner answers each
message with a bitmap of the fingerprints that others sent too; only texts so suspected are shuffled
and compared byte by byte.  A fingerprint that two different texts share costs one needless
comparison and never a wrong result.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.llm.common import hash_filter, partitions, quoted, split_by, text_or_empty, unused
from sward.session import cut_lineage

#: Bits of a fingerprint on the wire.
BITS = 48
#: Fingerprints of a message on average, below which there are fewer owners, and most of an owner.
MESSAGE_SIZE, OWNER_SIZE = 64, 1 << 22
MESSAGE = "chunk int, owner int, n int, k int, unary binary, low binary, repeated binary"


def rice(gaps, k):
    """Rice code of non-negative numbers: unary quotients, and ``k`` low bits each."""
    gaps = gaps.astype(np.int64)
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low.reshape(-1)).tobytes()


def unrice(unary, low, n, k):
    """The ``n`` numbers coded by ``rice``."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n]
    quotients = np.diff(np.concatenate(([-1], ends))) - 1
    bits = np.unpackbits(np.frombuffer(low, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    return (quotients.astype(np.int64) << k) + (bits << np.arange(k)).sum(axis=1)


def bitmap(flags):
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unbitmap(data, n):
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8))[:n].astype(bool)


def _messages(owner_bits):
    """A task's fingerprints to one message for each owner."""
    low_bits = BITS - owner_bits

    def send(batches):
        found = [np.asarray(batch.column(0)) for batch in batches]
        values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        context = TaskContext.get()
        chunk = context.partitionId() if context else 0
        edges = np.searchsorted(values, np.arange(2**owner_bits + 1, dtype=np.int64) << low_bits)
        rows = []
        for owner in np.flatnonzero(np.diff(edges)):
            own = values[edges[owner] : edges[owner + 1]] - (int(owner) << low_bits)
            k = max(0, int(np.log2(2.0**low_bits / len(own))))
            unary, low = rice(np.diff(own, prepend=0), k)
            flags = bitmap(counts[edges[owner] : edges[owner + 1]] > 1)
            rows.append((chunk, int(owner), len(own), k, unary, low, flags))
        names = ["chunk", "owner", "n", "k", "unary", "low", "repeated"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return send


def _decoded(row):
    return np.cumsum(unrice(row["unary"], row["low"], row["n"], row["k"]))


def _answers(table):
    """All messages of one owner to a bitmap for each: which fingerprints occur more than once."""
    rows = table.to_pylist()
    values = [_decoded(r) for r in rows]
    weights = [1 + unbitmap(r["repeated"], r["n"]) for r in rows]
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    many = np.bincount(inverse, weights=np.concatenate(weights))[inverse] > 1
    parts = np.split(many, np.cumsum([len(v) for v in values])[:-1])
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int32()),
        "owner": pa.array([r["owner"] for r in rows], pa.int32()),
        "suspects": pa.array([bitmap(p) for p in parts], pa.binary()),
    })


def _suspects(owner_bits):
    """Messages with their bitmaps to the suspected fingerprints."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _decoded(row)[unbitmap(row["suspects"], row["n"])]
                yield pa.RecordBatch.from_arrays([pa.array(own + (row["owner"] << (BITS - owner_bits)), pa.int64())], ["fp"])

    return read


def owner_bits_for(n, tasks, n_partitions):
    """Bits of the owner of a hash range: four a shuffle partition, where messages are not too small for the code."""
    wanted = int(np.ceil(np.log2(4 * n_partitions)))
    filled = int(np.log2(max(1, n // (tasks * MESSAGE_SIZE))))
    return max(min(wanted, filled), int(np.ceil(np.log2(max(1, n / OWNER_SIZE)))))


def repeated_fingerprints(fingerprints):
    """Distinct values of the one ``BITS``-bit long column that occur in more than one row."""
    spark = fingerprints.sparkSession
    tasks = fingerprints.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    tasks, n = tasks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    owner_bits = owner_bits_for(n, max(1, tasks), partitions(spark))
    sent = cut_lineage(fingerprints.mapInArrow(_messages(owner_bits), MESSAGE))
    # Written first, so that no task has two Python workers.
    answers = cut_lineage(sent.groupBy("owner").applyInArrow(_answers, "chunk int, owner int, suspects binary"))
    found = sent.join(answers, ["chunk", "owner"]).mapInArrow(_suspects(owner_bits), "fp long")
    return cut_lineage(found.distinct())


def _groups(docs, id_col, text_col):
    """Rows of ``docs`` by id and digest (written once), and the verified groups of equal texts."""
    light = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), _digest(text_col).alias("sha"), _fingerprint(text_col).alias("fp"),
        F.monotonically_increasing_id().alias("row"),
    ))
    suspects = repeated_fingerprints(light.select("fp"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), _fingerprint(text_col).alias("fp"))
    # Texts without a suspected fingerprint are not shuffled.
    maybe, _ = split_by(texts, F.col("fp"), hash_filter(suspects))
    groups = cut_lineage(
        maybe.join(suspects, "fp", "left_semi")
        .groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("fp").alias("fp"))
        .where("group_size > 1")
        .select(_digest("text").alias("sha"), "fp", "keep_id", "group_size")
    )
    first = (
        light.join(groups, "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("sha").agg(F.min("row").alias("keep_row"), F.count("*").alias("n_tied"))
    )
    return light, cut_lineage(groups.join(first, "sha"))


def exact_groups(docs, id_col="doc_id", text_col="text"):
    """One row per row of ``docs``: its id, the id that stays, group size, ``kept``, SHA-256 of the text.

    * Texts are equal when their bytes are; a null text counts as empty.
    * Of equal texts the row with the largest id stays; a null id is smaller than any other.
    * Of rows equal in id and text one is kept.
    * Other columns, whatever their names, are not read.  An empty table gives an empty result.
    """
    light, groups = _groups(docs, id_col, text_col)
    groups = groups.drop("fp")
    single = F.col("group_size").isNull()
    return light.join(groups, "sha", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` that stay, with all their columns; the rule is that of ``exact_groups``."""
    _, groups = _groups(docs, id_col, text_col)
    sha, keep, tied, number = unused(docs, "sha", "keep_id", "n_tied", "number")
    known = groups.select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.col("n_tied").alias(tied))
    # Rows whose text cannot be in a group stay where they are.
    maybe, alone = split_by(docs, _fingerprint(text_col), hash_filter(groups.select("fp")))
    rows = maybe.withColumn(sha, _digest(text_col)).join(known, sha, "left")
    stays = rows.where(F.col(tied).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    several = F.coalesce(F.col(tied), F.lit(1)) > 1
    order = Window.partitionBy(sha).orderBy(*[F.col(quoted(c)) for c, t in docs.dtypes if not t.startswith("map")])
    one = stays.where(several).withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    columns = [F.col(quoted(c)) for c in docs.columns]
    return alone.union(stays.where(~several).select(*columns)).union(one.select(*columns))


def _digest(text_col):
    return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))


def _fingerprint(text_col):
    return F.shiftrightunsigned(F.xxhash64(text_or_empty(text_col)), 64 - BITS)
