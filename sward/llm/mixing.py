"""Mixing sources to target token shares by entropy balancing.

Among all document rates that meet the token constraints, entropy balancing takes those closest to
one copy of everything (least relative entropy over tokens).  They are exponential in the dual
variables of the constraints that a document takes part in; Newton's method finds the variables, with
gradient and Hessian summed by Spark.  Rates are then rounded to whole copies.
"""

import math
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.llm.common import WORD, quoted, text_or_empty, unused
from sward.session import cut_lineage

#: Weights of the sources in the order of their names, and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of each source whose copies are settled last, so that the sum meets the target.
SETTLED, TRIES = 500, 32
#: Most sources whose table is sent to every executor.
BROADCAST = 10_000
TOLERANCE, ROUNDS = 1e-12, 100


def size_of(text_col="text"):
    """Number of words; 0 for a null text."""
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def share_targets(sizes, weights=WEIGHTS, most=MOST):
    """Token targets of the sources ``[(name, tokens)]``, which add up to all tokens.

    Names are ordered by code point, null last, and weigh ``weights``, repeating.  A target stops at
    ``most`` times its source's tokens; what is above goes to the others by weight until none is.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    open_ = {name: (weight, most * size) for (name, size), weight in zip(ordered, cycle(weights))}
    left, targets = float(sum(size for _, size in sizes)), {}
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = {name: top for name, (w, top) in open_.items() if w * level > top}
        if not full:
            return targets | {name: w * level for name, (w, _) in open_.items()}
        targets |= {name: float(top) for name, top in full.items()}
        left -= sum(full.values())
        open_ = {name: v for name, v in open_.items() if name not in full}
    return targets


def balance(cells, targets):
    """Dual variables of the constraints, by Newton's method.

    ``cells``: rows of ``keys`` (array of distinct constraint numbers) and ``tokens``; documents with
    equal keys have equal rates, so they are summed before.  ``targets``: tokens wanted for each
    constraint, all above 0.  The rate of a cell is exp of the sum of its variables.
    """
    wanted = np.array(targets, dtype=np.float64)
    dual = np.zeros(len(wanted))
    for _ in range(ROUNDS if len(wanted) else 0):
        values = F.array(*[F.lit(float(v)) for v in dual])
        tilt = F.aggregate("keys", F.lit(0.0), lambda total, k: total + F.get(values, k))
        moved = cells.select("keys", (F.col("tokens") * F.exp(tilt)).alias("moved"))
        sums = (
            moved.select(F.explode("keys").alias("i"), "keys", "moved")
            .select("i", F.explode("keys").alias("j"), "moved").groupBy("i", "j").agg(F.sum("moved").alias("moved"))
        )
        hessian = np.zeros((len(wanted), len(wanted)))
        for r in sums.collect():  # one number for each pair of constraints with a common document
            hessian[r["i"], r["j"]] = r["moved"]
        gap = wanted - hessian.diagonal()
        if np.all(np.abs(gap) <= TOLERANCE * wanted):
            break
        step = np.linalg.lstsq(hessian, gap, rcond=None)[0]
        dual += np.clip(step, -1.0, 1.0)  # far from the solution a full step overshoots
    return dual


def _table(spark, rows, schema):
    """A table of a row per source: broadcast while it has few rows, else left to the planner."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST else table


def _uniform(seed, *columns):
    """A number in [0, 1) fixed by the row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _filled(weights, residual):
    """Take weights in order while they fit, then one more if that comes nearer; the error and the choice."""
    left, taken = residual, np.zeros(len(weights), dtype=int)
    for i, weight in enumerate(weights):
        if 0 < weight <= left:
            taken[i], left = 1, left - weight
    rest = np.flatnonzero((taken == 0) & (weights > 0))
    if len(rest):
        best = rest[np.argmin(np.abs(left - weights[rest]))]
        if abs(left - weights[best]) < abs(left):
            taken[best], left = 1, left - weights[best]
    return abs(left), taken


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Which of a bounded number of documents get one copy more: the best of ``TRIES`` fixed orders."""
    rows = rows.sort_values(["order", "doc_id", "size"])
    weights, residual = rows["weight"].to_numpy(), float(rows["residual"].iloc[0])
    least, extra = np.inf, None
    for seed in range(TRIES):
        order = np.random.default_rng(seed).permutation(len(rows)) if seed else np.arange(len(rows))
        error, taken = _filled(weights[order], residual)
        if error < least:
            least, extra = error, np.zeros(len(rows), dtype=int)
            extra[order] = taken
    return rows.assign(extra=extra)[["doc_id", "source", "size", "extra"]]


def _plan(docs, id_col, source_col, text_col, weights, most):
    """Light rows of the documents, a row per source, and the settled documents."""
    spark = docs.sparkSession
    light = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size")
    )
    # Rows equal in id, source and size share one decision.
    light = cut_lineage(light.groupBy("doc_id", "source", "size").agg(F.count("*").alias("same")))
    tokens = F.col("size") * F.col("same")
    sources = [(r["source"], r["tokens"]) for r in light.groupBy("source").agg(F.sum(tokens).alias("tokens")).collect()]
    targets = share_targets(sources, weights, most)
    live = [(name, size) for name, size in sources if targets[name] > 0]
    rates = {name: 0.0 for name, _ in sources}
    if live:
        number = _table(spark, [(n, i) for i, (n, _) in enumerate(live)], "name string, number int")
        cells = cut_lineage(
            light.groupBy("source").agg(F.sum(tokens).alias("tokens"))
            .join(number, F.col("source").eqNullSafe(F.col("name"))).select(F.array("number").alias("keys"), "tokens")
        )
        dual = balance(cells, [targets[name] for name, _ in live])
        rates |= {name: min(math.exp(v), float(most)) for (name, _), v in zip(live, dual)}
    order = Window.partitionBy("source").orderBy("order")
    edge = (
        light.withColumn("order", _order()).select("source", "order", F.row_number().over(order).alias("n"))
        .where(F.col("n") <= SETTLED).groupBy("source").agg(F.max("order").alias("edge"))
    )
    edges = {r["source"]: r["edge"] for r in edge.collect()}
    table = [(n, s, targets[n], rates[n], edges[n]) for n, s in sources]
    known = _table(spark, table, "name string, source_size long, target double, rate double, edge double")
    rows = light.join(known, F.col("source").eqNullSafe(F.col("name"))).withColumn("order", _order())
    last = F.col("order") <= F.col("edge")
    given = F.col("size") * F.col("same") * (F.floor("rate") + F.when(last, 0).otherwise(_bulk("doc_id", "source", "size", F.col("rate"))))
    residual = rows.groupBy("source").agg((F.first("target") - F.sum(given)).alias("residual"))
    residuals = _table(spark, [(r["source"], float(r["residual"])) for r in residual.collect()], "left_name string, residual double")
    settled = cut_lineage(
        rows.where(last).join(residuals, F.col("source").eqNullSafe(F.col("left_name")))
        .select("doc_id", "source", "size", "order", "residual", (F.col("size") * F.col("same")).alias("weight"))
        .groupBy("source").applyInPandas(_settle, "doc_id long, source string, size long, extra int")
    )
    return light, known, settled


def _order():
    return _uniform(1, "doc_id", "source", "size")


def _bulk(doc_id, source, size, rate):
    """One copy more with the probability of the rate's fraction, fixed by the row."""
    return (_uniform(2, doc_id, source, size) < rate - F.floor(rate)).cast("int")


def mix_report(docs, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, most=MOST):
    """One row per document: ``doc_id, size, source_size, target, taken``.

    * A null text has size 0; a null source is a source of its own, the last in order.
    * Rows equal in id, source and size get equal copies.  Results depend on rows, not on their order
      or partitions, so that reruns agree.
    * A source without words has target 0.  An empty table gives an empty result.
    * Other columns, whatever their names, are not read.
    """
    light, known, settled = _plan(docs, id_col, source_col, text_col, weights, most)
    keys = settled.select(F.col("doc_id").alias("k1"), F.col("source").alias("k2"), F.col("size").alias("k3"), "extra")
    rows = light.join(known, F.col("source").eqNullSafe(F.col("name"))).join(
        keys, F.col("doc_id").eqNullSafe(F.col("k1")) & F.col("source").eqNullSafe(F.col("k2")) & (F.col("size") == F.col("k3")), "left")
    copies = F.floor("rate") + F.coalesce("extra", _bulk("doc_id", "source", "size", F.col("rate")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
        F.explode(F.array_repeat(F.lit(1), F.col("same").cast("int"))).alias("one"),
    ).drop("one")


def mix(docs, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, most=MOST):
    """``docs`` with each row as often as the mix takes it; columns as before, rules of ``mix_report``."""
    _, known, settled = _plan(docs, id_col, source_col, text_col, weights, most)
    names = unused(docs, "size", "name", "rate", "k1", "k2", "k3", "extra", "copy")
    size, name, rate, k1, k2, k3, extra, copy = names
    known = known.select(F.col("name").alias(name), F.col("rate").alias(rate))
    keys = settled.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "size", "extra"), (k1, k2, k3, extra))])
    rows = docs.withColumn(size, size_of(text_col)).join(known, F.col(source_col).eqNullSafe(F.col(name))).join(
        keys, F.col(id_col).eqNullSafe(F.col(k1)) & F.col(source_col).eqNullSafe(F.col(k2)) & (F.col(size) == F.col(k3)), "left")
    bulk = _bulk(F.col(id_col).cast("long"), source_col, size, F.col(rate))
    copies = (F.floor(rate) + F.coalesce(extra, bulk)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(quoted(c)) for c in docs.columns])
