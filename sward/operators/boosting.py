"""Boosted trees for many classes: second-order steps on the softmax loss.

A round grows one tree per class, all of them level by level.  A level is one job: tasks sum gradients and
curvatures of their rows per (class, node, feature, bin), the sums meet by slot of (class, node, feature), and one
split per open node comes back.  Nodes of at most ``LOCAL`` stored values are not taken further in this way: one last
job of the round sends the rows of each to one task, which grows the rest of its branch with the same cuts.
Zeros are never stored: their share of a node is its total less what is stored.
The driver holds the trees, a few numbers per node, and the bin edges, at most ``bins`` per feature.
"""

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F

from sward.operators.features import vector_entries
from sward.session import cut_lineage

#: Rounds whose trees are applied anew in each job before the margins are written again.
PENDING = 10
#: Most rows and stored values of a node whose branch is grown in one task.
LOCAL = 1 << 18
#: Gains are compared to this many digits; of equal gains the lower feature and bin win.
DIGITS = 9
NODES = "round int, class int, node int, feature int, threshold double, left int, right int, value double"


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys, seed, turn):
    """Numbers in [0, 1) that depend on the keys, the seed and the turn only."""
    start = _mixed(np.array([seed * 1_000_003 + turn + 1], dtype=np.uint64))
    return (_mixed(_mixed(keys.view(np.uint64)) ^ start) >> np.uint64(11)) / 2.0**53


class Tree:
    """Nodes as parallel arrays; a leaf has feature -1, and a row goes left up to the cut."""

    def __init__(self):
        self.feature, self.cut, self.threshold = [-1], [0], [0.0]
        self.left, self.right, self.value = [0], [0], [0.0]

    def split(self, node, feature, cut, threshold):
        first = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        self.left[node], self.right[node] = first, first + 1
        for values, empty in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            values += [empty, empty]
        return first, first + 1

    def leaves_of(self, rows, cuts):
        """Leaf of each row of ``rows``; ``cuts`` are bins or thresholds, as the rows' values."""
        feature, cut = np.array(self.feature), np.array(cuts)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(rows.count, dtype=np.int64)
        moving = np.arange(rows.count)
        while len(moving):
            moving = moving[feature[node[moving]] >= 0]
            at = node[moving]
            node[moving] = np.where(rows.values_at(moving, feature[at]) <= cut[at], left[at], right[at])
        return node


class Rows:
    """Sparse rows of an Arrow batch; what is not stored has the value ``missing`` of its feature."""

    def __init__(self, ids, values, size, missing):
        ends = np.cumsum(np.asarray(ids.value_lengths().fill_null(0), dtype=np.int64))
        self.count, self.size, self.missing = len(ids), size, missing
        self.row = np.repeat(np.arange(self.count), np.diff(np.concatenate(([0], ends))))
        self.feature = np.asarray(ids.flatten(), dtype=np.int64)
        self.value = np.asarray(values.flatten())
        self.key = self.row * size + self.feature

    def weights(self):
        """One and the number of stored values of each row."""
        return 1.0 + np.bincount(self.row, minlength=self.count)

    def values_at(self, rows, features):
        wanted = rows * self.size + features
        if not len(self.key):
            return self.missing[features]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.value[at], self.missing[features])


def lists(table):
    """Rows of a two-dimensional array as an Arrow array of lists."""
    offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.reshape(-1)))


def softmax(margins):
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def add_trees(margins, rows, rounds, rate, by_bin):
    """``margins`` with the leaf values of all trees of ``rounds`` added."""
    for trees in rounds:
        for c, tree in enumerate(trees):
            leaf = tree.leaves_of(rows, tree.cut if by_bin else tree.threshold)
            margins[:, c] += rate * np.array(tree.value)[leaf]
    return margins


def bin_edges(entries, bins):
    """Per feature its sorted bin edges, zero among them: quantiles of the stored values."""
    shares = [float(i) / bins for i in range(1, bins)] + [1.0]
    found = entries.groupBy("feature").agg(F.percentile_approx("value", shares, 50 * bins).alias("edges")).collect()
    return {r["feature"]: np.unique(np.array(r["edges"] + [0.0])) for r in found}


class _Binned:
    """Rows as the jobs read them: key, label, ids, bins, margins."""

    schema = "key long, label int, ids array<int>, bins array<int>, margins array<double>"

    def __init__(self, cfg, size, n_classes, zero):
        self.cfg, self.size, self.n_classes, self.zero = cfg, size, n_classes, zero

    def read(self, batch, rounds):
        """Rows, labels and margins of a batch after the trees of ``rounds``, and who is held out."""
        rows = Rows(batch.column("ids"), batch.column("bins"), self.size, self.zero)
        margins = np.asarray(batch.column("margins").flatten()).reshape(-1, self.n_classes).copy()
        add_trees(margins, rows, rounds, self.cfg.boost_rate, True)
        keys = np.asarray(batch.column("key"))
        held = uniform(keys, self.cfg.seed, 0) < self.cfg.holdout
        return rows, np.asarray(batch.column("label")), margins, keys, held

    def slopes(self, label, margins, keys, held, turn):
        """Gradients and curvatures per row and class; zero for rows not drawn in this turn."""
        share = softmax(margins)
        drawn = ~held & (uniform(keys, self.cfg.seed, turn + 1) < self.cfg.subsample)
        g = share.copy()
        g[np.arange(len(label)), label] -= 1.0
        return drawn, g, np.maximum(2.0 * share * (1.0 - share), 1e-16)


def _edges_of(broadcast):
    """Batches of key, label, indices, values to bins."""

    def run(batches):
        edges = broadcast.value
        for batch in batches:
            feature = np.asarray(batch.column("ids").flatten(), dtype=np.int64)
            value = np.asarray(batch.column("values").flatten())
            bins = np.zeros(len(feature), dtype=np.int32)
            order = np.argsort(feature, kind="stable")
            names, first = np.unique(feature[order], return_index=True)
            for name, at in zip(names.tolist(), np.split(order, first[1:])):
                bins[at] = np.searchsorted(edges.get(name, np.zeros(1)), value[at])
            lengths = np.asarray(batch.column("ids").value_lengths(), dtype=np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("label"), batch.column("ids"),
                pa.ListArray.from_arrays(offsets, pa.array(bins)), batch.column("margins"),
            ], ["key", "label", "ids", "bins", "margins"])

    return run


def _totals(binned, rounds, turn):
    """Per class the sums of a batch's drawn rows; as class -1 the wrong and all held-out rows, and the drawn rows' weight."""

    def run(batches):
        for batch in batches:
            rows, label, margins, keys, held = binned.read(batch, rounds.value)
            drawn, g, h = binned.slopes(label, margins, keys, held, turn)
            weight = np.zeros(binned.n_classes + 1)
            weight[0] = rows.weights()[drawn].sum()
            wrong = float((margins[held].argmax(axis=1) != label[held]).sum()) if held.any() else 0.0
            classes = np.arange(-1, binned.n_classes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(classes), pa.array(np.concatenate(([wrong], g[drawn].sum(axis=0)))),
                pa.array(np.concatenate(([float(held.sum())], h[drawn].sum(axis=0)))), pa.array(weight),
            ], ["class", "g", "h", "weight"])

    return run


def _summed(at, weights, count):
    """Sums of ``weights`` by place; doubles for no rows too, of which ``bincount`` alone makes whole numbers."""
    return np.bincount(at, weights, count).astype(np.float64)


CELLS = "slot int, class int, node int, feature int, bin int, g double, h double"


def _histograms(binned, rounds, growing, turn, slots):
    """Sums of a batch per class, open node, feature and bin; ``growing`` holds trees and their open nodes."""

    def run(batches):
        trees, opened = growing.value
        for batch in batches:
            rows, label, margins, keys, held = binned.read(batch, rounds.value)
            drawn, g, h = binned.slopes(label, margins, keys, held, turn)
            for c, tree in enumerate(trees):
                if not opened[c]:
                    continue
                node = tree.leaves_of(rows, tree.cut)
                use = (drawn & np.isin(node, opened[c]))[rows.row]
                row, feature, value = rows.row[use], rows.feature[use], rows.value[use].astype(np.int64)
                width = int(value.max(initial=0)) + 1
                cells, at = np.unique((node[row] * binned.size + feature) * width + value, return_inverse=True)
                feature = cells // width % binned.size
                slot = _mixed((cells // width).astype(np.uint64) + np.uint64(c << 40)) % np.uint64(slots)
                yield pa.RecordBatch.from_arrays([
                    pa.array(slot.astype(np.int32)), pa.array(np.full(len(cells), c, np.int32)),
                    pa.array((cells // width // binned.size).astype(np.int32)), pa.array(feature.astype(np.int32)),
                    pa.array((cells % width).astype(np.int32)),
                    pa.array(_summed(at, g[row, c], len(cells))), pa.array(_summed(at, h[row, c], len(cells))),
                ], [f.split()[0] for f in CELLS.split(", ")])

    return run


WEIGHTS = "class int, node int, weight double"


def _weights(binned, rounds, growing, turn):
    """Weight of a batch's rows in each open node of each class."""

    def run(batches):
        trees, opened = growing.value
        for batch in batches:
            rows, label, margins, keys, held = binned.read(batch, rounds.value)
            drawn, _, _ = binned.slopes(label, margins, keys, held, turn)
            weights = rows.weights()
            for c, tree in enumerate(trees):
                if not opened[c]:
                    continue
                node = tree.leaves_of(rows, tree.cut)
                use = drawn & np.isin(node, opened[c])
                nodes, at = np.unique(node[use], return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(nodes), c, np.int32)), pa.array(nodes.astype(np.int32)),
                    pa.array(_summed(at, weights[use], len(nodes))),
                ], [f.split()[0] for f in WEIGHTS.split(", ")])

    return run


MEMBERS = "class int, node int, ids array<int>, bins array<int>, g double, h double"


def _members(binned, rounds, growing, turn):
    """Rows of a batch in each open node of each class, with their gradient and curvature."""

    def run(batches):
        trees, opened = growing.value
        for batch in batches:
            rows, label, margins, keys, held = binned.read(batch, rounds.value)
            drawn, g, h = binned.slopes(label, margins, keys, held, turn)
            for c, tree in enumerate(trees):
                if not opened[c]:
                    continue
                node = tree.leaves_of(rows, tree.cut)
                at = np.flatnonzero(drawn & np.isin(node, opened[c]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), c, np.int32)), pa.array(node[at].astype(np.int32)),
                    batch.column("ids").take(pa.array(at)), batch.column("bins").take(pa.array(at)),
                    pa.array(g[at, c]), pa.array(h[at, c]),
                ], [f.split()[0] for f in MEMBERS.split(", ")])

    return run


BRANCH = "class int, node int, place int, feature int, bin int, left int, right int, value double"


def _branch(size, zero, cfg, starts):
    """The branch below one node from all of its rows; ``starts`` maps (class, node) to its sums and the levels left."""

    def run(table):
        table = table.combine_chunks()
        own = table["class"][0].as_py(), table["node"][0].as_py()
        total, levels = starts.value[own]
        rows = Rows(table["ids"].combine_chunks(), table["bins"].combine_chunks(), size, zero)
        g, h = np.asarray(table["g"]), np.asarray(table["h"])
        tree, sums, opened = Tree(), {0: total}, [0]
        tree.value[0] = step(total, cfg.penalty)
        node = np.zeros(rows.count, dtype=np.int64)
        for _ in range(levels):
            opened = [n for n in opened if sums[n][1] >= 2 * cfg.min_child]
            use = np.isin(node, opened)[rows.row]
            row, feature, value = rows.row[use], rows.feature[use], rows.value[use].astype(np.int64)
            width = int(value.max(initial=0)) + 1
            cells, at = np.unique((node[row] * size + feature) * width + value, return_inverse=True)
            found = best_splits({
                "class": np.zeros(len(cells), np.int64), "node": cells // width // size, "feature": cells // width % size,
                "bin": cells % width, "g": np.bincount(at, g[row], len(cells)), "h": np.bincount(at, h[row], len(cells)),
            }, {(0, n): sums[n] for n in opened}, zero, cfg.penalty, cfg.min_child).to_pylist()
            opened = []
            for s in found:
                left, right = _cut(tree, sums, s["node"], s, 0.0, cfg.penalty)
                opened += [left, right]
                at = np.flatnonzero(node == s["node"])
                low = rows.values_at(at, np.full(len(at), s["feature"])) <= s["bin"]
                node[at] = np.where(low, left, right)
            if not opened:
                break
        count = len(tree.feature)
        ints = [np.full(count, own[0]), np.full(count, own[1]), np.arange(count), tree.feature, tree.cut, tree.left, tree.right]
        return pa.table([pa.array(np.asarray(a, np.int32)) for a in ints] + [pa.array(tree.value, pa.float64())],
                        [f.split()[0] for f in BRANCH.split(", ")])

    return run


def _cut(tree, sums, node, s, threshold, penalty):
    """Split ``node`` of ``tree``; its children get their sums and values."""
    left, right = tree.split(node, s["feature"], s["bin"], threshold)
    g, h = sums[node]
    sums[left], sums[right] = (s["g"], s["h"]), (g - s["g"], h - s["h"])
    for child in (left, right):
        tree.value[child] = step(sums[child], penalty)
    return left, right


SPLITS = "class int, node int, feature int, bin int, gain double, g double, h double"


def best_splits(table, totals, zero, penalty, least):
    """Best split of each class and node among the features of ``table``.

    ``totals`` maps (class, node) to the sums of the node; ``g`` and ``h`` of a split are those of its left side.
    """
    columns = {n: np.asarray(table[n]) for n in ("class", "node", "feature", "bin", "g", "h")}
    names = ("class", "node", "feature")
    order = np.lexsort([columns[n] for n in reversed(names)])
    ordered = np.stack([columns[n][order] for n in names], axis=1)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    groups, group = ordered[new], np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    whole = np.array([totals[c, n] for c, n in groups[:, :2].tolist()]).reshape(-1, 2)
    # What is not stored is zero: the total less the stored cells.
    rest = whole - np.stack([np.bincount(group, columns[n], len(groups)) for n in "gh"], axis=1)
    group = np.concatenate((group, np.arange(len(groups))))
    bins = np.concatenate((columns["bin"], zero[groups[:, 2]]))
    sums = np.stack([np.concatenate((columns[n], rest[:, i])) for i, n in enumerate("gh")], axis=1)
    order = np.lexsort((bins, group))
    group, bins = group[order], bins[order]
    running = np.cumsum(sums[order], axis=0)
    first = np.searchsorted(group, np.arange(len(groups)))
    before = np.concatenate((np.zeros((1, 2)), running))[first]
    low = running - before[group]
    high = whole[group] - low
    # A cut lies after the last cell of a bin, unless no bin of the group follows.
    cut = np.zeros(len(group), dtype=bool)
    cut[:-1] = (group[1:] == group[:-1]) & (bins[1:] != bins[:-1])
    fits = cut & (low[:, 1] >= least) & (high[:, 1] >= least)

    def worth(s):
        return s[:, 0] ** 2 / (s[:, 1] + penalty)

    at = np.flatnonzero(fits)
    gain = np.round(worth(low[at]) + worth(high[at]) - worth(whole[group[at]]), DIGITS)
    at, gain = at[gain > 0], gain[gain > 0]
    found = groups[group[at]]
    order = np.lexsort((bins[at], found[:, 2], -gain, found[:, 1], found[:, 0]))
    at, gain, found = at[order], gain[order], found[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    arrays = [found[new, 0], found[new, 1], found[new, 2], bins[at[new]]]
    return pa.table([pa.array(a.astype(np.int32)) for a in arrays] + [pa.array(gain[new]), pa.array(low[at[new], 0]), pa.array(low[at[new], 1])],
                    [f.split()[0] for f in SPLITS.split(", ")])


def step(sums, penalty):
    """Value of a leaf; zero where there is neither curvature nor penalty."""
    g, h = sums
    return -g / (h + penalty) if h + penalty > 0 else 0.0


def _grow(base, binned, rounds, totals, weight, turn, edges, cfg):
    """Trees of one round, a tree per class; ``totals`` holds the sums of all drawn rows per class, ``weight`` their weight."""
    context = base.sparkSession.sparkContext
    slots = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = [Tree() for _ in range(binned.n_classes)]
    sums = [{0: totals[c]} for c in range(binned.n_classes)]
    for tree, own in zip(trees, sums):
        tree.value[0] = step(own[0], cfg.penalty)
    opened, small, starts = [[0] for _ in trees], [[] for _ in trees], {}
    for depth in range(cfg.boost_depth):
        # A node that cannot be cut into two sides of enough curvature stays a leaf.
        opened = [[n for n in nodes if sums[c][n][1] >= 2 * cfg.min_child] for c, nodes in enumerate(opened)]
        if not any(opened):
            break
        growing = context.broadcast((trees, opened))
        if depth:
            found = base.mapInArrow(_weights(binned, rounds, growing, turn), WEIGHTS).groupBy("class", "node").agg(F.sum("weight").alias("w"))
            weights = {(r["class"], r["node"]): r["w"] for r in found.collect()}
        else:
            weights = {(c, 0): weight for c in range(binned.n_classes)}
        for c, nodes in enumerate(opened):
            for n in nodes:
                if weights.get((c, n), 0.0) <= LOCAL:
                    small[c].append(n)
                    starts[c, n] = sums[c][n], cfg.boost_depth - depth
            opened[c] = [n for n in nodes if (c, n) not in starts]
        growing.unpersist()
        if not any(opened):
            break
        growing = context.broadcast((trees, opened))
        here = context.broadcast({(c, n): sums[c][n] for c, nodes in enumerate(opened) for n in nodes})
        zero, penalty, least = binned.zero, cfg.penalty, cfg.min_child
        cells = base.mapInArrow(_histograms(binned, rounds, growing, turn, slots), CELLS)
        cells = cells.groupBy("slot", "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        splits = cells.groupBy("slot").applyInArrow(lambda t: best_splits(t, here.value, zero, penalty, least), SPLITS)
        rank = F.struct(-F.col("gain"), "feature", "bin")
        best = splits.groupBy("class", "node").agg(F.min_by(F.struct("feature", "bin", "g", "h"), rank).alias("s")).collect()
        opened = [[] for _ in trees]
        for r in sorted(best, key=lambda r: (r["class"], r["node"])):
            c, s = r["class"], r["s"]
            opened[c] += _cut(trees[c], sums[c], r["node"], s, float(edges[s["feature"]][s["bin"]]), cfg.penalty)
        for used in (growing, here):
            used.unpersist()
        if not best:
            break
    if starts:
        _finish(base, binned, rounds, turn, edges, cfg, trees, small, starts)
    return trees


def _finish(base, binned, rounds, turn, edges, cfg, trees, small, starts):
    """Grow the branches below the nodes ``small`` of each class, a task for each, and add them to ``trees``."""
    context = base.sparkSession.sparkContext
    growing, begun = context.broadcast((trees, small)), context.broadcast(starts)
    members = base.mapInArrow(_members(binned, rounds, growing, turn), MEMBERS)
    branches = members.groupBy("class", "node").applyInArrow(_branch(binned.size, binned.zero, cfg, begun), BRANCH).collect()
    places = {}
    for r in sorted(branches, key=lambda r: (r["class"], r["node"], r["place"])):
        tree, branch = trees[r["class"]], (r["class"], r["node"])
        node = places.setdefault((*branch, 0), r["node"]) if r["place"] == 0 else places[(*branch, r["place"])]
        tree.value[node] = r["value"]
        if r["feature"] >= 0:
            threshold = float(edges[r["feature"]][r["bin"]])
            places[(*branch, r["left"])], places[(*branch, r["right"])] = tree.split(node, r["feature"], r["bin"], threshold)
    for used in (growing, begun):
        used.unpersist()


def fit_boosted(df, cfg, size, n_classes, key="row_id"):
    """Fitted ``BoostedModel`` on rows with ``features``, ``label_id`` and a ``key`` that names the row.

    * ``cfg.holdout`` of the rows, by hash of their key, are left out of the fit; after ``cfg.stop_after`` rounds
      without fewer errors on them fitting ends, and the rounds up to the best are kept.  Without held-out rows all
      ``cfg.rounds`` are kept.
    * Each round draws ``cfg.subsample`` of the other rows, by hash of key, seed and round.
    * An empty table gives trees without splits: all classes are equally likely.
    """
    spark = df.sparkSession
    plain = cut_lineage(vector_entries(df).select(
        F.xxhash64(key).alias("key"), F.col("label_id").cast("int").alias("label"),
        F.col("entries.indices").alias("ids"), F.col("entries.values").alias("values"),
        F.array_repeat(F.lit(0.0), n_classes).alias("margins"),
    ))
    zipped = F.explode(F.arrays_zip(F.col("ids").alias("feature"), F.col("values").alias("value")))
    edges = bin_edges(plain.select(zipped.alias("e")).select("e.feature", "e.value"), cfg.bins)
    zero = np.zeros(size, dtype=np.int64)
    for feature, own in edges.items():
        zero[feature] = np.searchsorted(own, 0.0)
    binned = _Binned(cfg, size, n_classes, zero)
    base = cut_lineage(plain.mapInArrow(_edges_of(spark.sparkContext.broadcast(edges)), binned.schema))

    rounds, written, best, fewest = [], 0, 0, None
    for turn in range(cfg.rounds + 1):
        if turn - written == PENDING:
            base = cut_lineage(base.mapInArrow(_margins(binned, spark.sparkContext.broadcast(rounds[written:])), binned.schema))
            written = turn
        pending = spark.sparkContext.broadcast(rounds[written:])
        found = base.mapInArrow(_totals(binned, pending, turn), "class int, g double, h double, weight double")
        found = found.groupBy("class").agg(*[F.sum(n).alias(n) for n in ("g", "h", "weight")]).collect()
        sums, weight = {r["class"]: (r["g"], r["h"]) for r in found}, sum(r["weight"] for r in found)
        wrong, held = sums.get(-1, (0.0, 0.0))
        if held and (fewest is None or wrong < fewest):
            best, fewest = turn, wrong
        if turn == cfg.rounds or (held and turn - best >= cfg.stop_after):
            break
        totals = {c: sums.get(c, (0.0, 0.0)) for c in range(n_classes)}
        rounds.append(_grow(base, binned, pending, totals, weight, turn, edges, cfg))
        pending.unpersist()
    return BoostedModel().using(rounds[:best] if fewest is not None else rounds, cfg.boost_rate, size, n_classes)


def _margins(binned, rounds):
    def run(batches):
        for batch in batches:
            margins = binned.read(batch, rounds.value)[2]
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", lists(margins))

    return run


def entries_of(vectors):
    """Indices and values of an Arrow array of vectors; a dense vector stores all of its positions."""
    ids, values = vectors.field("indices"), vectors.field("values")
    if ids.null_count:
        pairs = zip(ids.to_pylist(), values.value_lengths().to_pylist())
        ids = pa.array([list(range(n)) if own is None else own for own, n in pairs], pa.list_(pa.int32()))
    return ids, values


class BoostedTrees(Estimator):
    """Estimator of ``BoostedModel`` with the parameters of a ``ModelConfig``."""

    def __init__(self, cfg, size, n_classes, key="row_id"):
        super().__init__()
        self.cfg, self.size, self.n_classes, self.key_col = cfg, size, n_classes, key

    def _fit(self, df):
        return fit_boosted(df, self.cfg, self.size, self.n_classes, self.key_col)


class BoostedModel(Model, HasFeaturesCol, HasProbabilityCol, MLReadable, MLWritable):
    """Trees per round and class; adds a ``probability`` array."""

    @keyword_only
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", probabilityCol="probability")
        self.rounds, self.rate, self.size, self.n_classes = [], 0.0, 0, 0

    def using(self, rounds, rate, size, n_classes):
        self.rounds, self.rate, self.size, self.n_classes = rounds, rate, size, n_classes
        return self

    def _transform(self, df):
        spark = df.sparkSession
        rounds = spark.sparkContext.broadcast(self.rounds)
        rate, size, n_classes = self.rate, self.size, self.n_classes

        @F.arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            rows = Rows(*entries_of(vectors), size, np.zeros(size))
            shares = softmax(add_trees(np.zeros((rows.count, n_classes)), rows, rounds.value, rate, False))
            return lists(shares)

        return df.withColumn(self.getProbabilityCol(), score(F.col(self.getFeaturesCol())))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        model, spark = self.model, self.sparkSession
        shape = {"rate": model.rate, "size": model.size, "n_classes": model.n_classes, "n_rounds": len(model.rounds)}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata=shape)
        nodes = [
            (r, c, n, t.feature[n], float(t.threshold[n]), t.left[n], t.right[n], float(t.value[n]))
            for r, trees in enumerate(model.rounds) for c, t in enumerate(trees) for n in range(len(t.feature))
        ]
        spark.createDataFrame(nodes, NODES).write.mode("overwrite").parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rounds = [[Tree() for _ in range(found["n_classes"])] for _ in range(found["n_rounds"])]
        for r in self.sparkSession.read.schema(NODES).parquet(f"{path}/trees").orderBy("round", "class", "node").collect():
            tree = rounds[r["round"]][r["class"]]
            if r["node"] == 0:
                for values in (tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.cut):
                    values.clear()
            for name in ("feature", "threshold", "left", "right", "value"):
                getattr(tree, name).append(r[name])
            tree.cut.append(0)
        model = self.cls().using(rounds, found["rate"], found["size"], found["n_classes"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model
