"""Perceptron fitted by first-order steps on the softmax loss.

The training rows are dealt to batches by hash of their key and written once, a folder per batch.  A batch is read once
and kept by the executors as Arrow blocks, in memory or on disk.  A step is one job over the blocks of a batch, without a
plan of its own: tasks add up the gradients of their rows, the sums meet by chunk of the weights, and one vector of the
size of the network comes back to the driver, which holds the weights and the state of the optimizer.  How many steps an
epoch has is bounded, so a batch is a share of the rows where they are many.
"""

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F

from sward.operators.boosting import entries_of, lists, softmax, uniform
from sward.operators.features import vector_entries
from sward.session import scratch_path

#: Weights that travel in one row.
CHUNK = 1024
#: Rows worked on at a time in a task.
BLOCK = 1024
#: Batch of the rows that only judge epochs.
HELD = -1
#: Relative gain in held-out accuracy that counts for the learning rate.
BETTER = 1e-4
BATCHES = "key long, label int, ids array<int>, values array<double>, batch int"
SUMS = "part int, sums array<double>"

ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "sigmoid": (lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))), lambda a: a * (1.0 - a)),
    "tanh": (np.tanh, lambda a: 1.0 - a * a),
}


class Network:
    """Shape of a network; its weights are one vector, viewed as a matrix and a bias per layer."""

    def __init__(self, sizes, activation):
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation: {activation}")
        self.sizes, self.activation = list(sizes), activation
        self.shapes = list(zip(self.sizes, self.sizes[1:]))
        self.length = sum(n * m + m for n, m in self.shapes)

    def layers(self, weights):
        """Matrix and bias of each layer as views of ``weights``."""
        out, at = [], 0
        for n, m in self.shapes:
            out.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
            at += n * m + m
        return out

    def start(self, how, seed):
        """First weights: uniform within the root of the inputs (``None``), ``kaiming``, ``xavier`` or ``zeros``."""
        rng, weights = np.random.default_rng(seed), np.zeros(self.length)
        if how not in (None, "kaiming", "xavier", "zeros"):
            raise ValueError(f"unknown start of weights: {how}")
        for matrix, bias in self.layers(weights) if how != "zeros" else ():
            n, m = matrix.shape
            bound = 1.0 / np.sqrt(max(n, 1))
            bias[:] = rng.uniform(-bound, bound, m)
            if how is None:
                matrix[:] = rng.uniform(-bound, bound, (n, m))
            else:
                matrix[:] = rng.normal(0.0, np.sqrt(2.0 / (n if how == "kaiming" else n + m)), (n, m))
        return weights

    def outputs(self, layers, x, used):
        """Inputs of each layer after the first, and the output; ``x`` has the columns ``used`` only."""
        act = ACTIVATIONS[self.activation][0]
        z, hidden = x @ layers[0][0][used] + layers[0][1], []
        for matrix, bias in layers[1:]:
            hidden.append(act(z))
            z = hidden[-1] @ matrix + bias
        return hidden, z

    def add_gradient(self, layers, sums, x, used, label):
        """Add the gradients of the loss of these rows to the views ``sums``."""
        slope = ACTIVATIONS[self.activation][1]
        hidden, z = self.outputs(layers, x, used)
        delta = softmax(z)
        delta[np.arange(len(label)), label] -= 1.0
        for i in range(len(layers) - 1, 0, -1):
            sums[i][0][:] += hidden[i - 1].T @ delta
            sums[i][1][:] += delta.sum(axis=0)
            delta = (delta @ layers[i][0].T) * slope(hidden[i - 1])
        sums[0][0][used] += x.T @ delta
        sums[0][1][:] += delta.sum(axis=0)


def compact(ids, values):
    """Rows as a matrix of the features that any of them stores, and those features."""
    lengths = np.asarray(ids.value_lengths().fill_null(0), dtype=np.int64)
    used, at = np.unique(np.asarray(ids.flatten(), dtype=np.int64), return_inverse=True)
    x = np.zeros((len(lengths), len(used)))
    x[np.repeat(np.arange(len(lengths)), lengths), at] = np.asarray(values.flatten())
    return x, used


def _packed(batches):
    """Arrow blocks of at most ``BLOCK`` rows as bytes."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(first, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def blocks(rows):
    """Rows as an RDD of Arrow blocks, kept by the executors once read."""
    packed = rows.mapInArrow(_packed, "block binary").rdd.map(lambda r: bytes(r["block"]))
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def _gradients(network, weights):
    """A task's gradient sums in chunks; part -1 counts its rows, held-out rows and those of them that are right."""

    def run(index, packed):
        layers, total = network.layers(weights.value), np.zeros(network.length)
        sums, seen = network.layers(total), np.zeros(3)
        for block in packed:
            for part in pa.ipc.open_stream(block):
                label = np.asarray(part.column("label"))
                x, used = compact(part.column("ids"), part.column("values"))
                held = np.asarray(part.column("batch")) == HELD
                if held.any():
                    z = network.outputs(layers, x[held], used)[1]
                    seen += (0, held.sum(), (z.argmax(axis=1) == label[held]).sum())
                if not held.all():
                    network.add_gradient(layers, sums, x[~held], used, label[~held])
                    seen[0] += (~held).sum()
        yield -1, (index, seen)
        for first in range(0, network.length, CHUNK):
            own = total[first : first + CHUNK]
            if own.any():
                yield first // CHUNK, (index, own)

    return run


def _added(sums):
    """Sum of one part's chunks, in order of the tasks they come from."""
    return np.sum([own for _, own in sorted(sums, key=lambda s: s[0])], axis=0)


def gradient(packed, network, weights):
    """Gradient sums over the rows that are not held out; counts of rows, held-out rows and right ones.

    ``packed`` is an RDD of Arrow blocks.
    """
    context = packed.context
    sent = context.broadcast(weights)
    parts = max(1, min(context.defaultParallelism, 1 - (-network.length // CHUNK)))
    found = packed.mapPartitionsWithIndex(_gradients(network, sent)).groupByKey(parts).mapValues(_added).collect()
    sent.unpersist()
    total, seen = np.zeros(network.length), np.zeros(3)
    for part, own in found:
        if part < 0:
            seen = own
        else:
            total[part * CHUNK : part * CHUNK + len(own)] = own
    return total, seen


class Optimizer:
    """Steps of ``sgd`` with Nesterov's momentum or of ``adam``; both shrink weights by ``weight_decay``."""

    def __init__(self, cfg, length):
        if cfg.optimizer not in ("sgd", "adam"):
            raise ValueError(f"unknown optimizer: {cfg.optimizer}")
        self.cfg, self.rate, self.turn = cfg, cfg.learning_rate, 0
        self.first, self.second = np.zeros(length), np.zeros(length)

    def step(self, weights, g):
        cfg = self.cfg
        g = g + cfg.weight_decay * weights
        self.turn += 1
        if cfg.optimizer == "sgd":
            self.first = cfg.momentum * self.first + g
            return weights - self.rate * (g + cfg.momentum * self.first)
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        mean, spread = self.first / (1 - 0.9**self.turn), self.second / (1 - 0.999**self.turn)
        return weights - self.rate * mean / (np.sqrt(spread) + 1e-8)


class Plateau:
    """Cuts the learning rate by ``factor`` after more than ``patience`` epochs without a better accuracy."""

    def __init__(self, cfg):
        self.cfg, self.best, self.idle = cfg, -np.inf, 0

    def rate(self, rate, accuracy):
        if accuracy > self.best * (1 + BETTER):
            self.best, self.idle = accuracy, 0
        else:
            self.idle += 1
        if self.idle > self.cfg.patience:
            self.idle = 0
            return rate * self.cfg.factor
        return rate


def _dealt(df, cfg, key):
    """The rows in a written table with a folder per batch, and the number of batches.

    ``cfg.holdout`` of the rows go to the held-out batch.  Both depend on the key and the seed only.
    """
    plain = vector_entries(df)
    n_batches = int(max(1, min(cfg.updates, -(-plain.count() // cfg.batch_size))))
    seed, holdout = cfg.seed, cfg.holdout

    @F.arrow_udf("int")
    def deal(keys: pa.Array) -> pa.Array:
        keys = np.asarray(keys)
        batch = (uniform(keys, seed, 1) * n_batches).astype(np.int32)
        return pa.array(np.where(uniform(keys, seed, 0) < holdout, np.int32(HELD), batch), pa.int32())

    # A dense vector stores all of its positions.
    stored = F.size("entries.values")
    every = F.transform(F.sequence(F.lit(0), stored - 1), lambda i: i.cast("int"))
    ids = F.coalesce("entries.indices", F.when(stored > 0, every), F.array().cast("array<int>"))
    rows = plain.select(
        F.xxhash64(key).alias("key"), F.col("label_id").cast("int").alias("label"),
        ids.alias("ids"), F.col("entries.values").alias("values"),
    )
    path = scratch_path(df.sparkSession, "batches")
    rows.withColumn("batch", deal("key")).write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema(BATCHES).parquet(path), n_batches


def fit_perceptron(df, cfg, size, n_classes, key="row_id"):
    """Fitted ``PerceptronModel`` on rows with ``features``, ``label_id`` and a ``key`` that names the row.

    * An epoch takes the batches in seeded order, a step each: ``cfg.updates`` of them, fewer where rows do not fill
      batches of ``cfg.batch_size``.  A step follows the mean gradient of the rows of its batch.
    * ``cfg.holdout`` of the rows judge each epoch: more than ``cfg.patience`` epochs without a better accuracy
      cut the learning rate by ``cfg.factor``, ``cfg.stop_after`` of them end the fit, and the best weights are kept.
      Without held-out rows all epochs are made and the last weights kept.
    * An empty table leaves the first weights.  The driver holds some four vectors of the size of the network.
    """
    network = Network([size] + [cfg.neurons] * cfg.hidden_layers + [n_classes], cfg.activation)
    weights = network.start(cfg.weight_init, cfg.seed)
    rows, n_batches = _dealt(df, cfg, key)
    dealt = {batch: blocks(rows.where(F.col("batch") == batch)) for batch in [HELD, *range(n_batches)]}
    try:
        return PerceptronModel().using(_descend(dealt, n_batches, cfg, network, weights), network)
    finally:
        for own in dealt.values():
            own.unpersist()


def _descend(dealt, n_batches, cfg, network, weights):
    """Weights after all epochs over the blocks of each batch, as ``fit_perceptron`` says."""
    optimizer, plateau = Optimizer(cfg, network.length), Plateau(cfg)
    best, kept, idle = -np.inf, weights, 0
    for epoch in range(cfg.epochs + 1):
        order = np.random.default_rng((cfg.seed, epoch)).permutation(n_batches).tolist()
        for turn, batch in enumerate(order):
            # The first job of an epoch also judges the weights of the epoch before.
            wanted = [batch] if epoch < cfg.epochs else []
            if turn == 0 and epoch and cfg.holdout > 0:
                wanted.append(HELD)
            if not wanted:
                break
            own = dealt[wanted[0]] if len(wanted) == 1 else dealt[batch].context.union([dealt[b] for b in wanted])
            g, (n, held, right) = gradient(own, network, weights)
            if held:
                accuracy = right / held
                optimizer.rate = plateau.rate(optimizer.rate, accuracy)
                idle = 0 if accuracy > best else idle + 1
                if accuracy > best:
                    best, kept = accuracy, weights
                if idle >= cfg.stop_after:
                    return kept
            if n:
                weights = optimizer.step(weights, g / n)
            if epoch == cfg.epochs:
                break
    return kept if best > -np.inf else weights


class Perceptron(Estimator):
    """Estimator of ``PerceptronModel`` with the parameters of a ``ModelConfig``."""

    def __init__(self, cfg, size, n_classes, key="row_id"):
        super().__init__()
        self.cfg, self.size, self.n_classes, self.key_col = cfg, size, n_classes, key

    def _fit(self, df):
        return fit_perceptron(df, self.cfg, self.size, self.n_classes, self.key_col)


class PerceptronModel(Model, HasFeaturesCol, HasRawPredictionCol, HasProbabilityCol, MLReadable, MLWritable):
    """Weights of a network; adds arrays ``rawPrediction`` and ``probability``."""

    @keyword_only
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", rawPredictionCol="rawPrediction", probabilityCol="probability")
        self.weights, self.network = np.zeros(0), None

    def using(self, weights, network):
        self.weights, self.network = weights, network
        return self

    def _transform(self, df):
        weights, network = df.sparkSession.sparkContext.broadcast(self.weights), self.network

        @F.arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            layers, out = network.layers(weights.value), [np.zeros((0, network.sizes[-1]))]
            for first in range(0, len(vectors), BLOCK):
                x, used = compact(*entries_of(vectors.slice(first, BLOCK)))
                out.append(network.outputs(layers, x, used)[1])
            return lists(np.concatenate(out))

        raw = F.col(self.getRawPredictionCol())
        raised = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
        total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
        scored = df.withColumn(self.getRawPredictionCol(), score(F.col(self.getFeaturesCol())))
        return scored.withColumn(self.getProbabilityCol(), F.transform(raised, lambda v: v / total))

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
        shape = {"sizes": model.network.sizes, "activation": model.network.activation}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata=shape)
        starts = range(0, len(model.weights), CHUNK)
        chunks = pa.array([model.weights[at : at + CHUNK] for at in starts], pa.list_(pa.float64()))
        table = pa.table({"part": pa.array(range(len(starts)), pa.int32()), "sums": chunks})
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/weights")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.schema(SUMS).parquet(f"{path}/weights").orderBy("part").toArrow()
        weights = np.asarray(table["sums"].combine_chunks().flatten())
        model = self.cls().using(weights, Network(found["sizes"], found["activation"]))
        DefaultParamsReader.getAndSetParams(model, found)
        return model
