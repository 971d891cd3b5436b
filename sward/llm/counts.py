"""Token counts by a two-tier lookup on the map side.

Every task cuts its texts into pre-tokens and adds their lengths in tokens.  Lengths of frequent
pre-tokens come from a compact table that is broadcast; all others are encoded once and remembered by
the worker.  No pre-token is shuffled: what travels while the table is made is one summary of bounded
size per task.
"""

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from sward.llm.bytelevel import ByteLevelTokenizer
from sward.llm.common import quoted, slices, unused
from sward.llm.remember import Recent

#: Pre-tokens of a summary and of the broadcast table, and the longest of them in characters: with 4
#: bytes a character and 8 for its numbers the table stays below 4.5 MB.
TABLE, LONGEST = 1 << 15, 32
#: Different pre-tokens a task counts before it cuts its summary, and summaries merged at a time: two
#: levels of merging leave one summary for every ``FAN`` ** 2 tasks to the last one.
ROOM, FAN = 1 << 18, 64
SUMMARY = "part long, words array<string>, n array<long>"
_TABLES = {}


def cut(counts, size):
    """The ``size`` most frequent of ``counts``, less what the next one has (Misra and Gries).

    Summaries so cut can be added and cut again: whatever makes up more than 1 / ``size`` of all
    pre-tokens of the corpus stays in.  Of equal counts the smaller pre-token stays.
    """
    if len(counts) <= size:
        return counts
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    less = ranked[size][1]
    return Counter({k: n - less for k, n in ranked[:size] if n > less})


def _summary(part, counts, size):
    counts = cut(counts, size)
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())),
        pa.array([list(counts.values())], pa.list_(pa.int64()))], ["part", "words", "n"])


def _count(path, size):
    def run(batches):
        tokenizer, counts = ByteLevelTokenizer(path), Counter()
        for batch in batches:
            for rows in slices(batch, 0, 4 << 20):
                for text in rows.column(0).to_pylist():
                    for found in tokenizer.pretokens(text or ""):
                        if isinstance(found, list):
                            counts.update(found)
                        if len(counts) > ROOM:
                            counts = cut(Counter({k: n for k, n in counts.items() if len(k) <= LONGEST}), size)
        counts = Counter({k: n for k, n in counts.items() if len(k) <= LONGEST})
        if counts:
            yield _summary(TaskContext.get().partitionId(), counts, size)

    return run


def _merge(size):
    def run(key, table):
        counts = Counter()
        for words, n in zip(table.column("words").to_pylist(), table.column("n").to_pylist()):
            counts.update(dict(zip(words, n)))
        return pa.Table.from_batches([_summary(key[0].as_py(), counts, size)])

    return run


def frequent(docs, path, text_col="text", size=TABLE):
    """Pre-tokens that are frequent over all texts with their lengths, as Arrow bytes of bounded size."""
    summaries = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(_count(path, size), SUMMARY)
    for part in (f"part div {FAN}", f"part div {FAN}", "0L"):
        summaries = summaries.withColumn("part", F.expr(part)).groupBy("part").applyInArrow(_merge(size), SUMMARY)
    rows = summaries.select("words").collect()  # one summary, none for a table without text
    words = rows[0][0] if rows else []
    tokenizer = ByteLevelTokenizer(path)
    lengths = [tokenizer.pretoken_length(w) for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(lengths, pa.int32())], ["word", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Lengths(dict):
    """Tokens of a pre-token: the broadcast table first, then what this worker remembers."""

    def __init__(self, path, table):
        batch = pa.ipc.open_stream(table).read_all()
        super().__init__(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        self.tokenizer = ByteLevelTokenizer(path)
        self.rest = Recent(self.tokenizer.pretoken_length)

    def __missing__(self, pretoken):
        return self.rest[pretoken]

    def count(self, text):
        total = self.tokenizer.specials(text)
        for found in self.tokenizer.pretokens(text):
            if isinstance(found, list):
                total += sum(map(self.__getitem__, found))
            else:
                total += len(self.tokenizer.ids(found))
        return total


def token_counts(docs, path, limit=1024, text_col="text"):
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; also the names of these columns.

    The names get a ``_`` where ``docs`` has them already, whatever the case.

    * A null text counts as empty: no bytes, no tokens.  Equal rows get equal counts.
    * Strings of special tokens inside a text are those tokens, as the library takes them by default.
    * Long texts are worked on in windows; a single pre-token of megabytes is encoded whole.
    * Other columns stay as they are.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = unused(docs, "n_bytes", "n_tokens", "over_limit")
    shared = spark.sparkContext.broadcast(frequent(docs, path, text_col))
    run_id = uuid.uuid4().hex

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        if run_id not in _TABLES:
            _TABLES.clear()  # a worker serves one count at a time
            _TABLES[run_id] = Lengths(path, shared.value)
        lengths = _TABLES[run_id]
        return pa.array(np.fromiter((lengths.count(t.as_py() or "") for t in texts), np.int64, len(texts)))

    text = F.col(quoted(text_col))
    counted = docs.withColumn(names[0], F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    counted = counted.withColumn(names[1], run(text))
    return counted.withColumn(names[2], F.col(names[1]) > limit), names
