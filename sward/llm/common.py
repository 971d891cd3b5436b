"""Helpers shared by the operators of this package."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sward.session import cut_lineage

#: Java class of the characters between words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]"
#: A word: a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Words of 64 bits in a filter of hashes: 8 MB of bits.
FILTER_WORDS = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def partitions(spark):
    """Number of shuffle partitions the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark):
    """Let Arrow batches of texts hold 8 MB instead of 64: each task has some of them in memory at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def quoted(name):
    return "`" + name.replace("`", "``") + "`"


def unused(df, *names):
    """Column names made from ``names`` that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _place(hashes):
    """Word and bit of a 64-bit hash in a filter."""
    return F.pmod(hashes, F.lit(FILTER_WORDS)), F.shiftrightunsigned(hashes, 20).bitwiseAND(F.lit(63)).cast("int")


def hash_filter(hashes):
    """Written table ``word, bits`` of the hashes in the one long column: at most ``FILTER_WORDS`` rows.

    So it may be broadcast however many hashes there are; the more they are, the more others seem to be among them.
    """
    word, bit = _place(F.col(hashes.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return cut_lineage(hashes.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")))


def split_by(df, hashes, words):
    """Rows of ``df`` whose hash may be in the filter, all that are among them, and the other rows.

    Only the first need a join on what was hashed; no row is shuffled here.
    """
    name, bits = unused(df, "word", "bits")
    word, bit = _place(hashes)
    table = F.broadcast(words.select(F.col("word").alias(name), F.col("bits").alias(bits)))
    found = df.join(table, word == F.col(name), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col(bits), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    columns = [F.col(quoted(c)) for c in df.columns]
    return found.where(hit).select(*columns), found.where(~hit).select(*columns)


def slices(batch, column, limit=1 << 20):
    """Parts of a record batch whose ``column`` holds about ``limit`` bytes, one row at least.

    Bounds the working memory of vectorised code by the longest text, not by the batch.
    """
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed, count):
    """``count`` fixed 64-bit numbers drawn from ``seed``."""
    base = np.uint64((seed * 0x632BE59BD9B4E019) & (2**64 - 1))
    return mix(base + np.arange(1, count + 1, dtype=np.uint64) * _ODD)


class Polynomial:
    """Hashes of all ranges of a sequence of 64-bit numbers from one running sum.

    The hash of ``values[a:b]`` is the sum of ``values[a + j] * base ** j`` modulo 2^64.
    """

    def __init__(self, seed):
        self.base = np.uint64(int(seeded(seed, 1)[0]) | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, count):
        if len(self.up) < count:
            size = max(count, 1 << 16)
            steps = np.full(size, self.base, dtype=np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps = np.full(size, self.inverse, dtype=np.uint64)
            steps[0] = 1
            self.down = np.multiply.accumulate(steps)

    def ranges(self, values, starts, ends):
        self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]


class Words:
    """Word boundaries of a batch of texts and a 64-bit hash of each word."""

    def __init__(self, texts, inside=None):
        """``texts``: an Arrow string array; a null holds no word.

        ``inside``: for each byte whether it is part of a word; all but white space if not given.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        if inside is None:
            inside = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        else:
            inside = inside[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.zeros(len(self.data), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(self.data), dtype=bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        #: Index of the first word of each text, and the number of words at the end.
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self, polynomial, letters, fold=False):
        """Hash of each word; ``letters`` has a number for each byte, ``fold`` lower-cases A to Z."""
        data = self.data
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        raw = polynomial.ranges(letters[data], self.starts, self.ends)
        return mix(raw + (self.ends - self.starts).astype(np.uint64) * _ODD)


def runs(keys):
    """First index of each run of equal neighbours in sorted ``keys`` and the run of each element."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
