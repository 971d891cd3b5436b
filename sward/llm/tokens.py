"""Token ids of a corpus in Huffman-coded files.

A file set has a code book and blocks.  The code is canonical and length-limited, made from the
counts of all ids.  A block holds whole documents in order; each document starts at a byte and has a
bit offset for every ``STEP`` ids, so that blocks, and segments inside them, decode independently.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sward.llm.common import partitions, slices
from sward.session import cut_lineage, scratch_path

#: Longest code in bits; the decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Ids between two checkpoints, and ids after which a block is closed.
STEP, BLOCK = 128, 1 << 16
#: Words a worker remembers before it starts anew.
REMEMBERED = 500_000

_PUNCTUATION = ".,;:!?*$%&#()[]{}-+=/\"@~^`_\\"
_ENCODERS = {}


class WordEncoder(dict):
    """Ids of space-free pieces of text as little-endian bytes; equal to encoding the whole text.

    The tokenizer drops white space and never joins text across it, so a text is the concatenation
    of its parts between spaces.  Parts are cut further only where the tokenizer cuts too: at line
    ends, and between a Latin letter or number and closing punctuation.  Lower-case Latin words go to
    the tokenizer's model directly, all else through the whole tokenizer.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in range(33, 256) if chr(c).isalpha()]
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in latin}

    def __missing__(self, part):
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[part] = self._encode(part)
        return ids

    def _encode(self, part):
        if not part:
            return b""
        if "\n" in part:
            return b"".join([self[p] for p in part.split("\n")])
        core = part.rstrip(_PUNCTUATION)
        if core and len(core) < len(part) and core[-1].isalnum() and core[-1] < "Ā":
            return self[core] + self[part[len(core):]]
        if part.isalpha() and max(part) < "Ā":
            low = part.lower()
            if low != part:
                return self[low]
            return self._packed([t.id for t in self.tokenizer.model.tokenize(low.translate(self.bytes))])
        return self._packed(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _packed(self, ids):
        return np.array(ids, dtype=self.dtype).tobytes()

    def text(self, text):
        return b"".join(map(self.__getitem__, text.split(" ")))


def encoder(path):
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(docs, path, end_id=1, id_col="doc_id", text_col="text"):
    """``doc_id`` and ``ids``: little-endian ids, 2 bytes each if the vocabulary allows, else 4.

    A null text holds the end id only.
    """

    def run(batches):
        words = encoder(path)
        end = words._packed([end_id])
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                ids = [words.text(t or "") + end for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


def id_counts(encoded, dtype):
    """Number of occurrences of each id over all rows; one row per id and task before the shuffle."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                found = np.bincount(_joined(part.column(0), dtype))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _joined(column, dtype):
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def code_lengths(counts, limit=LIMIT):
    """Lengths of an optimal prefix code with no code above ``limit`` bits (package-merge).

    ``counts``: positive numbers.  One symbol alone gets one bit.
    """
    counts = np.asarray(counts, dtype=np.float64)
    if len(counts) > 2**limit:
        raise ValueError("more ids than codes of the longest length")
    if len(counts) < 2:
        return np.ones(len(counts), dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order]
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        ranks = np.argsort(merged, kind="stable")
        levels.append(ranks < len(leaves))
        merged = merged[ranks]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2][: len(merged) // 2]
    lengths, taken = np.zeros(len(counts), dtype=np.int64), 2 * len(counts) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[order[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


class CodeBook:
    """Canonical codes: shorter codes first, equal lengths by id."""

    def __init__(self, ids, lengths):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids)[order], np.asarray(lengths)[order]
        steps = np.left_shift(1, LIMIT - self.lengths)
        firsts = np.cumsum(steps) - steps
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = firsts >> (LIMIT - self.lengths)
        self.length[self.ids] = self.lengths
        #: For the next LIMIT bits: the id and the length of its code.
        table = np.repeat(self.ids * 32 + self.lengths, steps)
        self.table = np.pad(table, (0, 2**LIMIT - len(table)))

    def pack(self, ids, ends):
        """Bytes, byte ends and checkpoints of the id runs that end at ``ends``."""
        lengths = self.length[ids]
        bits = np.cumsum(lengths)
        starts = np.concatenate(([0], ends[:-1]))
        before = np.concatenate(([0], bits))[starts]
        own_bits = np.concatenate(([0], bits))[ends] - before
        byte_ends = np.cumsum((own_bits + 7) // 8)
        shift = np.concatenate(([0], byte_ends[:-1])) * 8 - before
        at = bits - lengths + np.repeat(shift, ends - starts)
        word, offset = at >> 5, (at & 31).astype(np.uint64)
        value = self.code[ids] << (np.uint64(64) - offset - lengths.astype(np.uint64))
        size = int(byte_ends[-1]) // 4 + 3 if len(byte_ends) else 0
        # The bits of different codes do not overlap: sums of halves below 2^32 are exact in a double.
        packed = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=size)
        packed[1:] += np.bincount(word, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)[:-1]
        data = packed.astype(np.uint64).astype(">u4").tobytes()
        marks = [at[a:b:STEP] - 8 * s for a, b, s in zip(starts, ends, np.concatenate(([0], byte_ends[:-1])))]
        return data, byte_ends, marks

    def unpack(self, data, positions, counts):
        """Ids of segments of at most ``STEP`` ids at bit ``positions``, one after the other."""
        raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        order = np.argsort(-counts, kind="stable")
        where = (np.cumsum(counts) - counts)[order]
        at, left = positions[order].astype(np.int64), counts[order]
        out = np.zeros(int(counts.sum()), dtype=np.uint32)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step))  # segments with more than ``step`` ids
            at, where = at[:live], where[:live]
            peek = (window[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & np.uint32(2**LIMIT - 1)
            found = self.table[peek]
            out[where + step] = found >> 5
            at = at + (found & 31)
        return out


BLOCKS = (
    "bucket int, seq int, start long, n long, doc_ids array<long>, counts array<long>, "
    "byte_ends array<long>, marks array<long>, payload binary"
)


def write_tokens(encoded, dtype, folder):
    """Write ``encoded`` (see ``encode``) to ``folder`` in ascending order of ``doc_id``, nulls first.

    Rows with equal ids are ordered by their number of ids and then by their bytes, so that reruns
    agree.  Bounds between buckets are quantiles of the ids; only coded documents are shuffled.
    """
    spark = encoded.sparkSession
    counts = id_counts(encoded, dtype).toPandas()  # one row per id of the vocabulary
    book = CodeBook(counts["id"].to_numpy(), code_lengths(counts["n"].to_numpy()))
    spark.createDataFrame(
        [(int(i), int(n)) for i, n in zip(book.ids, book.lengths)], "id long, length int"
    ).coalesce(1).write.parquet(f"{folder}/codes")
    buckets = 4 * partitions(spark)
    cuts = encoded.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def code(batches):
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                sizes = np.asarray(pc.binary_length(part.column(1)), dtype=np.int64) // np.dtype(dtype).itemsize
                data, ends, marks = book.pack(_joined(part.column(1), dtype), np.cumsum(sizes))
                firsts = np.concatenate(([0], ends[:-1]))
                ids = part.column(0)
                bucket = np.searchsorted(bounds, np.asarray(pc.fill_null(ids, np.iinfo(np.int64).min)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket, pa.int32()), ids, pa.array(sizes, pa.int64()),
                    pa.array([data[a:b] for a, b in zip(firsts, ends)], pa.binary()),
                    pa.array([m.tolist() for m in marks], pa.list_(pa.int64())),
                ], ["bucket", "doc_id", "n", "payload", "marks"])

    coded = encoded.mapInArrow(code, "bucket int, doc_id long, n long, payload binary, marks array<long>")
    sorted_rows = coded.repartition("bucket").sortWithinPartitions(
        "bucket", F.col("doc_id").asc_nulls_first(), "n", "payload"
    )
    sorted_rows.mapInArrow(_blocks, BLOCKS).write.parquet(f"{folder}/blocks")


def _blocks(batches):
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 4 + [pa.binary()]
    bucket, seq, start, size, rows = None, 0, 0, 0, []

    def closed():
        row = [bucket, seq, start, size, [r["doc_id"] for r in rows], [r["n"] for r in rows],
               np.cumsum([len(r["payload"]) for r in rows]).tolist(), [m for r in rows for m in r["marks"]],
               b"".join([r["payload"] for r in rows])]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    for batch in batches:
        for part in slices(batch, 3):
            for r in part.to_pylist():
                if rows and (r["bucket"] != bucket or size + r["n"] > BLOCK):
                    yield closed()
                    seq, start, size, rows = seq + 1, start + size, 0, []
                if r["bucket"] != bucket:
                    bucket, seq, start = r["bucket"], 0, 0
                size += r["n"]
                rows.append(r)
    if rows:
        yield closed()


def read_tokens(spark, folder):
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (``<u4`` bytes)."""
    codes = spark.read.parquet(f"{folder}/codes").toPandas()
    book = CodeBook(codes["id"].to_numpy(), codes["length"].to_numpy())
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = sorted((r["bucket"], r["n"]) for r in blocks.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([n for _, n in sizes])  # one number per bucket of the writer
    bases = {b: int(end - n) for (b, n), end in zip(sizes, ends)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, 8):
                yield from _read(part, book, bases)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _read(part, book, bases):
    rows = part.to_pylist()
    shift, at, sizes = 0, [], []
    for r in rows:
        own, ends = np.array(r["counts"]), np.array(r["byte_ends"])
        segments = -(-own // STEP)
        firsts = np.repeat(np.concatenate(([0], ends[:-1])), segments)
        at.append(np.array(r["marks"]) + 8 * (firsts + shift))
        full = np.full(int(segments.sum()), STEP)
        full[np.cumsum(segments) - 1] = own - (segments - 1) * STEP
        sizes.append(full)
        shift += len(r["payload"])
    ids = book.unpack(b"".join([r["payload"] for r in rows]), np.concatenate(at), np.concatenate(sizes))
    data, done = ids.astype("<u4").tobytes(), 0
    doc_ids, starts, counts, out = [], [], [], []
    for r in rows:
        start = bases[r["bucket"]] + r["start"]
        for doc_id, n in zip(r["doc_ids"], r["counts"]):
            doc_ids.append(doc_id)
            starts.append(start)
            counts.append(n)
            out.append(data[4 * done : 4 * (done + n)])
            start, done = start + n, done + n
    yield pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary()),
    ], ["doc_id", "start", "n_tokens", "ids"])


def token_files(docs, path, folder=None, end_id=1, id_col="doc_id", text_col="text"):
    """Encode, write and read back whole texts; returns what ``read_tokens`` does.

    * A null or empty text has the end id alone; the tokenizer's own rules hold for all else.
    * A null id comes before all others; rows with equal ids keep one order in every run.
    * Other columns, whatever their names, are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    encoded = cut_lineage(encode(docs, path, end_id, id_col, text_col), compression="zstd")
    write_tokens(encoded, encoder(path).dtype, folder)
    return read_tokens(spark, folder)
