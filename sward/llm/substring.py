"""Removal of passages that occur earlier, by difference-cover anchors.

A passage is ``WINDOW`` consecutive words.  Anchors of ``ANCHOR`` words are hashed only where the word
position modulo ``PERIOD`` is in ``COVER``.  Every difference modulo ``PERIOD`` is one between two
members of the cover, so any two equal passages hold an equal anchor at the same distance from their
starts.  Anchors that occur once are dropped; around the others, passages are extended to ``WINDOW``
words and the first of equal ones is found.  Tasks settle what repeats among their own rows and send
one row for each other hash, so that a passage of many documents is never gathered anywhere.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sward.llm.common import Polynomial, Words, partitions, seeded, slices, text_or_empty

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a hash that travel besides its owner.  Anchors may collide (that only adds candidates);
#: passages are compared by 96 bits.
ANCHOR_BYTES = 4
#: Hashes a task holds before it sends them.
HELD = 1 << 22

#: One row from a task to an owner: keys of documents, hashes, and the document and position of each.
SENT = (
    "owner int, k1 binary, k2 binary, hashes binary, docs binary, positions binary, "
    "known binary, sure_docs binary, sure_positions binary"
)
FOUND = "k1 long, k2 long, position int"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.int32()]

_LETTERS = [seeded(s, 256) for s in (1, 2)]
_WORD_SUMS = [Polynomial(s) for s in (3, 4)]
_PASSAGE_SUMS = [Polynomial(s) for s in (5, 6)]


def _planes(values, size):
    """Little-endian numbers of ``size`` bytes, first all low bytes: high zeros compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(data, size):
    count = len(data) // size
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(size, count).T
    return out.reshape(-1).view("<u8")


def _window_hashes(words, width, starts, seeds):
    """Hashes of ``width`` words from each of ``starts``."""
    return [
        _PASSAGE_SUMS[i].ranges(words.hashes(_WORD_SUMS[i], _LETTERS[i]), starts, starts + width) for i in range(seeds)
    ]


def _places(words, width):
    """Document, position and word index of each window of ``width`` words inside one text."""
    counts = np.diff(words.bounds)
    room = np.maximum(counts - width + 1, 0)
    docs = np.repeat(np.arange(len(counts)), room)
    positions = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
    return docs, positions, words.bounds[docs] + positions


def _top(high, bits):
    return (high >> np.uint64(64 - bits)).astype(np.int64)


class _Sender:
    """Gathers hashed places and makes rows to owners.

    ``first_stays``: of equal hashes the place that is first in order is not itself found.
    """

    def __init__(self, owner_bits, hash_bytes, first_stays):
        self.owner_bits, self.hash_bytes, self.first_stays = owner_bits, hash_bytes, first_stays
        self.parts, self.held = [], 0
        self.names = [f.split()[0] for f in SENT.split(", ")]
        self.types = [pa.int32()] + [pa.binary()] * 8

    def add(self, keys, high, low, docs, positions):
        """``keys``: two arrays for the documents that ``docs`` counts through."""
        self.parts.append((*keys, high, low, docs, positions))
        self.held += len(high)
        return self.held >= HELD

    def rows(self):
        if not self.held:
            self.parts = []
            return
        shift = np.cumsum([0] + [len(p[0]) for p in self.parts])
        k1, k2, high, low = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        docs = np.concatenate([p[4] + s for p, s in zip(self.parts, shift)])
        positions = np.concatenate([p[5] for p in self.parts])
        self.parts, self.held = [], 0
        by_key = np.lexsort((k2, k1))
        rank_doc = np.empty(len(k1), dtype=np.int64)
        rank_doc[by_key] = np.arange(len(k1))
        rank = np.zeros(len(k1), dtype=np.int64)
        rank[by_key[1:]] = np.cumsum((np.diff(k1[by_key]) != 0) | (np.diff(k2[by_key]) != 0))
        order = np.lexsort((positions, rank[docs], low, high))
        high, low, docs, positions = high[order], low[order], docs[order], positions[order]
        new = np.ones(len(high), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        firsts = np.flatnonzero(new)
        many = np.diff(np.append(firsts, len(high))) > 1
        repeated = np.repeat(many, np.diff(np.append(firsts, len(high))))
        if self.first_stays:
            first = firsts[np.cumsum(new) - 1]  # a document given twice does not repeat itself
            own = (rank[docs] == rank[docs[first]]) & (positions == positions[first])
            sure, open_, known = ~own, new, np.zeros(len(high), dtype=bool)
        else:
            sure, open_, known = repeated, new & ~repeated, new & repeated
        owners = _top(high, self.owner_bits)
        sure_at = np.flatnonzero(sure)
        sure_owner = docs[sure_at] % (1 << self.owner_bits)  # needs no owner: dealt evenly
        grouped = np.argsort(sure_owner, kind="stable")
        sure_at, sure_owner = sure_at[grouped], sure_owner[grouped]
        open_at, known_at = np.flatnonzero(open_), np.flatnonzero(known)
        edges = np.arange((1 << self.owner_bits) + 1)
        cuts = [np.searchsorted(o, edges) for o in (owners[open_at], owners[known_at], sure_owner)]
        for owner in range(1 << self.owner_bits):
            a, b, c = (at[cut[owner] : cut[owner + 1]] for at, cut in zip((open_at, known_at, sure_at), cuts))
            if len(a) + len(b) + len(c) == 0:
                continue
            used, within = np.unique(rank_doc[np.concatenate((docs[a], docs[c]))], return_inverse=True)
            used = by_key[used]  # in order of their keys, whose differences are small
            yield self._batch([
                int(owner), _planes(np.diff(k1[used], prepend=0).view(np.uint64), 8), _planes(k2[used], 4), self._hashes(high[a], low[a]), _planes(within[: len(a)], 4),
                _planes(positions[a], 4), self._hashes(high[b], low[b]), _planes(within[len(a) :], 4), _planes(positions[c], 4),
            ])

    def _hashes(self, high, low):
        if self.hash_bytes <= 8:
            kept = (high << np.uint64(self.owner_bits)) >> np.uint64(64 - 8 * self.hash_bytes)
            return _planes(kept, self.hash_bytes)
        return _planes(high, 8) + _planes(low, self.hash_bytes - 8)

    def _batch(self, row):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, self.types)], self.names)


def _unhash(data, size):
    if size <= 8:
        values = _unplanes(data, size)
        return values, np.zeros(len(values), dtype=np.uint64)
    count = len(data) // size
    return _unplanes(data[: 8 * count], 8), _unplanes(data[8 * count :], size - 8)


def _owner(hash_bytes, first_stays):
    """All rows of one owner to the places whose hash occurs again (or earlier, if the first stays)."""

    def run(table: pa.Table) -> pa.Table:
        out, parts, known = [], [], [np.zeros(0, np.uint64)]
        for r in table.to_pylist():
            k1, k2 = np.cumsum(_unplanes(r["k1"], 8)).view(np.int64), _unplanes(r["k2"], 4).astype(np.int64)
            docs = _unplanes(r["sure_docs"], 4).astype(np.int64)
            out.append((k1[docs], k2[docs], _unplanes(r["sure_positions"], 4)))
            docs = _unplanes(r["docs"], 4).astype(np.int64)
            parts.append((*_unhash(r["hashes"], hash_bytes), k1[docs], k2[docs], _unplanes(r["positions"], 4)))
            known.append(_unhash(r["known"], hash_bytes)[0])
        high, low, k1, k2, positions = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((positions, k2, k1, low, high)) if first_stays else np.argsort(high, kind="stable")
        high, low = high[order], low[order]
        k1, k2, positions = k1[order], k2[order], positions[order]
        new = np.ones(len(high), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        firsts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        if first_stays:
            first = firsts[run]
            found = (k1 != k1[first]) | (k2 != k2[first]) | (positions != positions[first])
        else:
            found = (np.diff(np.append(firsts, len(high))) > 1)[run] | np.isin(high, np.concatenate(known))
        out.append((k1[found], k2[found], positions[found]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, _FOUND_TYPES)], ["k1", "k2", "position"])

    return run


def _anchors(owner_bits):
    """Batches of ``k1, k2, text, no_id`` to hashed anchors for owners."""
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(batches):
        sender = _Sender(owner_bits, ANCHOR_BYTES, first_stays=False)
        for batch in batches:
            for part in slices(batch, 2):
                words = Words(part.column(2))
                docs, positions, at = _places(words, ANCHOR)
                # A passage must fit: anchors of shorter texts match nothing.
                use = cover[positions % PERIOD] & (np.diff(words.bounds) >= WINDOW)[docs]
                docs, positions = docs[use], positions[use]
                (high,) = _window_hashes(words, ANCHOR, at[use], 1)
                keys = [np.asarray(part.column(i)) for i in (0, 1)]
                # Only the bytes that travel tell anchors apart, here as at the owner.
                bits = np.uint64(64 - owner_bits - 8 * ANCHOR_BYTES)
                high = (high >> bits) << bits
                if sender.add(keys, high, np.zeros(len(high), np.uint64), docs, positions):
                    yield from sender.rows()
        yield from sender.rows()

    return run


def _passages(owner_bits):
    """Batches of ``k1, k2, text, no_id, positions`` of repeated anchors to hashed passages for owners."""

    def run(batches):
        sender = _Sender(owner_bits, 12, first_stays=True)
        for batch in batches:
            for part in slices(batch, 2):
                words = Words(part.column(2))
                docs, positions, at = _places(words, WINDOW)
                use = _near(words, part.column(4))[at]
                docs, positions = docs[use], positions[use]
                high, low = _window_hashes(words, WINDOW, at[use], 2)
                keys = [np.asarray(part.column(i)) for i in (0, 1)]
                if sender.add(keys, high, low & np.uint64(0xFFFFFFFF), docs, positions):
                    yield from sender.rows()
        yield from sender.rows()

    return run


def _marks(words, lists):
    """Word indices of the listed positions of each text."""
    counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    positions = np.asarray(lists.flatten(), dtype=np.int64)
    return np.repeat(words.bounds[:-1], counts) + positions


def _near(words, lists):
    """Whether a passage that starts at a word may hold one of the listed anchors."""
    change = np.zeros(len(words.starts) + PERIOD + 2, dtype=np.int64)
    at = _marks(words, lists)
    np.add.at(change, np.maximum(at - (PERIOD - 1), 0), 1)
    np.add.at(change, at + 1, -1)
    return np.cumsum(change)[: len(words.starts)] > 0


def _keep(batches):
    """Batches of ``k1, k2, text, no_id, positions`` of later passages to the texts that are left."""
    for batch in batches:
        for part in slices(batch, 2):
            words = Words(part.column(2))
            change = np.zeros(len(words.starts) + WINDOW + 1, dtype=np.int64)
            at = _marks(words, part.column(4))
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            removed = np.cumsum(change)[: len(words.starts)] > 0
            gone = np.concatenate(([0], np.cumsum(removed)))[words.bounds]
            kept = np.flatnonzero(~removed)
            bounds = np.searchsorted(kept, words.bounds)
            first = np.zeros(len(kept), dtype=bool)
            first[bounds[:-1][np.diff(bounds) > 0]] = True
            sizes = words.ends[kept] - words.starts[kept]
            stops = np.cumsum(sizes + ~first)  # a space before each word but a text's first
            data = np.full(int(stops[-1]) if len(stops) else 0, 32, dtype=np.uint8)
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            data[np.repeat(stops - sizes, sizes) + within] = words.data[np.repeat(words.starts[kept], sizes) + within]
            offsets = np.concatenate(([0], stops))[bounds]
            texts = pa.Array.from_buffers(
                pa.large_string(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays([
                pc.if_else(part.column(3), None, part.column(0)), pa.array(np.diff(words.bounds), pa.int64()), pa.array(np.diff(gone), pa.int64()),
                texts.cast(pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs, id_col="doc_id", text_col="text"):
    """``doc_id, n_words, n_removed, kept`` of each document: the words outside earlier-seen passages.

    A word goes if a passage over it starts earlier too: in a document with a smaller id, or before in
    the same one.  Passages are judged on the input, not on what is left.

    * A null or empty text has no words; texts below ``WINDOW`` words lose none.
    * A null id is larger than any other.  Rows with equal ids and different texts are ordered by a
      hash of the text; rows equal in both are one document given repeatedly, with equal results.
    * Other columns, whatever their names, are not read.  An empty table gives an empty result.
    """
    owner_bits = int(np.ceil(np.log2(2 * partitions(docs.sparkSession))))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k1"), F.shiftrightunsigned(F.xxhash64(text_or_empty(text_col)), 32).alias("k2"),
        text_or_empty(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"),
    )

    def places(sent, hash_bytes, first_stays):
        found = sent.groupBy("owner").applyInArrow(_owner(hash_bytes, first_stays), FOUND)
        return found.groupBy("k1", "k2").agg(F.collect_set("position").alias("positions"))

    anchors = places(rows.mapInArrow(_anchors(owner_bits), SENT), ANCHOR_BYTES, False)
    passages = rows.join(anchors, ["k1", "k2"]).mapInArrow(_passages(owner_bits), SENT)
    later = places(passages, 12, True)
    return rows.join(later, ["k1", "k2"], "left").mapInArrow(
        _keep, "doc_id long, n_words long, n_removed long, kept string"
    )
