"""Alignment of two tokenizers' ids over the same bytes, and how often id pairs meet in a corpus.

Ends of tokens, in bytes, are the keys of one dictionary for each tokenizer; the keys that both hold
cut a text into groups, and every id of the one is linked with every id of the other in its group.
Both tokenizers always cut before a space that follows a visible character, so texts are aligned in
units between such places, and a unit that returns is aligned once.
"""

import re
from array import array
from collections import Counter
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.llm.bytelevel import SAFE, ByteLevelTokenizer, windows
from sward.llm.common import quoted, slices
from sward.llm.remember import no_collector
from sward.session import cut_lineage

MARK = "▁"
#: Without white space before a space all spaces are cuts.
BLANKS = re.compile(r"\s ")
#: Bytes of text of a block (one document at least), the unit in which counts are asked for.  A task holds the
#: links of all its occurrences at a time, some fifty times as many bytes.
BLOCK = 1 << 20
#: Links of a group that are listed one by one; in longer ones equal ids are counted first.
SHORT = 64
#: New units that are aligned together, and the most that are aligned one by one when that fails.
RUN, ALONE = 1024, 32
#: Bytes of pre-tokens that a worker remembers in each of two generations.
WORDS = 16 << 20
#: Bits of the second id in a packed pair.
SHIFT = 32
ALIGNED = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, ends array<long>, at binary, times binary, pairs array<long>, holders array<int>"
)
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_ALIGNERS = {}


def common_slices(ends_a, ends_b):
    """``(a0, a1, b0, b1)`` of each group: the tokens of both between two common ends.

    ``ends_*``: the end of each token, in order.
    """
    at_a = dict(zip(ends_a, count(1)))
    at_b = dict(zip(ends_b, count(1)))
    both = at_a.keys() & at_b.keys()
    a0, b0, out = 0, 0, []
    for end in sorted(both) if len(both) > 1 else both:
        a1, b1 = at_a[end], at_b[end]
        out.append((a0, a1, b0, b1))
        a0, b0 = a1, b1
    return out


class Unit:
    """One aligned unit; ``good`` is false where the bytes of a tokenizer are not those of the unit.

    ``links`` holds packed pairs, ``times`` how often each is linked (nothing: once each).
    """

    __slots__ = ("good", "n_a", "n_b", "n_groups", "n_links", "text", "links", "times")

    def __init__(self, good, n_a, n_b, n_groups, n_links, text, links, times=b""):
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links = good, n_a, n_b, n_groups, n_links
        self.text, self.links, self.times = text, links, times


def aligned_unit(unit, a, b, bytes_a, bytes_b, names):
    """The ``Unit`` of a text with ids ``a`` and ``b``."""
    parts_a, parts_b = [bytes_a[i] for i in a], [bytes_b[i] for i in b]
    if not b"".join(parts_a) == unit.encode() == b"".join(parts_b):
        return Unit(False, len(a), len(b), 0, 0, "", b"")
    texts, links, times = [], [], Counter()
    for a0, a1, b0, b1 in common_slices(accumulate(map(len, parts_a)), accumulate(map(len, parts_b))):
        xs, ys = a[a0:a1], b[b0:b1]
        texts.append(",".join([names[x] for x in xs]) + "|" + ",".join([names[y] for y in ys]))
        if len(xs) * len(ys) <= SHORT:
            links += [x << SHIFT | y for x in xs for y in ys]
        else:
            for x, n in Counter(xs).items():
                for y, m in Counter(ys).items():
                    times[x << SHIFT | y] += n * m
    n_links = len(links) + sum(times.values())
    counts = array("q", [1] * len(links) + list(times.values())).tobytes() if times else b""
    return Unit(True, len(a), len(b), len(texts), n_links, ";".join(texts), array("q", [*links, *times]).tobytes(), counts)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, width=()):
        self.data, self.size = np.empty((1 << 10, *width), dtype=dtype), 0

    def extend(self, values):
        size = self.size + len(values)
        if size > len(self.data):
            data = np.empty((max(size, len(self.data) * 5 // 4), *self.data.shape[1:]), dtype=self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : size] = values
        self.size = size

    def all(self):
        return self.data[: self.size]


class Columns:
    """Aligned units as rows: ``counts`` (``n_a, n_b, n_groups, n_links``; no groups where bytes differ), texts and links.

    ``times`` has how often each pair is linked for the rows where that is not once.
    """

    def __init__(self):
        self.counts, self.text, self.links = Grown(np.int64, (4,)), Grown(np.uint8), Grown(np.int64)
        self.text_ends, self.link_ends = Grown(np.int64), Grown(np.int64)
        self.times = {}

    def __len__(self):
        return self.counts.size

    def add(self, counts, text, text_ends, links, link_ends):
        """Rows whose ``text_ends`` and ``link_ends`` count from the first of them."""
        self.counts.extend(counts)
        self.text_ends.extend(text_ends + self.text.size)
        self.link_ends.extend(link_ends + self.links.size)
        self.text.extend(text)
        self.links.extend(links)

    def add_unit(self, unit):
        if unit.times:
            self.times[len(self)] = np.frombuffer(unit.times, dtype=np.int64)
        text, links = np.frombuffer(unit.text.encode(), dtype=np.uint8), np.frombuffer(unit.links, dtype=np.int64)
        counts = np.array([[unit.n_a, unit.n_b, unit.n_groups, unit.n_links]])
        self.add(counts, text, np.array([len(text)]), links, np.array([len(links)]))

    def add_rows(self, other, rows):
        """Copies of rows of another table."""
        for to, row in enumerate(rows.tolist() if other.times else (), len(self)):
            if row in other.times:
                self.times[to] = other.times[row]
        text, n_text = other.runs(other.text, other.text_ends, rows)
        links, n_links = other.runs(other.links, other.link_ends, rows)
        self.add(other.counts.data[rows], text, np.cumsum(n_text), links, np.cumsum(n_links))

    def runs(self, values, ends, rows):
        """The values of ``rows``, one after the other, and how many each has."""
        last = ends.data[rows]
        first = np.where(rows > 0, ends.data[rows - 1], 0)
        return values.data[_gather(first, last - first)], last - first

    def texts(self):
        offsets = np.concatenate(([0], self.text_ends.all())).astype(np.int32)
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(self.text.all()))

    def unit(self, row):
        one = np.array([row])
        times = self.times[row].tobytes() if row in self.times else b""
        text, links = self.runs(self.text, self.text_ends, one)[0], self.runs(self.links, self.link_ends, one)[0]
        counts = self.counts.data[row].tolist()
        return Unit(counts[2] > 0, *counts, text.tobytes().decode(), links.tobytes(), times)


class Known(dict):
    """Rows by unit, in two generations of about ``limit`` bytes; units of over ``longest`` characters are not found again."""

    #: About what a unit's key, its place in a dictionary and its row take beside their contents.
    OVERHEAD = 300

    def __init__(self, limit, longest=64):
        super().__init__()
        self.limit, self.longest = limit, longest
        self.old, self.columns, self.old_columns, self.letters = {}, Columns(), Columns(), 0

    def turn(self):
        """Make the young generation the old one where it is full; rows are those of the young one from here on."""
        held = self.OVERHEAD * len(self.columns) + 2 * self.letters + self.columns.text.size + 8 * self.columns.links.size
        if held > self.limit:
            self.old, self.old_columns = dict(self), self.columns
            self.clear()
            self.columns, self.letters = Columns(), 0

    def name(self, units):
        """Give the last rows their names."""
        self.update(zip(units, range(len(self.columns) - len(units), len(self.columns))))
        self.letters += sum(map(len, units))
        for unit in units:
            if len(unit) > self.longest:
                del self[unit]


class TokenBytes(list):
    """Bytes of each id, and their numbers as an array."""

    def __init__(self, found):
        super().__init__(found)
        self.sizes = np.array([len(b) for b in self], dtype=np.int64)


class Names(list):
    """Decimal text of each id, and the same as rows of an array with one byte more than any needs."""

    def __init__(self, count):
        super().__init__(map(str, range(count)))
        self.sizes = np.array([len(n) for n in self], dtype=np.int64)
        self.letters = np.array(self, dtype=f"S{int(self.sizes.max(initial=0)) + 1}").view(np.uint8).reshape(count, -1)


def aligned_run(units, flat_a, flat_b, bytes_a, bytes_b, names):
    """The rows (see ``Columns.add``) of units with the ids of their joined text, or None.

    None unless both tokenizers keep all bytes and end a token with each unit, and all groups are short.
    """
    text = "".join(units).encode()
    if not b"".join([bytes_a[i] for i in flat_a]) == text == b"".join([bytes_b[i] for i in flat_b]):
        return None
    ids_a, ids_b = np.array(flat_a, dtype=np.int64), np.array(flat_b, dtype=np.int64)
    size_a, size_b = bytes_a.sizes[ids_a], bytes_b.sizes[ids_b]
    ends_a, ends_b, own = np.cumsum(size_a), np.cumsum(size_b), np.cumsum([len(u.encode()) for u in units])
    cut = np.zeros(len(text) + 1, dtype=np.int8)
    cut[ends_a] += 1
    cut[ends_b] += 1
    if not (size_a.all() and size_b.all()) or (cut[own] != 2).any():
        return None
    stop_a, stop_b = (np.flatnonzero(cut[ends] == 2) + 1 for ends in (ends_a, ends_b))
    in_a, in_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    sizes = in_a * in_b
    if (sizes > SHORT).any():
        return None
    width = np.repeat(in_b, sizes)
    within = np.arange(len(width)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    across = within // width
    x, y = np.repeat(stop_a - in_a, sizes) + across, np.repeat(stop_b - in_b, sizes) + within - across * width
    links = ids_a[x] << SHIFT | ids_b[y]
    groups = np.searchsorted(ends_a[stop_a - 1], own, side="right")  # groups up to the end of each unit
    link_ends = np.cumsum(sizes)[groups - 1]
    # Ids in the order of the text: those of a group by the one, then by the other tokenizer.
    at_a = np.arange(len(ids_a)) + np.repeat(stop_b - in_b, in_a)
    at_b = np.arange(len(ids_b)) + np.repeat(stop_a, in_b)
    ids, marks = np.empty(len(ids_a) + len(ids_b), dtype=np.int64), np.full(len(ids_a) + len(ids_b), ord(","), dtype=np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    marks[at_a[stop_a - 1]], marks[at_b[stop_b - 1]] = ord("|"), ord(";")
    last = at_b[stop_b[groups - 1] - 1]
    letters, room = names.letters[ids], names.sizes[ids]
    letters[np.arange(len(ids)), room] = marks
    room += 1
    room[last] -= 1
    written = letters[np.arange(letters.shape[1]) < room[:, None]]
    counts = [np.diff(n, prepend=0) for n in (stop_a[groups - 1], stop_b[groups - 1], groups, link_ends)]
    return np.stack(counts, axis=1), written, np.cumsum(room)[last], links, link_ends


def aligned_units(units, all_a, all_b, bytes_a, bytes_b, names):
    """``aligned_unit`` of many units, worked out together; None where ``aligned_run`` is."""
    rows = aligned_run(units, *[list(chain.from_iterable(ids)) for ids in (all_a, all_b)], bytes_a, bytes_b, names)
    if rows is None:
        return None
    out = Columns()
    out.add(*rows)
    return [out.unit(row) for row in range(len(out))]


class Aligner:
    """Both tokenizers of a worker, and the units it remembers."""

    def __init__(self, path_a, path_b):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.a = ByteLevelTokenizer(path_a, plain=True)
        self.bytes_a = TokenBytes(self.a.token_bytes())
        proto = sentencepiece_model_pb2.ModelProto()
        self.b = SentencePieceProcessor(model_file=path_b)
        proto.ParseFromString(self.b.serialized_model_proto())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.escape_whitespaces and rules.add_dummy_prefix):
            raise ValueError("only models that keep the text and put a space before it are supported")
        self.space = self.b.piece_to_id(MARK)
        if self.space == self.b.unk_id():
            raise ValueError("only models with a piece for the space are supported")
        found = []
        for i, piece in enumerate(proto.pieces):
            if piece.piece.lstrip(MARK).find(MARK) >= 0:
                raise ValueError(f"piece with a mark inside: {piece.piece}")
            text = piece.piece
            found.append(bytes([int(text[1:-1], 16)]) if self.b.is_byte(i) else text.replace(MARK, " ").encode())
        self.bytes_b = TokenBytes(found)
        self.names = Names(max(len(self.bytes_a), len(self.bytes_b)))
        self.words, self.old_words, self.letters = {}, {}, 0
        # Each byte's character, and a space, which is not among them, for the byte that no text has.
        self.alphabet = np.array([ord(self.a.alphabet[b]) for b in range(255)] + [ord(" ")], dtype="<u2")
        self.known = Known(limit=96 << 20)

    def _learn(self, words):
        """Remember the ids of new pre-tokens, in two generations of about ``WORDS`` bytes."""
        if 300 * len(self.words) + 2 * self.letters > WORDS:
            self.words, self.old_words, self.letters = {}, self.words, 0
        new = [w for w in words if w not in self.old_words]
        data = np.frombuffer("\udcff".join(new).encode(errors="surrogateescape"), dtype=np.uint8)
        spelled = self.alphabet[data].tobytes().decode("utf-16-le").split(" ")
        tokenize = self.a.tokenizer.model.tokenize
        self.words.update((w, self.old_words[w]) for w in words if w in self.old_words)
        self.words.update(zip(new, [tuple([t.id for t in tokenize(w)]) for w in spelled]))
        self.letters += sum(map(len, words))

    def _ids_a(self, text):
        ids = []
        for found in self.a.pretokens(text):
            if isinstance(found, list):
                distinct = set(found)
                new = distinct.difference(self.words)
                if new:
                    self._learn(new)
                    if not distinct <= self.words.keys():  # a generation has ended
                        self._learn(distinct.difference(self.words))
                ids.extend(chain.from_iterable(map(self.words.__getitem__, found)))
            else:
                ids.extend(self.a.ids(found))
        return ids

    def units(self, names):
        """A row of ``known.columns`` for each different unit of a block; each begins with a space."""
        known = self.known
        known.turn()
        rows = np.array([known.get(n, -1) for n in names], dtype=np.int64)
        missing = [(i, known.old.get(names[i], -1)) for i in np.flatnonzero(rows < 0).tolist()]
        again = [(i, row) for i, row in missing if row >= 0]
        if again:
            at, old = np.array(again, dtype=np.int64).T
            rows[at] = np.arange(len(known.columns), len(known.columns) + len(at))
            known.columns.add_rows(known.old_columns, old)
            known.name([names[i] for i in at.tolist()])
        new = [i for i, row in missing if row < 0]
        # Joined units are cut again where they meet if the first of them ends visibly.
        solid = [i for i in new if not names[i][-1].isspace()]
        loose = [i for i in new if names[i][-1].isspace()]
        rows[solid + loose] = np.arange(len(known.columns), len(known.columns) + len(new))
        fresh = [names[i] for i in solid + loose]
        for at in range(0, len(solid), RUN):
            self._align(fresh[at : min(at + RUN, len(solid))])
        for unit in fresh[len(solid) :]:
            self._align([unit])
        known.name(fresh)
        return rows

    def _align(self, units):
        """Add the rows of units that all end visibly, or of a single one."""
        found = None
        if len(units) > 1:
            text = "".join(units)
            rules = self.bytes_a, self.bytes_b, self.names
            # The model puts the first space back.
            found = aligned_run(units, self._ids_a(text), self.b.encode(text[1:]), *rules)
        if found is not None:
            self.known.columns.add(*found)
        elif len(units) > ALONE:
            # In shorter runs, so that a unit of the uncommon kind costs its neighbours little.
            for half in (units[: len(units) // 2], units[len(units) // 2 :]):
                self._align(half)
        else:
            for unit in units:
                # It gives nothing at all for an empty text.
                b = self.b.encode(unit[1:]) or [self.space]
                self.known.columns.add_unit(aligned_unit(unit, self._ids_a(unit), b, self.bytes_a, self.bytes_b, self.names))


def aligner(path_a, path_b):
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _gather(starts, sizes):
    """Positions of the runs that begin at ``starts`` and have ``sizes`` elements, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut_units(text):
    """Units of a text that begins with a space, without the space that each begins with."""
    if BLANKS.search(text):
        return [unit[1:] for unit in SAFE.split(text)]
    return text[1:].split(" ")


def _block(number, ids, texts, pair_of):
    found, sizes = [], []
    for text in texts:
        before = len(found)
        for window in windows(" " + text) if text else ():
            found += cut_units(window)
        sizes.append(len(found) - before)
    coded = pa.array(found, pa.string()).dictionary_encode()
    occurrences, sizes = np.asarray(coded.indices).astype(np.int64), np.array(sizes, dtype=np.int64)
    rows = pair_of.units([" " + unit for unit in coded.dictionary.to_pylist()])
    table = pair_of.known.columns
    counts = table.counts.data[rows]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    spoiled = np.bincount(doc[(counts[:, 2] == 0)[occurrences]], minlength=len(sizes)) > 0
    kept = ~spoiled[doc]
    occurrences, doc = occurrences[kept], doc[kept]
    edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), table.texts().take(pa.array(rows)).take(pa.array(occurrences)))
    sums = np.concatenate((np.zeros((1, 4), dtype=np.int64), np.cumsum(counts[occurrences], axis=0)))
    totals = (sums[edges[1:]] - sums[edges[:-1]]).T
    packed, own = table.runs(table.links, table.link_ends, rows)
    weights = None
    for row, first in zip(rows.tolist(), (np.cumsum(own) - own).tolist()) if table.times else ():
        if row in table.times:
            if weights is None:
                weights = np.ones(len(packed), dtype=np.int64)
            weights[first : first + len(table.times[row])] = table.times[row]
    # Equal pairs are found by hashing, and only different ones sorted.
    named = pa.array(packed).dictionary_encode()
    pairs = np.asarray(named.dictionary)
    order = np.argsort(pairs)
    place = np.empty(len(pairs), dtype=np.int64)
    place[order] = np.arange(len(pairs))
    pairs, code = pairs[order], place[np.asarray(named.indices)]
    where = _gather((np.cumsum(own) - own)[occurrences], own[occurrences])
    keys = np.repeat(doc, own[occurrences]) * len(pairs) + code[where] if len(where) else where
    if weights is None:
        keys.sort()
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(heads, append=len(keys))
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.add.reduceat(weights[where][order], heads) if len(heads) else np.zeros(0, np.int64)
    keys = keys[heads]
    at, of = (keys % len(pairs), keys // len(pairs)) if len(keys) else (keys, keys)
    holders = np.bincount(at, minlength=len(pairs))
    place = np.cumsum(holders > 0) - 1  # pairs only of documents without tokens are left out
    ends = np.cumsum(np.bincount(of, minlength=len(sizes)))
    row = [
        number, ids, *totals, pc.binary_join(lists, ";").to_pylist(), ends,
        place[at].astype("<u4").tobytes(), times.astype("<i8").tobytes(), pairs[holders > 0], holders[holders > 0],
    ]
    longs = pa.list_(pa.int64())
    types = [pa.int64()] + [longs] * 5 + [pa.list_(pa.string()), longs, pa.binary(), pa.binary(), longs, pa.list_(pa.int32())]
    names = [f.strip().split()[0] for f in ALIGNED.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)


def align(docs, path_a, path_b, id_col="doc_id", text_col="text"):
    """Blocks of aligned documents; ``documents_of`` and ``links_of`` read them, ``scored`` counts over them.

    ``path_a`` is a byte-level BPE file, ``path_b`` a SentencePiece model that puts a space before a
    text; both read that space and the text.  A row is a block: arrays with one entry per document
    (``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of both in each group), its id pairs packed in
    ``pairs`` with the number of documents that hold each, and for each document the places of its
    pairs and how often each occurs.

    * Null or empty texts, and those whose bytes a tokenizer changes (the mark U+2581 is read as a
      space), have no tokens: zeros and an empty string.
    * Every row is a document of its own; rows may repeat and ids be null.  Other columns are not read.
    * Long texts are cut in windows; one unit of megabytes is aligned whole.  No rows, no blocks.
    """

    def run(batches):
        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                texts = [t or "" for t in part.column(1).to_pylist()]
                with no_collector():
                    block = _block(number, part.column(0).to_pylist(), texts, both)
                yield block
                number += 1

    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return picked.mapInArrow(run, ALIGNED)


def documents_of(aligned):
    """One row per document: ``doc_id``, numbers of tokens, groups and links, and ``groups``."""
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    return aligned.select(F.explode(F.arrays_zip(*fields)).alias("d")).select("d.*")


def links_of(aligned):
    """One row per document and linked id pair: ``doc_id``, ``a``, ``b``, ``times``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, times = np.frombuffer(row["at"], "<u4"), np.frombuffer(row["times"], "<i8")
                pair = np.array(row["pairs"], dtype=np.int64)[at]
                sizes = np.diff(row["ends"], prepend=0)
                ids = pa.array(row["doc_id"], pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                columns = [ids, pa.array(pair >> SHIFT), pa.array(pair & (1 << SHIFT) - 1), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "times"])

    picked = aligned.select("doc_id", "ends", "at", "times", "pairs")
    return picked.mapInArrow(run, "doc_id long, a long, b long, times long")


def pair_counts(aligned):
    """``pair``, ``n`` (documents that hold it linked) and ``best``: no pair with its first id has more.

    Blocks send one number per pair, added up on the map side, so a pair in every document costs one
    row per task.
    """
    held = aligned.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("n"))
    first = Window.partitionBy(F.shiftright("pair", SHIFT))  # as many rows as the other vocabulary at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(first))


def scored(aligned):
    """One row per document: its counts, ``n_best`` (links whose pair is ``best``), ``count_sum``, ``groups``.

    Each block asks once for each of its pairs and gets the counts back; documents do not travel with
    their links, and texts not at all.
    """
    blocks = cut_lineage(aligned, compression="zstd")
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    value = (F.col("n") * 2 + F.col("best").cast("long")).alias("value")
    answers = (
        asked.join(pair_counts(blocks).select("pair", value), "pair")
        .groupBy("block").agg(F.collect_list(F.struct("at", "value")).alias("answers"))
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scores(batch.slice(i, 1))

    return blocks.drop("pairs", "holders").join(answers, "block", "left").mapInArrow(run, SCORED)


def _scores(row):
    def flat(name):
        return row.column(name).flatten()

    at = np.frombuffer(row.column("at")[0].as_py(), "<u4")
    times = np.frombuffer(row.column("times")[0].as_py(), "<i8")
    answers = flat("answers")
    value = np.zeros(len(answers), dtype=np.int64)
    value[np.asarray(answers.field("at"))] = np.asarray(answers.field("value"))
    ends = np.asarray(flat("ends"))

    def total(values):
        sums = np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], ends))]
        return pa.array(np.diff(sums), pa.int64())

    counts = [flat(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    scores = [total(times * (value[at] & 1)), total(times * (value[at] >> 1))]
    return pa.RecordBatch.from_arrays([*counts, *scores, flat("groups")], [f.split()[0] for f in SCORED.split(", ")])
