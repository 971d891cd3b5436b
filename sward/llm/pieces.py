"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton, and decoding.

A text's spaces become the mark U+2581, with one put in front where the model asks for it.  Of all
ways to cut the text into pieces the one with the largest sum of stored scores is taken; the
automaton reports, at each position, every piece that ends there by following its output links.
"""

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sward.llm.common import quoted, unused
from sward.llm.remember import Recent, give_back

MARK = "▁"
#: Pieces never hold a mark after another character, so the best cut of a text is that of its units.
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Score of an unknown character, below that of the worst piece.
UNKNOWN, NEVER = -10.0, float("-inf")
#: Bytes of units a worker remembers in each of two generations.
REMEMBERED = 64 << 20
#: Characters from which on a unit is cut with packed tables, of 24 bytes a character.
LONG = 1 << 12
#: Ids decoded at a time.
IDS = 1 << 18
#: In the place of an id: the character is no piece.
ALONE = -1
_NORMAL, _USER = 1, 4
_MODELS = {}


class PieceModel:
    """Pieces of a model file, and the packed ids of the units this worker remembers."""

    def __init__(self, path, remembered=REMEMBERED):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.units = Recent(self._packed, limit=remembered)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        self.prefix = rules.add_dummy_prefix
        processor = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.unknown = processor.unk_id()
        self.byte_ids = {}
        self.automaton = ahocorasick.Automaton()
        self.scores, self.pieces = {}, []
        for i, piece in enumerate(proto.pieces):
            text = piece.piece
            if processor.is_byte(i):
                self.byte_ids[int(text[1:-1], 16)] = i
                self.pieces.append(bytes([int(text[1:-1], 16)]))
            elif piece.type in (_NORMAL, _USER):
                if text.lstrip(MARK).find(MARK) >= 0:
                    raise ValueError(f"piece with a mark inside: {text}")
                self.automaton.add_word(text, (len(text), piece.score, i))
                self.scores[text] = piece.score
                self.pieces.append(text.replace(MARK, " ").encode())
            else:
                self.pieces.append("⁇".encode() if i == self.unknown else b"")
        self.automaton.make_automaton()
        self.single = {text for text in self.scores if len(text) == 1}
        self.worst = min(self.scores.values()) + UNKNOWN
        sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.sizes, self.firsts = sizes, np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)

    def best_cut(self, unit):
        """Ids of the best cut in one pass over ``unit``; of equal sums the longer last piece wins."""
        size = len(unit)
        # A character that is no piece can only stand alone.
        unknown = () if self.single.issuperset(unit) else [c not in self.single for c in unit]
        best, starts, pieces = [0.0] + [NEVER] * size, [0] * (size + 1), [ALONE] * (size + 1)
        if size > LONG:
            best, starts, pieces = array("d", best), array("q", starts), array("q", pieces)
        settled = 0
        for last, (length, score, i) in self.automaton.iter(unit):  # longest first at each position
            end = last + 1
            if unknown:
                settled = self._alone(unknown, best, starts, pieces, settled, last)
            start = end - length
            total = best[start] + score
            if total > best[end]:
                best[end], starts[end], pieces[end] = total, start, i
        if unknown:
            self._alone(unknown, best, starts, pieces, settled, size)
        ids, end = [], size
        while end:
            start, i = starts[end], pieces[end]
            ids.extend(reversed(self._bytes(unit[start:end])) if i == ALONE else (i,))
            end = start
        return ids[::-1]

    def _alone(self, unknown, best, starts, pieces, settled, last):
        """Step over the unknown characters that end at positions up to ``last``."""
        for end in range(settled + 1, last + 1):
            total = best[end - 1] + self.worst
            if unknown[end - 1] and total > best[end]:
                best[end], starts[end], pieces[end] = total, end - 1, ALONE
        return max(settled, last)

    def _bytes(self, character):
        data = character.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in data] if len(self.byte_ids) == 256 else [self.unknown]

    def _packed(self, unit):
        return np.array(self.best_cut(unit), dtype="<i4").tobytes()

    def encode(self, text):
        """Packed ids of a whole text; none for a null or empty one."""
        if not text:
            return b""
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))

    def decode(self, ids, ends):
        """Texts of the id runs that end at ``ends``."""
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        where = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.firsts[ids] - (stops - sizes), sizes)
        data = self.data[where].tobytes()
        bounds = np.concatenate(([0], stops))[np.concatenate(([0], ends))]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


def model(path, remembered=REMEMBERED):
    """The model of this worker process."""
    if (path, remembered) not in _MODELS:
        _MODELS[path, remembered] = PieceModel(path, remembered)
    return _MODELS[path, remembered]


def forget():
    """Give the memory of all models of this worker back."""
    _MODELS.clear()
    give_back()


def encode(docs, path, text_col="text", ids="ids", remembered=REMEMBERED):
    """``docs`` with an array column of ids (named ``ids``, or that and ``_`` where taken) and its name.

    * A null or empty text has an empty array.
    * A character outside the vocabulary becomes its UTF-8 bytes, or the unknown id in a model
      without byte pieces.  The mark U+2581 in a text is read as a space, as the library does.
    * Equal rows get equal ids; other columns stay as they are.
    * A text without spaces is one unit, cut as a whole in memory of some 24 bytes a character.
    * A task remembers ``remembered`` bytes of units, which is only a matter of speed and memory.  The model
      goes with the task: a worker would hold it through all later stages, and it is read in a fraction of a second.
    """
    (name,) = unused(docs, ids)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _ids(model(path, remembered), texts)
        forget()

    return docs.withColumn(name, run(F.col(quoted(text_col)))), name


def decode(coded, path, ids_col="ids", text="decoded"):
    """``coded`` with the text of its ids (null ids: empty) and the name of that column."""
    (name,) = unused(coded, text)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _texts(model(path), lists)
        forget()

    return coded.withColumn(name, run(F.col(quoted(ids_col)))), name


def encode_and_decode(docs, path, text_col="text", coded="coded"):
    """``docs`` with a column of ``ids`` and their ``decoded`` text, and its name, in one step.

    ``decode`` of ``encode`` in one plan would encode twice: the planner repeats a Python function
    inside the argument of another.  The rules are those of ``encode``.
    """
    (name,) = unused(docs, coded)

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids = _ids(model(path), texts)
            yield pa.StructArray.from_arrays([ids, _texts(model(path), ids)], ["ids", "decoded"])
        forget()

    return docs.withColumn(name, run(F.col(quoted(text_col)))), name


def _ids(pieces, texts):
    packed = [pieces.encode(t.as_py()) for t in texts]
    offsets = np.cumsum([0] + [len(p) // 4 for p in packed])
    values = np.frombuffer(b"".join(packed), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _texts(pieces, lists):
    lists = lists.fill_null([]) if lists.null_count else lists
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    texts, first = [], 0
    for last in np.flatnonzero(np.diff(np.cumsum(sizes) // IDS, append=-1)) + 1:
        part = lists.slice(first, last - first)
        texts += pieces.decode(np.asarray(part.flatten(), dtype=np.int64), np.cumsum(sizes[first:last]))
        first = int(last)
    return pa.array(texts, pa.string())
