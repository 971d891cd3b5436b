"""License notices in documents, by MinHash over overlapping windows.

Templates are grouped by size.  For a group whose templates have at most S shingles, texts are cut into
windows of 2 S shingles every S, so each notice lies whole in one window.  A window retrieves the
templates with which it shares a band (one MinHash value), and the share of a template's shingles in
the window decides.  A window with 0.8 of a template has a Jaccard similarity of at least 0.19 with it:
64 bands of one value miss it with probability 1.4e-6 at most.

Two sets share a MinHash value only if the template's least shingle under that hash is in the window.
Windows without any such shingle cannot collide, so signatures are only computed for the others.

Versions of a license differ in few words.  With ``best``, a template counts only where the words of its
version are found too, and of templates that share a passage the one with most shingles in it is kept.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sward.llm.common import Polynomial, Words, mix, quoted, seeded, slices, text_or_empty
from sward.llm.license_texts import LIBRARY, TEMPLATES

#: Words of a shingle, share of a template's shingles, and bands of one value.
SHINGLE, SHARE, BANDS = 5, 0.8, 64

_LETTERS, _WORD_SUM, _SHINGLE_SUM = seeded(21, 256), Polynomial(22), Polynomial(23)
_SEEDS = seeded(24, BANDS)
_INSIDE = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
FOUND = "array<struct<license:string,start:int,end:int,share:double>>"


def shingles(texts):
    """Shingle hashes of all texts in order, and the bounds of each text's part."""
    words = Words(texts, _INSIDE)
    hashes = words.hashes(_WORD_SUM, _LETTERS, fold=True)
    room = np.maximum(np.diff(words.bounds) - SHINGLE + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(room)))
    starts = np.repeat(words.bounds[:-1] - bounds[:-1], room) + np.arange(int(bounds[-1]))
    return _SHINGLE_SUM.ranges(hashes, starts, starts + SHINGLE), bounds


def signature(found):
    """Least hash of a set for each band."""
    return mix(found[None, :] ^ _SEEDS[:, None]).min(axis=1)


def version_shingles(name, text):
    """Hashes of the shingles of a template that hold the version in its name; none where it has no version."""
    version = re.search(r"-(\d+)\.(\d+)$", name)
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    if version is None:
        return np.zeros(0, np.uint64)
    a, b = version.groups()
    for wanted in (["version", a, b], [f"v{a}", b], [a, b], ["version", a], [f"v{a}"], [a]):
        at = [i for i in range(len(words) - len(wanted) + 1) if words[i : i + len(wanted)] == wanted]
        if at:
            starts = {j for i in at for j in range(i + len(wanted) - SHINGLE, i + 1) if 0 <= j <= len(words) - SHINGLE}
            return np.unique(shingles(pa.array([" ".join(words[j : j + SHINGLE]) for j in sorted(starts)], pa.string()))[0])
    return np.zeros(0, np.uint64)


class Library:
    """Templates by size class, with signatures and the shingles that carry them."""

    def __init__(self, templates):
        named = [(name, text) for name in sorted(templates) for text in templates[name]]
        found, bounds = shingles(pa.array([text for _, text in named], pa.string()))
        self.classes, carriers, signatures = {}, {}, {}
        for (name, text), a, b in zip(named, bounds[:-1], bounds[1:]):
            own = np.unique(found[a:b])
            if not len(own):
                raise ValueError(f"template of fewer than {SHINGLE} words: {text}")
            span = 1 << int(b - a - 1).bit_length()
            self.classes.setdefault(span, []).append((name, own, version_shingles(name, text)))
            signatures.setdefault(span, []).append(signature(own))
            carriers.setdefault(span, []).append(own[np.unique(mix(own[None, :] ^ _SEEDS[:, None]).argmin(axis=1))])
        self.signatures = {span: np.stack(parts) for span, parts in signatures.items()}
        self.by_class = {span: np.unique(np.concatenate(parts)) for span, parts in carriers.items()}
        self.carriers = np.unique(np.concatenate(list(self.by_class.values()))) if carriers else np.zeros(0, np.uint64)

    def matches(self, found, hits, best=False):
        """``(license, start, end, share)`` in one text: ``hits`` are the positions of carriers."""
        seen, places = {}, []
        for span, templates in self.classes.items():
            near = hits[np.isin(found[hits], self.by_class[span])]
            for window in np.unique(np.concatenate((near // span, near // span - 1))):
                first = max(int(window), 0) * span
                part = found[first : first + 2 * span]
                own, bands = np.unique(part), signature(part)
                for i in np.flatnonzero((self.signatures[span] == bands).any(axis=1)):
                    name, template, version = templates[i]
                    share = float(np.isin(template, own, assume_unique=True).mean())
                    if share < SHARE or best and len(version) and not np.isin(version, own).any():
                        continue
                    at = np.flatnonzero(np.isin(part, template))
                    key = (name, first + int(at[0]), first + int(at[-1]) + SHINGLE)
                    seen[key] = max(seen.get(key, 0.0), share)
                    places.append((-round(share * len(template)), -share, key, first + at))
        return _merged(_best(places, len(found)) if best else seen)


def _best(places, size):
    """The spans that explain most shingles; others of which these explain over half are left out."""
    owner, names, kept = np.full(size, -1), {}, {}
    for _, share, key, at in sorted(places, key=lambda p: p[:3]):
        me = names.setdefault(key[0], len(names))
        if 2 * np.count_nonzero((owner[at] >= 0) & (owner[at] != me)) <= len(at):
            owner[at[owner[at] < 0]] = me
            kept[key] = max(kept.get(key, 0.0), -share)
    return kept


def _merged(spans):
    """Of overlapping spans of one license the union, with the largest share."""
    out = []
    for (name, start, end), share in sorted(spans.items()):
        if out and out[-1][0] == name and start < out[-1][2]:
            out[-1] = (name, out[-1][1], max(end, out[-1][2]), max(share, out[-1][3]))
        else:
            out.append((name, start, end, share))
    return sorted(out, key=lambda m: (m[1], m[0]))


def scan(docs, templates=None, id_col="doc_id", text_col="text", best=False):
    """``doc_id`` and ``found``, the license notices of each document in order of their first word.

    Words are runs of ASCII letters and digits or other characters beyond ASCII, A to Z lower-cased;
    ``start`` and ``end`` count them, the end exclusive.  With ``best`` a passage has one license, of its own
    version, of all in ``LIBRARY``; else every license with a template contained in it, of ``TEMPLATES``.

    * A null or empty text, or one below ``SHINGLE`` words, has no notice.
    * Repeated rows have equal results; a null id stays null.  Other columns, whatever their names, are
      not read; an empty table gives an empty result.
    """
    if templates is None:
        templates = LIBRARY if best else TEMPLATES

    def run(batches):
        library = Library(templates)
        for batch in batches:
            for part in slices(batch, 1):
                found, bounds = shingles(part.column(1))
                at = np.searchsorted(library.carriers, found)
                at[at == len(library.carriers)] = 0
                hits = np.flatnonzero(library.carriers[at] == found) if len(library.carriers) else at[:0]
                cuts = np.searchsorted(hits, bounds)
                rows = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(np.diff(cuts)):
                    a, b = bounds[i], bounds[i + 1]
                    rows[i] = [
                        dict(zip(("license", "start", "end", "share"), m))
                        for m in library.matches(found[a:b], hits[cuts[i] : cuts[i + 1]] - a, best)
                    ]
                kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, found {FOUND}")
