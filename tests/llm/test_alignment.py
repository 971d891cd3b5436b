import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sward.llm import alignment
from sward.llm.alignment import align, common_slices, documents_of, links_of, scored
from sward.llm.bytelevel import byte_alphabet
from sward.llm.queries import QUERIES, tokenizer_path
from llm_cases import edge, none, small  # noqa: F401

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def _tokens():
    """Whole texts by the libraries alone: ids and bytes of both."""
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    back = {c: b for b, c in byte_alphabet().items()}

    def run(text):
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        names = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(n[3:-1], 16)]) if second.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        return a.ids, [bytes(back[c] for c in t) for t in a.tokens], b, bytes_b

    return run


def _groups(text, tokens):
    """Groups of ids by walking along both, the shorter side first."""
    if not text:
        return []
    a, bytes_a, b, bytes_b = tokens(text)
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    groups, i, j = [], 0, 0
    while i < len(a):
        group, done = ([a[i]], [b[j]]), [len(bytes_a[i]), len(bytes_b[j])]
        i, j = i + 1, j + 1
        while done[0] != done[1]:
            if done[0] < done[1]:
                group[0].append(a[i])
                done[0], i = done[0] + len(bytes_a[i]), i + 1
            else:
                group[1].append(b[j])
                done[1], j = done[1] + len(bytes_b[j]), j + 1
        groups.append(group)
    return groups


def _expected(rows):
    tokens = _tokens()
    all_groups = [(i, _groups(t, tokens)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in all_groups]
    count, best = Counter(p for ls in links for p in ls), defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for (i, g), ls in zip(all_groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out[
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(ls.values()),
            sum(t for p, t in ls.items() if count[p] == best[p[0]]), sum(t * count[p] for p, t in ls.items()), text,
        ] += 1
    return out, all_groups, links


def _check(docs):
    expected, _, _ = _expected([(r.doc_id, r.text) for r in docs.collect()])
    found = Counter(tuple(r) for r in scored(align(docs, A, B)).collect())
    assert found == expected


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected, _, _ = _expected([(r.doc_id, r.text) for r in docs.collect()])
    hashed = Counter({(*k[:-1], hashlib.sha256(k[-1].encode()).hexdigest() if k[-1] else ""): n for k, n in expected.items()})
    found = QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001")
    assert found.columns[-1] == "groups_sha256" and Counter(tuple(r) for r in found.collect()) == hashed


def test_edge_cases(edge, none):
    _check(edge)
    _check(edge.repartition(5))
    assert scored(align(none, A, B)).count() == 0


def test_awkward_texts(spark):
    rng = random.Random(4)
    letters = list("abT's 19\n\t\r\x1c\x85\xa0　 é中🙂½=,.-_\0") + ["<|endoftext|>", "<s>", "▁", "  ", "====", "՘", "\U0003fc3b", " \n b"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["=" * 20_000, "x" + " " * 5000 + "y", "中文字" * 3000, "a b " * 2000 + "\n \n" * 50, "a ▁ b"]
    _check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_blocks_do_not_matter(spark, small):
    docs = small.where("doc_id < 60")
    whole = Counter(tuple(r) for r in scored(align(docs.coalesce(1), A, B)).collect())
    assert whole == Counter(tuple(r) for r in scored(align(docs.repartition(13), A, B)).collect())


def test_outputs(small):
    docs = small.where("doc_id < 40")
    _, groups, links = _expected([(r.doc_id, r.text) for r in docs.collect()])
    aligned = align(docs, A, B)
    found = {(r.doc_id, r.a, r.b): r.times for r in links_of(aligned).collect()}
    assert found == {(i, *p): n for (i, _), ls in zip(groups, links) for p, n in ls.items()}
    assert {r.doc_id: r.n_groups for r in documents_of(aligned).collect()} == {i: len(g) for i, g in groups}


def test_common_slices():
    assert common_slices([2, 5, 9], [1, 5, 7, 9]) == [(0, 2, 0, 2), (2, 3, 2, 4)]
    assert common_slices([], []) == []


def test_remembered_units_are_bounded():
    both = alignment.Aligner(A, B)
    both.known.limit = 20_000
    for n in range(400):
        both.units([f" word{n}", f" w{n * 7}", " " + "long" * 40])
    assert len(both.known) + len(both.known.old) < 120 and " " + "long" * 40 not in both.known


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        alignment.Aligner(tokenizer_path("word_bpe_49k.json"), B)


def test_blocks_are_short(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 5000) for i in range(60)], "doc_id long, text string").coalesce(1)
    sizes = [len(r.doc_id) for r in align(docs, A, B).select("doc_id").collect()]
    assert sum(sizes) == 60 and max(sizes) * 35_000 <= 1.1 * (1 << 20)


def test_units_together_equal_units_alone():
    both, rng = alignment.Aligner(A, B), random.Random(8)
    units = [" " + "".join(rng.choice("abTé's,.\n中=9") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    units = list(dict.fromkeys(u for u in units if not u.endswith("\n")))
    sides = [[both._ids_a(u) for u in units], [both.b.encode(u[1:]) or [both.space] for u in units]]
    rules = both.bytes_a, both.bytes_b, both.names
    alone = [alignment.aligned_unit(u, a, b, *rules) for u, a, b in zip(units, *sides)]
    good = [i for i, u in enumerate(alone) if u.good]
    together = alignment.aligned_units([units[i] for i in good], *[[s[i] for i in good] for s in sides], *rules)

    def fields(unit):
        return [getattr(unit, f) for f in alignment.Unit.__slots__]

    assert len(good) > 200 and [fields(u) for u in together] == [fields(alone[i]) for i in good]


def test_common_units_are_made_without_an_object_each(monkeypatch):
    both, rng = alignment.Aligner(A, B), random.Random(9)
    names = list({" " + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) + "," for _ in range(5000)})
    calls = []

    monkeypatch.setattr(alignment, "Unit", None)
    monkeypatch.setattr(both, "b", SimpleNamespace(encode=both.b.encode))
    both.b.encode = lambda text, f=both.b.encode: calls.append(text) or f(text)
    first, again = both.units(names), both.units(names[::-1])[::-1]
    assert first.tolist() == again.tolist() == [both.known[n] for n in names]
    assert len(calls) <= len(names) // alignment.RUN + 1


def test_rows_survive_a_generation(monkeypatch):
    monkeypatch.setattr(alignment, "SHORT", 3)
    both, rng = alignment.Aligner(A, B), random.Random(10)
    names = [" " + "".join(rng.choice("abTé's,.\n中=9▁") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    names = list(dict.fromkeys([*names, " " + "=" * 300, " " + "x" * 90]))

    def found(aligner):
        return [[getattr(aligner.known.columns.unit(r), f) for f in alignment.Unit.__slots__] for r in aligner.units(names)]

    expected = found(both)
    both.known.limit = 1
    assert any(row[-1] for row in expected) and not all(row[0] for row in expected)
    assert found(both) == found(both) == expected and len(both.known) < len(names)
