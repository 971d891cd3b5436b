import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sward.llm import tokens
from sward.llm.queries import tokenizer_path
from sward.llm.tokens import CodeBook, code_lengths, encoder, token_files
from llm_cases import edge, none, small  # noqa: F401

PATH = tokenizer_path("word_bpe_49k.json")


def test_code_lengths():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    for limit in (5, 8, 18):
        lengths = code_lengths(fibonacci, limit)
        assert lengths.max() <= limit and sum(2.0**-n for n in lengths) <= 1
    assert code_lengths([1, 1, 2, 4], 18).tolist() == [3, 3, 2, 1]
    assert code_lengths([7]).tolist() == [1] and code_lengths([]).tolist() == []
    with pytest.raises(ValueError):
        code_lengths([1] * 5, 2)


@pytest.mark.parametrize("symbols", [1, 2, 300, 5000])
def test_blocks_decode(symbols):
    rng = np.random.default_rng(symbols)
    ids = np.minimum(rng.geometric(3 / symbols if symbols > 3 else 0.9, 9000), symbols) - 1
    values, counts = np.unique(ids, return_counts=True)
    book = CodeBook(values, code_lengths(counts))
    ends = np.sort(rng.choice(np.arange(1, 9000), 40, replace=False))
    ends[-1] = 9000
    data, byte_ends, marks = book.pack(ids, ends)
    firsts = np.concatenate(([0], byte_ends[:-1]))
    sizes = np.diff(ends, prepend=0)
    at = np.concatenate([m + 8 * f for m, f in zip(marks, firsts)])
    full = np.concatenate([[tokens.STEP] * (n // tokens.STEP) + ([n % tokens.STEP] if n % tokens.STEP else []) for n in sizes])
    assert (book.unpack(data, at, full) == ids).all()


def _expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    coded = []
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        coded.append((r["doc_id"] is not None, r["doc_id"] or 0, len(ids), r["doc_id"], np.array(ids, "<u4").tobytes()))
    for _, _, n, doc_id, data in sorted(coded, key=lambda c: c[:3]):
        out.append((doc_id, start, n, zlib.crc32(data)))
        start += n
    return out


def test_whole_texts(small, edge, none):
    for docs in (small, edge):
        found = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files(docs, PATH).collect()]
        expected = _expected(docs.collect())
        assert Counter((d, n, c) for d, _, n, c in found) == Counter((d, n, c) for d, _, n, c in expected)
        assert sorted((s, n) for _, s, n, _ in found) == [(s, n) for _, s, n, _ in expected]
        once = {d for d, n in Counter(e[0] for e in expected).items() if n == 1}
        assert {f for f in found if f[0] in once} == {e for e in expected if e[0] in once}
    assert token_files(none, PATH).count() == 0


def test_parts_equal_whole():
    rng, words, whole = np.random.default_rng(1), encoder(PATH), Tokenizer.from_file(PATH)
    letters = list("aAbZéÉßµ'.,<|>s123 \n\t\x1c İǅΣσ中१٣é ½-_$%`🙂") + ["<|endoftext|>", "'re"]
    for _ in range(2000):
        text = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert np.frombuffer(words.text(text), words.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
