import random
from collections import Counter

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sward.llm.bytelevel import ByteLevelTokenizer, windows
from sward.llm.counts import Lengths, cut, frequent, token_counts
from sward.llm.queries import QUERIES, tokenizer_path
from llm_cases import edge, none, small  # noqa: F401

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def _expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = {(r.doc_id, len((r.text or "").encode()), _expected(r.text), _expected(r.text) > 1024) for r in docs.collect()}
    assert {tuple(r) for r in QUERIES["op12_token_counts"](spark, "/root/testdata/sf0.001").collect()} == expected


def test_edge_cases(spark, edge, none):
    found, names = token_counts(edge.withColumnRenamed("k1", "N_Tokens"), PATH)
    assert names == ["n_bytes", "n_tokens_", "over_limit"] and found.columns[-3:] == names
    for r in found.collect():
        assert (r[names[0]], r[names[1]]) == (len((r["text"] or "").encode()), _expected(r["text"]))
        assert r[names[2]] == (r[names[1]] > 1024)
    assert token_counts(none, PATH)[0].count() == 0


def test_awkward_texts(spark):
    """Special strings, white space of all kinds, characters newer than a library, long runs."""
    rng = random.Random(5)
    letters = list("abT's 19\n\t\r\x0b\x1c\x85\xa0 é中🙂½,.-_") + ["<|endoftext|>", "'ll", "  ", "՘", "\U0003fc3b", "\0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["x" * 30_000, " " * 5000, "中文" * 4000, "a b " * 3000 + "\n \n" * 50, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, (_, n, _) = token_counts(rows, PATH)
    assert [r[n] for r in found.orderBy("doc_id").collect()] == [_expected(t) for t in texts]


def test_windows_cut_where_tokens_end():
    rng = random.Random(9)
    lengths = Lengths(PATH, _table())
    for _ in range(200):
        text = "".join(rng.choice("ab  \n\t.1é") for _ in range(rng.randint(1, 200)))
        parts = list(windows(text, 5))
        assert "".join(parts) == text
        assert sum(lengths.count(p) for p in parts) == _expected(text)


def _table(words=()):
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([99] * len(words), pa.int32())], ["word", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def test_table_is_used_first():
    assert Lengths(PATH, _table([" the"])).count("on the way") == 1 + 99 + 1


def test_summaries_keep_what_is_frequent(spark):
    rng = random.Random(2)
    parts = [Counter(rng.choice("abc") if rng.random() < 0.5 else str(rng.randint(0, 5000)) for _ in range(2000)) for _ in range(9)]
    merged = Counter()
    for part in parts:
        merged = cut(merged + cut(part, 20), 20)
    assert len(merged) <= 20 and {"a", "b", "c"} <= set(merged)
    docs = spark.createDataFrame([(i, "the cat sat" if i % 2 else f"word{i} the") for i in range(300)], "doc_id long, text string")
    table = pa.ipc.open_stream(frequent(docs.repartition(7), PATH, size=8)).read_all().to_pylist()
    assert len(table) <= 8 and " the" in {r["word"] for r in table}
    assert all(r["length"] == _expected(r["word"]) for r in table)


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        ByteLevelTokenizer(tokenizer_path("word_bpe_49k.json"))


def test_patterns_agree_with_the_library():
    """Characters of the common Unicode versions, between a letter, a number, a sign and a space."""
    tokenizer, library = ByteLevelTokenizer(PATH), LIBRARY.pre_tokenizer
    kinds = Counter()
    for code in [*range(0x3000), *range(0x3000, 0x110000, 17)]:  # all were compared once
        c = chr(code)
        find = tokenizer.finders.get(tokenizer.kinds[c])
        kinds[tokenizer.kinds[c]] += 1
        if find and not 0xD800 <= code < 0xE000:
            text = f"a{c}1{c}_{c}!{c}'s {c}'{c} _{c}"
            expected = [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
            assert find(text) == expected and tokenizer.finders[1](text) == expected
    assert set(kinds) == {0, 1, 2}
