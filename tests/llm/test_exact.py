import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sward.llm import exact
from sward.llm.exact import exact_groups, keep_one, repeated_fingerprints, rice, unrice
from llm_cases import edge, none, small  # noqa: F401


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for k in (0, 3, 17):
        gaps = rng.integers(0, 1 << (k + 3), 500)
        assert (unrice(*rice(gaps, k), len(gaps), k) == gaps).all()
    assert len(unrice(*rice(np.zeros(0, int), 4), 0, 4)) == 0


def test_repeated_fingerprints(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 48, 3000).tolist()
    values += values[:100] + [0, 0, (1 << 48) - 1, (1 << 48) - 1]
    found = repeated_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long").repartition(7))
    assert sorted(r.fp for r in found.collect()) == sorted(v for v, n in Counter(values).items() if n > 1)


def test_messages_hold_enough_fingerprints_at_any_number_of_partitions():
    rng = np.random.default_rng(3)
    for n, tasks in ((10_000, 1), (1_000_000, 16), (10, 4), (0, 1)):
        bits = exact.owner_bits_for(n, tasks, 1 << 13)
        assert bits <= 15 and n <= exact.OWNER_SIZE << bits
        own = rng.integers(0, 1 << 48, n // tasks)
        batches = [pa.RecordBatch.from_arrays([pa.array(part)], ["fp"]) for part in np.array_split(own, 7)]
        sent = next(exact._messages(bits)(iter(batches)))
        assert sent.num_rows <= max(1, len(own) // 32)
        if len(own) > 1000:
            assert sent.nbytes / len(own) < 6
    assert exact.owner_bits_for(10**12, 10**6, 1 << 13) >= 15


def test_rows_beside_the_filter_are_whole(spark):
    from sward.llm.common import hash_filter, split_by

    df = spark.range(3000).selectExpr("id", "id AS word", "xxhash64(id) AS h").repartition(5)
    words = hash_filter(df.where("id % 7 = 0").select("h"))
    maybe, other = split_by(df, F.col("h"), words)
    assert maybe.columns == other.columns == df.columns
    found, rest = {r["id"] for r in maybe.collect()}, {r["id"] for r in other.collect()}
    assert found | rest == set(range(3000)) and not found & rest
    assert found >= set(range(0, 3000, 7)) and len(found) < 450
    nothing, everything = split_by(df, F.col("h"), hash_filter(df.where("false").select("h")))
    assert nothing.count() == 0 and everything.count() == 3000
    assert "Exchange hashpartitioning" not in maybe._jdf.queryExecution().simpleString()


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = max(known) if known else None, hashlib.sha256(text.encode()).hexdigest()
        kept_once = False
        for i in ids:
            kept = i == keep and not kept_once
            kept_once |= kept
            out.append((i, keep, len(ids), kept, sha))
    return Counter(out)


def test_groups_of_edge_cases(edge, none):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = exact_groups(edge)
    assert found.columns == columns
    assert Counter(tuple(r) for r in found.collect()) == _expected(edge.collect())
    assert exact_groups(none).count() == 0


def test_one_row_of_each_text_stays(edge, none):
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter({r["text"] or "" for r in edge.collect()})
    assert keep_one(none).count() == 0


@pytest.mark.parametrize("bits", [20, 48])
def test_colliding_fingerprints_do_no_harm(small, bits, monkeypatch):
    monkeypatch.setattr(exact, "BITS", bits)
    found = Counter(tuple(r) for r in exact_groups(small).collect())
    assert found == _expected(small.collect())
