import numpy as np
import pytest

from sward.operators import reports as P


def test_quantiles_without_gathering(spark):
    """Groups of one row to most rows, repeated values, nulls, a null group and one without values."""
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(size=6000).round(3), "one": [2.5], "two": [1.0, -4.0], None: rng.integers(0, 3, 50), "ties": [7.0] * 99}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None), ("empty", None)]
    table = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, score double").repartition(9)
    shares = {**P.FIVE, "p99": 0.99}
    found = {r["g"]: r for r in P.quantiles(table, ["g"], "score", shares).collect()}
    assert set(found) == {*groups, "empty"} and all(found["empty"][n] is None for n in shares)
    for g, values in groups.items():
        for name, share in shares.items():
            assert found[g][name] == pytest.approx(np.quantile(np.array(values, float), share), abs=1e-12)


def test_no_buffer_per_group(spark):
    table = spark.range(1000).selectExpr("id % 3 AS g", "id / 7 AS score")
    out = P.five_number(table, ["g"])
    plan = out._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    assert P.five_number(table.where("false"), ["g"]).count() == 0
