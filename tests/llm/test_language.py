from pyspark.sql import functions as F

from sward.llm.language import fit_languages, held_out, identify, keep_identified
from llm_cases import edge, none  # noqa: F401

MEDIUM = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(MEDIUM)
    model = fit_languages(docs.where(~held_out()))
    found, name = identify(docs.where(held_out()), model)
    right = found.agg(F.avg((F.col(name)["lang"] == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_edge_cases(edge, none):
    model = fit_languages(edge)
    assert set(model) == {"en", "de", "fr"}
    found, name = identify(edge, model)
    for r in found.collect():
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r[name]["lang"] == "und") == blank and 0 <= r[name]["score"] <= 1
    assert identify(none, model)[0].count() == 0
    nothing, name = identify(edge, fit_languages(none))
    assert {r[name]["lang"] for r in nothing.collect()} == {"und"}
    assert keep_identified(edge, {}).count() == 0


def test_only_text_decides(edge):
    model = fit_languages(edge)
    a, name = identify(edge, model)
    b, _ = identify(edge.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("q")).withColumn("doc_id", F.lit(0)), model)
    order = lambda rows: sorted((r["text"] or "", r[name]["lang"], r[name]["score"]) for r in rows)
    assert order(a.collect()) == order(b.collect())
