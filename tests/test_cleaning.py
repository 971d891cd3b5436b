import pytest
from pyspark.sql import functions as F

from sward.operators import cleaning as C
from sward.operators import encoding as E
from sward.operators import taxonomy as T
from sward.sources import readers as R
from sward.sources import writers as K


def header(spark, *recs):
    cols = "plot_id string, cover_scale string, recorded string, label string, lon string, lat string"
    return spark.createDataFrame(list(recs), cols)


def test_year_and_fill(spark, rows):
    df = header(
        spark,
        ("1", None, "12:07:1998", "R22", "1", "2"),
        ("2", "%", None, "R22", "1", "2"),
        ("3", "%", "1998", "R22", "1", "2"),
        ("4", "Presence/Absence", "1998", "R22", "1", "2"),
        ("5", "%", "1998", None, "1", "2"),
    )
    assert rows(C.clean_header(df), "plot_id", "year") == [("1", 1998), ("2", 0), ("3", 1998)]
    assert rows(C.clean_header(df, 1990), "plot_id") == [("1",), ("3",)]


def test_labels_are_not_trimmed(spark, rows):
    df = header(spark, ("1", "%", "1998", "R22, R35", "1.00015", "0.00005"))
    codes = spark.createDataFrame([("R22",), ("R35",)], "code string")
    out = C.training_header(df, codes, occurrences=1)
    assert rows(out, "plot_id", "label") == [(1, "R22")]
    trimmed = C.training_header(df, codes, occurrences=1, trim=True)
    assert rows(trimmed, "label") == [("R22",), ("R35",)]


def test_levels(spark, rows):
    codes = spark.createDataFrame([(c,) for c in ("R", "R2", "R22", "MA2", "MA21", "MA211")], "code string")
    assert rows(C.codes_at_level(codes, 3)) == [("MA211",), ("R22",)]
    assert rows(C.codes_at_level(codes, 1)) == [("MA2",), ("R",)]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    values = [0.00005, 1.00015, -2.00025, 12.34565]
    df = spark.createDataFrame([(v, v) for v in values], "lon double, lat double")
    import numpy as np

    got = [r["lon"] for r in C.round_coordinates(df).collect()]
    assert got == [float(np.rint(v * 1e4) / 1e4) for v in values]


def test_min_support_counts_once(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(10)], "v string, i int")
    assert {r[0] for r in rows(C.min_support(df, "v", 10))} == {"b"}


def test_retention(spark, rows):
    before = spark.createDataFrame([(1, str(i)) for i in range(4)] + [(2, str(i)) for i in range(4)], "plot_id long, s string")
    after = before.where("(plot_id = 1 AND s < '3') OR (plot_id = 2 AND s < '2')")
    assert {r[0] for r in rows(C.retention_filter(after, before), "plot_id")} == {1}


def test_region_list_may_contain_blanks(spark, rows):
    plots = spark.createDataFrame([(1, "Germany"), (2, "France"), (3, "Spain")], "plot_id long, country string")
    species = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "plot_id long, species string")
    kept, of = C.keep_regions(plots, species, "France, Germany")
    assert rows(kept, "plot_id") == [(1,), (2,)] and rows(of, "plot_id") == [(1,), (2,)]
    assert C.keep_regions(plots, species)[0] is plots


def test_truncation_is_towards_zero(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,)], "c double")
    assert [r[0] for r in df.select(C.truncate_int("c")).collect()] == [1, -1]


def test_tsv_header_null_markers(spark, tmp_path, rows):
    path = str(tmp_path / "h")
    names = list(R.HEADER_COLUMNS)
    spark.createDataFrame(
        [("1", "?", "NA", "R22", "1.5", "2.5"), ("2", "%", "", "?", "NaN", "2")], names
    ).coalesce(1).write.csv(path, sep="\t", header=True)
    got = rows(R.read_header(spark, path))
    assert got == [("1", None, None, "R22", "1.5", "2.5"), ("2", "%", None, None, None, "2")]
    with_mark = spark.createDataFrame([("1", "?", "2")], list(R.SPECIES_COLUMNS))
    with_mark.write.csv(str(tmp_path / "s"), sep="\t", header=True)
    assert rows(R.read_species(spark, str(tmp_path / "s"))) == [("1", "?", "2")]


def test_export_quotes_and_order(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', 2)], "plot_id long, species string, cover int")
    out = K.export_view(df, {**K.EXPORT_SPECIES, "dataset": "dataset"}, {"dataset": "dataset"})
    assert out.columns == ["RELEVE_NR", "TaxonName", "Cover_Perc", "dataset"]
    K.write_export(out, str(tmp_path / "x"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert '"1","a ""b""","2","dataset"' in text


def test_encoder_round_trip_and_unseen(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("é",), ("B",), ("a",)], "v string")
    enc = E.fit_encoder(df, "v")
    assert rows(enc, "id", "value") == [(i, v) for i, v in enumerate(sorted({"b", "a", "é", "B"}))]
    assert rows(E.decode(E.encode(df, enc, "v"), enc, "v")) == sorted([("b",), ("a",), ("é",), ("B",), ("a",)])
    other = spark.createDataFrame([("z",)], "v string")
    with pytest.raises(Exception, match="value not in encoder: z"):
        E.encode(other, enc, "v").collect()
    assert E.encode(other, enc, "v", unseen="drop").count() == 0
    hot = E.one_hot(other.withColumn("row_id", F.lit(1)), enc, "v")
    assert hot.count() == 0


def test_names(spark, rows):
    backbone = spark.createDataFrame(
        [("a", "Tracheophyta", "X y"), ("b", "Tracheophyta", "X y"), ("c", "Bryophyta", "M n"), ("d", "Tracheophyta", None)],
        "raw_name string, phylum string, accepted_name string",
    )
    species = spark.createDataFrame([(1, n, 2.0) for n in "abcde"], "plot_id long, species string, cover double")
    assert rows(T.normalise_names(species, backbone)) == [(1, "X y", 4.0)]
    assert rows(T.observed_name_map(species, backbone)) == [
        ("a", "X y"), ("b", "X y"), ("c", "?"), ("d", "?"), ("e", "?")
    ]
    accepted = spark.createDataFrame([("?",), ("Other",)], "accepted_name string")
    assert T.normalise_names(species, backbone, accepted).count() == 0


def coded(spark, *codes):
    return spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "row_id long, pos int, code string")


def test_crosswalk(spark, rows):
    table = spark.createDataFrame(
        [("Y1", "X1", 0), ("Y2", "X2; X1", 1), ("Y3", None, 2)], "new_code string, old_codes string, ord int"
    )
    out = T.crosswalk_codes(coded(spark, "X1", "Z9"), T.crosswalk_edges(table))
    assert rows(out, "pos", "ord", "code") == [(0, 0, "Y1"), (0, 1, "Y2"), (1, 0, "~")]


def test_expansion(spark, rows):
    codes = spark.createDataFrame(
        [(c,) for c in ("R", "R2", "R21", "R22", "R221", "MA2", "MA21", "MA211", "MA221", "MA2111")], "code string"
    )
    def to(code):
        return [c for (c,) in rows(T.expand_to_level(coded(spark, code), codes), "code")]

    assert to("R2") == ["R21", "R22"]
    assert to("R") == ["R21", "R22"]
    assert to("R221") == [] and to("MA2111") == []
    assert to("~") == ["~"] and to("Q99") == ["Q99"]
    assert to("MA2") == ["MA211", "MA221"] and to("MA21") == ["MA211"]
    assert to("MA211") == ["MA211"]


def test_noise_and_label_count(spark, rows):
    known = spark.createDataFrame([(f"R{i}",) for i in range(10)], "code string")

    def sets(*codes):
        return T.label_sets(coded(spark, *codes), known)

    assert rows(T.keep_clean_labels(sets("~", "R2")), "noise_pct") == [(50.0,)]
    assert T.keep_clean_labels(sets("~", "~", "R2")).count() == 0
    assert T.keep_clean_labels(sets("R1", "R2", "R3", "R4", "R5", "R5")).count() == 1
    assert T.keep_clean_labels(sets("R1", "R2", "R3", "R4", "R5", "R6")).count() == 0


def test_threat_match_and_last_row_wins(spark, rows):
    cross = spark.createDataFrame(
        [("A", "1", 0), ("B", "2", 1), ("C", "3", 2), ("D", "1", 3), ("D", "3", 4)], "code string, threat_code string, ord int"
    )
    red = spark.createDataFrame(
        [("1", "Endangered", 0), ("2", "Critically Endangered", 1), ("3", "Vulnerable", 2)], "threat_code string, category string, ord int"
    )
    labels = spark.createDataFrame([(c, i) for i, c in enumerate("ABCD")], "code string, id int")
    assert rows(T.endangered_labels(cross, red, labels), "code") == [("A",), ("B",)]


def test_unknown_category_is_unknown_group(spark, rows):
    threats = spark.createDataFrame([("A", "Odd"), ("B", "Least concern"), ("B", "Vulnerable")], "code string, category string")
    plots = spark.createDataFrame([("A",), ("B",), ("C",)], "label string")
    out = T.with_category(plots, T.highest_category(threats))
    assert rows(out, "label", "threat_group") == [
        ("A", "Unknown Category"), ("B", "Threatened Category"), ("C", "Incomplete Category")
    ]


def test_repeated_lookup_key_raises(spark):
    df = spark.createDataFrame([("a",)], "k string")
    look = spark.createDataFrame([("a", "1"), ("a", "2")], "k string, v string")
    with pytest.raises(Exception, match="more than once"):
        T.map_column(df, look, "k", "k", "v").collect()


def test_code_lists_are_translated_once_per_list(spark, rows):
    """Plots share a list, repeat a plot or a code, or hold no id; the work depends on the lists only."""
    seen = []
    table = spark.createDataFrame([("Y1", "X1", 0), ("Y2", "X2; X1", 1), ("Y1", "X1", 2)], "new_code string, old_codes string, ord int")
    edges = T.crosswalk_edges(table)

    def translate(cells):
        seen.append(cells.count())
        return T.crosswalk_codes(T.split_codes(cells, key="codes"), edges)

    plots = spark.createDataFrame(
        [(1, "X1"), (1, "X1"), (1, "Z9"), (2, "X1, X2"), (None, "X1"), (3, None)], "plot_id long, codes string")
    plain = T.crosswalk_codes(T.split_codes(plots, key="plot_id"), edges)
    assert rows(T.codes_of_cells(plots, translate), "plot_id", "code") == rows(plain, "plot_id", "code")
    known = spark.createDataFrame([("Y1",)], "code string")
    sets = T.label_sets_of_cells(plots, translate, known, "plot_id")
    assert rows(sets, "plot_id", "noise_pct", "codes") == rows(T.label_sets(plain, known, "plot_id"), "plot_id", "noise_pct", "codes")
    assert seen == [4, 4]


def test_a_code_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "REPEATS", 4)
    table = spark.createDataFrame([("Y1", "X1", i) for i in range(11)], "new_code string, old_codes string, ord int")
    plots = spark.createDataFrame([(i, "X1") for i in range(5)], "plot_id long, codes string")
    out = T.codes_of_cells(plots, lambda cells: T.crosswalk_codes(T.split_codes(cells, key="codes"), T.crosswalk_edges(table)))
    assert {(r["plot_id"], r["count"]) for r in out.groupBy("plot_id").count().collect()} == {(i, 11) for i in range(5)}
