import pytest
from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.operators import clean
from cohortwise.operators.features import activity_wide, join_features, label_encode, label_mapping
from cohortwise.operators.models import PopulationScaler
from cohortwise.sources.tables import CSV_SCHEMAS, load_csv_tables, null_profile


def test_require_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        clean.require_columns(df, ["id", "label"])
    with pytest.raises(ValueError):
        clean.drop_leakage(df, "label")
    assert clean.present_columns(df, ["id", "nope"]) == ["id"]


def test_all_null_column_goes(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b int, c string")
    assert clean.drop_all_null_columns(df).columns == ["a", "c"]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert {r[0]: r[1] for r in null_profile(df).collect()} == {"a": 1, "b": 2, "total": 3}


def test_null_category_rows_go_and_numbers_fill(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "id int, cat string, n int")
    rows = clean.fill_zero(clean.drop_missing(df, ["cat"]), ["n"]).collect()
    assert [tuple(r) for r in rows] == [(2, "x", 0)]


def test_label_of_null_is_zero(spark):
    df = spark.createDataFrame([("Fail",), ("Pass",), ("Withdrawn",), (None,)], "r string")
    got = [r[0] for r in df.select(S.binary_label("r", ["Fail", "Withdrawn"])).collect()]
    assert got == [1, 0, 1, 0]


def test_period_code(spark):
    df = spark.createDataFrame([("2013J",), ("2014B",), ("2014X",)], "c string")
    got = [tuple(r) for r in df.select(S.period_year("c"), S.period_term("c")).collect()]
    assert got == [("2013", "Autumn"), ("2014", "Spring"), ("2014", None)]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(S.row_mean(["a", "b"])).collect()] == [1.0, None, 2.0]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_ratio("a", "b")).collect()] == [0.5, 0.0]


@pytest.mark.parametrize("direct_rows", [100_000, 50])
def test_quantiles_match_numpy(spark, direct_rows):
    import numpy as np

    from cohortwise.operators.ordering import exact_quantiles

    rng = np.random.default_rng(3)
    smooth, tied = rng.normal(size=5000), rng.integers(0, 4, size=5000).astype(float)
    rows = [(float(a), float(b), None if i % 7 else float(a)) for i, (a, b) in enumerate(zip(smooth, tied))]
    df = spark.createDataFrame(rows, "smooth double, tied double, holes double").repartition(4).cache()
    probs = [0.0, 0.25, 0.5, 0.98, 1.0]
    got = exact_quantiles(df, ["smooth", "tied", "holes"], probs, direct_rows=direct_rows)
    for name, values in {"smooth": smooth, "tied": tied, "holes": smooth[::7]}.items():
        assert np.allclose(got[name], np.quantile(values, probs))


def test_quantiles_of_empty_column(spark):
    from cohortwise.operators.ordering import exact_quantiles

    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_cap_leaves_missing_and_low_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "a double")
    capped = clean.cap_upper(df, ["a"], 0.98)
    assert capped.agg(F.max("a"), F.min("a"), F.count("a")).first()[:] == (98.0, 0.0, 101)


def test_entity_without_activity_and_unseen_kind(spark):
    log = spark.createDataFrame([(1, "quiz", 3, 2.0), (1, "quiz", 3, 4.0), (1, "quiz", 5, 1.0), (1, "other", 1, 9.0)],
                                "id int, kind string, day int, clicks double")
    wide = activity_wide(log, ["id"], "kind", "day", "clicks", ["quiz", "forum"], rest="rest")
    rows = {r["id"]: r for r in join_features(spark.createDataFrame([(1,), (2,)], "id int"), wide, ["id"]).collect()}
    assert (rows[1]["total_clicks_quiz"], rows[1]["active_days_quiz"], rows[1]["total_clicks_forum"]) == (7.0, 2, 0.0)
    assert (rows[1]["total_clicks_rest"], rows[1]["active_days_rest"]) == (9.0, 1)
    assert (rows[2]["total_clicks_quiz"], rows[2]["active_days_forum"]) == (0.0, 0)


# Categories whose codes are known.
BANDS = ["0-10%", "10-20", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%", "70-80%", "80-90%", "90-100%"]


@pytest.mark.parametrize("windowed", [100_000, 0])
def test_encoding_order(spark, monkeypatch, windowed):
    from cohortwise.operators import features

    monkeypatch.setattr(features, "_WINDOWED_CATEGORIES", windowed)
    df = spark.createDataFrame([(b, "F" if i % 2 else None) for i, b in enumerate(reversed(BANDS))], "band string, g string")
    codes = {(r[0], r[1]): r[2] for r in label_mapping(df, ["band", "g"]).collect()}
    assert [codes[("band", b)] for b in BANDS] == list(range(10))
    assert codes[("g", "F")] == 0 and codes[("g", "nan")] == 1
    encoded, _ = label_encode(df, ["band", "g", "absent"])
    assert sorted(r[0] for r in encoded.select("band").collect()) == list(range(10))


def test_zero_variance_becomes_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaled = PopulationScaler(inputCols=["a", "b"], outputCols=["a", "b"]).fit(df).transform(df)
    assert sorted(tuple(r) for r in scaled.collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_quoted_csv_with_empty_field(spark, tmp_path):
    (tmp_path / "assessments.csv").write_text(
        '"code_module","code_presentation","id_assessment","assessment_type","date","weight"\n'
        '"AAA","2013J","1","TMA","19","10"\n"AAA","2013J","2","Exam","","100"\n'
    )
    df = load_csv_tables(spark, str(tmp_path), {"assessments": CSV_SCHEMAS["assessments"]})["assessments"]
    assert [tuple(r) for r in df.orderBy("id_assessment").collect()] == [
        ("AAA", "2013J", 1, "TMA", 19, 10.0), ("AAA", "2013J", 2, "Exam", None, 100.0)]


def test_missing_csv_fails(spark, tmp_path):
    with pytest.raises(Exception):
        load_csv_tables(spark, str(tmp_path), {"courses": CSV_SCHEMAS["courses"]})["courses"].count()
