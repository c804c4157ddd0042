"""Repair, roles and encoding on small literal tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tablemend.functions import cells
from tablemend.operators import diagnose, encode, features, impute, roles
from tablemend.plans.diagnosis import diagnose_table
from tablemend.plans.pipeline import analyse, clean
from tablemend.plans.policy import policy_for
from tablemend.plans.repair import Repair, fit_repair


@pytest.fixture(scope="module")
def all_roles(spark):
    return spark.range(100).selectExpr(
        "concat('ID_', id) as id", "concat('ICAO_', id) as icao_code",
        "date_format(date_add(date'2023-01-01', cast(id as int)), 'yyyy-MM-dd') as date", "cast(18 + id % 47 as int) as age",
        "30000D + id * 700 as salary", "element_at(array('New York', 'London', 'Tokyo'), cast(id % 3 + 1 as int)) as city",
        "element_at(array('small', 'medium', 'large'), cast(id % 3 + 1 as int)) as size", "cast(id % 2 as int) as target",
    )


def test_roles(all_roles):
    assert roles.detect_roles(all_roles) == {
        "id": "identifier", "icao_code": "identifier", "date": "datetime", "age": "numerical", "salary": "numerical",
        "city": "nominal", "size": "ordinal", "target": "target",
    }


def test_whole_word_identifiers():
    assert roles.name_marks_identifier("normal_text")
    assert not roles.name_marks_identifier("normal_text", whole_words=True)
    assert roles.name_marks_identifier("orderId", whole_words=True)


def test_numeric_widths(spark):
    df = spark.createDataFrame(
        [(1, 2, 3, 1.0, 2.0, 0), (2, 3, 4, 2.0, 3.0, 1)], "int8 tinyint, int16 smallint, int32 int, f16 float, f32 float, target int"
    )
    assert set(roles.detect_roles(df).values()) == {"numerical", "target"}


def test_time_words_are_words():
    assert "date" not in roles.name_words("update_count")


@pytest.fixture(scope="module")
def gentle(spark):
    rows = [(1, "a", 10.0, 0), (2, "b", None, 1), (2, "b", 30.0, 1), (4, None, 5000.0, 0)]
    return spark.createDataFrame(rows, "id int, name string, value double, target int")


def test_gentle_repair(gentle):
    fitted = fit_repair(gentle)
    assert fitted.frame.columns == gentle.columns
    rows = sorted(map(tuple, fitted.frame.select("id", "name", "value").collect()))
    assert rows == [(1, "A", 10.0), (2, "B", 30.0), (2, "B", 1680.0), (4, "B", 5000.0)]
    assert fitted.weights == {}
    assert roles.detect_roles(gentle)["id"] == "numerical"
    assert roles.detect_roles(gentle)["name"] == "identifier"


def test_repair_keeps_column_and_row_count(all_roles):
    holes = all_roles.withColumn("age", F.when(F.col("age") % 5 != 0, F.col("age"))).withColumn(
        "city", F.when(F.col("city") != "Tokyo", F.col("city"))
    )
    frame = fit_repair(holes).frame
    assert frame.columns == holes.columns and frame.count() == 100
    assert frame.filter(" or ".join(f"{c} is null" for c in frame.columns)).count() == 0
    again = fit_repair(holes.repartition(7)).frame
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, again.collect()))


def test_model_ready_columns(spark):
    df = spark.range(100).selectExpr(
        "concat('ID_', id) as id", "date_format(date_add(date'2023-01-01', cast(id as int)), 'yyyy-MM-dd') as date",
        "id * 1.5D as feature1", "element_at(array('A', 'B', 'C'), cast(id % 3 + 1 as int)) as feature2",
        "case when id >= 95 then id * 1D end as high_missing", "cast(id % 2 as int) as target",
    )
    fitted = fit_repair(df, readable=False, policy=policy_for("balanced"))
    assert set(df.columns) <= set(fitted.frame.columns)
    for c in ("date_year", "date_month", "date_day", "date_dayofweek", "feature2_A", "feature2_B", "feature2_C"):
        assert c in fitted.frame.columns
    first = fitted.frame.filter("id = 'ID_0' or id = 'Id_0'").first()
    assert (first["date_year"], first["date_month"], first["date_day"], first["date_dayofweek"]) == (2023, 1, 1, 6)
    # 95 % is the threshold itself, and the rule is strict
    assert not [a for a in fitted.actions if a[0] == "flag_high_missing_columns"]


def test_saved_repair_equals_fitted(spark, all_roles, tmp_path):
    holes = all_roles.withColumn("age", F.when(F.col("age") % 5 != 0, F.col("age")))
    fitted = fit_repair(holes, readable=False)
    fitted.save(spark, str(tmp_path / "repair"))
    loaded = Repair.load(spark, str(tmp_path / "repair"))
    assert sorted(map(str, loaded.apply(holes).collect())) == sorted(map(str, fitted.frame.collect()))


def test_high_cardinality(spark):
    df = spark.range(1000).selectExpr(
        "concat('ID_', id) as id", "concat('Cat_', id) as high_card_category",
        "element_at(array('A', 'B', 'C'), cast(id % 3 + 1 as int)) as low_card_category", "id * 0.5D as feature1",
        "cast(id % 2 as int) as target",
    )
    assert set(roles.high_cardinality(df)) == {"id", "high_card_category"}
    frame = fit_repair(df, readable=False).frame
    assert [r[0] for r in frame.select("high_card_category_freq").distinct().collect()] == [0.001]
    assert {"low_card_category_A", "low_card_category_B", "low_card_category_C"} <= set(frame.columns)
    assert [r[0] for r in frame.select("high_card_category_entity_frequency").distinct().collect()] == [1]
    with pytest.raises(ValueError):
        encode.fit_categories(df, ["high_card_category"])


def test_mixed_fields(spark):
    numbers = ["123", "456", "N/A", "789", "unknown", "234"]
    dates = ["2023-01-01", "2023-02-15", "invalid", "2023-03-20", "N/A"]
    rows = [(f"ID_{i}", numbers[i % 6], dates[i % 5], float(i), "ABC"[i % 3], i % 2) for i in range(100)]
    df = spark.createDataFrame(
        rows, "id string, mixed_numeric_text string, mixed_dates string, normal_numeric double, normal_text string, target int"
    )
    found = {r["column"]: (r["type"], r["n_match"], r["n_other"]) for r in diagnose.mixed_fields(df).collect()}
    assert found["mixed_numeric_text"] == (diagnose.MIXED_NUMBER, 67, 33)
    assert found["mixed_dates"] == (diagnose.MIXED_DATE, 60, 40)
    assert "normal_text" not in found
    assert roles.detect_roles(df)["normal_text"] == "identifier"


def test_title_case_matches_python(spark):
    words = ["o'neil a-b", "MIXED case2go", "éCLAIR über", "", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(cells.title_case(F.col("w"))).collect()] == [w.title() for w in words]


def test_missing_kinds_are_one(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], " x  double")
    assert cells.normalise(df).filter("x is null").count() == 3
    with pytest.raises(ValueError):
        cells.tidy_names(spark.createDataFrame([(1, 2)], ["a", "a "]))


def test_empty_table_is_an_error(spark, gentle):
    with pytest.raises(ValueError):
        analyse(gentle.limit(0))


def test_policy_switches():
    assert policy_for("aggressive").outlier_action == "remove"
    assert policy_for("gentle").missing_column_threshold == 0.98
    with pytest.raises(ValueError):
        policy_for("gentle", no_such_switch=1)


@pytest.mark.parametrize("method", ["isolation_forest", "iqr", "zscore"])
def test_remove_outliers(spark, method):
    df = spark.range(600).selectExpr("id as row_id", "case when id = 7 then 1e6 else 10 + id % 20 end as x", "cast(id % 2 as int) as y")
    policy = policy_for("balanced", outlier_action="remove", outlier_method=method, apply_log_transform=False)
    frame = fit_repair(df, "y", policy, readable=False).frame
    assert frame.agg(F.max("x")).first()[0] < 1e6


def test_regression_weights(spark):
    df = spark.range(200).selectExpr("id * 1D as a", "(id * 7 % 31) * 1D as b", "(id * id % 17) * 1D as c")
    df = df.withColumn("y", F.when(F.col("a") % 3 != 0, 2 + 3 * F.col("a") - 0.5 * F.col("b") + 4 * F.col("c")))
    intercept, slopes = impute.regression_weights(df, "y", ["a", "b", "c"])
    assert [round(v, 6) for v in (intercept, *slopes)] == [2.0, 3.0, -0.5, 4.0]


def test_ordinal_orders(spark):
    df = spark.createDataFrame([("low",), ("high",), ("medium",)], "s string")
    plain = {r["value"]: r["code"] for r in encode.fit_codes(df, "s").collect()}
    scaled = {r["value"]: r["code"] for r in encode.fit_codes(df, "s", semantic=True).collect()}
    assert plain == {"high": 0, "low": 1, "medium": 2}
    assert scaled == {"low": 0, "medium": 1, "high": 2}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [r[0] for r in features.standardise(df).collect()] == [0.0, 0.0, 0.0]


def test_diagnosis_of_a_copy_leaks(spark):
    df = spark.range(200).selectExpr("id % 7 as a", "id * 2D as twin", "id * 1D as target")
    found = diagnose_table(df)
    assert found.leaking == ["twin"]
    assert "Data Leakage" in [r["type"] for r in found.issues.collect()]


def test_clean_job_writes_everything(spark, all_roles, tmp_path):
    done = clean(all_roles, path=str(tmp_path), version="7")
    assert spark.read.parquet(f"{tmp_path}/ml_ready/version=7").count() == 100
    record = spark.read.parquet(f"{tmp_path}/versions").first()
    assert (record["original_rows"], record["cleaned_rows"], record["version"]) == (100, 100, "7")
    assert done.readable.frame.columns == all_roles.columns
