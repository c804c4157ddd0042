"""Keys survive the repair, new holes are filled, and what did not run is not reported as 0."""

import pytest
from pyspark.sql import functions as F

from tablemend.functions import schema
from tablemend.operators.near_duplicates import near_duplicate_rows
from tablemend.plans import training
from tablemend.plans.diagnosis import DiagnosisOptions, diagnose_table
from tablemend.plans.policy import policy_for
from tablemend.plans.repair import fit_repair


def rows(spark, n=1000):
    return spark.range(n).selectExpr(
        "id * id as row_id", "case when id % 9 = 0 then null else exp(id % 13) end as a", "cast(id % 7 as int) as b",
        "element_at(array('x', 'y', 'z'), cast(id % 3 + 1 as int)) as kind", "cast(id % 2 as int) as y",
    )


def test_keys_are_untouched(spark):
    df = rows(spark)
    fitted = fit_repair(df, "y", policy_for("aggressive"), readable=False, key="row_id")
    assert fitted.frame.select("row_id").distinct().count() == 1000
    assert fitted.frame.select("row_id").exceptAll(df.select("row_id")).count() == 0
    fresh = spark.createDataFrame([(-9001, None, None, None)], "row_id bigint, a double, b int, kind string")
    mended = fitted.apply(fresh, with_target=False).first()
    assert mended["row_id"] == -9001 and mended["a"] is not None and mended["b"] is not None
    assert sum(mended[c] or 0 for c in mended.asDict() if c.startswith("kind_")) == 1


def test_rolling_mean_reads_earlier_rows_only(spark):
    df = spark.range(200).selectExpr("timestamp_seconds(id * 86400) as ts", "cast(id % 17 as double) as z", "cast(id * id as double) as v")
    policy = policy_for("balanced", apply_normalization=False, apply_log_transform=False, handle_outliers=False)
    frame = fit_repair(df, "v", policy, readable=False, order_by=["ts"]).frame
    name = "v_rolling_mean_3"
    if name in frame.columns:
        late = frame.filter(F.col("v") == 100.0 * 100.0).first()
        assert abs(late[name] - (99**2 + 98**2 + 97**2) / 3) < 1e-6


def test_near_copies_with_text_keys(spark):
    df = spark.createDataFrame([("k1", "apple"), ("k2", "pear")], "k string, t string")
    assert near_duplicate_rows(df, "k", ["t"]).count() == 0


def test_checks_that_did_not_run_are_null(spark):
    pairs = spark.range(40).selectExpr("id", "concat('word', id div 2, ' more', id div 2) as t", "cast(id % 2 as int) as y")
    full = diagnose_table(pairs, "y", DiagnosisOptions(key="id")).metrics.first()
    assert full["near_duplicates"] == 40
    bare = diagnose_table(pairs.drop("id"), "y").metrics.first()
    assert bare["near_duplicates"] == 40
    cut = diagnose_table(pairs, "y", DiagnosisOptions(False, False, False)).metrics.first()
    assert cut["near_duplicates"] is None and cut["isolation_outliers"] is None and cut["label_noise"] is None


def test_marks_travel_with_the_schema(spark, tmp_path):
    """A protected column passes the repair unchanged, and marks survive every step, writing and reading."""
    df = spark.range(300).selectExpr(
        "id as row_id", "if(id % 9 = 0, null, id * id % 50 * 1D) as kept", "if(id % 9 = 0, null, id * 31 % 70 * 1D + if(id = 7, 900, 0)) as mended",
        "element_at(array('a', 'b'), cast(id % 2 + 1 as int)) as word", "id % 5 as leak", "id % 2 as y",
    )
    df = schema.with_marks(df, {"key": ["row_id"], "protected": ["kept", "word"], "quarantined": ["leak"]})
    for readable in (True, False):
        fitted = fit_repair(df, "y", policy_for("balanced"), readable=readable)
        path = str(tmp_path / f"t{readable}")
        fitted.frame.write.parquet(path)
        back = spark.read.parquet(path)
        assert back.select("row_id", "kept", "word").exceptAll(df.select("row_id", "kept", "word")).count() == 0 and back.count() == 300
        assert back.filter("mended is null or mended > 800").count() == 0
        assert schema.marked_columns(back, "protected") == ["kept", "word"] and schema.marked_columns(back, "key") == ["row_id"]
        assert "leak" in schema.marked_columns(back, "quarantined") and "leak" in fitted.quarantined
    data = training.prepare(back, "y", "id")
    assert "leak" not in data.columns and "row_id" not in data.columns and "mended" in data.columns
    with pytest.raises(ValueError):
        schema.with_marks(df, {"key": ["none"]})
