"""Operators with their own distribution scheme against brute force on small tables."""

from functools import partial
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemend.operators import correlate, labels, near_duplicates, neighbours, ordering, outliers, profile, quantiles, resample
from tablemend.operators.lookup import attach_by_value, hot_values, join_spread, value_counts
from tablemend.plans.diagnosis import diagnose_table
from tablemend.session import shared_folder
from tablemend.sources.sampling import seeded_sample


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (150, 3)), rng.normal(6, 0.3, (120, 3)), np.zeros((130, 3))]  # a third are copies
    return x, spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "id long, label int, vec array<double>")


@pytest.mark.parametrize("options", [{}, {"block": 16, "pivots": 12}, {"block": 8, "pivots": 1}])
def test_nearest_is_exact(points, options):
    x, df = points
    found = neighbours.attach_neighbours(df, neighbours.nearest(df, df, 4, **options), "id", False, 4)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"], r["distance"]))
    for i in range(0, len(x), 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = np.lexsort((np.arange(len(x)), d))[:4]
        mine = sorted(got[i])
        assert [m[1] for m in mine] == order.tolist()
        assert np.allclose([m[2] for m in mine], d[order])


def test_near_copies_are_all_found(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    texts += [t + " w1" for t in texts[:20]] + texts[:15] + ["w1 w2"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    small = near_duplicates.near_duplicate_rows(df, "id", ["text"], block=4)
    large = near_duplicates.near_duplicate_rows(df, "id", ["text"])
    key = lambda rows: sorted((r["id"], r["near_id"], round(r["cosine"], 9)) for r in rows)
    assert key(small.collect()) == key(large.collect())
    # brute force over the same weights
    weights = near_duplicates.term_weights(near_duplicates._folded(df, "id", ["text"]))
    dense = {}
    for r in weights.collect():
        dense.setdefault(r["id"], {})[r["term"]] = r["w"]
    ids = sorted(dense)
    near = {}
    for a in ids:
        for b in ids:
            c = sum(w * dense[b].get(o, 0.0) for o, w in dense[a].items())
            if a != b and c >= 0.97:
                near.setdefault(a, []).append(b)
    links = near_duplicates.near_links(weights, 0.97, block=4)
    assert {r["id"]: r["near_id"] for r in links.collect()} == {a: min(b) for a, b in near.items()}
    assert all(abs(r["cosine"] - max(sum(w * dense[b].get(o, 0.0) for o, w in dense[r["id"]].items()) for b in near[r["id"]])) < 1e-9 for r in links.collect())
    kept = near_duplicates.drop_near_duplicates(df, "id", columns=["text"])
    assert kept.filter("text = 'w1 w2'").count() == 1


def test_near_copies_count_rare_terms(spark):
    """Rows that differ in a word of their own only are near copies if that word weighs little, whatever the vocabulary."""
    common = " ".join(f"c{i}" for i in range(12))
    df = spark.range(2500).selectExpr("id", f"concat('{common} own', id) as text")
    assert near_duplicates.near_duplicate_rows(df, "id", ["text"]).count() == 0
    few = near_duplicates.near_duplicate_rows(df, "id", ["text"], vocabulary=2000)
    assert few.count() == 512  # without the rarest words 512 rows are equal
    long = " ".join(f"c{i}" for i in range(3000))
    df = spark.range(50).selectExpr("id", f"concat('{long} own', id) as text")
    assert near_duplicates.near_duplicate_rows(df, "id", ["text"], block=8).filter("near_id = if(id = 0, 1, 0)").count() == 50


def test_digests_tell_rows_apart(spark):
    rows = spark.sql("""select * from values (1, '', null, 0.0D, timestamp '2020-01-01 00:00:00.000001', array(1, null)),
        (1, null, '', -0.0D, timestamp '2020-01-01 00:00:00.000002', array(null, 1)), (1, null, '', 0.0D, timestamp '2020-01-01 00:00:00.000002', array(null, 1)),
        (1, null, '', double('nan'), null, null), (1, null, '', double('nan'), null, null), (1, 'null', '"', null, null, null),
        (null, 'null', '"', null, null, null) as t(a, b, c, d, e, f)""")
    assert profile.duplicate_rows(rows).first() == (7, 2)
    kept = near_duplicates.drop_exact_duplicates(rows)
    assert kept.columns == rows.columns and kept.count() == 5 and kept.exceptAll(rows.distinct()).count() == 0
    assert near_duplicates.drop_exact_duplicates(rows.filter("a = 7")).count() == 0


def test_many_ranges(spark):
    """5,000 ranges, far beyond one literal list, number and look back like one."""
    df = spark.range(10_000).selectExpr("id", "id * 7919 % 10007 as at", "cast(id % 5 as double) as v")
    options = {"rows_per_range": 2}
    numbered = ordering.with_row_numbers(df, ["at", "id"], **options)
    assert numbered.select(F.max("position"), F.countDistinct("position")).first() == (10_000, 10_000)
    assert ordering.with_ranges(df, ["at", "id"], 10_000, 2).select(ordering.RANGE).distinct().count() > 2_500
    names = {"l": ("lag", 2, 0), "m": ("avg", -2, 0)}
    one, many = (ordering.with_lookback(df, ["at", "id"], [], 2, names, "v", **o).select("id", "l", "m") for o in ({}, options))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_quantiles_by_brackets(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "DIRECT_CELLS", 0)
    monkeypatch.setattr(quantiles, "READ_LIMIT", 20)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 100)
    df = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 5D else id * 0.37 end as hot", "case when id % 4 = 0 then null else cast(id * 31 % 997 as double) end as x",
        "cast(null as double) as none", "7D as same",
    )
    got = quantiles.exact_quantiles(df, df.columns, [0.0, 0.05, 0.25, 0.5, 0.9, 1.0])
    rows = df.toPandas()
    for c in ("hot", "x", "same"):
        assert np.allclose(got[c], rows[c].dropna().quantile([0.0, 0.05, 0.25, 0.5, 0.9, 1.0]))
    assert got["none"] == [None] * 6


def test_order_in_ranges(spark):
    df = spark.range(500).selectExpr("id", "case when id % 3 = 0 then 1 else id % 50 end as ts", "id * 1.5D as v")
    pandas = df.toPandas().sort_values(["ts", "id"]).reset_index(drop=True)
    numbered = ordering.with_row_numbers(df, ["ts", "id"], rows_per_range=20).toPandas().sort_values("position")
    assert numbered["id"].tolist() == pandas["id"].tolist() and numbered["position"].tolist() == list(range(1, 501))
    lagged = ordering.with_lookback(df, ["ts", "id"], [], 2, {"l": ("lag", 2, 0), "m": ("avg", -2, 0)}, "v", rows_per_range=3)
    got = lagged.toPandas().sort_values(["ts", "id"]).reset_index(drop=True)
    assert np.allclose(got["l"].astype(float), pandas["v"].shift(2), equal_nan=True)
    assert np.allclose(got["m"], pandas["v"].rolling(3, min_periods=1).mean())


def test_salted_lookup(spark):
    df = spark.range(300).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id as string) end as v")
    assert hot_values(df, "v", 300) == ["hot"]
    counts = value_counts(df, "v")
    plain = sorted(map(str, attach_by_value(df, "v", counts).collect()))
    assert plain == sorted(map(str, attach_by_value(df, "v", counts, counts, task_rows=30).collect()))


def test_spread_join(spark):
    rows = spark.range(200).selectExpr("id", "case when id % 3 = 0 then 7 else id end as q1", "1 as q2")
    table = spark.range(200).selectExpr("id as q1", "1 as q2", "id * 2 as v")
    plain = sorted(map(str, join_spread(rows, table, ["q1", "q2"]).select("id", "v").collect()))
    assert plain == sorted(map(str, join_spread(rows, table, ["q1", "q2"], task_rows=20).select("id", "v").collect()))


def test_rank_correlation_in_ranges(spark, monkeypatch):
    df = spark.range(400).selectExpr(
        "case when id % 3 = 0 then 0D else id * 7 % 101 end as a", "id * 13 % 89 as b", "if(id % 4 = 0, null, id % 37) as c", "id * id % 71 as y"
    )
    small = {r["column"]: r["r"] for r in correlate.all_rank_correlations(df, "y").collect()}
    monkeypatch.setattr(correlate, "with_ranges", partial(ordering.with_ranges, rows_per_range=9))
    large = {r["column"]: r["r"] for r in correlate.all_rank_correlations(df, "y").collect()}
    pandas = df.toPandas()
    for c in ("a", "b", "c"):
        expected = abs(pandas[[c, "y"]].dropna().rank().corr()["y"][c])
        assert small[c] == pytest.approx(expected) and large[c] == pytest.approx(expected)


def test_many_pairs_match_few(spark, monkeypatch):
    df = spark.range(300).selectExpr("id * 3 % 17 as a", "case when id % 5 <> 0 then id * 1D end as b", "id * 2D + id % 3 as c", "4 as d")
    few = {(r["left"], r["right"]): r["r"] for r in correlate.correlation_pairs(df).collect()}
    monkeypatch.setattr(correlate, "WIDE_PAIRS", 0)
    many = {(r["left"], r["right"]): r["r"] for r in correlate.correlation_pairs(df).collect()}
    assert few.keys() == many.keys()
    for k, r in few.items():
        assert (r is None and many[k] is None) or r == pytest.approx(many[k])


def test_planted_outliers_score_highest(spark):
    df = spark.range(2000).selectExpr("id", "case when id in (3, 77) then 90D else (id * 37 % 101) / 50D end as x", "case when id in (3, 77) then 80D else (id * 53 % 97) / 50D end as y")
    scored = outliers.isolation_scores(df, ["x", "y"], ["id"])
    top = [r["id"] for r in scored.orderBy(F.col("anomaly_score").desc()).limit(2).collect()]
    assert sorted(top) == [3, 77]
    again = outliers.isolation_scores(df.repartition(5), ["x", "y"], ["id"])
    assert scored.select("id", "anomaly_score").exceptAll(again.select("id", "anomaly_score")).count() == 0


def test_planted_label_noise(spark):
    rows = [(i, 1 - i // 50 if i in (10, 60) else i // 50, [float(i // 50 * 100 + i % 10), float(i % 7)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    assert sorted(r["id"] for r in labels.label_noise(df, "id", exclude_self=True).collect()) == [10, 60]


def test_smote_balances_and_split_is_exact(points):
    _, df = points
    uneven = df.filter("label = 0 or id % 2 = 0")
    made = {r["label"]: r["n"] for r in resample.smote(uneven, "id").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r["label"]: r["count"] for r in uneven.groupBy("label").count().collect()}
    assert made == {c: max(sizes.values()) - n for c, n in sizes.items() if n < max(sizes.values())}
    split = resample.stratified_split(uneven, "id", "label").groupBy("label").agg(F.count_if("is_test").alias("t")).collect()
    assert {r["label"]: r["t"] for r in split} == {c: max(1, round(n * 0.2)) for c, n in sizes.items()}


def test_sample_is_stable(spark):
    df = spark.range(5000)
    first = seeded_sample(df, 100).collect()
    assert len(first) == 100 and sorted(first) == sorted(seeded_sample(df.repartition(13), 100).collect())


def test_diagnosis_writes_the_table_once_and_leaves_nothing(spark, tmp_path):
    """Every check reads one written copy of the table, and its intermediates are gone when it ends."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        read.add(1)
        return i

    df = spark.range(120).select(
        seen("id").alias("n"), (F.col("id") % 7 * 1.5).alias("x"), F.concat(F.lit("t"), F.col("id") % 30).alias("words"), (F.col("id") % 3).cast("string").alias("y")
    )
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    found = diagnose_table(df, "y")
    metrics = found.metrics.first()
    assert metrics["rows"] == 120 and None not in (metrics["near_duplicates"], metrics["isolation_outliers"], metrics["label_noise"])
    assert found.issues.count() > 0
    assert {p.name for p in folder.iterdir()} <= before
    assert read.value == 120
