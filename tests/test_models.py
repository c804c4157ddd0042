"""Training, saving, batch prediction and relabelling on a small separable table."""

import pytest
from pyspark.sql import functions as F

from tablemend.catalog import models
from tablemend.operators import labels
from tablemend.plans import repair, training
from tablemend.plans.policy import policy_for
from tablemend.plans.repair import fit_repair


@pytest.fixture(scope="module")
def flowers(spark):
    return spark.range(240).selectExpr(
        "id as row_id",
        "case when id % 11 = 0 then null else (id % 3) * 10 + (id * 7 % 5) end * 1D as width",
        "(id % 3) * -4D + (id * 3 % 4) as height",
        "element_at(array('red', 'blue'), cast(id % 2 + 1 as int)) as colour",
        "element_at(array('iris', 'rose', 'tulip'), cast(id % 3 + 1 as int)) as kind",
    )


@pytest.mark.parametrize("name", [training.TREE, training.KNN])
def test_train_save_predict(spark, flowers, tmp_path, name):
    repair = fit_repair(flowers, "kind", readable=False)
    done = training.train_and_compare(repair.frame, "kind", "row_id", name, options={training.TREE: {"maxDepth": 4}})
    assert done.best.scores["accuracy"] > 0.9
    assert training.save_best(spark, done, str(tmp_path / "best")) == name
    fresh = flowers.drop("kind").withColumn("row_id", F.col("row_id") + 1000)
    predicted = training.predict_batch(fresh, str(tmp_path / "best"), repair, "kind", key="row_id")
    assert predicted.columns == [*fresh.columns, "Predicted_kind"] and predicted.count() == 240
    truth = flowers.select((F.col("row_id") + 1000).alias("row_id"), "kind")
    right = predicted.join(truth, "row_id").filter("kind = Predicted_kind").count()
    assert right > 210
    # the given cells come back as they were
    assert predicted.filter("width is null").count() == flowers.filter("width is null").count()


def test_relabel_mends_planted_labels(spark):
    df = spark.range(300).selectExpr(
        "id", "(id % 3) * 10D + id % 4 as x", "cast(case when id in (30, 31) then (id + 1) % 3 else id % 3 end as int) as y"
    )
    issues = labels.confident_label_issues(labels.forest_probabilities(df, ["x"], "y", "id", trees=10), "id")
    assert {r["id"] for r in issues.collect()} == {30, 31}
    mended = labels.relabel(df, ["x"], "y", "id", 3, trees=10)
    assert mended.filter("y <> id % 3").count() == 0


@pytest.mark.parametrize("low", [-1, 100_000])
def test_any_numbers_are_classes(spark, low, tmp_path):
    """Labels -1 and 1, or 100000 and 100007, are two classes, and predictions come back as such."""
    df = spark.range(120).selectExpr("id", "(id % 2) * 9D + id % 4 as x", f"cast({low} + (id % 2) * {2 if low < 0 else 7} as int) as y")
    done = training.train_and_compare(df, "y", "id", [training.TREE, training.LOGISTIC], options={training.TREE: {"maxDepth": 3}})
    assert done.data.classes == 2 and not done.failed and done.best.scores["accuracy"] == 1.0
    training.save_best(spark, done, str(tmp_path / "best"))
    predicted = training.predict_batch(df.drop("y"), str(tmp_path / "best"), target_name="y")
    assert predicted.join(df, "id").filter("y <> Predicted_y").count() == 0
    first = training.first_predictions(done.best.predictions, 5, done.data.codes)
    assert first.filter("label <> prediction").count() == 0 and {r["label"] for r in first.collect()} <= {low, low + (2 if low < 0 else 7)}


def test_failing_model_is_a_row(spark, tmp_path):
    df = spark.range(80).selectExpr("id", "(id % 2) * 9D + id % 4 as x", "concat('t', id) as words", "cast(id % 2 as int) as y")
    wrong = {training.TREE: {"maxDepth": -1}, training.LOGISTIC: {"maxIter": 10}}
    done = training.train_and_compare(df, "y", "id", [training.TREE, training.LOGISTIC, training.KNN], options=wrong)
    assert list(done.failed) == [training.TREE] and {t.name for t in done.trained} == {training.LOGISTIC, training.KNN, training.ENSEMBLE}
    assert done.table(spark).filter("metric = 'failed'").collect()[0]["model"] == training.TREE
    training.save_comparison(spark, done, str(tmp_path / "r"), "original", "3")
    scores = training.registered_scores(spark, str(tmp_path / "r"))
    assert scores.filter("version = '3' and dataset = 'original'").count() == done.table(spark).count()
    listed = done.failures(spark).collect()
    assert sorted((r["kind"], r["name"]) for r in listed) == [("column", "words"), ("model", training.TREE)]
    done.release()


def test_lost_work_is_no_result(spark, monkeypatch, tmp_path):
    """A job that Spark gave up ends the training, and results that do not name their models need all of them."""
    df = spark.range(80).selectExpr("id as doc_id", "'en' as lang", "'web' as source", "id % 2 * 9 + id % 4 as n_chars", "concat('a b. ', id) as text")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    real = training._train_one
    wrong = {training.TREE: {"maxDepth": -1}, training.FOREST: {"maxDepth": -1}}
    monkeypatch.setattr(training, "_train_one", lambda name, data, options, *a: real(name, data, wrong.get(name, options), *a))
    for query in (models.feature_importance, models.ensemble):
        with pytest.raises(RuntimeError, match="failed: IllegalArgumentException"):
            query(spark, str(tmp_path))

    def lost(*_):
        return spark.range(1).select(F.raise_error(F.lit("lost executor"))).collect()

    monkeypatch.setattr(training, "_train_one", lost)
    with pytest.raises(Exception, match="lost executor"):
        models.model_compare(spark, str(tmp_path))


def test_search_shares_folds(spark, monkeypatch):
    """Three fits a setting and one for the model; one neighbour search a fold."""
    df = spark.range(90).selectExpr("id", "(id % 3) * 9D + id % 5 as x", "cast(id % 3 as int) as y")
    fits, searches = [], []
    real, pairs = training.estimator, training.knn_paired
    monkeypatch.setattr(training, "estimator", lambda *a, **o: (fits.append(a), real(*a, **o))[1])
    monkeypatch.setattr(training, "knn_paired", lambda train, asked, k: (searches.append(k), pairs(train, asked, k))[1])
    done = training.train_and_compare(df, "y", "id", [training.TREE, training.KNN], search=True, balance=False)
    assert not done.failed and len(fits) == training.SEARCH_SIZE * training.FOLDS + 1
    folds = searches[: training.FOLDS]
    assert len(searches) == training.FOLDS + 2 and set(folds) == {max(s["k"] for s in training.search_space(training.KNN))}


def test_longer_lists_answer_every_k(spark):
    df = spark.range(200).selectExpr("id as key", "array(cast(id * 37 % 101 as double), cast(id % 7 as double)) as vec", "cast(id % 3 as double) as label")
    base, asked = df.filter("key % 4 <> 0"), df.filter("key % 4 = 0")
    long = training.knn_paired(base, asked, 11)
    for k in (1, 3, 7):
        for weights in ("uniform", "distance"):
            one = training.knn_vote(long, asked, "classification", k, weights).orderBy("key").collect()
            assert one == training.knn_predict(base, asked, "classification", k, weights).orderBy("key").collect()


def test_planted_wrong_labels_are_found(spark):
    """Of labels planted wrong, confident learning finds at least 9 in 10, and at least 9 in 10 of its finds are planted."""
    df = spark.range(600).selectExpr(
        "id", "(id % 3) * 10D + id * 7 % 4 as x", "(id % 3) * -6D + id * 3 % 5 as z", "id % 23 = 0 as planted",
        "element_at(array('a', 'b', 'c'), cast((id + if(id % 23 = 0, 1, 0)) % 3 + 1 as int)) as y",
    )
    planted = {r["id"] for r in df.filter("planted").collect()}
    fixes = {r["id"]: r["likely"] for r in labels.relabelled(df, ["x", "z"], "y", "id", trees=20).collect()}
    assert len(planted & set(fixes)) >= 0.9 * len(planted) and len(planted & set(fixes)) >= 0.9 * len(fixes)
    assert all(fixes[i] == "abc"[i % 3] for i in planted & set(fixes))
    method, n = labels.label_noise_report(df.drop("planted"), "y", "id", "classification")
    assert method == "confident_learning" and 0.9 * len(planted) <= n <= 1.1 * len(planted)
    assert labels.label_noise_report(df.selectExpr("id", "x", "x as y"), "y", "id", "regression") == ("not_applicable", None)


def test_repair_relabels_on_demand(spark):
    df = spark.range(300).selectExpr(
        "id", "(id % 3) * 10D + id * 7 % 4 as x", "(id % 3) * -6D + id * 3 % 5 as z",
        "element_at(array('a', 'b', 'c'), cast((id + if(id in (30, 31), 1, 0)) % 3 + 1 as int)) as y",
    )
    plain = fit_repair(df, "y", policy_for("balanced", handle_outliers=False), key="id", readable=False)
    mended = fit_repair(df, "y", policy_for("balanced", handle_outliers=False, correct_label_noise=True), key="id", readable=False)
    assert plain.frame.filter("y <> id % 3").count() == 2 and mended.frame.filter("y <> id % 3").count() == 0
    assert [a[3] for a in mended.actions if a[0] == "label_noise_correction"] == [2]


@pytest.mark.parametrize("entity", [[], ["who"]])
def test_lags_go_on_from_the_training_table(spark, tmp_path, entity):
    """A batch after the training rows gets the lags of the joined table; targets it knows are rolled on."""
    rows = spark.range(200).selectExpr("id as at", "concat('e', id % 7) as who", "if(id >= 190 and id % 3 = 0, null, id * id % 31 * 1D) as y")
    train = rows.filter("at < 190")
    args = {"target": "y", "order_by": ["at"], "entity": entity, "median": -1.0, "table": "lag_state", "on_target": True}
    fitted = repair.Repair("y", [repair.Step("lags", args)], {"lag_state": repair.lag_state(train, "y", ["at"], entity)})
    fitted.save(spark, str(tmp_path / "r"))
    fitted = repair.Repair.load(spark, str(tmp_path / "r"))
    names = ["at", "y_lag_1", "y_lag_2", "y_rolling_mean_3"]
    for later, known in ((rows.filter("at >= 190"), rows), (rows.filter("at >= 190").drop("y"), rows.withColumn("y", F.expr("if(at < 190, y, null)")))):
        got = fitted.apply(later, with_target=False)
        assert ("y" in got.columns) == ("y" in later.columns) and got.count() == 10
        joined = fitted.apply(known).filter("at >= 190")
        assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, joined.select(names).collect()))
    assert got.filter("y_lag_1 <> -1.0").count() == (7 if entity else 1)


def test_menu():
    assert training.KNN in training.model_menu("classification")
    with pytest.raises(ValueError):
        training.choose_models("regression", training.LOGISTIC)
    assert len(training.search_space(training.FOREST)) == 5


def test_searched_settings_are_validated_once(spark, monkeypatch):
    """The score of the chosen settings comes from the search; settings that override them are validated anew."""
    asked = []
    check = training.cross_validate
    monkeypatch.setattr(training, "cross_validate", lambda *a: asked.append(check(*a)) or asked[-1])
    df = spark.range(300).selectExpr("id", "cast(id % 17 as double) as x", "cast(id % 17 + id % 3 as double) as y")
    data = training.prepare(df, "y", "id", task="regression")
    for options, runs in (({}, training.SEARCH_SIZE), ({"maxBins": 16}, training.SEARCH_SIZE + 1)):
        asked.clear()
        done = training._train_one(training.TREE, data, options, True, True)
        assert len(asked) == runs
        assert done.scores["cv_mean"] == round(max(asked) if runs == training.SEARCH_SIZE else asked[-1], 4)


def test_models_are_fitted_on_no_more_partitions_than_cores(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id as key", "cast(id % 7 as double) as label", "array(cast(id % 7 as double)) as vec", "cast(id % 3 as int) as fold")
    rows = rows.repartition(60)
    data = training.Prepared("regression", ["x"], rows, rows.drop("fold"), rows.select("label", "vec"), {"x": (0.0, 1.0)}, 0, 400, False)
    seen, make = [], training.estimator

    class Watched:
        def __init__(self, real):
            self.real = real

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return self.real.fit(df)

    monkeypatch.setattr(training, "FIT_ROWS", 1)
    monkeypatch.setattr(training, "estimator", lambda *a: Watched(make(*a)))
    done = training._train_one(training.TREE, data, {"maxDepth": 3}, False, False)
    assert done.scores["r2"] == 1.0 and seen == [spark.sparkContext.defaultParallelism]
    monkeypatch.setattr(training, "FIT_MOST", 20)
    assert training.fit_parts(spark, 400) == 20
    assert training.fit_parts(spark, 0) == 1


def test_neighbour_model_searches_once_and_reads_the_table_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return float(x % 13)

    width = F.udf(seen, "double").asNondeterministic()
    df = spark.range(200).select(F.col("id"), width("id").alias("width"), (F.col("id") % 13 % 3).cast("string").alias("kind"))
    calls, search = [], training.nearest
    monkeypatch.setattr(training, "nearest", lambda *a, **k: calls.append(1) or search(*a, **k))
    done = training.train_and_compare(df, "kind", "id", training.KNN, balance=False)
    assert done.best.scores["accuracy"] == 1.0 and done.best.scores["train_accuracy"] == 1.0
    assert len(calls) == 1
    assert read.value == 200
