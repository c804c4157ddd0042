"""Split, balance, scale, tune, train, compare and predict with Spark ML (ML1-ML18)."""

from __future__ import annotations

import itertools
import json
import random
from dataclasses import dataclass, field
from importlib import import_module

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import col, missing
from ..functions.schema import KEY, QUARANTINED, is_temporal, marked_columns, numeric_columns, quoted, target_of, text_columns
from ..operators import encode, features
from ..operators.labels import FOLDS, class_index, fold_of
from ..operators.lookup import attach_by_value, value_counts
from ..operators.metrics import classification_metrics, composite_score, regression_metrics
from ..operators.neighbours import MARK, attach_neighbours, nearest, vector
from ..operators.profile import distinct_counts, rows_frame
from ..operators.resample import balance as balanced_classes
from ..operators.resample import class_sizes, stratified_split
from ..operators.roles import HIGH_CARDINALITY, task_type
from ..session import settle, stored
from ..sinks.versions import write_table
from .repair import Repair

# Names of the models.
FOREST, TREE, LOGISTIC, LINEAR, KNN, BOOSTED = (
    "Random Forest", "Decision Tree", "Logistic Regression", "Linear Regression", "KNN", "Gradient Boosting",
)
ALL = "All Algorithms"
ENSEMBLE = "Ensemble (Top-2)"
SCALED = {KNN, LOGISTIC, LINEAR}

# Spark bounds tree depth; "no limit" is this depth.
UNBOUNDED_DEPTH = 15

# What a model raises that its settings or its rows rule out. Anything else, like a job that Spark gave up, is no result.
UNFIT = (IllegalArgumentException, TypeError, ValueError)

# Candidates of the random search.
GRIDS = {
    FOREST: {"numTrees": [100, 200, 300], "maxDepth": [None, 8, 16, 24], "minInstancesPerNode": [1, 2, 4]},
    TREE: {"maxDepth": [None, 5, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    LOGISTIC: {"C": [0.01, 0.1, 1.0, 10.0, 50.0]},
    KNN: {"k": [1, 3, 5, 7, 9, 11], "weights": ["uniform", "distance"]},
}
SEARCH_SIZE = 5
#: Rows of a partition that models are fitted on; small tables are not cut into many tiny tasks.
FIT_ROWS = 20_000
#: Rows of a partition beyond which there are more partitions than cores.
FIT_MOST = 1_000_000


def model_menu(task: str) -> list[str]:
    """Models offered for a task (ML7)."""
    first = [FOREST, TREE, LOGISTIC, KNN] if task == "classification" else [LINEAR, FOREST, TREE, KNN]
    return [*first, BOOSTED]


def choose_models(task: str, wanted: str = ALL) -> list[str]:
    menu = model_menu(task)
    if wanted == ALL:
        return menu
    if wanted not in menu:
        raise ValueError(f"{wanted!r} is not offered for {task}; there are {menu}")
    return [wanted]


def estimator(name: str, task: str, rows: int, classes: int, options: dict | None = None):
    """Spark ML estimator of a menu entry; ``options`` override its parameters.

    The settings below are fixed values.
    """
    columns = {"featuresCol": "features", "labelCol": "label"}
    options = dict(options or {})
    if "maxDepth" in options:
        options["maxDepth"] = UNBOUNDED_DEPTH if options["maxDepth"] is None else min(30, options["maxDepth"])
    classify = task == "classification"
    if name == FOREST:
        kind = RandomForestClassifier if classify else RandomForestRegressor
        return kind(**columns, seed=42, **{"numTrees": 100, "maxDepth": UNBOUNDED_DEPTH, **options})
    if name == TREE:
        kind = DecisionTreeClassifier if classify else DecisionTreeRegressor
        return kind(**columns, seed=42, **{"maxDepth": UNBOUNDED_DEPTH, **options})
    if name == LOGISTIC:
        c = options.pop("C", 1.0)
        settings = {"maxIter": 1000, "regParam": 1.0 / (c * max(1, rows)), "standardization": False, **options}
        return LogisticRegression(**columns, **settings)
    if name == LINEAR:
        return LinearRegression(**columns, **options)
    if name == BOOSTED:
        boosted = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9, **options}
        if not classify:
            return GBTRegressor(**columns, seed=42, **boosted)
        one = GBTClassifier(**columns, seed=42, **boosted)
        return one if classes <= 2 else OneVsRest(classifier=one, **columns)
    raise ValueError(f"no estimator for {name!r}")


@dataclass
class Prepared:
    """Numeric matrix of a table: key, label and an array of features, split by key hash.

    ``train`` carries the fold of each row, one for all models and settings. ``codes`` gives the class (``value``) of each
    label of a classification.
    """

    task: str
    columns: list[str]
    train: DataFrame
    test: DataFrame
    fitted_on: DataFrame
    scaling: dict[str, tuple[float, float]]
    classes: int
    train_rows: int
    balanced: bool
    codes: DataFrame | None = None
    left_out: list[str] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)


def training_matrix(
    df: DataFrame, target: str, key: str, quarantined: list[str] | tuple[str, ...] = ()
) -> tuple[DataFrame, list[str], list[str]]:
    """Features of a table: numbers, and indicators of text columns that have none yet (ENC7); the text columns left out.

    Raw dates and text of many values are left out; their parts and frequencies are numbers.
    """
    x = features.feature_matrix(df, target, [q for q in quarantined if q != key])
    texts = [c for c in text_columns(x) if c != key]
    counts = distinct_counts(x, texts, watch=100)
    few = [c for c in texts if counts[c] <= HIGH_CARDINALITY]
    categories = encode.fit_categories(df, few) if few else {}
    # a text column has its indicators if all that one-hot would add are there
    plain = [c for c in few if any(f"{c}_{v}" not in x.columns for v in categories[c])]
    wide = encode.one_hot(df, plain, {c: categories[c] for c in plain}) if plain else df
    left_out = {target, key, *quarantined}
    columns = [c for c in numeric_columns(wide) if c not in left_out]
    assert not any(is_temporal(wide.schema[c].dataType) for c in columns)
    return wide, columns, [c for c in texts if c not in few]


def prepare(
    df: DataFrame, target: str | None = None, key: str = "id", quarantined: list[str] | tuple[str, ...] = (),
    balance: bool = True, task: str | None = None,
) -> Prepared:
    """Matrix, split, balancing of the training part (SMOTE, then the Tomek links of the result), scaling statistics.

    Columns marked as quarantined in the schema are left out like those listed, and where there is no column ``key``, the
    one marked as key is it.
    """
    target = target_of(df, target)
    quarantined = [*quarantined, *(c for c in marked_columns(df, QUARANTINED) if c not in quarantined)]
    if key not in df.columns and len(marked_columns(df, KEY)) == 1:
        key = marked_columns(df, KEY)[0]
    task = task or task_type(df, target)
    wide, columns, left_out = training_matrix(df, target, key, quarantined)
    present = wide.filter(~missing(target, wide.schema[target].dataType))
    codes, label = None, col(target).cast("double")
    if task == "classification":
        codes = class_index(df, target)
        present = attach_by_value(present, target, codes.withColumnRenamed("code", "__code"), value_counts(present, target))
        label = F.col("__code")
    # written once: the split reads it several times, and its expressions may cost more than the models
    matrix = stored(present.select(col(key).alias("key"), label.alias("label"), vector(present, columns, 0.0).alias("vec")))
    split = stratified_split(matrix, "key", "label" if task == "classification" else None)
    split = split.withColumn("fold", fold_of("key", FOLDS)).persist()
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test", "fold")
    number = least = 0
    if task == "classification":
        number, least = class_sizes(train).agg(F.count(F.lit(1)), F.min("n")).first()
    plain = train.select("label", "vec")
    balanced = balance and number > 1 and least >= 2
    if balanced:
        plain = settle(balanced_classes(train, "key").select("label", "vec"))
    n = len(columns)
    parts = []
    for i in range(n):
        x = F.get("vec", F.lit(i))
        parts += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = plain.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    scaling = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    classes = codes.count() if codes is not None else 0
    return Prepared(task, columns, train, test, plain, scaling, classes, row["rows"], balanced, codes, left_out, [split])


def as_features(df: DataFrame, columns: list[str], scaling: dict | None) -> DataFrame:
    """The array column, scaled if asked, as an ML vector."""
    x = F.col("vec")
    if scaling:
        shift = F.array(*[F.lit(float(scaling[c][0])) for c in columns])
        width = F.array(*[F.lit(float(scaling[c][1])) for c in columns])
        x = F.zip_with(F.zip_with(x, shift, lambda a, b: a - b), width, lambda a, b: a / b)
    return df.withColumn("vec", x).withColumn("features", array_to_vector("vec"))


def search_space(name: str, seed: int = 42) -> list[dict]:
    """At most five of the candidate settings, drawn with a seed (ML8)."""
    grid = GRIDS.get(name)
    if not grid:
        return []
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(every, min(SEARCH_SIZE, len(every)))


def tune(name: str, data: Prepared, train: DataFrame) -> tuple[dict, float | None]:
    """Best settings of a three-fold random search by weighted F1 or R2, and their mean score."""
    best, best_score = {}, None
    for options in search_space(name):
        score = cross_validate(name, data, train, options)
        if best_score is None or score > best_score:
            best, best_score = options, score
    return best, best_score


def cross_validate(name: str, data: Prepared, train: DataFrame, options: dict | None = None) -> float:
    """Mean score over the shared folds of the training part before balancing (ML11): one fit a fold, none on all rows."""
    if data.task == "classification":
        judge = MulticlassClassificationEvaluator(metricName="f1", labelCol="label")
    else:
        judge = RegressionEvaluator(metricName="r2", labelCol="label")
    scores = []
    for fold in range(FOLDS):
        part, rest = train.filter(F.col("fold") == fold), train.filter(F.col("fold") != fold)
        if part.isEmpty() or rest.isEmpty():
            continue
        model = estimator(name, data.task, data.train_rows, data.classes, options).fit(rest)
        scores.append(judge.evaluate(model.transform(part)))
    return sum(scores) / len(scores) if scores else 0.0


def knn_found(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of ``train`` (label, vec) to each distinct vector of the queries."""
    base = train.select("vec", F.col("label").alias("id"), F.col("label").alias("__label"))
    return nearest(queries, base, k, payload=["__label"])


def knn_paired(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of ``train`` (label, vec) to each query: key, label of the neighbour, distance, place.

    ``train`` may be what ``knn_found`` returned for these queries, among others.
    """
    found = train if set(MARK) <= set(train.columns) else knn_found(train, queries, k)
    return attach_neighbours(queries, found, "key", False, k)


def knn_vote(paired: DataFrame, queries: DataFrame, task: str, k: int, weights: str = "uniform") -> DataFrame:
    """Vote or mean of the first ``k`` neighbours of lists that may be longer; a vote that ties goes to the lowest label."""
    paired = paired.filter(F.col("place") <= k)
    weight = F.lit(1.0) if weights == "uniform" else 1.0 / F.greatest("distance", F.lit(1e-12))
    if task == "classification":
        votes = paired.groupBy("key", F.col("__label").alias("prediction")).agg(F.sum(weight).alias("w"))
        best = votes.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "prediction")).alias("b"))
        guess = best.select("key", "b.prediction")
    else:
        guess = paired.groupBy("key").agg((F.sum(weight * F.col("__label")) / F.sum(weight)).alias("prediction"))
    return queries.select("key", "label").join(guess, "key")


def knn_predict(train: DataFrame, queries: DataFrame, task: str, k: int = 5, weights: str = "uniform") -> DataFrame:
    """Neighbour vote or mean (ML5): key, label and prediction of every query row. ``train`` has label and vec."""
    return knn_vote(knn_paired(train, queries, k), queries, task, k, weights)


@dataclass
class Trained:
    name: str
    options: dict
    scores: dict[str, float]
    model: Model | None
    predictions: DataFrame
    importance: list[tuple[str, float]] = field(default_factory=list)


@dataclass
class Comparison:
    """All models of one table, with their scores; ``best`` has the highest composite score."""

    task: str
    columns: list[str]
    scaling: dict
    trained: list[Trained]
    data: Prepared
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def best(self) -> Trained:
        alone = [t for t in self.trained if t.name != ENSEMBLE]
        if not alone:
            raise ValueError(f"no model was trained: {self.failed}")
        return max(alone, key=lambda t: t.scores["composite"])

    def whole(self) -> Comparison:
        """This comparison, if no model failed: for results that do not show which models they come from."""
        if self.failed:
            raise RuntimeError("; ".join(f"{name} failed: {error}" for name, error in self.failed.items()))
        return self

    def release(self) -> None:
        """Give back the memory of cached rows; predictions are computed anew after this."""
        for df in [*self.data.held, *(t.predictions for t in self.trained)]:
            df.unpersist()

    def table(self, spark: SparkSession, dataset: str = "original") -> DataFrame:
        """Scores by model; one that failed has the metric ``failed`` alone, text columns left out are counted."""
        rows = [(dataset, t.name, m, round(float(v), 4)) for t in self.trained for m, v in t.scores.items() if v is not None]
        rows += [(dataset, name, "failed", 1.0) for name in self.failed]
        return rows_frame(spark, rows, "dataset string, model string, metric string, value double")

    def failures(self, spark: SparkSession, dataset: str = "original") -> DataFrame:
        """Why models failed and which text columns of many values no model saw: dataset, kind, name, detail."""
        rows = [(dataset, "model", name, text) for name, text in self.failed.items()]
        rows += [(dataset, "column", c, "text of many values") for c in self.data.left_out]
        return rows_frame(spark, rows, "dataset string, kind string, name string, detail string")

    def importance_table(self, spark: SparkSession, top: int = 5) -> DataFrame:
        """Most important features per tree model (ML14)."""
        rows = [
            (t.name, f, round(v, 4))
            for t in self.trained
            for f, v in sorted(t.importance, key=lambda p: (-p[1], p[0]))[:top]
        ]
        return rows_frame(spark, rows, "model string, feature string, importance double")


def train_and_compare(
    df: DataFrame, target: str | None = None, key: str = "id", wanted: str | list[str] = ALL,
    quarantined: list[str] | tuple[str, ...] = (), search: bool = False, validate: bool = False, balance: bool = True,
    options: dict[str, dict] | None = None, ensemble: bool = True,
) -> Comparison:
    """Train the wanted models on one split and score them (ML1-ML15).

    ``options`` overrides parameters per model, ``search`` tunes them, ``validate`` adds the
    cross-validated score. A model that its settings or the rows rule out is listed with its error, and the others go on;
    any other error ends the training.
    """
    data = prepare(df, target, key, quarantined, balance)
    names = choose_models(data.task, wanted) if isinstance(wanted, str) else wanted
    done = Comparison(data.task, data.columns, data.scaling, [], data)
    for name in names:
        try:
            done.trained.append(_train_one(name, data, (options or {}).get(name, {}), search, validate))
        except UNFIT as error:
            done.failed[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:300]
    if ensemble and len(done.trained) >= 2:
        done.trained.append(ensemble_top2(done))
    return done


def fit_parts(spark: SparkSession, rows: int) -> int:
    """Partitions that models are fitted on: no more than cores, as boosting runs thousands of stages and every task reports."""
    cores = max(2, spark.sparkContext.defaultParallelism)
    return max(1, min(-(-rows // FIT_ROWS), cores), -(-rows // FIT_MOST))


def _train_one(name: str, data: Prepared, options: dict, search: bool, validate: bool) -> Trained:
    scaling = data.scaling if name in SCALED else None
    fit_on, test = as_features(data.fitted_on, data.columns, scaling), as_features(data.test, data.columns, scaling)
    unbalanced = as_features(data.train, data.columns, scaling)
    parts = fit_parts(data.train.sparkSession, data.train_rows)
    if name == KNN:
        k = max(1, min(options.get("k", 5), data.train_rows - 1))
        chosen = {"k": k, "weights": options.get("weights", "uniform")}
        if search:
            chosen = _search_knn(unbalanced, data)
        # one search for the rows of both parts
        found = knn_found(fit_on, test.select("vec").unionByName(unbalanced.select("vec")), chosen["k"])

        def answer(asked: DataFrame) -> DataFrame:
            return knn_vote(knn_paired(found, asked, chosen["k"]), asked, data.task, **chosen)

        guess, seen = answer(test).persist(), answer(unbalanced)
        return Trained(name, chosen, _scores(data.task, guess, seen, None), None, guess)
    unbalanced = unbalanced.coalesce(parts)
    validated = None
    if search and name in GRIDS:
        tuned, score = tune(name, data, unbalanced)
        # the search has validated the chosen settings on these folds
        validated = score if {**tuned, **options} == tuned else None
        options = {**tuned, **options}
    model = estimator(name, data.task, data.train_rows, data.classes, options).fit(fit_on.coalesce(parts))
    guess = model.transform(test)
    kept = ["key", "label", "prediction"] + (["probability"] if "probability" in guess.columns else [])
    guess = guess.select(*kept).persist()
    if not validate:
        validated = None
    elif validated is None:
        validated = cross_validate(name, data, unbalanced, options)
    importance = []
    if hasattr(model, "featureImportances"):
        importance = [(c, float(v)) for c, v in zip(data.columns, model.featureImportances.toArray())]
    return Trained(name, options, _scores(data.task, guess, model.transform(unbalanced), validated), model, guess, importance)


def _search_knn(train: DataFrame, data: Prepared) -> dict:
    """Best k and weighting over the shared folds. One neighbour search a fold, of the greatest k, answers all settings."""
    settings = [s for s in search_space(KNN) if s["k"] < data.train_rows]
    best, best_score = {"k": 5, "weights": "uniform"}, None
    measure, main = (classification_metrics, "f1") if data.task == "classification" else (regression_metrics, "r2")
    scores: dict[int, list[float]] = {i: [] for i in range(len(settings))}
    for fold in range(FOLDS if settings else 0):
        asked = train.filter(F.col("fold") == fold)
        paired = settle(knn_paired(train.filter(F.col("fold") != fold), asked, max(s["k"] for s in settings)))
        for i, chosen in enumerate(settings):
            score = measure(knn_vote(paired, asked, data.task, **chosen)).first()[main]
            scores[i] += [score] if score is not None else []
    for i, chosen in enumerate(settings):
        score = sum(scores[i]) / len(scores[i]) if scores[i] else 0.0
        if best_score is None or score > best_score:
            best, best_score = chosen, score
    return best


def _scores(task: str, test: DataFrame, train: DataFrame, validated: float | None) -> dict[str, float]:
    measure, main = (classification_metrics, "accuracy") if task == "classification" else (regression_metrics, "r2")
    scores = measure(test).first().asDict()
    seen = measure(train).first()[main]
    rounded = {k: round(v, 4) for k, v in scores.items()}
    gap = round(seen - scores[main], 4)
    rounded[f"train_{main}"] = round(seen, 4)
    rounded["generalization_gap"] = gap
    if validated is not None:
        rounded["cv_mean"] = round(validated, 4)
    rounded["composite"] = round(composite_score(task, rounded, gap), 4)
    return rounded


def ensemble_top2(done: Comparison) -> Trained:
    """Mean of the probabilities (or predictions) of the two best models, by row key (ML15)."""
    top = sorted(done.trained, key=lambda t: -t.scores["composite"])[:2]
    if done.task == "classification":
        def shares(t: Trained, name: str) -> DataFrame:
            if "probability" in t.predictions.columns:
                return t.predictions.select("key", "label", vector_to_array("probability").alias(name))
            one_hot = F.transform(
                F.sequence(F.lit(0), F.lit(done.data.classes - 1)), lambda i: (F.col("prediction") == i).cast("double")
            )
            return t.predictions.select("key", "label", one_hot.alias(name))

        both = shares(top[0], "a").join(shares(top[1], "b").drop("label"), "key")
        mean = F.zip_with("a", "b", lambda x, y: (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))) / 2)
        guess = both.withColumn("m", mean).select(
            "key", "label", (F.array_position("m", F.array_max("m")) - 1).cast("double").alias("prediction")
        )
        scores = classification_metrics(guess).first().asDict()
    else:
        both = top[0].predictions.select("key", "label", F.col("prediction").alias("a")).join(
            top[1].predictions.select("key", F.col("prediction").alias("b")), "key"
        )
        guess = both.select("key", "label", ((F.col("a") + F.col("b")) / 2).alias("prediction"))
        scores = regression_metrics(guess).first().asDict()
    rounded = {k: round(v, 4) for k, v in scores.items()}
    rounded["composite"] = round(composite_score(done.task, rounded, 0.0), 4)
    return Trained(ENSEMBLE, {"members": [t.name for t in top]}, rounded, None, guess)


def first_predictions(predictions: DataFrame, n: int = 50, codes: DataFrame | None = None) -> DataFrame:
    """Actual against predicted of the first rows by key (ML17), as classes if their codes are given."""
    first = predictions.orderBy("key").limit(n).select("key", "label", "prediction")
    if codes is None:
        return first
    actual = codes.select(F.col("code").alias("label"), F.col("value").alias("__label"))
    guessed = codes.select(F.col("code").alias("prediction"), F.col("value").alias("__prediction"))
    named = first.join(actual, "label", "left").join(guessed, "prediction", "left")
    return named.select("key", F.col("__label").alias("label"), F.col("__prediction").alias("prediction"))


def compare_versions(spark: SparkSession, original: Comparison, repaired: Comparison) -> DataFrame:
    """Scores of the same models on the original and the repaired table (ML16)."""
    both = original.table(spark, "original").unionByName(repaired.table(spark, "repaired"))
    return both.groupBy("model", "metric").pivot("dataset", ["original", "repaired"]).agg(F.first("value"))


# ---- keeping and using the best model -------------------------------------------------------


def save_best(spark: SparkSession, done: Comparison, path: str) -> str:
    """Best model with its columns and scaling (ML13). A neighbour model is its training table."""
    best = done.best
    if done.data.codes is not None:
        done.data.codes.write.mode("overwrite").parquet(f"{path}/classes")
    info = {
        "name": best.name, "task": done.task, "columns": done.columns, "options": best.options,
        "scaling": {c: list(s) for c, s in done.scaling.items()} if best.name in SCALED else None,
        "model_class": f"{type(best.model).__module__}:{type(best.model).__name__}" if best.model else None,
    }
    rows_frame(spark, [(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")
    if best.model is not None:
        best.model.write().overwrite().save(f"{path}/model")
    else:
        done.data.fitted_on.write.mode("overwrite").parquet(f"{path}/rows")
    return best.name


def save_comparison(spark: SparkSession, done: Comparison, path: str, dataset: str, version: str = "1") -> None:
    """The registry entry of a training (SNK5): scores, failures and the best model of a dataset and version."""
    place = f"version={version}/dataset={dataset}"
    write_table(done.table(spark, dataset).drop("dataset"), f"{path}/scores/{place}")
    write_table(done.failures(spark, dataset).drop("dataset"), f"{path}/failures/{place}")
    write_table(done.importance_table(spark), f"{path}/importances/{place}")
    save_best(spark, done, f"{path}/models/{place}")


def registered_scores(spark: SparkSession, path: str) -> DataFrame:
    """All scores of a registry: model, metric, value, version, dataset."""
    schema = "model string, metric string, value double, version string, dataset string"
    return spark.read.schema(schema).option("basePath", f"{path}/scores").parquet(f"{path}/scores")


def predict_batch(
    df: DataFrame, path: str, repair: Repair | None = None, target_name: str | None = None, key: str | None = None
) -> DataFrame:
    """Append the prediction of a saved model to new rows (ML18).

    The rows are repaired with the statistics of the training table, brought to its columns and
    scaled with its scaling; class codes turn back into class names. Original cells are kept.
    """
    spark = df.sparkSession
    info = json.loads(spark.read.text(f"{path}/info").first()["value"])
    carried = df.withColumn("__row", F.struct(*[quoted(c) for c in df.columns]))
    ready = repair.apply(carried, with_target=False) if repair else carried
    columns = info["columns"]
    realigned = features.realign(ready, [*columns, "__row"])
    matrix = realigned.select("__row", vector(realigned, columns, 0.0).alias("vec"))
    matrix = as_features(matrix, columns, info["scaling"])
    if info["model_class"]:
        module, name = info["model_class"].split(":")
        guess = getattr(import_module(module), name).load(f"{path}/model").transform(matrix)
    else:
        if key is None:
            raise ValueError("a neighbour model needs the key column of the new rows")
        train = as_features(spark.read.parquet(f"{path}/rows"), columns, info["scaling"])
        asked = matrix.select(F.col(f"__row.{key}").alias("key"), F.lit(None).cast("double").alias("label"), "vec")
        found = knn_predict(train, asked, info["task"], **info["options"]).select("key", "prediction")
        guess = matrix.withColumn("key", F.col(f"__row.{key}")).join(found, "key")
    name = f"Predicted_{target_name}" if target_name else "Prediction"
    result = guess.select("__row.*", F.col("prediction").alias(name))
    if info["task"] == "classification":
        classes = spark.read.parquet(f"{path}/classes").select(F.col("code").alias("value"), F.col("value").alias("__class"))
        result = attach_by_value(result, name, classes).withColumn(name, F.col("__class")).drop("__class")
    codes = repair.tables.get("target_codes") if repair else None
    return encode.decode_labels(result, name, codes) if codes is not None else result
