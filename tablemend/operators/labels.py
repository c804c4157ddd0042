"""Label noise: neighbour vote, confident learning, relabelling (DGN13, LBL1, LBL2)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import col, missing
from ..functions.schema import numeric_columns, quoted, target_of, text_columns
from ..session import settle
from .encode import fit_codes, encode_with
from .features import scale, scale_statistics
from .neighbours import attach_neighbours, nearest, vector
from .profile import distinct_counts
from .roles import HIGH_CARDINALITY

NEIGHBOURS = 5
FEWEST_ROWS = 10
FOLDS = 3


def neighbour_features(df: DataFrame, target: str, key: str) -> DataFrame:
    """Key, label and scaled vector: numbers (missing is 0), text of at most 50 values as codes."""
    texts = [c for c in text_columns(df, [target]) if c != key]
    counts = distinct_counts(df, texts, watch=100)
    few = [c for c in texts if counts[c] <= HIGH_CARDINALITY]
    for c in few:
        # missing text is the value "0", as filling before encoding makes it
        df = encode_with(df.withColumn(c, F.coalesce(col(c), F.lit("0"))), c, fit_codes(df.fillna("0", [c]), c))
    numbers = [c for c in numeric_columns(df, [target]) if c != key]
    filled = df.fillna(0, numbers)
    scaled = scale(filled, scale_statistics(filled, numbers))
    return scaled.select(col(key).alias(key), col(target).alias("label"), vector(scaled, numbers).alias("vec"))


def neighbour_votes(
    labelled: DataFrame, key: str, k: int = NEIGHBOURS, exclude_self: bool = False, **options
) -> DataFrame:
    """Share of each label among the nearest rows, per row: key, given label, label, share.

    ``labelled`` has the key, ``label`` and ``vec``.
    """
    base = labelled.select(F.col("vec"), col(key).alias("id"), F.col("label").alias("__near"))
    found = nearest(labelled, base, k + (1 if exclude_self else 0), payload=["__near"], **options)
    paired = attach_neighbours(labelled, found, key, exclude_self, k)
    votes = paired.groupBy(key, F.col("__near").alias("voted")).agg(F.count(F.lit(1)).alias("n"))
    return _shares(votes, labelled, key)


def _shares(votes: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(key))
    given = labelled.select(col(key).alias(key), F.col("label").alias("given"))
    return votes.withColumn("share", F.col("n") / total).join(given, key).select(key, "given", "voted", "share")


def label_noise(labelled: DataFrame, key: str, k: int = NEIGHBOURS, exclude_self: bool = False, **options) -> DataFrame:
    """Rows whose label loses the vote of their nearest rows; ties go to the lowest label (DGN13).

    The row itself votes unless ``exclude_self``.
    """
    return _outvoted(neighbour_votes(labelled, key, k, exclude_self, **options), key)


def _outvoted(votes: DataFrame, key: str) -> DataFrame:
    best = votes.groupBy(key).agg(
        F.any_value("given").alias("given"), F.min(F.struct((-F.col("share")).alias("s"), "voted")).alias("best")
    )
    return best.select(key, "given", F.col("best.voted").alias("voted")).filter(F.col("given") != F.col("voted"))


def label_noise_report(df: DataFrame, target: str, key: str, task: str, k: int = NEIGHBOURS, **options) -> tuple[str, int | None]:
    """Method and count; a continuous target and tables of ten rows or fewer do not apply.

    Confident learning comes first, on the label shares of the nearest other rows: a row has no say in its own
    probabilities, whatever the number of classes. Where it finds nothing, the vote of the nearest rows counts, the row
    itself among them. One neighbour search serves both.
    """
    target = target_of(df, target)
    if task == "regression" or df.limit(FEWEST_ROWS + 1).count() <= FEWEST_ROWS:
        return "not_applicable", None
    labelled = settle(neighbour_features(df.filter(~missing(target, df.schema[target].dataType)), target, key))
    base = labelled.select(F.col("vec"), col(key).alias("id"), F.col("label").alias("__near"))
    found = nearest(labelled, base, k + 1, payload=["__near"], **options)

    def votes(exclude_self: bool) -> DataFrame:
        paired = attach_neighbours(labelled, found.filter((F.col("place") <= k) | F.lit(exclude_self)), key, exclude_self, k)
        return _shares(paired.groupBy(key, F.col("__near").alias("voted")).agg(F.count(F.lit(1)).alias("n")), labelled, key)

    shares = votes(True).select(key, "given", F.col("voted").alias("label"), F.col("share").alias("p"))
    issues = confident_label_issues(shares, key).count()
    return ("confident_learning", issues) if issues else ("knn_vote", _outvoted(votes(False), key).count())


def confident_label_issues(probabilities: DataFrame, key: str) -> DataFrame:
    """Confident learning (Northcutt, Jiang and Chuang 2021) on out-of-sample probabilities.

    ``probabilities`` holds key, ``given``, ``label``, ``p`` (absent labels have probability 0).
    A label is confident for a row if its probability reaches the mean probability that rows
    given that label have for it; a row whose most probable confident label is another than the
    given one is an issue.
    """
    own = probabilities.filter(F.col("given") == F.col("label"))
    given = probabilities.select(key, "given").distinct()
    sums = own.groupBy("given").agg(F.sum("p").alias("sum_p"))
    sizes = given.groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    # one row per class
    limits = sizes.join(sums, "given", "left").select(
        F.col("given").alias("label"), (F.coalesce("sum_p", F.lit(0.0)) / F.col("n")).alias("limit")
    )
    confident = probabilities.join(limits, "label").filter((F.col("p") >= F.col("limit")) & (F.col("p") > 0))
    likely = confident.groupBy(key).agg(
        F.any_value("given").alias("given"), F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("best")
    )
    return likely.select(key, "given", F.col("best.label").alias("likely"), (-F.col("best.q")).alias("p")).filter(
        F.col("given") != F.col("likely")
    )


def confident_joint(probabilities: DataFrame, key: str) -> DataFrame:
    """Counts of (given, likely) over the rows with a confident other label."""
    issues = confident_label_issues(probabilities, key)
    return issues.groupBy("given", "likely").agg(F.count(F.lit(1)).alias("n"))


def class_index(df: DataFrame, target: str) -> DataFrame:
    """(value, code): the classes of a target of any type, in order from 0. A missing label is no class."""
    classes = df.filter(~missing(target, df.schema[target].dataType)).groupBy(col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # one row a class: the only global order is over these
    return settle(classes.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("double").alias("code")))


def fold_of(key: str, folds: int = FOLDS) -> Column:
    """The fold of a row, by key: the same for every model and setting."""
    return F.pmod(F.xxhash64(col(key)), F.lit(folds)).cast("int")


def forest_probabilities(
    df: DataFrame, features: list[str], target: str, key: str, folds: int = FOLDS, trees: int = 50, depth: int = 5
) -> DataFrame:
    """Out-of-fold class probabilities of a random forest, long form: key, given, label, p.

    Folds go by key hash. The target holds class codes 0..k-1.
    """
    ready = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(
        df.select(quoted(key), col(target).cast("double").alias("__y"), *[quoted(c) for c in features]).fillna(0, features)
    )
    marked = ready.withColumn("__fold", fold_of(key, folds))
    parts = []
    for fold in range(folds):
        part, rest = marked.filter(F.col("__fold") == fold), marked.filter(F.col("__fold") != fold)
        if part.isEmpty() or rest.isEmpty():
            continue
        forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=42).fit(rest)
        parts.append(forest.transform(part))
    return reduce(DataFrame.unionByName, parts).select(
        quoted(key), F.col("__y").cast("int").alias("given"), F.posexplode(vector_to_array("probability")).alias("label", "p")
    )


def relabelled(df: DataFrame, features: list[str], target: str, key: str, **options) -> DataFrame:
    """(key, given, likely) of the rows whose label is a confident issue: the class they were given and the likely one.

    Labels of any type; 2 to 19 classes, else no rows. Features are numeric columns. Rows without a label have no issue.
    """
    codes = class_index(df, target)
    kind = df.schema[target].dataType
    if not 1 < codes.count() < 20 or not features:
        return df.select(col(key).alias(key), col(target).alias("given"), col(target).alias("likely")).limit(0)
    present = df.filter(~missing(target, kind)).select(col(key).alias(key), col(target).alias("value"), *[quoted(c) for c in features])
    coded = settle(present.join(F.broadcast(codes), "value"))  # fewer than 20 rows
    issues = confident_label_issues(forest_probabilities(coded, features, "code", key, **options), key)
    named = issues.select(key, F.col("given").cast("double").alias("code"), F.col("likely").cast("double").alias("__other"))
    named = named.join(F.broadcast(codes.withColumnRenamed("value", "given")), "code")
    other = codes.select(F.col("code").alias("__other"), F.col("value").alias("likely"))
    return named.join(F.broadcast(other), "__other").select(key, "given", "likely")


def relabel(
    df: DataFrame, features: list[str], target: str, key: str, classes: int | None = None, *, fixes: DataFrame | None = None, **options
) -> DataFrame:
    """Set the label of every confident issue to the likely label of the same row (LBL2).

    ``classes`` spares nothing but the search where it is known not to be 2 to 19.
    """
    if classes is not None and not 1 < classes < 20:
        return df
    fixes = relabelled(df, features, target, key, **options) if fixes is None else fixes
    return (
        df.join(fixes.select(key, F.col("likely").alias("__likely")), key, "left")
        .withColumn(target, F.coalesce("__likely", col(target)))
        .select(*[quoted(c) for c in df.columns])
    )
