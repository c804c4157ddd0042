"""Model scores as aggregates over predictions (ML9, ML10, ML12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, as one row.

    Works on the confusion counts, at most the square of the number of classes; a class that is
    never predicted has precision 0.
    """
    confusion = predictions.groupBy(col(label).alias("a"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    by_class = sides.groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    precision = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hit") / F.col("actual")).otherwise(0.0)
    scored = by_class.select("actual", "hit", precision.alias("pr"), recall.alias("re")).withColumn(
        "f1", F.when(F.col("pr") + F.col("re") > 0, 2 * F.col("pr") * F.col("re") / (F.col("pr") + F.col("re"))).otherwise(0.0)
    )
    total = F.sum("actual")
    return scored.agg(
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum(F.col("actual") * F.col("pr")) / total).alias("precision"),
        (F.sum(F.col("actual") * F.col("re")) / total).alias("recall"),
        (F.sum(F.col("actual") * F.col("f1")) / total).alias("f1"),
    )


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean absolute and squared error and R2, as one row, in one aggregate."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    return predictions.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y)).alias("unexplained"),
    ).select("mae", "mse", (1 - F.col("unexplained")).alias("r2"))


def composite_score(task: str, scores: dict[str, float], gap: float) -> float:
    """Performance less a penalty for the gap between training and test score."""
    if task == "classification":
        return 0.5 * scores["accuracy"] + 0.4 * scores["f1"] - 0.1 * abs(gap)
    return 0.8 * scores["r2"] - 0.2 * abs(gap)
