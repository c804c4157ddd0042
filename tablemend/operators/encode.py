"""Encoders as mapping tables: frequency, one-hot, ordinal, label; sample weights (ENC1-ENC7, WGT1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import col, missing
from ..functions.schema import is_numeric, quoted, target_of
from .lookup import attach_by_value, value_counts
from .ordering import with_row_numbers
from .roles import HIGH_CARDINALITY, ORDINAL_SCALES


def fit_frequency(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Share of the present rows each value holds, as a table (value, share, n)."""
    counts = value_counts(df, column)
    present = df.filter(col(column).isNotNull()).count() if rows is None else rows
    return counts.select("value", (F.col("n") / F.lit(max(1, present))).alias("share"), "n")


def frequency_encode(df: DataFrame, columns: list[str], fitted: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add ``<column>_freq``; the column itself is kept. Unseen and missing values give 0 (ENC1)."""
    for c in columns:
        table = fitted[c] if fitted else fit_frequency(df, c)
        joined = attach_by_value(df, c, table.select("value", "share"), fitted_counts(table))
        df = joined.withColumn(f"{c}_freq", F.coalesce("share", F.lit(0.0))).drop("share")
    return df


def fitted_counts(table: DataFrame) -> DataFrame | None:
    """(value, n) of a mapping table that carries the rows its values held when it was fitted."""
    return table.select("value", "n") if "n" in table.columns else None


def fit_categories(df: DataFrame, columns: list[str], limit: int = HIGH_CARDINALITY) -> dict[str, list[str]]:
    """Sorted categories per column; a column with more than ``limit`` is an error, not a cut."""
    if not columns:
        return {}
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
        ).alias("cell")
    ).select("cell.*")
    found: dict[str, list[str]] = {c: [] for c in columns}
    seen = cells.filter(F.col("value").isNotNull()).distinct().limit(len(columns) * limit + 1)
    for r in seen.collect():
        found[r["column"]].append(r["value"])
    wide = [c for c, values in found.items() if len(values) > limit]
    if wide or sum(map(len, found.values())) > len(columns) * limit:
        raise ValueError(f"more than {limit} categories in {wide or columns}: use frequency encoding")
    return {c: sorted(values) for c, values in found.items()}


def one_hot(df: DataFrame, columns: list[str], categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``<column>_<value>`` indicators; an unknown value has zeros everywhere (ENC2, ENC7)."""
    categories = categories or fit_categories(df, columns)
    return df.withColumns(
        {
            f"{c}_{v}": F.coalesce((col(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0))
            for c in columns
            for v in categories[c]
        }
    )


def fit_codes(df: DataFrame, column: str, semantic: bool = False) -> DataFrame:
    """Codes 0, 1, ... of the distinct values in text order, as a table (value, code, n).

    ``semantic`` puts the words of a known scale in the order of that scale.
    """
    values = df.filter(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if semantic:
        place = F.lit(None).cast("int")
        for scale in reversed(ORDINAL_SCALES):
            for i, word in enumerate(scale):
                place = F.when(F.lower("value") == word, F.lit(i)).otherwise(place)
        ordered = with_row_numbers(values.withColumn("__scale", F.coalesce(place, F.lit(len(ORDINAL_SCALES[2])))), ["__scale", "value"])
        return ordered.select("value", (F.col("position") - 1).cast("int").alias("code"), "n")
    ordered = with_row_numbers(values, ["value"])
    return ordered.select("value", (F.col("position") - 1).cast("int").alias("code"), "n")


def encode_with(df: DataFrame, column: str, codes: DataFrame, into: str | None = None, unknown: int = -1) -> DataFrame:
    """Replace (or add) a column by its codes; values the table does not hold get ``unknown``."""
    as_text = df.withColumn("__text", col(column).cast("string"))
    joined = attach_by_value(as_text, "__text", codes.select("value", "code"), fitted_counts(codes)).drop("__text")
    return joined.withColumn(into or column, F.coalesce("code", F.lit(unknown))).drop("code")


def ordinal_encode(df: DataFrame, columns: list[str], semantic: bool = False) -> DataFrame:
    """Codes in text order, or in the order of the scale (ENC3)."""
    order = df.columns
    for c in columns:
        df = encode_with(df, c, fit_codes(df, c, semantic))
    return df.select(*[quoted(c) for c in order])


def label_encode(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Text target to codes of its sorted classes, with the class table (ENC4); numbers stay."""
    target = target_of(df, target)
    if is_numeric(df.schema[target].dataType):
        return df, None
    codes = fit_codes(df, target)
    return encode_with(df, target, codes).select(*[quoted(c) for c in df.columns]), codes


def decode_labels(df: DataFrame, column: str, codes: DataFrame, into: str | None = None) -> DataFrame:
    """Class of each predicted code (ENC5). The class table has one row per class."""
    classes = codes.select(F.col("code").cast("int").alias("value"), F.col("value").alias("__class"))
    keyed = df.withColumn("__code", col(column).cast("int"))
    joined = attach_by_value(keyed, "__code", classes)
    kept = [c for c in df.columns if c != (into or column)]
    return joined.select(*[quoted(c) for c in kept], F.col("__class").alias(into or column))


def save_encoder(table: DataFrame, path: str) -> None:
    """Keep a mapping table as Parquet (ENC6)."""
    table.write.mode("overwrite").parquet(path)


def load_encoder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


MOST_WEIGHTED_CLASSES = 50
BALANCED = 0.8


def class_weights(df: DataFrame, target: str | None = None) -> dict:
    """Balanced weight n / (k * n_c) per class, or none if the target is not an imbalanced
    numeric one of 2 to 50 classes (WGT1)."""
    target = target_of(df, target)
    if not is_numeric(df.schema[target].dataType):
        return {}
    present = df.filter(~missing(target, df.schema[target].dataType))
    counts = present.groupBy(col(target).alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_WEIGHTED_CLASSES + 1)
    found = {r["y"]: r["n"] for r in counts.collect()}
    if not 2 <= len(found) <= MOST_WEIGHTED_CLASSES or min(found.values()) / max(found.values()) >= BALANCED:
        return {}
    total = sum(found.values())
    return {y: total / (len(found) * n) for y, n in found.items()}


def sample_weights(df: DataFrame, target: str | None = None) -> DataFrame:
    """Add ``weight`` if the classes call for it; at most 50 classes become literals, no join."""
    target = target_of(df, target)
    weights = class_weights(df, target)
    if not weights:
        return df
    weight = F.lit(None).cast("double")
    for y, w in weights.items():
        weight = F.when(col(target) == F.lit(y), F.lit(w)).otherwise(weight)
    return df.withColumn("weight", weight)
