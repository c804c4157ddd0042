"""Feature engineering: dates, names, lags, entity counts, domain ratios, scaling (FE1-FE8, LEG5)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col, date_parts, human_date, lenient_timestamp, title_case
from ..functions.schema import is_numeric, is_text, numeric_columns, text_columns
from .lookup import attach_by_value, value_counts
from .ordering import with_lookback
from .profile import number
from .quantiles import exact_quantiles


def as_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse text columns leniently; real dates and timestamps stay (CST2)."""
    texts = {c: lenient_timestamp(col(c)) for c in columns if is_text(df.schema[c].dataType)}
    return df.withColumns(texts) if texts else df


def add_date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add year, month, day and dayofweek columns (FE1)."""
    return df.withColumns({f"{c}_{part}": e for c in columns for part, e in date_parts(col(c)).items()})


def humanise_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Dates to day-month-year text (FE2)."""
    return df.withColumns({c: human_date(col(c)) for c in columns}) if columns else df


def title_case_names(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Title-case every text column, or those among ``columns``, whose name contains ``name`` (FE3)."""
    named = [c for c in text_columns(df) if "name" in c.lower() and (columns is None or c in columns)]
    return df.withColumns({c: title_case(col(c)) for c in named}) if named else df


def lag_features(
    df: DataFrame, target: str, order_by: list[str], entity: list[str] | None = None, rows: int | None = None, **options
) -> DataFrame:
    """Add lags 1 and 2 and the rolling mean of 3 rows of the target; gaps get its median (FE4, FE5)."""
    names = {
        f"{target}_lag_1": ("lag", 1, 0),
        f"{target}_lag_2": ("lag", 2, 0),
        f"{target}_rolling_mean_3": ("avg", -2, 0),
    }
    added = with_lookback(df, order_by, entity or [], 2, names, target, rows, **options)
    median = exact_quantiles(df, [target], [0.5])[target][0]
    if median is None:
        return added
    return added.withColumns({n: F.coalesce(col(n).cast("double"), F.lit(median)) for n in names})


def past_mean(df: DataFrame, target: str, order_by: list[str], entity: list[str] | None = None, **options) -> DataFrame:
    """Mean of the three rows before, without the row itself: safe as a model feature."""
    names = {f"{target}_past_mean_3": ("avg", -3, -1)}
    return with_lookback(df, order_by, entity or [], 3, names, target, **options)


def entity_frequency(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """Add how often each identifier occurs (FE6): a folded count joined back, not a window, so an
    identifier on a third of the rows does not end in one task."""
    for c in columns:
        counts = value_counts(df, c, f"{c}_entity_frequency")
        df = attach_by_value(df, c, counts, counts.select("value", F.col(f"{c}_entity_frequency").alias("n")))
    return df


def traffic_features(df: DataFrame) -> DataFrame:
    """Departures plus arrivals and their ratio, for numeric columns named so (FE7)."""
    dep = arr = None
    for f in df.schema:
        if not is_numeric(f.dataType):
            continue
        if re.search(r"\bdep\b", f.name.lower()):
            dep = f.name
        if re.search(r"\barr\b", f.name.lower()):
            arr = f.name
    if not dep or not arr:
        return df
    return df.withColumns(
        {
            "traffic_volume": col(dep) + col(arr),
            "dep_arr_ratio": F.try_divide(col(dep).cast("double"), col(arr) + 1),
        }
    )


def scale_statistics(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """Shift and divisor per column: mean and population deviation, minimum and range, or median
    and interquartile range. A divisor of 0 is read as 1, so a constant column turns to 0."""
    if method == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        raw = {c: (q[c][1], (q[c][2] - q[c][0]) if q[c][1] is not None else None) for c in columns}
    else:
        first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        parts = []
        for i, c in enumerate(columns):
            parts += [first(number(df, c)).alias(f"a{i}"), second(number(df, c)).alias(f"b{i}")]
        row = df.agg(*parts).first()
        raw = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}
        if method == "minmax":
            raw = {c: (a, b - a if a is not None else None) for c, (a, b) in raw.items()}
        elif method != "standard":
            raise ValueError(f"unknown scaling {method!r}")
    return {c: (a or 0.0, b or 1.0) for c, (a, b) in raw.items()}


def scale(df: DataFrame, statistics: dict[str, tuple[float, float]], fill_zero: bool = True) -> DataFrame:
    """Apply fitted statistics; missing cells turn to 0 (FE8, LEG5)."""
    scaled = {c: (number(df, c) - F.lit(shift)) / F.lit(width) for c, (shift, width) in statistics.items()}
    if fill_zero:
        scaled = {c: F.coalesce(e, F.lit(0.0)) for c, e in scaled.items()}
    return df.withColumns(scaled)


def standardise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    return scale(df, scale_statistics(df, columns, "standard"))


def normalise_range(df: DataFrame, columns: list[str] | None = None, method: str = "minmax") -> DataFrame:
    columns = columns or numeric_columns(df)
    return scale(df, scale_statistics(df, columns, method))


def realign(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bring a table to a saved column list: absent columns are 0, extra ones leave (PRJ3)."""
    return df.select(*[col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def feature_matrix(df: DataFrame, target: str, quarantined: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The table without target and quarantined columns (PRJ2)."""
    return df.drop(*[c for c in (target, *quarantined) if c in df.columns])
