"""Column expressions on single cells: missing values, literals in text, text and date forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import is_fractional, is_numeric, is_text, quoted

# Text literals that count as a number or begin like a date.
NUMBER_PATTERN = r"(?U)^-?\d*\.?\d+$"
DATE_PATTERN = r"(?U)^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"

# Timestamp formats tried in turn when text is parsed leniently.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-M-d",
    "yyyy/M/d",
    "M/d/yyyy",
    "M-d-yyyy",
    "d-MMM-yyyy",
    "d/MMM/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
    "d-M-yyyy",
    "d/M/yyyy",
    "yyyyMMdd",
    "yyyy-MM",
    "yyyy",
]


def col(name: str) -> Column:
    return F.col(quoted(name))


def clean_value(name: str, dtype: T.DataType) -> Column:
    """The cell with NaN turned into null (the two are one kind of missing)."""
    cell = col(name)
    return F.nanvl(cell, F.lit(None).cast(dtype)) if is_fractional(dtype) else cell


def finite_value(name: str, dtype: T.DataType) -> Column:
    """The cell with NaN and both infinities turned into null (CST1)."""
    if not is_fractional(dtype):
        return col(name)
    cell = col(name)
    infinite = [float("inf"), float("-inf"), float("nan")]
    return F.when(~cell.isin(infinite), cell)


def missing(name: str, dtype: T.DataType) -> Column:
    cell = col(name)
    return (cell.isNull() | F.isnan(cell)) if is_fractional(dtype) else cell.isNull()


def as_double(name: str, dtype: T.DataType) -> Column:
    return clean_value(name, dtype).cast("double")


def number_literal(cell: Column) -> Column:
    return cell.rlike(NUMBER_PATTERN)


def date_literal(cell: Column) -> Column:
    return cell.rlike(DATE_PATTERN)


def text_to_number(cell: Column) -> Column:
    """Lenient text-to-number (CST3): anything that is not a plain number turns into null."""
    plain = F.trim(cell)
    return F.when(plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), plain.try_cast("double"))


def lenient_timestamp(cell: Column) -> Column:
    """Lenient timestamp parse (CST2): the first format that fits, else null."""
    text = F.trim(cell)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS])


def title_case(cell: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others (FE3)."""
    runs = F.regexp_extract_all(cell, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 2**31 - 1)))),
        "",
    )


def human_date(cell: Column) -> Column:
    """Date as day-month-year text (FE2)."""
    return F.date_format(cell, "dd-MM-yyyy")


def date_parts(cell: Column) -> dict[str, Column]:
    """Year, month, day and weekday (Monday is 0); a missing date gives 0, 1, 1, 0 (FE1)."""
    return {
        "year": F.coalesce(F.year(cell), F.lit(0)),
        "month": F.coalesce(F.month(cell), F.lit(1)),
        "day": F.coalesce(F.dayofmonth(cell), F.lit(1)),
        "dayofweek": F.coalesce(F.weekday(cell), F.lit(0)),
    }


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as one text, cells joined by a bar."""
    return F.concat_ws(" | ", *[col(c).cast("string") for c in (columns or df.columns)])


def tidy_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names (SRC7); two names that then collide are an error."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide once stripped: {sorted(names)}")
    return df.toDF(*names)


def normalise(df: DataFrame) -> DataFrame:
    """One boundary step: tidy names, NaN and infinities to null (SRC7, CST1)."""
    named = tidy_names(df)
    changed = {f.name: finite_value(f.name, f.dataType) for f in named.schema if is_fractional(f.dataType)}
    return named.withColumns(changed) if changed else named


def numeric_text(df: DataFrame) -> list[str]:
    """Names of numeric then text columns, the two kinds the diagnostics inspect."""
    return [f.name for f in df.schema if is_numeric(f.dataType) or is_text(f.dataType)]


def require_rows(df: DataFrame, step: str) -> DataFrame:
    """Shape guard (SRC10): a table without columns or rows is an error at the boundary."""
    if not df.columns:
        raise ValueError(f"the table has no columns before {step}")
    if df.isEmpty():
        raise ValueError(f"the table has no rows before {step}")
    return df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is missing (FLT1)."""
    return df.na.drop("all")


def present_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows in which one column is present (FLT2)."""
    dtype = df.schema[column].dataType
    return df.filter(~missing(column, dtype))
