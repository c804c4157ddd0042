"""Schema walks: which columns are numeric, text, temporal (PRJ1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType) and f.name not in exclude]


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Keep the columns of one kind: ``numeric``, ``text`` or ``temporal``."""
    test = {"numeric": is_numeric, "text": is_text, "temporal": is_temporal}[kind]
    return df.select(*[quoted(f.name) for f in df.schema if test(f.dataType)])


def quoted(name: str) -> str:
    """Backquote a column name, so that dots and blanks in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


#: Field metadata that holds a column's marks; Spark keeps it in Parquet schemas.
MARKS = "tablemend"
KEY, PROTECTED, QUARANTINED = "key", "protected", "quarantined"


def with_marks(df: DataFrame, marks: dict[str, list[str]]) -> DataFrame:
    """Mark columns as key, protected or quarantined, beside the marks they have; unknown columns are an error."""
    wanted: dict[str, set[str]] = {}
    for kind, columns in marks.items():
        if kind not in (KEY, PROTECTED, QUARANTINED):
            raise ValueError(f"unknown mark {kind!r}")
        for c in columns:
            if c not in df.columns:
                raise ValueError(f"no column {c!r} to mark")
            wanted.setdefault(c, set()).add(kind)
    for c, kinds in wanted.items():
        kept = df.schema[c].metadata
        df = df.withMetadata(c, {**kept, MARKS: sorted({*kept.get(MARKS, []), *kinds})})
    return df


def marked_columns(df: DataFrame, kind: str) -> list[str]:
    """Columns with a mark, in the order of the table."""
    return [f.name for f in df.schema if kind in f.metadata.get(MARKS, [])]


def keep_marks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with the marks of the columns of the same name in ``before``, which a projection loses."""
    lost: dict[str, list[str]] = {}
    for f in before.schema:
        if f.name in after.columns:
            for kind in set(f.metadata.get(MARKS, [])) - set(after.schema[f.name].metadata.get(MARKS, [])):
                lost.setdefault(kind, []).append(f.name)
    return with_marks(after, lost) if lost else after


def target_of(df: DataFrame, target: str | None) -> str:
    """The target column: the one named, else the last."""
    name = target.strip() if target else df.columns[-1]
    if name not in df.columns:
        raise ValueError(f"target column {name!r} is not in the table; it has {df.columns}")
    return name
