"""Sinks: tables, versioned snapshots, version records and JSON results (SNK1-SNK5)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame



def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A table as Parquet, or as CSV with header (SNK1, SNK2)."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_version(path: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Each named table once, in the folder of the version (SNK3)."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}/version={version}")


def version_record(
    before: DataFrame, after: DataFrame, issues_before: DataFrame, issues_after: DataFrame, version: str, policy: dict
) -> DataFrame:
    """One row on a version: sizes and issues before and after, issues resolved (SNK4)."""
    resolved = [r["type"] for r in issues_before.select("type").subtract(issues_after.select("type")).orderBy("type").collect()]
    rows_before, rows_after = before.count(), after.count()
    row = (
        version, 42, rows_before, rows_after, len(before.columns), len(after.columns), issues_before.count(),
        issues_after.count(), resolved, rows_before - rows_after, len(before.columns) - len(after.columns), json.dumps(policy),
    )
    schema = (
        "version string, seed int, original_rows long, cleaned_rows long, original_columns int, cleaned_columns int, "
        "original_issues long, cleaned_issues long, issues_resolved array<string>, rows_removed long, "
        "columns_removed int, policy string"
    )
    return before.sparkSession.createDataFrame([row], schema)


def append_record(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A result table as JSON lines (SNK5)."""
    df.write.mode("overwrite").json(path)


