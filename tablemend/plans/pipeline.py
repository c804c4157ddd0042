"""The three whole jobs: analyse, clean, train."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from ..functions.cells import normalise, require_rows
from ..functions.schema import target_of
from ..operators.quality import drift_report
from ..operators.roles import build_strategy
from ..sinks.versions import append_record, version_record, write_json, write_table, write_version
from .diagnosis import Diagnosis, DiagnosisOptions, diagnose_table, report_table
from .policy import RepairPolicy, policy_for
from .repair import Repair, fit_repair
from .training import Comparison, compare_versions, save_comparison, train_and_compare


@dataclass
class Cleaned:
    readable: Repair
    model_ready: Repair
    before: Diagnosis
    after: Diagnosis


def analyse(df: DataFrame, target: str | None = None, options: DiagnosisOptions = DiagnosisOptions()) -> tuple[Diagnosis, DataFrame]:
    """Diagnosis and report of a table."""
    df = require_rows(normalise(df), "analysis")
    found = diagnose_table(df, target, options)
    return found, report_table(df, found)


def clean(
    df: DataFrame, target: str | None = None, policy: RepairPolicy | None = None, path: str | None = None,
    version: str = "1", options: DiagnosisOptions = DiagnosisOptions(), order_by: list[str] | None = None,
) -> Cleaned:
    """Readable and model-ready repair of a table; with ``path``, all tables and results written."""
    df = require_rows(normalise(df), "cleaning")
    target = target_of(df, target)
    before = diagnose_table(df, target, options)
    strategy = build_strategy(df, target)
    policy = policy or policy_for("gentle")
    readable = fit_repair(df, target, policy, strategy, before.leaking, readable=True, key=options.key)
    model_ready = fit_repair(
        df, target, policy_for("balanced", remove_duplicates=True), strategy, before.leaking, readable=False, order_by=order_by,
        key=options.key,
    )
    after = diagnose_table(readable.frame, target, options)
    if path:
        spark = df.sparkSession
        write_version(path, version, {"before_clean": df, "after_clean": readable.frame, "ml_ready": model_ready.frame})
        write_table(readable.frame, f"{path}/cleaned_dataset")
        record = version_record(df, readable.frame, before.issues, after.issues, version, asdict(policy))
        append_record(record, f"{path}/versions")
        write_json(drift_report(df, readable.frame), f"{path}/drift_report")
        write_json(readable.action_table(spark), f"{path}/cleaning_log")
        write_json(before.issues, f"{path}/original_diagnostics")
        write_json(after.issues, f"{path}/diagnostics")
        model_ready.save(spark, f"{path}/repair")
    return Cleaned(readable, model_ready, before, after)


def train(
    original: DataFrame, repaired: DataFrame, target: str, key: str, quarantined: list[str] | tuple[str, ...] = (),
    path: str | None = None, version: str = "1", **options,
) -> tuple[Comparison, Comparison, DataFrame]:
    """The same models on the original and the repaired table, and their scores side by side.

    With ``path``, scores, failures, importances and the best model of both are written there under ``version``.
    """
    spark = original.sparkSession
    first = train_and_compare(original, target, key, quarantined=quarantined, **options)
    second = train_and_compare(repaired, target, key, quarantined=quarantined, **options)
    if path:
        save_comparison(spark, first, path, "original", version)
        save_comparison(spark, second, path, "repaired", version)
    return first, second, compare_versions(spark, first, second)
