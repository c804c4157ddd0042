"""Whole diagnosis of a table: counts of every check, issue list, score, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import normalise
from ..functions.schema import numeric_columns, quoted, target_of
from ..operators import correlate, diagnose, labels, near_duplicates, outliers, profile, quality, roles
from ..session import scratch, stored

ROW = "__row_number"


@dataclass(frozen=True)
class DiagnosisOptions:
    """The checks of rows against rows cost most, so they can be left out; what is left out is null.

    ``key`` names a unique column; without one a row number is given for the time of the diagnosis.
    """

    near_duplicates: bool = True
    isolation: bool = True
    label_noise: bool = True
    key: str | None = None
    skip_columns: tuple[str, ...] = ()


@dataclass
class Diagnosis:
    target: str
    metrics: DataFrame
    issues: DataFrame
    leaking: list[str]
    roles: dict[str, str]


def diagnose_table(df: DataFrame, target: str | None = None, options: DiagnosisOptions = DiagnosisOptions()) -> Diagnosis:
    """Run the checks over all rows and score what they find.

    Only counts reach the driver. A check that was left out or does not apply is null, not 0. The table is written once, as
    every check reads it anew; what a check writes is deleted when it ends.
    """
    spark = df.sparkSession
    with scratch(spark):
        return _diagnose(spark, df, target, options)


def _diagnose(spark: SparkSession, df: DataFrame, target: str | None, options: DiagnosisOptions) -> Diagnosis:
    df, key = normalise(df), options.key
    names = df.columns
    if key is None and (options.near_duplicates or options.isolation or options.label_noise):
        # written before use, so the numbers are the same wherever they are read
        df, key = df.withColumn(ROW, F.monotonically_increasing_id()), ROW
    keyed = stored(df)
    df = keyed.select(*[quoted(c) for c in names])
    target = target_of(df, target)
    numbers = [c for c in numeric_columns(df) if c not in options.skip_columns]
    summary = profile.profile_table(df)
    copies = profile.duplicate_rows(df).first()["n_duplicates"]
    beyond = profile.iqr_outliers(df, numbers).agg(F.sum("n_outliers")).first()[0] if numbers else 0
    ratio = diagnose.imbalance_ratio(df, target).first()["ratio"]
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in options.skip_columns])
    leaking = [r["column"] for r in correlate.leakage_scores(kept, target).filter("leaks").collect()]
    mixed = diagnose.mixed_fields(df, target).count()
    skewed = sum(
        1 for c in numbers if summary.columns[c].skew is not None and abs(summary.columns[c].skew) > 1.0
    )
    near = isolated = noisy = None
    if options.near_duplicates:
        with scratch(spark):
            near = near_duplicates.near_duplicate_rows(keyed, key, [c for c in df.columns if c != key]).count()
    if options.isolation and numbers and summary.rows > 20:
        inputs = [c for c in numbers if c != key]
        with scratch(spark):
            isolated = outliers.isolation_outliers(keyed, inputs, [key]).filter("is_outlier").count() if inputs else None
    if options.label_noise:
        with scratch(spark):
            noisy = labels.label_noise_report(keyed, target, key, roles.task_type(df, target))[1]
    row = (
        summary.rows, len(df.columns), len(numbers), summary.missing_total, copies, near,
        beyond, isolated, noisy, ratio, len(leaking), mixed, skewed,
    )
    metrics = profile.rows_frame(spark, [row], diagnose.METRICS)
    return Diagnosis(target, metrics, diagnose.issues_from_metrics(metrics), leaking, roles.detect_roles(df, target))


def report_table(df: DataFrame, found: Diagnosis, results: DataFrame | None = None) -> DataFrame:
    """Assessment report as rows (section, ord, item, value) in fixed section order (SNK6).

    ``results`` is a model comparison (dataset, model, metric, value).
    """
    spark = df.sparkSession
    scores = quality.quality_scores(found.metrics).first()
    metrics = found.metrics.first()
    domain, industry = quality.report_domain(df.columns)
    n_classes = diagnose.class_distribution(df, found.target).count()
    rows = [
        ("1 summary", "suitability", scores["suitability"]),
        ("1 summary", "quality_score", f"{scores['quality_score']:.1f}"),
        ("1 summary", "domain", domain),
        ("1 summary", "industry", industry),
        ("1 summary", "rows", str(metrics["rows"])),
        ("1 summary", "columns", str(metrics["columns"])),
    ]
    issues = found.issues.orderBy("type").collect()  # at most one row per kind of issue
    rows += [("2 issues", r["type"], f"{r['severity']} {r['score']:.4f}") for r in issues]
    rows += [
        ("3 interventions", r["issue"], r["strategy"])
        for r in quality.interventions(found.issues).orderBy("issue").collect()
    ]
    rows += [
        ("4 strengths and weaknesses", r["kind"], r["point"])
        for r in quality.strengths_and_weaknesses(found.metrics, found.issues).orderBy("kind", "point").collect()
    ]
    names = ("duplicates", "missing", "outliers", "isolation_outliers", "label_noise", "near_duplicates")
    rows += [("5 diagnostics", n, "not run" if metrics[n] is None else str(metrics[n])) for n in names]
    rows += [("5 diagnostics", "target", found.target)]
    rows += [("5 diagnostics", "leaking", c) for c in found.leaking]
    rows += [("5 diagnostics", f"role of {c}", r) for c, r in sorted(found.roles.items())]
    rows += [(f"6 {kind}s", kind, text) for kind, text in quality.suggested_tasks(df, n_classes)]
    report = profile.rows_frame(
        spark, [(s, i, item, v) for i, (s, item, v) in enumerate(rows)], "section string, ord int, item string, value string"
    )
    if results is not None:
        models = results.select(
            F.lit("7 models").alias("section"),
            F.lit(len(rows)).alias("ord"),
            F.concat_ws(" / ", "model", "metric", "dataset").alias("item"),
            F.format_string("%.4f", "value").alias("value"),
        )
        report = report.unionByName(models)
    verdict = profile.rows_frame(
        spark, [("8 verdict", 1_000_000, "verdict", scores["verdict"])], "section string, ord int, item string, value string"
    )
    return report.unionByName(verdict)
