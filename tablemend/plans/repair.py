"""Repair of a whole table: fitted once as literal steps, applied to any table of the same kind.

Fitting walks the fixed order of repair steps. Each step reads its statistics from the table as
it stands, turns them into literals, and becomes a projection; only neighbour fills, code tables
and counts need a join. The fitted steps can be saved and applied to new rows, so a prediction
batch is repaired with the statistics of the training table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cells import col, drop_empty_rows, missing, normalise, number_literal, require_rows, text_to_number
from ..functions.schema import (
    KEY, PROTECTED, QUARANTINED, is_numeric, is_text, keep_marks, marked_columns, numeric_columns, quoted, target_of, text_columns, with_marks,
)
from ..operators import encode, extra, features, impute, labels, near_duplicates, outliers, quality, roles
from ..operators.correlate import redundant_pairs
from ..operators.lookup import attach_by_value, join_spread, value_counts
from ..operators.neighbours import MARK, marked, nearest, vector
from ..operators.profile import number, rows_frame
from ..operators.quantiles import exact_quantiles
from ..operators.roles import DATETIME, IDENTIFIER, NOMINAL, ORDINAL, Strategy, build_strategy
from ..session import settle
from .policy import RepairPolicy, policy_for


#: Rows that lags and the rolling mean look back.
LAG_ROWS = 3


@dataclass
class Step:
    kind: str
    args: dict


@dataclass
class Repair:
    """Fitted repair: steps with literal statistics, and the mapping tables some steps join."""

    target: str
    steps: list[Step] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    actions: list[tuple] = field(default_factory=list)
    quarantined: list[str] = field(default_factory=list)
    weights: dict = field(default_factory=dict)
    frame: DataFrame | None = None

    def apply(self, df: DataFrame, with_target: bool = True) -> DataFrame:
        """Repair another table with the fitted statistics. Without a target, steps on the target and
        steps that drop rows are left out; lags go on from the last rows of the fitted table."""
        for step in self.steps:
            if not with_target and step.kind == "lags":
                df = _later_lags(df, step.args, self.tables)
                continue
            if not with_target and (step.args.get("on_target") or step.kind in ("drop_duplicates", "drop_empty_rows")):
                continue
            df = _apply(df, step, self.tables)
        return df

    def action_table(self, spark: SparkSession) -> DataFrame:
        """Log of the steps taken (AUD1): step, column, detail, cells."""
        return rows_frame(spark, self.actions, "step string, column string, detail string, cells long")

    def save(self, spark: SparkSession, path: str) -> None:
        """Mapping tables as Parquet, steps as one JSON row (ENC6)."""
        for name, table in self.tables.items():
            encode.save_encoder(table, f"{path}/tables/{name}")
        body = json.dumps(
            {
                "target": self.target,
                "quarantined": self.quarantined,
                "tables": sorted(self.tables),
                "steps": [{"kind": s.kind, "args": s.args} for s in self.steps],
            }
        )
        rows_frame(spark, [(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/steps")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Repair:
        saved = json.loads(spark.read.text(f"{path}/steps").first()["value"])
        return Repair(
            target=saved["target"],
            quarantined=saved["quarantined"],
            steps=[Step(s["kind"], s["args"]) for s in saved["steps"]],
            tables={n: encode.load_encoder(spark, f"{path}/tables/{n}") for n in saved["tables"]},
        )


# ---- applying one fitted step --------------------------------------------------------------


def _apply(df: DataFrame, step: Step, tables: dict[str, DataFrame]) -> DataFrame:
    return keep_marks(df, _APPLY[step.kind](df, step.args, tables))


def _only(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _fill(df, args, tables):
    return impute.fill_with(df, {c: v for c, v in args["values"].items() if c in df.columns})


def _later_fill(df, args, tables):
    """Fill without changing a column's type."""
    values = {c: v for c, v in args["values"].items() if c in df.columns}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def _regression(df, args, tables):
    guess = F.lit(args["intercept"])
    for c, slope in zip(args["context"], args["slopes"]):
        guess = guess + F.lit(slope) * number(df, c)
    return df.withColumn(args["column"], F.coalesce(number(df, args["column"]), guess))


def _knn(df, args, tables):
    column, context = args["column"], args["context"]
    hole = missing(column, df.schema[column].dataType)
    holes = marked(df.filter(hole).withColumn("vec", vector(df, context)))
    found = nearest(holes, tables[args["table"]], args["k"], payload=["__value"])
    means = found.groupBy(*MARK).agg(F.avg("__value").alias("__fill"))
    whole = df.filter(~hole).withColumn(column, number(df, column))
    mended = join_spread(holes, means, MARK, "left").withColumn(column, F.col("__fill")).drop("vec", "__fill", *MARK)
    return whole.unionByName(mended.select(*[quoted(c) for c in df.columns]))


def _clip(df, args, tables):
    clipped = {}
    for c, (low, high) in args["bounds"].items():
        x = number(df, c)
        clipped[c] = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return df.withColumns(clipped)


def _outside_to_median(df, args, tables):
    changed = {}
    for c, (low, high, median) in args["bounds"].items():
        x = number(df, c)
        changed[c] = F.when((x < low) | (x > high), F.lit(median)).otherwise(x)
    return df.withColumns(changed)


def _isolated_to_median(df, args, tables):
    forest = [{k: np.array(v) for k, v in tree.items()} for tree in args["forest"]]
    c = args["column"]
    ready = df.withColumn("__x", F.coalesce(number(df, c), F.lit(args["median"])))
    scored = outliers.score_isolation(ready, ["__x"], forest, args["size"])
    odd = (F.col("anomaly_score") > args["cut"]) & number(df, c).isNotNull()
    return scored.withColumn(c, F.when(odd, F.lit(args["median"])).otherwise(number(df, c))).drop("__x", "anomaly_score")


def _frequency(df, args, tables):
    c = args["column"]
    table = tables[args["table"]]
    joined = attach_by_value(df, c, table.select("value", "share"), encode.fitted_counts(table))
    return joined.withColumn(f"{c}_freq", F.coalesce("share", F.lit(0.0))).drop("share")


def _entity(df, args, tables):
    c = args["column"]
    joined = attach_by_value(df, c, tables[args["table"]], tables[args["table"]])
    return joined.withColumn(f"{c}_entity_frequency", F.coalesce("n", F.lit(0))).drop("n")


def _codes(df, args, tables):
    c = args["column"]
    return encode.encode_with(df, c, tables[args["table"]]).select(*[quoted(n) for n in df.columns])


def _lagged(df: DataFrame, args: dict) -> DataFrame:
    target = args["target"]
    # earlier rows only: a row's own target is not among its features
    names = {f"{target}_lag_1": ("lag", 1, 0), f"{target}_lag_2": ("lag", 2, 0), f"{target}_rolling_mean_3": ("avg", -LAG_ROWS, -1)}
    return features.with_lookback(df, args["order_by"], args["entity"], LAG_ROWS, names, target)


def _lag_fills(df: DataFrame, args: dict) -> DataFrame:
    names = [f"{args['target']}_{part}" for part in ("lag_1", "lag_2", "rolling_mean_3")]
    return df.withColumns({n: F.coalesce(col(n).cast("double"), F.lit(args["median"])) for n in names})


def _lags(df, args, tables):
    return _lag_fills(_lagged(df, args), args)


def _later_lags(df: DataFrame, args: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """Lags of rows that come after the training table: its last rows per entity go in front of them, and known targets of
    the new rows are rolled on."""
    target, names = args["target"], [*args["order_by"], *args["entity"]]
    absent = [c for c in names if c not in df.columns]
    if absent or args.get("table") not in tables:
        return df
    given = df if target in df.columns else df.withColumn(target, F.lit(None).cast("double"))
    state = tables[args["table"]].select(*[quoted(c) for c in names], quoted(target), F.lit(True).alias("__past"))
    both = given.withColumn("__past", F.lit(False)).unionByName(state, allowMissingColumns=True)
    added = _lag_fills(_lagged(both, args), args).filter(~F.col("__past")).drop("__past")
    return added if target in df.columns else added.drop(target)


def lag_state(df: DataFrame, target: str, order_by: list[str], entity: list[str]) -> DataFrame:
    """The last rows of each entity by the order keys: keys, entity and target, as many as lags look back."""
    rows = df.select(*[quoted(c) for c in [*order_by, *entity]], quoted(target))
    if not entity:
        return rows.orderBy(*[col(c).desc() for c in order_by]).limit(LAG_ROWS)
    last = Window.partitionBy(*[col(c) for c in entity]).orderBy(*[col(c).desc() for c in order_by])
    return rows.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= LAG_ROWS).drop("__r")


_APPLY = {
    "normalise": lambda df, a, t: normalise(df),
    "drop_columns": lambda df, a, t: df.drop(*_only(df, a["columns"])),
    "empty_columns": lambda df, a, t: impute.replace_empty_columns(df, _only(df, a["columns"])),
    "drop_empty_rows": lambda df, a, t: drop_empty_rows(df),
    "drop_duplicates": lambda df, a, t: near_duplicates.drop_exact_duplicates(df),
    "timestamps": lambda df, a, t: features.as_timestamps(df, _only(df, a["columns"])),
    "human_dates": lambda df, a, t: features.humanise_dates(df, _only(df, a["columns"])),
    "date_parts": lambda df, a, t: features.add_date_parts(df, _only(df, a["columns"])),
    "title_case": lambda df, a, t: features.title_case_names(df, a.get("columns")),
    "to_number": lambda df, a, t: df.withColumns({c: text_to_number(col(c)) for c in _only(df, a["columns"])}),
    "fill": _fill,
    "later_fill": _later_fill,
    "regression": _regression,
    "knn": _knn,
    "clip": _clip,
    "outside_to_median": _outside_to_median,
    "isolated_to_median": _isolated_to_median,
    "log1p": lambda df, a, t: df.withColumns({c: F.log1p(number(df, c)) for c in a["columns"]}),
    "transform": lambda df, a, t: extra.apply_transforms(df, {c: tuple(p) for c, p in a["plan"].items()}),
    "scale": lambda df, a, t: features.scale(df, {c: tuple(s) for c, s in a["statistics"].items()}),
    "lags": _lags,
    "entity": _entity,
    "traffic": lambda df, a, t: features.traffic_features(df),
    "frequency": _frequency,
    "one_hot": lambda df, a, t: encode.one_hot(df, list(a["categories"]), a["categories"]),
    "codes": _codes,
    "blank_text": lambda df, a, t: df.withColumns(
        {c: F.when(F.trim(col(c)) != "", col(c)) for c in _only(df, a["columns"])}
    ),
}


# ---- fitting -------------------------------------------------------------------------------


class _Fitting:
    """The table as repaired so far, with the steps that led there."""

    def __init__(self, df: DataFrame, target: str):
        self.df = df
        self.repair = Repair(target=target)

    def do(self, kind: str, log: tuple | None = None, mapping: DataFrame | None = None, **args) -> None:
        if mapping is not None:
            self.repair.tables[args["table"]] = mapping
        step = Step(kind, args)
        self.df = _apply(self.df, step, self.repair.tables)
        self.repair.steps.append(step)
        if log:
            self.log(*log)

    def log(self, step: str, column: str | None, detail: str, cells: int | None = None) -> None:
        self.repair.actions.append((step, column, detail, cells))

    def holes(self, columns: list[str]) -> dict[str, int]:
        if not columns:
            return {}
        row = self.df.agg(
            *[F.count_if(missing(c, self.df.schema[c].dataType)).alias(f"n{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def fit_repair(
    df: DataFrame,
    target: str | None = None,
    policy: RepairPolicy | None = None,
    strategy: Strategy | None = None,
    leaking: list[str] | tuple[str, ...] = (),
    readable: bool = True,
    order_by: list[str] | None = None,
    entity: list[str] | None = None,
    key: str | list[str] | None = None,
) -> Repair:
    """Fit the repair of a table; ``result.frame`` is the repaired table.

    ``readable`` keeps the column list (dates as text, no encoding); otherwise the table becomes
    model-ready. Lags of a time series need ``order_by``. Columns named by ``key`` tell rows apart:
    no step changes them, and none reads them as a number; without ``key`` those marked as key in the
    schema count. Columns marked as protected pass unchanged as well, and the marks of both and of
    quarantined columns stay in the schema of the result. Columns that the strategy protects are never
    dropped for their holes.
    """
    keys = [key] if isinstance(key, str) else list(key or marked_columns(df, KEY))
    protected = [c.strip() for c in marked_columns(df, PROTECTED)]
    policy = policy or policy_for("gentle" if readable else "balanced")
    marks = {KEY: keys, PROTECTED: protected, QUARANTINED: [c.strip() for c in marked_columns(df, QUARANTINED)]}
    labels_key = keys
    df = normalise(df)
    require_rows(df, "repair")
    original = df.columns
    target = target_of(df, target)
    strategy = strategy or build_strategy(df, target)
    if strategy.is_small:
        policy = policy.merge(apply_transformation=False, apply_normalization=False, apply_log_transform=False)
    keys = [*keys, *(c for c in protected if c not in keys and c != target)]
    fit = _Fitting(df, target)
    fit.do("normalise")
    rows = strategy.rows
    dropped: list[str] = []

    holes = fit.holes(df.columns)
    empty = [c for c in df.columns if holes[c] == rows and c not in protected]
    if empty:
        fit.do("empty_columns", ("fill_empty_columns", None, ", ".join(empty)), columns=empty)
    fit.do("drop_empty_rows")
    if policy.remove_duplicates:
        fit.do("drop_duplicates", ("remove_duplicates", None, "exact copies"))

    identifiers = [c for c in strategy.with_role(IDENTIFIER) if c != target]
    leaking = [c for c in leaking if c in df.columns and c != target]
    fit.repair.quarantined = sorted({*identifiers, *leaking})
    for step, columns in (("flag_identifier_columns", identifiers), ("flag_leakage_columns", leaking)):
        for c in columns:
            fit.log(step, c, "quarantined")
    sparse = [c for c in df.columns if c != target and c not in empty and c not in keys and holes[c] / max(1, rows) > policy.missing_column_threshold]
    for c in sparse:
        fit.log("flag_high_missing_columns", c, f"over {policy.missing_column_threshold} missing, filled all the same", holes[c])
    for wanted, columns in (
        (policy.drop_identifier_columns, identifiers),
        (policy.drop_leakage_columns, leaking),
        (policy.drop_high_missing_columns, [c for c in sparse if c not in strategy.protected]),
    ):
        gone = [c for c in columns if wanted and c in fit.df.columns and c not in keys]
        if gone:
            fit.do("drop_columns", ("drop_columns", None, ", ".join(gone)), columns=gone)
            dropped += gone

    dates = [c for c in strategy.with_role(DATETIME) if c in fit.df.columns and c not in (target, *keys)]
    if dates:
        fit.do("timestamps", ("datetime_normalization", None, ", ".join(dates)), columns=dates)
    numbers = [c for c in numeric_columns(fit.df, [target, *keys])]
    if dates:
        fit.do("human_dates" if readable else "date_parts", columns=dates)
    fit.do("title_case", columns=[c for c in fit.df.columns if c not in keys])
    if policy.convert_mixed_numeric_text:
        texts = text_columns(fit.df, [target, *keys])
        if texts:
            row = fit.df.agg(
                *[F.count_if(number_literal(col(c))).alias(f"n{i}") for i, c in enumerate(texts)],
                *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(texts)],
            ).first()
            mixed = [c for i, c in enumerate(texts) if 0 < row[f"n{i}"] < row[f"p{i}"]]
            if mixed:
                fit.do("to_number", ("mixed_type_coercion", None, ", ".join(mixed)), columns=mixed)
                numbers += mixed

    _fit_fills(fit, numbers, [target, *keys], empty, policy)
    _fit_later_fills(fit, [target, *keys])
    if policy.handle_outliers:
        _fit_outliers(fit, numbers, policy)
    if policy.apply_log_transform and not strategy.is_small:
        _, chosen = outliers.log_skewed(fit.df, numbers, policy.skew_threshold)
        if chosen:
            fit.do("log1p", ("log_transformation", None, ", ".join(chosen)), columns=chosen)
    if policy.apply_transformation and numbers:
        plan = extra.transform_plan(fit.df, numbers, policy.transformation_method)
        if plan:
            fit.do("transform", ("transformation", None, ", ".join(plan)), plan={c: list(p) for c, p in plan.items()})
    if policy.apply_normalization and numbers:
        statistics = features.scale_statistics(fit.df, numbers, policy.normalization_method)
        fit.do("scale", ("normalization", None, policy.normalization_method), statistics={c: list(s) for c, s in statistics.items()})

    if not readable:
        _fit_features(fit, strategy, target, order_by, entity)
    if not readable and policy.encode_features:
        _fit_encoding(fit, strategy, target, keys)
    _fit_sweep(fit, keys)
    if not readable and policy.correct_label_noise:
        _fit_labels(fit, target, labels_key)

    quality.require_no_column_loss([c for c in original if c not in dropped], fit.df.columns)
    fit.repair.weights = encode.class_weights(fit.df, target)
    if fit.repair.weights:
        fit.log("sample_weight_computation", target, "balanced")
    if not readable and policy.encode_features:
        for r in redundant_pairs(fit.df, numeric_columns(fit.df, [target, *keys])).collect():
            fit.log("flag_redundant_features", r["right"], f"correlates {r['r']} with {r['left']}")
    fit.repair.quarantined = sorted({*fit.repair.quarantined, *marks[QUARANTINED]})
    marks[QUARANTINED] = fit.repair.quarantined
    fit.repair.frame = with_marks(fit.df, {kind: [c for c in columns if c in fit.df.columns] for kind, columns in marks.items()})
    return fit.repair


def _fit_fills(fit: _Fitting, numbers: list[str], untouched: list[str], empty: list[str], policy: RepairPolicy) -> None:
    rows = fit.df.count()
    holes = fit.holes(numbers)
    steps = impute.plan_numeric_fill(holes, rows, numbers, policy.numeric_imputation)
    plain = [s.column for s in steps if s.method == "median"]
    medians = exact_quantiles(fit.df, plain, [0.5])
    for s in steps:
        log = ("numeric_imputation", s.column, s.method, s.cells)
        if s.method == "regression":
            intercept, slopes = impute.regression_weights(fit.df, s.column, list(s.context))
            fit.do("regression", log, column=s.column, context=list(s.context), intercept=intercept, slopes=slopes)
        elif s.method == "knn":
            donors = fit.df.filter(number(fit.df, s.column).isNotNull()).select(
                vector(fit.df, list(s.context)).alias("vec"),
                number(fit.df, s.column).alias("id"),
                number(fit.df, s.column).alias("__value"),
            )
            _do_knn(fit, s, log, donors)
        elif s.method == "mean":
            row = fit.df.agg(F.avg(number(fit.df, s.column)).alias("m")).first()
            fit.do("fill", log, values={s.column: row["m"]})
        else:
            fit.do("fill", log, values={s.column: medians[s.column][0] if s.method == "median" else 0.0})
    texts = [c for c in text_columns(fit.df, untouched) if c not in empty]
    gaps = {c: n for c, n in fit.holes(texts).items() if n}
    modes = impute.mode_values(fit.df, list(gaps))
    for c, n in gaps.items():
        value = modes[c] if modes[c] is not None else "Unknown"
        fit.do("fill", ("categorical_imputation", c, "mode", n), values={c: value})


def _do_knn(fit: _Fitting, step: impute.FillStep, log: tuple, donors: DataFrame) -> None:
    name = f"donors_{len(fit.repair.tables)}"
    fit.do("knn", log, donors, table=name, column=step.column, context=list(step.context), k=impute.NEIGHBOURS)
    fit.df = settle(fit.df)


def _fit_outliers(fit: _Fitting, numbers: list[str], policy: RepairPolicy) -> None:
    if not numbers:
        return
    if policy.outlier_action == "cap":
        clipped = outliers.winsor_bounds(fit.df, numbers, policy.outlier_percentile)
        if policy.outlier_method != "isolation_forest":
            row = fit.df.agg(
                *[F.count_if(m).alias(f"n{i}") for i, m in enumerate(outliers.outlier_mask(fit.df, numbers, policy.outlier_method).values())]
            ).first()
            clipped = {c: b for c, b in clipped.items() if row[f"n{numbers.index(c)}"]}
        if clipped:
            fit.do("clip", ("outlier_handling", None, policy.outlier_method), bounds={c: list(b) for c, b in clipped.items()})
        return
    medians = exact_quantiles(fit.df, numbers, [0.5])
    if policy.outlier_method == "isolation_forest":
        for c in numbers:
            varied = fit.df.agg(F.count(number(fit.df, c)).alias("n"), (F.max(number(fit.df, c)) > F.min(number(fit.df, c))).alias("v")).first()
            if varied["n"] <= outliers.FEWEST_VALUES or not varied["v"]:
                continue
            one = fit.df.select(number(fit.df, c).alias("__x"), F.xxhash64(*[quoted(o) for o in fit.df.columns]).alias("__k")).filter("__x is not null")
            forest, size = outliers.fit_isolation_forest(one, ["__x"], ["__k"])
            scores = outliers.score_isolation(one, ["__x"], forest, size)
            cut = exact_quantiles(scores, ["anomaly_score"], [0.9])["anomaly_score"][0]
            fit.do(
                "isolated_to_median", ("outlier_handling", c, "isolation_forest"), column=c, cut=cut, size=size,
                median=medians[c][0], forest=[{k: v.tolist() for k, v in tree.items()} for tree in forest],
            )
        return
    bounds = outliers.outlier_bounds(fit.df, numbers, policy.outlier_method)
    if bounds:
        fit.do(
            "outside_to_median", ("outlier_handling", None, policy.outlier_method),
            bounds={c: [low, high, medians[c][0]] for c, (low, high) in bounds.items()},
        )


def _fit_features(fit: _Fitting, strategy: Strategy, target: str, order_by, entity) -> None:
    rows = strategy.rows
    if strategy.dataset_type == "time_series" and order_by and is_numeric(fit.df.schema[target].dataType):
        median = exact_quantiles(fit.df, [target], [0.5])[target][0]
        fit.do(
            "lags", ("time_series_features", target, "lags and rolling mean"), settle(lag_state(fit.df, target, order_by, entity or [])),
            table="lag_state", target=target, order_by=order_by, entity=entity or [], median=median if median is not None else 0.0,
            on_target=True,
        )
    if strategy.dataset_type == "relational":
        for c in strategy.with_role(IDENTIFIER):
            if c in fit.df.columns and c != target:
                fit.do("entity", ("relational_features", c, "entity frequency"), value_counts(fit.df, c), table=f"entity_{len(fit.repair.tables)}", column=c, rows=rows)
    if strategy.domain == "aviation":
        fit.do("traffic", ("domain_features", None, "traffic volume and ratio"))


def _fit_encoding(fit: _Fitting, strategy: Strategy, target: str, keys: list[str]) -> None:
    wide = [c for c in strategy.high_cardinality if c in fit.df.columns and c not in keys and is_text(fit.df.schema[c].dataType)]
    for c in wide:
        table = encode.fit_frequency(fit.df, c)
        fit.do("frequency", ("frequency_encoding", c, "share of rows"), table, table=f"frequency_{len(fit.repair.tables)}", column=c, rows=strategy.rows)
    nominal = [c for c in strategy.with_role(NOMINAL) if c in fit.df.columns and c not in wide and c != target]
    nominal = [c for c in nominal if c not in keys and is_text(fit.df.schema[c].dataType)]
    if nominal:
        fit.do("one_hot", ("one_hot_encoding", None, ", ".join(nominal)), categories=encode.fit_categories(fit.df, nominal))
    ordinal = [c for c in strategy.with_role(ORDINAL) if c in fit.df.columns and c not in (target, *keys)]
    for c in [c for c in ordinal if is_text(fit.df.schema[c].dataType)]:
        fit.do("codes", ("ordinal_encoding", c, "text order"), encode.fit_codes(fit.df, c), table=f"codes_{len(fit.repair.tables)}", column=c)
    if is_text(fit.df.schema[target].dataType):
        fit.do("codes", ("target_encoding", target, "class codes"), encode.fit_codes(fit.df, target), table="target_codes", column=target, on_target=True)


def _fit_later_fills(fit: _Fitting, untouched: list[str]) -> None:
    """Median or mode of every column, for holes that only a table repaired later has (ML18)."""
    numbers, texts = numeric_columns(fit.df, untouched), text_columns(fit.df, untouched)
    medians, modes = exact_quantiles(fit.df, numbers, [0.5]), impute.mode_values(fit.df, texts)
    values = {c: medians[c][0] for c in numbers} | {c: modes[c] for c in texts}
    values = {c: v for c, v in values.items() if v is not None}
    if values:
        fit.do("later_fill", values=values)


def _fit_labels(fit: _Fitting, target: str, keys: list[str]) -> None:
    """Labels that confident learning finds wrong get the likely class (LBL2). Only this table's rows change: it is no step
    for later tables, whose labels are not there yet. Needs one key column; quarantined columns are no features."""
    if len(keys) != 1:
        raise ValueError("correcting labels needs one key column")
    inputs = [c for c in numeric_columns(fit.df, [target, *keys]) if c not in fit.repair.quarantined]
    if roles.task_type(fit.df, target) != "classification":
        return
    fixes = settle(labels.relabelled(fit.df, inputs, target, keys[0]))
    n = fixes.count()
    if n:
        fit.df = labels.relabel(fit.df, inputs, target, keys[0], fixes=fixes)
        fit.log("label_noise_correction", target, "confident learning", n)


def _fit_sweep(fit: _Fitting, keys: list[str]) -> None:
    """Nothing stays missing: blanks and nulls of text by mode, numbers by median (CST5)."""
    gaps = [c for c, n in fit.holes([c for c in fit.df.columns if c not in keys]).items() if n]
    texts = [c for c in gaps if is_text(fit.df.schema[c].dataType)]
    numbers = [c for c in gaps if is_numeric(fit.df.schema[c].dataType)]
    if texts:
        fit.do("blank_text", columns=texts)
        modes = impute.mode_values(fit.df, texts)
        fit.do("fill", values={c: modes[c] if modes[c] is not None else "Unknown" for c in texts})
    if numbers:
        medians = exact_quantiles(fit.df, numbers, [0.5])
        fit.do("fill", values={c: medians[c][0] if medians[c][0] is not None else 0.0 for c in numbers})
