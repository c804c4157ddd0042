"""Profile, diagnosis and scoring queries."""

from pyspark.sql import functions as F

from ..operators import correlate, diagnose, profile, roles
from .registry import damaged_sql, defective, register, table, union_sql

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMBERS = LINEITEM[:8]
PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "missing_profile",
    damaged_sql("lineitem")
    + union_sql([f" select '{c}' as \"column\", count(*) - count({c}) as n_missing, count(*) as n_rows from d" for c in LINEITEM]),
)
def missing_profile(spark, folder):
    return profile.missing_profile(defective(spark, folder, "lineitem"))


@register(
    "duplicate_rows",
    damaged_sql("orders")
    + """ select (select count(*) from d) as n_rows,
        (select count(*) from d) - (select count(*) from (select distinct * from d)) as n_duplicates""",
)
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(defective(spark, folder, "orders"))


@register(
    "numeric_stats",
    damaged_sql("lineitem")
    + union_sql(
        [
            f""" select '{c}' as "column", round(avg({c}), 4) as mean,
            round(quantile_cont({c}::double, 0.5), 4) as median, round(stddev_samp({c}), 4) as std from d"""
            for c in LINE_NUMBERS
        ]
    ),
)
def numeric_stats(spark, folder):
    stats = profile.numeric_stats(defective(spark, folder, "lineitem"))
    return stats.select("column", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")])


def _iqr_sql(column: str, source: str) -> str:
    return f""" select '{column}' as "column", round(q.q1, 4) as q1, round(q.q3, 4) as q3,
        count_if({column} < q.q1 - 1.5 * (q.q3 - q.q1) or {column} > q.q3 + 1.5 * (q.q3 - q.q1))::bigint as n_outliers
        from {source}, (select quantile_cont({column}::double, 0.25) as q1, quantile_cont({column}::double, 0.75) as q3
        from {source}) q group by q.q1, q.q3"""


@register("iqr_outliers", damaged_sql("lineitem") + union_sql([_iqr_sql(c, "d") for c in PRICES]))
def iqr_outliers(spark, folder):
    found = profile.iqr_outliers(defective(spark, folder, "lineitem"), PRICES)
    return found.select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "n_outliers")


@register("iqr_outliers_events", _iqr_sql("value", "events"))
def iqr_outliers_events(spark, folder):
    found = profile.iqr_outliers(table(spark, folder, "events"), ["value"])
    return found.select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "n_outliers")


@register(
    "class_distribution",
    'select cast(quality as varchar) as "class", count(*) as n from labels where quality is not null group by quality',
)
def class_distribution(spark, folder):
    return diagnose.class_distribution(table(spark, folder, "labels"), "quality")


@register(
    "imbalance_ratio",
    """with c as (select quality, count(*) as n from labels where quality is not null group by quality),
    r as (select count(*) as n_classes, case when count(*) > 1 then max(n) / min(n)::double end as ratio from c)
    select n_classes, round(ratio, 6) as ratio,
    case when ratio > 20 then 'High' when ratio > 5 then 'Medium' else 'None' end as severity from r""",
)
def imbalance_ratio(spark, folder):
    found = diagnose.imbalance_ratio(table(spark, folder, "labels"), "quality")
    return found.withColumn("ratio", F.round("ratio", 6))


COPIED = "l_extendedprice * 2 + l_linenumber as price_copy"


def _line_with_copy(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*LINE_NUMBERS, COPIED)


@register(
    "correlation_pairs",
    union_sql(
        [
            f"""select '{a}' as "left", '{b}' as "right",
            round(coalesce(corr({a}, {b}), 0), 6) as r from (select *, {COPIED} from lineitem)"""
            for i, a in enumerate([*LINE_NUMBERS, "price_copy"])
            for b in [*LINE_NUMBERS, "price_copy"][i + 1 :]
        ]
    ),
)
def correlation_pairs(spark, folder):
    pairs = correlate.correlation_pairs(_line_with_copy(spark, folder))
    return pairs.withColumn("r", F.round(F.coalesce("r", F.lit(0.0)), 6))


@register(
    "redundant_pairs",
    f"""with d as (select *, {COPIED} from lineitem), r as ("""
    + union_sql(
        [
            f"""select '{a}' as "left", '{b}' as "right", abs(corr({a}, {b})) as r from d"""
            for i, a in enumerate([*LINE_NUMBERS, "price_copy"])
            for b in [*LINE_NUMBERS, "price_copy"][i + 1 :]
        ]
    )
    + """) select "left", "right", round(r, 4) as r from r where r > 0.95""",
)
def redundant_pairs(spark, folder):
    return correlate.redundant_pairs(_line_with_copy(spark, folder))


def _top_target_sql(features: list[str], target: str, source: str) -> str:
    each = union_sql([f"""select '{c}' as "column", abs(corr({c}, {target})) as r from {source}""" for c in features])
    return f"""select "column", round(r, 4) as r from ({each}) where r is not null
        order by r desc, "column" limit 5"""


@register("corr_with_target", _top_target_sql(["p_partkey", "p_size"], "p_retailprice", "part"))
def corr_with_target(spark, folder):
    return correlate.target_correlations(table(spark, folder, "part"), "p_retailprice")


def _spearman_sql(features: list[str], target: str, source: str) -> str:
    def ranked(c: str) -> str:
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"

    each = union_sql(
        [
            f"""select '{c}' as "column", abs(corr(rx, ry)) as r from
            (select {ranked(c)} as rx, {ranked(target)} as ry from {source}
            where {c} is not null and {target} is not null)"""
            for c in features
        ]
    )
    return f"""select "column", round(r, 4) as r from ({each}) order by r desc, "column" limit 5"""


@register(
    "spearman_with_target",
    damaged_sql("lineitem")
    + " "
    + _spearman_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"], "l_extendedprice", "d"),
)
def spearman_with_target(spark, folder):
    lines = defective(spark, folder, "lineitem")
    kept = lines.select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_extendedprice")
    return correlate.target_rank_correlations(kept, "l_extendedprice")


def _information_sql(features: list[str], target: str, few: set[str], source: str, bins: int = 10) -> str:
    """Joint counts over bins: values themselves for the ``few``-valued columns, else ten bins."""
    shares = ", ".join(str(i / bins) for i in range(1, bins))
    cuts = ", ".join(
        f"list_distinct(quantile_cont({c}::double, [{shares}])) as e_{c}" for c in [*features, target] if c not in few
    )

    def label(c: str) -> str:
        if c in few:
            return f"coalesce(cast({c} as varchar), 'missing')"
        return f"cast(coalesce(len(list_filter(e_{c}, lambda e: e < {c})), -1) as varchar)"

    each = union_sql(
        [
            f"""select '{c}' as "column", {label(c)} as x, {label(target)} as y, count(*) as n
            from {source}, cuts group by all"""
            for c in features
        ]
    )
    return f"""cuts as (select {cuts} from {source}), joint as ({each}),
    s as (select "column", n, sum(n) over (partition by "column") as total,
      sum(n) over (partition by "column", x) as nx, sum(n) over (partition by "column", y) as ny from joint),
    mi as (select "column", round(sum(n / total::double * ln(n * total / (nx * ny)::double)), 6) as mutual_information
      from s group by "column")"""


@register(
    "mutual_information_binned",
    "with "
    + _information_sql(
        ["l_quantity", "l_discount", "l_linenumber"], "l_extendedprice", {"l_discount", "l_linenumber"}, "lineitem"
    )
    + " select * from mi",
)
def mutual_information_binned(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_linenumber", "l_extendedprice")
    found = correlate.mutual_information_binned(lines, "l_extendedprice")
    return found.withColumn("mutual_information", F.round("mutual_information", 6))


@register(
    "leakage_flags",
    "with d as (select l_quantity, l_tax, l_extendedprice * 2 + 1 as price_copy, l_extendedprice from lineitem), "
    + _information_sql(["l_quantity", "l_tax", "price_copy"], "l_extendedprice", {"l_tax"}, "d")
    + ", sp as ("
    + _spearman_sql(["l_quantity", "l_tax", "price_copy"], "l_extendedprice", "d")
    + "), pe as ("
    + _top_target_sql(["l_quantity", "l_tax", "price_copy"], "l_extendedprice", "d")
    + """) select pe."column" as "column", pe.r as pearson, sp.r as spearman, mutual_information,
    pe.r > 0.95 or sp.r > 0.95 or mutual_information > 0.8 as leaks
    from pe join sp on pe."column" = sp."column" join mi on pe."column" = mi."column" """,
)
def leakage_flags(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_tax", "l_extendedprice * 2 + 1 as price_copy", "l_extendedprice"
    )
    scores = correlate.leakage_scores(lines, "l_extendedprice")
    return scores.select(
        "column",
        F.round("pearson", 4).alias("pearson"),
        F.round("spearman", 4).alias("spearman"),
        F.round("mutual_information", 6).alias("mutual_information"),
        "leaks",
    )


NUMBER_SQL = r"'^-?[0-9]*\.?[0-9]+$'"
DATE_SQL = r"'^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}'"


@register(
    "mixed_fields",
    damaged_sql("part")
    + ", c as ("
    + union_sql(
        [
            f"""select '{c}' as "column", count({c}) as present,
            count_if(regexp_matches({c}, {NUMBER_SQL})) as numbers,
            count_if(regexp_matches({c}, {DATE_SQL})) as dates from d"""
            for c in ("p_name", "p_brand", "p_type", "p_size_text", "p_date_text")
        ]
    )
    + """) select "column", case when numbers > 0 and numbers < present then 'Mixed numeric and text'
    else 'Mixed date formats' end as type,
    (case when numbers > 0 and numbers < present then numbers else dates end)::bigint as n_match,
    (present - case when numbers > 0 and numbers < present then numbers else dates end)::bigint as n_other
    from c where (numbers > 0 and numbers < present) or (dates > 0 and dates < present)""",
)
def mixed_fields(spark, folder):
    return diagnose.mixed_fields(defective(spark, folder, "part"), "p_retailprice")


@register(
    "mixed_field_samples",
    damaged_sql("part")
    + union_sql(
        [
            f""" select * from (select '{c}' as "column", value, cast(row_number() over (order by value) as integer) as place
            from (select distinct {c} as value from d where {c} is not null)) where place <= 5"""
            for c in ("p_size_text", "p_date_text")
        ]
    ),
)
def mixed_field_samples(spark, folder):
    return diagnose.mixed_field_samples(defective(spark, folder, "part"), ["p_size_text", "p_date_text"])


@register(
    "skewed_features",
    """select "column", round(s, 4) as skew from (select 'value' as "column", skewness(value) as s from events
    union all select 'event_id', skewness(event_id) from events
    union all select 'user_id', skewness(user_id) from events) where abs(s) > 1.0""",
)
def skewed_features(spark, folder):
    return profile.skewed_features(table(spark, folder, "events"))


@register(
    "skewed_features_documents",
    """select 'n_chars' as "column", round(skewness(n_chars), 4) as skew from documents having abs(skewness(n_chars)) > 1.0""",
)
def skewed_features_documents(spark, folder):
    return profile.skewed_features(table(spark, folder, "documents"), columns=["n_chars"])


@register(
    "distinct_counts",
    union_sql(
        [f"""select '{c}' as "column", count(distinct {c}) as n from customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
    ),
)
def distinct_counts(spark, folder):
    customers = table(spark, folder, "customer")
    counts = profile.exact_distinct_counts(customers, customers.columns)
    return profile.rows_frame(spark, list(counts.items()), "column string, n long")


@register(
    "column_roles",
    """select * from (values ('c_custkey', 'numerical'), ('c_name', 'identifier'), ('c_nationkey', 'numerical'),
    ('c_acctbal', 'numerical'), ('c_mktsegment', 'target')) as t("column", role)""",
)
def column_roles(spark, folder):
    return roles.column_roles(table(spark, folder, "customer"))


@register("dataset_strategy")
def dataset_strategy(spark, folder):
    return roles.strategy_table(table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value"))


@register(
    "task_type",
    """select case when (select count(distinct l_extendedprice) from lineitem) > 20 then 'regression'
    else 'classification' end as price_task,
    case when (select count(distinct quality) from labels) > 20 then 'regression' else 'classification' end as quality_task""",
)
def task_type(spark, folder):
    rows = [
        (
            roles.task_type(table(spark, folder, "lineitem"), "l_extendedprice"),
            roles.task_type(table(spark, folder, "labels"), "quality"),
        )
    ]
    return profile.rows_frame(spark, rows, "price_task string, quality_task string")

