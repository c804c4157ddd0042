"""Issue list, scoring, comparison, imputation, outlier and repair queries."""

from pyspark.sql import functions as F

from ..functions import cells, schema
from ..operators import audit, diagnose, extra, impute, near_duplicates, outliers, profile, quality
from ..plans.diagnosis import diagnose_table, report_table
from ..plans.policy import policy_for
from ..plans.repair import fit_repair
from .registry import damaged_sql, defective, register, table, union_sql

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]

# Counts of the damaged orders; the last column, o_orderpriority, is the target.
ORDER_METRICS = (
    damaged_sql("orders")
    + """, q as ("""
    + union_sql(
        [
            f"""select '{c}' as c, quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3,
            skewness({c}) as g from d"""
            for c in ORDER_NUMBERS
        ]
    )
    + "), o as ("
    + union_sql(
        [
            f"""select count_if({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as n
            from d, q where q.c = '{c}'"""
            for c in ORDER_NUMBERS
        ]
    )
    + """), k as (select count(*) as n from d where o_orderpriority is not null group by o_orderpriority),
    m as (select (select count(*) from d) as rows, 6 as columns, 3 as numbers,
      (select count(*) - count(o_totalprice) from d) as missing,
      (select count(*) from d) - (select count(*) from (select distinct * from d)) as copies,
      (select sum(n) from o) as beyond, (select max(n) / min(n)::double from k) as ratio,
      (select count(*) from q where abs(g) > 1) as skewed)"""
)
# Confident learning on the labels of the five nearest other rows; missing prices are 0, statuses are coded in text order.
ORDER_APART = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in "abcs")
ORDER_NOISE = f""", nx as (select row_number() over () as id, o_orderpriority as given, o_orderkey::double as a, o_custkey::double as b,
      coalesce(o_totalprice, 0)::double as c, (dense_rank() over (order by o_orderstatus) - 1)::double as s from d),
    ns as (select id, given, {', '.join(f'({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}' for c in 'abcs')} from nx),
    nn as (select x.id, x.given, unnest(arg_min(y.given, {ORDER_APART}, 5)) as voted from ns x join ns y on x.id <> y.id group by x.id, x.given),
    np as (select id, given, voted, count(*) / 5.0::double as p from nn group by all),
    nl as (select ns.given as label, coalesce(sum(np.p), 0) / count(*) as lim from ns left join np on np.id = ns.id and np.voted = ns.given
      group by ns.given),
    nc as (select given, voted from np join nl on nl.label = np.voted where p >= lim
      qualify row_number() over (partition by id order by p desc, voted) = 1),
    noise as (select count(*) as noisy from nc where given <> voted)"""
# An isolation forest finds some rows in any table of this size, so outliers are raised whatever their share.
ORDER_ISSUES = (
    ORDER_METRICS
    + ORDER_NOISE
    + """, i as (select 'Missing Values' as type, missing / (rows * columns)::double as score, 0.05 as lo, 0.2 as hi from m
    union all select 'Class Imbalance', ratio, 5, 20 from m
    union all select 'Redundancy', copies / rows::double, 0.05, 0.15 from m
    union all select 'Outliers', beyond / (rows * numbers)::double, -1, 0.25 from m
    union all select 'Label Noise', noisy / rows::double, 0.1, 0.2 from m, noise
    union all select 'Distribution Skew', skewed / numbers::double, 0, 0.5 from m),
    issues as (select type, case when score > hi then 'High' else 'Medium' end as severity, round(score, 6) as score
    from i where score > lo)"""
)


@register("issue_list", ORDER_ISSUES + " select type, severity, score from issues")
def issue_list(spark, folder):
    found = diagnose_table(defective(spark, folder, "orders"))
    return found.issues.withColumn("score", F.round("score", 6))


@register(
    "issue_taxonomy",
    ORDER_ISSUES
    + """ select coalesce(bool_or(type = 'Class Imbalance'), false) as imbalance,
    coalesce(bool_or(type = 'Label Noise'), false) as label_noise, coalesce(bool_or(type = 'Redundancy'), false) as redundancy,
    coalesce(bool_or(type = 'Data Leakage'), false) as leakage,
    coalesce(bool_or(type = 'Distribution Skew'), false) as distribution_skew from issues""",
)
def issue_taxonomy(spark, folder):
    return diagnose.issue_taxonomy(diagnose_table(defective(spark, folder, "orders")).issues)


@register(
    "quality_score",
    ORDER_METRICS
    + """, p as (select rows, least(missing * 200.0 / (rows * columns), 30.0) as missing_penalty,
      least(copies * 100.0 / rows, 20.0) as duplicate_penalty,
      case when ratio > 50 then 25.0 when ratio > 10 then 15.0 else 0.0 end as imbalance_penalty from m),
    s as (select *, greatest(0.0, 100.0 - missing_penalty - duplicate_penalty - imbalance_penalty) as score from p)
    select round(missing_penalty, 6)::double as missing_penalty, round(duplicate_penalty, 6)::double as duplicate_penalty,
    imbalance_penalty::double as imbalance_penalty, round(score, 6)::double as quality_score,
    case when score > 80 then 'HIGHLY SUITABLE' when score >= 60 and rows >= 100 then 'CONDITIONALLY SUITABLE'
    else 'UNSUITABLE' end as suitability,
    case when score > 80 then 'APPROVED' when score >= 60 and rows >= 100 then 'ELIGIBLE' else 'NOT SUITABLE' end as verdict
    from s""",
)
def quality_score(spark, folder):
    scores = quality.quality_scores(diagnose_table(defective(spark, folder, "orders")).metrics)
    rounded = ("missing_penalty", "duplicate_penalty", "quality_score")
    return scores.withColumns({c: F.round(c, 6) for c in rounded})


@register(
    "interventions",
    ORDER_ISSUES
    + """, r as (select * from (values """
    + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in quality.INTERVENTIONS)
    + """) as t(type, strategy, rationale))
    select r.type as issue, strategy, rationale from issues join r on issues.type = r.type""",
)
def interventions(spark, folder):
    return quality.interventions(diagnose_table(defective(spark, folder, "orders")).issues)


@register(
    "strengths_and_weaknesses",
    ORDER_ISSUES
    + """ select case when missing * 100.0 / (rows * columns) < 1 then 'strength' else 'weakness' end as kind,
    case when missing * 100.0 / (rows * columns) < 1 then 'High data completeness (minimal missing values)'
    else printf('Significant data gaps (%.1f%% missing cells)', (missing * 100.0 / (rows * columns))::double) end as point from m
    union all select case when rows > 5000 then 'strength' else 'weakness' end,
    case when rows > 5000 then 'Large sample size (' || rows || ' records) for robust training'
    else 'Small dataset size; high risk of overfitting' end from m where rows > 5000 or rows < 500
    union all select 'weakness', 'Critical ' || type || ' detected (Severity: High)' from issues where severity = 'High'""",
)
def strengths_and_weaknesses(spark, folder):
    found = diagnose_table(defective(spark, folder, "orders"))
    return quality.strengths_and_weaknesses(found.metrics, found.issues)


@register("report_table")
def report(spark, folder):
    orders = defective(spark, folder, "orders")
    return report_table(orders, diagnose_table(orders))


@register("full_diagnosis")
def full_diagnosis(spark, folder):
    """The counts of all checks, those of rows against rows included."""
    return diagnose_table(defective(spark, folder, "orders")).metrics


FILLED = ["l_quantity", "l_discount", "l_tax"]
FILLED_SQL = (
    damaged_sql("lineitem")
    + ", v as (select "
    + ", ".join(f"quantile_cont({c}::double, 0.5) as m_{c}" for c in FILLED)
    + " from d), f as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, "
    + ", ".join(f"coalesce({c}, m_{c}) as {c}" for c in FILLED)
    + " from d, v)"
)


def _filled(spark, folder):
    before = defective(spark, folder, "lineitem")
    return before, impute.fill_median(before, FILLED)


@register(
    "drift_report",
    FILLED_SQL
    + union_sql(
        [
            f""" select '{c}' as "column",
            round(coalesce((select avg({c}) from f), 0) - coalesce((select avg({c}) from d), 0), 6) as mean_shift,
            round(coalesce((select stddev_samp({c}) from f), 0) - coalesce((select stddev_samp({c}) from d), 0), 6) as std_shift"""
            for c in FILLED
        ]
    ),
)
def drift_report(spark, folder):
    before, after = _filled(spark, folder)
    return quality.drift_report(before.select(*FILLED), after.select(*FILLED))


@register(
    "quality_gates",
    damaged_sql("orders")
    + """, r as (select count(*) as b, (select count(*) from (select distinct * from d)) as a from d)
    select 'rows' as gate, round(abs(b - a) / b::double, 6) as change, abs(b - a) / b::double > 0.2 as warns from r
    union all select 'columns', 0.0::double, false from r""",
)
def quality_gates(spark, folder):
    before = defective(spark, folder, "orders")
    return quality.quality_gates(before, before.dropDuplicates()).withColumn("change", F.round("change", 6))


@register(
    "issues_resolved",
    ORDER_ISSUES + " select type from issues where type = 'Redundancy'",
)
def issues_resolved(spark, folder):
    before = defective(spark, folder, "orders")
    after = before.dropDuplicates()
    return quality.issues_resolved(diagnose_table(before).issues, diagnose_table(after).issues)


@register(
    "before_after_totals",
    FILLED_SQL
    + """ select 'before' as version, count(*) as rows, 11 as columns,
    (sum(case when l_quantity is null then 1 else 0 end + case when l_discount is null then 1 else 0 end
    + case when l_tax is null then 1 else 0 end + case when l_returnflag is null then 1 else 0 end))::bigint as missing_total from d
    union all select 'after', count(*), 11, (count(*) - count(l_returnflag))::bigint from d""",
)
def before_after_totals(spark, folder):
    return quality.before_after_totals(*_filled(spark, folder))


@register(
    "dedup_exact",
    damaged_sql("orders")
    + """ select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total
    from (select distinct * from d) group by o_orderstatus""",
)
def dedup_exact(spark, folder):
    kept = near_duplicates.drop_exact_duplicates(defective(spark, folder, "orders"))
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(
    "impute_median",
    damaged_sql("orders")
    + """ select o_orderkey, round(coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from d)), 4) as o_totalprice
    from d""",
)
def impute_median(spark, folder):
    filled = impute.fill_median(defective(spark, folder, "orders"), ["o_totalprice"])
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@register(
    "impute_mean",
    damaged_sql("orders")
    + """ select o_orderkey, round(coalesce(o_totalprice, (select avg(o_totalprice) from d)), 4) as o_totalprice from d""",
)
def impute_mean(spark, folder):
    filled = impute.fill_mean(defective(spark, folder, "orders"), ["o_totalprice"])
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@register(
    "impute_mode",
    damaged_sql("lineitem")
    + """ select l_orderkey, l_partkey, l_linenumber, coalesce(l_returnflag, (select l_returnflag from d
    where l_returnflag is not null group by l_returnflag order by count(*) desc, l_returnflag limit 1)) as l_returnflag from d""",
)
def impute_mode(spark, folder):
    filled = impute.fill_mode(defective(spark, folder, "lineitem"), ["l_returnflag"])
    return filled.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")


@register(
    "impute_regression",
    damaged_sql("lineitem")
    + """ select l_orderkey, l_partkey, l_linenumber,
    round(coalesce(l_quantity, (select regr_intercept(l_quantity, l_extendedprice) from d)
    + (select regr_slope(l_quantity, l_extendedprice) from d) * l_extendedprice), 4) as l_quantity from d""",
)
def impute_regression(spark, folder):
    filled = impute.fill_regression(defective(spark, folder, "lineitem"), "l_quantity", ["l_extendedprice"])
    return filled.select("l_orderkey", "l_partkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"))


@register(
    "impute_knn",
    damaged_sql("supplier")
    + """, r as (select h.s_suppkey, o.s_acctbal, row_number() over (partition by h.s_suppkey order by
      (h.s_suppkey - o.s_suppkey) * (h.s_suppkey - o.s_suppkey) + (h.s_nationkey - o.s_nationkey) * (h.s_nationkey - o.s_nationkey),
      o.s_acctbal) as place from d h join d o on h.s_acctbal is null and o.s_acctbal is not null)
    select s_suppkey, round(s_acctbal, 4) as s_acctbal from d where s_acctbal is not null
    union all select s_suppkey, round(avg(s_acctbal), 4) from r where place <= 5 group by s_suppkey""",
)
def impute_knn(spark, folder):
    filled = impute.fill_knn(defective(spark, folder, "supplier"), "s_acctbal", ["s_suppkey", "s_nationkey"])
    return filled.select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"))


@register(
    "imputation_plan",
    damaged_sql("lineitem")
    + """, s as (select count(*) as n, count(*) - count(l_quantity) as q, count(*) - count(l_discount) as dd,
    count(*) - count(l_tax) as t from d)
    select 'l_quantity' as "column", case when q > 0.3 * n then 'median' when q > 0.1 * n then 'knn' else 'regression' end as method,
      'l_orderkey,l_partkey,l_suppkey' as context, q as cells from s
    union all select 'l_discount', case when dd > 0.3 * n then 'median' when dd > 0.1 * n then 'knn' else 'regression' end,
      'l_orderkey,l_partkey,l_suppkey', dd from s
    union all select 'l_tax', case when t > 0.3 * n then 'median' when t > 0.1 * n then 'knn' else 'regression' end,
      'l_orderkey,l_partkey,l_suppkey', t from s""",
)
def imputation_plan(spark, folder):
    lines = defective(spark, folder, "lineitem")
    summary = profile.profile_table(lines)
    numbers = schema.numeric_columns(lines)
    steps = impute.plan_numeric_fill({c: summary.columns[c].missing for c in numbers}, summary.rows, numbers)
    rows = [(s.column, s.method, ",".join(s.context), s.cells) for s in steps]
    return profile.rows_frame(spark, rows, "column string, method string, context string, cells long")


@register(
    "final_sweep",
    damaged_sql("customer")
    + """ select c_custkey, round(coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from d)), 4) as c_acctbal,
    coalesce(c_mktsegment, (select c_mktsegment from d where c_mktsegment is not null group by 1
    order by count(*) desc, c_mktsegment limit 1)) as c_mktsegment from d""",
)
def final_sweep(spark, folder):
    swept = impute.final_sweep(defective(spark, folder, "customer"))
    return swept.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@register(
    "zscore_outliers",
    """with s as (select avg(value) as m, stddev_pop(value) as p from events)
    select event_id, value from events, s where abs(value - m) / p > 3""",
)
def zscore_outliers(spark, folder):
    events = table(spark, folder, "events")
    return events.filter(outliers.outlier_mask(events, ["value"], "zscore")["value"]).select("event_id", "value")


@register(
    "winsorise",
    """with q as (select quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from events)
    select event_id, round(greatest(lo, least(hi, value)), 4) as value from events, q""",
)
def winsorise(spark, folder):
    clipped = outliers.winsorise(table(spark, folder, "events"), ["value"])
    return clipped.select("event_id", F.round("value", 4).alias("value"))


@register(
    "outlier_to_median",
    """with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.5) as m from events)
    select event_id, round(case when value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) then m else value end, 4) as value
    from events, q""",
)
def outlier_to_median(spark, folder):
    mended = outliers.outliers_to_median(table(spark, folder, "events"), ["value"])
    return mended.select("event_id", F.round("value", 4).alias("value"))


@register(
    "log1p_skewed",
    """select event_id, round(case when (select abs(skewness(value)) > 1 and min(value) > 0 from events)
    then ln(1 + value) else value end, 6) as value from events""",
)
def log1p_skewed(spark, folder):
    changed, _ = outliers.log_skewed(table(spark, folder, "events"), ["value"])
    return changed.select("event_id", F.round("value", 6).alias("value"))


@register(
    "flag_high_missing",
    damaged_sql("customer")
    + """ select "column", share from (select 'c_acctbal' as "column",
    round((count(*) - count(c_acctbal)) / count(*)::double, 6) as share from d
    union all select 'c_mktsegment', round((count(*) - count(c_mktsegment)) / count(*)::double, 6) from d) where share > 0.95""",
)
def flag_high_missing(spark, folder):
    counts = profile.missing_profile(defective(spark, folder, "customer"))
    share = F.col("n_missing") / F.col("n_rows")
    limit = policy_for("balanced").missing_column_threshold
    return counts.filter(share > limit).select("column", F.round(share, 6).alias("share"))


@register(
    "cell_audit",
    damaged_sql("customer")
    + """, m as (select c_mktsegment as v from d where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1)
    select c_custkey, 'c_mktsegment' as "column", cast(null as varchar) as before, v as after, 'mode' as reason
    from d, m where c_mktsegment is null""",
)
def cell_audit(spark, folder):
    before = defective(spark, folder, "customer")
    after = impute.fill_mode(before, ["c_mktsegment"])
    return audit.cell_audit(before, after, ["c_custkey"], ["c_name", "c_mktsegment"], "mode")


@register(
    "mixed_to_number",
    damaged_sql("part") + " select p_partkey, try_cast(p_size_text as double) as p_size from d",
)
def mixed_to_number(spark, folder):
    return defective(spark, folder, "part").select("p_partkey", cells.text_to_number(F.col("p_size_text")).alias("p_size"))


@register(
    "lenient_dates",
    damaged_sql("part")
    + """ select p_partkey, cast(try_cast(p_date_text as date) as varchar) as day from d""",
)
def lenient_dates(spark, folder):
    parsed = cells.lenient_timestamp(F.col("p_date_text"))
    return defective(spark, folder, "part").select("p_partkey", F.date_format(parsed, "yyyy-MM-dd").alias("day"))


# Two-predictor least squares of the price on order and customer key, as the fitted repair does.
@register(
    "repair_readable",
    damaged_sql("orders")
    + """, s as (select avg(o_totalprice) as my, avg(o_orderkey) as m1, avg(o_custkey) as m2,
      var_pop(o_orderkey) as a11, var_pop(o_custkey) as a22, covar_pop(o_orderkey, o_custkey) as a12,
      covar_pop(o_orderkey, o_totalprice) as b1, covar_pop(o_custkey, o_totalprice) as b2 from d where o_totalprice is not null),
    w as (select *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) as w1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) as w2 from s)
    select o_orderkey, o_custkey, o_orderstatus,
    round(coalesce(o_totalprice, my + w1 * (o_orderkey - m1) + w2 * (o_custkey - m2)), 3) as o_totalprice,
    strftime(o_orderdate, '%d-%m-%Y') as o_orderdate, o_orderpriority from d, w""",
)
def repair_readable(spark, folder):
    fitted = fit_repair(defective(spark, folder, "orders"))
    return fitted.frame.withColumn("o_totalprice", F.round("o_totalprice", 3))


@register("repair_model_ready")
def repair_model_ready(spark, folder):
    fitted = fit_repair(defective(spark, folder, "lineitem").drop("l_shipdate"), "l_linestatus", readable=False)
    return fitted.frame


@register("repair_actions")
def repair_actions(spark, folder):
    fitted = fit_repair(defective(spark, folder, "customer"), readable=True)
    return fitted.action_table(spark)


MISSING = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register(
    "missing_severity",
    damaged_sql("customer")
    + union_sql(
        [
            f""" select '{c}' as "column", count(*) - count({c}) as n_missing,
            round((count(*) - count({c})) * 100.0 / count(*), 2)::double as percent,
            case when (count(*) - count({c})) * 100.0 / count(*) > 50 then 'High'
            when (count(*) - count({c})) * 100.0 / count(*) > 20 then 'Medium' else 'Low' end as severity from d"""
            for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        ]
    ),
)
def missing_severity(spark, folder):
    return extra.missing_severity(defective(spark, folder, "customer"))


@register(
    "missing_by_row",
    damaged_sql("customer")
    + """, r as (select case when c_acctbal is null then 1 else 0 end + case when c_mktsegment is null then 1 else 0 end as m from d)
    select max(m) as max_missing, round(avg(m), 2) as avg_missing, count_if(m = 0)::bigint as complete_rows,
    count_if(m > 0)::bigint as partial_rows from r""",
)
def missing_by_row(spark, folder):
    return extra.missing_by_row(defective(spark, folder, "customer"))


@register(
    "missing_patterns",
    damaged_sql("events")
    + """, p as (select value, row_number() over (order by event_id) as pos from d),
    g as (select pos - lag(pos) over (order by pos) as gap from p where value is null)
    select 'value' as "column", count(*) + 1 as n_missing, min(gap) as every from g where gap is not null
    having count(*) + 1 > 5 and min(gap) = max(gap) and min(gap) > 1""",
)
def missing_patterns(spark, folder):
    return extra.systematic_missing(defective(spark, folder, "events"), ["event_id"])


@register(
    "completeness_score",
    damaged_sql("customer")
    + """, c as (select count(*) as n, count(*) - count(c_acctbal) + count(*) - count(c_mktsegment) as holes,
      count(*) - (select count(*) from (select distinct * from d)) as copies,
      case when stddev_samp(c_acctbal) / avg(c_acctbal) > 5 then 1 else 0 end
      + case when stddev_samp(c_nationkey) / avg(c_nationkey) > 5 then 1 else 0 end
      + case when stddev_samp(c_custkey) / avg(c_custkey) > 5 then 1 else 0 end
      + case when count(distinct lower(c_mktsegment)) < count(distinct c_mktsegment) then 1 else 0 end as flaws from d),
    s as (select round((n * 5 - holes) * 100.0 / (n * 5), 2)::double as completeness,
      round((n - copies) * 100.0 / n, 2)::double as consistency, round((5 - flaws) * 100.0 / 5, 2)::double as validity from c)
    select *, round(completeness * 0.4 + consistency * 0.3 + validity * 0.3, 2) as overall_score from s""",
)
def completeness_score(spark, folder):
    return extra.weighted_quality(defective(spark, folder, "customer"))


@register(
    "transform_auto",
    """with s as (select skewness(value) as g, kurtosis(value) as k, min(value) as lo from events)
    select event_id, round(case when abs(g) > 2 or (abs(k) <= 3 and lo > 0) then ln(1 + value + case when lo > 0 then 0 else 1 - lo end)
    else value end, 6) as value from events, s where abs(g) > 2 or abs(k) <= 3
    union all select doc_id, round(ln(1 + n_chars + case when lo > 0 then 0 else 1 - lo end), 6) from documents,
    (select min(n_chars) as lo, skewness(n_chars) as g from documents) where abs(g) > 2""",
)
def transform_auto(spark, folder):
    events = table(spark, folder, "events")
    documents = table(spark, folder, "documents")
    plan = extra.transform_plan(documents, ["n_chars"])
    changed = extra.apply_transforms(documents, plan).select(
        F.col("doc_id").alias("event_id"), F.round("n_chars", 6).alias("value")
    )
    events_plan = {c: p for c, p in extra.transform_plan(events, ["value"]).items() if p[0] == "log"}
    if events_plan:
        changed = changed.unionByName(
            extra.apply_transforms(events, events_plan).select("event_id", F.round("value", 6).alias("value"))
        )
    return changed


@register("transform_yeo_johnson")
def transform_yeo_johnson(spark, folder):
    events = table(spark, folder, "events")
    plan = extra.transform_plan(events, ["value"], "yeo-johnson")
    return extra.apply_transforms(events, plan).select("event_id", "value")
