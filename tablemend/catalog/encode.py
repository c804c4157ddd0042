"""Encoding, feature and scaling queries."""

from pyspark.sql import functions as F

from ..functions import cells
from ..operators import encode, features, resample
from .registry import damaged_sql, defective, register, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


@register(
    "frequency_encode",
    """select p_partkey, p_brand, round(count(*) over (partition by p_brand) / (select count(*) from part)::double, 6) as p_brand_freq
    from part""",
)
def frequency_encode(spark, folder):
    encoded = encode.frequency_encode(table(spark, folder, "part"), ["p_brand"])
    return encoded.select("p_partkey", "p_brand", F.round("p_brand_freq", 6).alias("p_brand_freq"))


@register(
    "one_hot",
    "select o_orderkey, "
    + ", ".join(f"case when o_orderstatus = '{s}' then 1.0 else 0.0 end::double as \"o_orderstatus_{s}\"" for s in STATUSES)
    + " from orders",
)
def one_hot(spark, folder):
    encoded = encode.one_hot(table(spark, folder, "orders"), ["o_orderstatus"])
    return encoded.select("o_orderkey", *[f"o_orderstatus_{s}" for s in STATUSES])


@register(
    "ordinal_encode",
    """with c as (select o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as code
    from (select distinct o_orderpriority from orders))
    select o_orderkey, cast(code as integer) as o_orderpriority from orders join c using (o_orderpriority)""",
)
def ordinal_encode(spark, folder):
    return encode.ordinal_encode(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register(
    "label_encode",
    """with c as (select c_mktsegment, dense_rank() over (order by c_mktsegment) - 1 as code
    from (select distinct c_mktsegment from customer))
    select c_custkey, cast(code as integer) as code, c_mktsegment as decoded from customer join c using (c_mktsegment)""",
)
def label_encode(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    encoded, codes = encode.label_encode(customers, "c_mktsegment")
    decoded = encode.decode_labels(encoded.withColumnRenamed("c_mktsegment", "code"), "code", codes, "decoded")
    return decoded.select("c_custkey", "code", "decoded")


@register(
    "sample_weights",
    """with c as (select quality, count(*) as n from labels group by quality),
    k as (select count(*) as k, sum(n) as total, min(n) / max(n)::double as ratio from c)
    select doc_id, round(case when ratio < 0.8 then total / (k * n)::double end, 6) as weight
    from labels join c using (quality), k""",
)
def sample_weights(spark, folder):
    weighted = encode.sample_weights(table(spark, folder, "labels"), "quality")
    return weighted.select("doc_id", F.round("weight", 6).alias("weight"))


@register(
    "date_parts",
    """select o_orderkey, year(o_orderdate)::integer as o_orderdate_year, month(o_orderdate)::integer as o_orderdate_month,
    day(o_orderdate)::integer as o_orderdate_day, (isodow(o_orderdate) - 1)::integer as o_orderdate_dayofweek from orders""",
)
def date_parts(spark, folder):
    parts = features.add_date_parts(table(spark, folder, "orders"), ["o_orderdate"])
    return parts.select("o_orderkey", *[f"o_orderdate_{p}" for p in ("year", "month", "day", "dayofweek")])


@register("date_format", "select o_orderkey, strftime(o_orderdate, '%d-%m-%Y') as o_orderdate from orders")
def date_format(spark, folder):
    return features.humanise_dates(table(spark, folder, "orders"), ["o_orderdate"]).select("o_orderkey", "o_orderdate")


@register(
    "title_case",
    """select p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as p_name from part""",
)
def title_case(spark, folder):
    return features.title_case_names(table(spark, folder, "part")).select("p_partkey", "p_name")


@register(
    "lag_rolling",
    """with m as (select quantile_cont(value, 0.5) as median from events)
    select event_id, coalesce(lag(value, 1) over w, median) as value_lag_1, coalesce(lag(value, 2) over w, median) as value_lag_2,
    round(avg(value) over (order by ts, event_id rows between 2 preceding and current row), 6) as value_rolling_mean_3
    from events, m window w as (order by ts, event_id)""",
)
def lag_rolling(spark, folder):
    added = features.lag_features(table(spark, folder, "events"), "value", ["ts", "event_id"])
    return added.select(
        "event_id", "value_lag_1", "value_lag_2", F.round("value_rolling_mean_3", 6).alias("value_rolling_mean_3")
    )


@register(
    "lag_rolling_by_entity",
    """select event_id, lag(value, 1) over w as value_lag_1,
    round(avg(value) over (partition by event_type order by ts, event_id rows between 3 preceding and 1 preceding), 6) as past_mean
    from events window w as (partition by event_type order by ts, event_id)""",
)
def lag_rolling_by_entity(spark, folder):
    events = table(spark, folder, "events")
    names = {"value_lag_1": ("lag", 1, 0), "past_mean": ("avg", -3, -1)}
    added = features.with_lookback(events, ["ts", "event_id"], ["event_type"], 3, names, "value", rows_per_range=1000)
    return added.select("event_id", "value_lag_1", F.round("past_mean", 6).alias("past_mean"))


@register(
    "entity_frequency",
    "select o_orderkey, o_custkey, count(*) over (partition by o_custkey) as o_custkey_entity_frequency from orders",
)
def entity_frequency(spark, folder):
    counted = features.entity_frequency(table(spark, folder, "orders"), ["o_custkey"])
    return counted.select("o_orderkey", "o_custkey", "o_custkey_entity_frequency")


TRAFFIC = """select p_partkey, p_size as dep, p_partkey % 7 as "arr" from part"""


@register(
    "traffic_features",
    f"""select p_partkey, dep + arr as traffic_volume, round(dep / (arr + 1)::double, 6) as dep_arr_ratio from ({TRAFFIC})""",
)
def traffic_features(spark, folder):
    flights = table(spark, folder, "part").selectExpr("p_partkey", "p_size as dep", "p_partkey % 7 as arr")
    added = features.traffic_features(flights)
    return added.select("p_partkey", "traffic_volume", F.round("dep_arr_ratio", 6).alias("dep_arr_ratio"))


def _scaled(spark, folder, method):
    lines = defective(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    columns = ["l_quantity", "l_extendedprice"]
    scaled = features.scale(lines, features.scale_statistics(lines, columns, method))
    return scaled.select("l_orderkey", "l_partkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in columns])


def _scaled_sql(shift: str, width: str) -> str:
    columns = ["l_quantity", "l_extendedprice"]
    stats = ", ".join(f"{shift.format(c=c)} as a_{c}, {width.format(c=c)} as b_{c}" for c in columns)
    cells_sql = ", ".join(f"round(coalesce(({c} - a_{c}) / b_{c}, 0), 5) as {c}" for c in columns)
    return damaged_sql("lineitem") + f", s as (select {stats} from d) select l_orderkey, l_partkey, l_linenumber, {cells_sql} from d, s"


@register("standardise", _scaled_sql("avg({c})", "stddev_pop({c})"))
def standardise(spark, folder):
    return _scaled(spark, folder, "standard")


@register("minmax", _scaled_sql("min({c})", "max({c}) - min({c})"))
def minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@register("robust_scale", _scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scale(spark, folder):
    return _scaled(spark, folder, "robust")


@register(
    "realign",
    "select o_totalprice, cast(0 as double) as absent, o_custkey from orders",
)
def realign(spark, folder):
    return features.realign(table(spark, folder, "orders"), ["o_totalprice", "absent", "o_custkey"])


@register(
    "stratified_split_sizes",
    """select quality, count(*) as n, greatest(1, round_even(count(*) * 0.2, 0))::bigint as n_test from labels group by quality""",
)
def stratified_split_sizes(spark, folder):
    split = resample.stratified_split(table(spark, folder, "labels"), "doc_id", "quality")
    return split.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@register("stratified_split")
def stratified_split(spark, folder):
    return resample.stratified_split(table(spark, folder, "labels"), "doc_id", "quality")


@register(
    "drop_empty_rows",
    damaged_sql("customer")
    + """ select case when c_custkey % 2 = 0 then c_custkey end as even_key, c_acctbal from d
    where c_acctbal is not null or c_custkey % 2 = 0""",
)
def drop_empty_rows(spark, folder):
    half = defective(spark, folder, "customer").selectExpr(
        "case when c_custkey % 2 = 0 then c_custkey end as even_key", "c_acctbal"
    )
    return cells.drop_empty_rows(half)
