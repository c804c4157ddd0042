"""Registration of queries with their SQL twins, and the planted-defect tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The tables have no missing cells and no duplicates, so defects are planted by expressions
# that read the same in Spark and in the SQL twins.
DEFECTS = {
    "lineitem": [
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "case when (l_orderkey*31+l_partkey)%20=0 then null else l_quantity end as l_quantity",
        "case when (l_orderkey+l_suppkey)%97=0 then l_extendedprice*10 else l_extendedprice end as l_extendedprice",
        "case when (l_orderkey*17+l_partkey)%5<2 then null else l_discount end as l_discount",
        "case when (l_orderkey*13+l_suppkey)%7=0 then null else l_tax end as l_tax",
        "case when l_partkey%11=0 then null else l_returnflag end as l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ],
    "orders": [
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "case when o_orderkey%13=0 then null else o_totalprice end as o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    ],
    "customer": [
        "c_custkey",
        "lower(c_name) as c_name",
        "c_nationkey",
        "case when c_custkey%100<>0 then null else c_acctbal end as c_acctbal",
        "case when c_custkey%4=0 then null else c_mktsegment end as c_mktsegment",
    ],
    "supplier": [
        "s_suppkey",
        "s_name",
        "s_nationkey",
        "case when s_suppkey%8=0 then null else s_acctbal end as s_acctbal",
    ],
    "part": [
        "p_partkey",
        "p_name",
        "p_brand",
        "p_type",
        "case when p_partkey%6=2 then 'N/A' when p_partkey%6=4 then 'unknown' else cast(p_size as string) end as p_size_text",
        "case when p_partkey%5=2 then 'invalid' when p_partkey%5=4 then 'N/A' else '2023-01-15' end as p_date_text",
        "p_retailprice",
    ],
    "events": [
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "case when event_id%10=3 then null else value end as value",
        "props",
    ],
}


def defective(spark: SparkSession, folder: str, name: str) -> DataFrame:
    damaged = table(spark, folder, name).selectExpr(*DEFECTS[name])
    if name == "orders":
        return damaged.unionByName(damaged.filter("o_orderkey % 10 = 0"))
    return damaged


def damaged_sql(name: str) -> str:
    """The damaged table as a common table expression named ``d``."""
    body = f"select {', '.join(DEFECTS[name])} from {name}"
    if name == "orders":
        body = f"select * from ({body}) union all select * from ({body}) where o_orderkey % 10 = 0"
    return f"with d as ({body})"


def union_sql(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)
