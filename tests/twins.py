"""Run a registered query and its SQL twin and compare all rows and values."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql, folder):
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = rows_of(names, cur.fetchall())
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if left != right:
        only = [x for x in left if x not in set(right)][:3], [x for x in right if x not in set(left)][:3]
        return f"{len(left)} against {len(right)} rows; Spark only {only[0]}; SQL only {only[1]}"
    return None
