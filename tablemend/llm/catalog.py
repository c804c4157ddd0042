"""Registered queries of the corpus operators, on whole tables with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import twins
from .licenses import license_notices, twin_sql
from .store import short_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_ids")
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import scratch
    from .token_file import read_documents, write_token_file

    path = scratch(spark, "token-file")
    write_token_file(read(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


@query("op9_decontaminate", twins.CONTAMINATION)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op3_near_copies", twins.COMPONENTS)
def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_copies import near_copies

    return near_copies(read(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(read(spark, sf_dir, "documents"))


@query("op8_warc", twins.ARCHIVE)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import scratch
    from .warc import read_archive, write_archive

    path = scratch(spark, "archive")
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


@query("op4_line_templates")
def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_lines

    return drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 20
"""


@query("op2_top_products", OP2_SQL)
def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_products import top_products

    return top_products(read(spark, sf_dir, "embeddings"))


@query("op10_licenses", twin_sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(read(spark, sf_dir, "documents"))


@query("op11_collocations", twins.PHRASES)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(read(spark, sf_dir, "documents"))


@query("op13_repeated_passages", twins.REPEATS)
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeats

    return drop_repeats(read(spark, sf_dir, "documents")).selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256) kept_sha256")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))
