"""A training corpus from raw documents: five stages, each written before the next reads it.

1. toxicity: documents scored as toxic go.
2. line_dedup: recurring line templates go from all documents but the first; a document left without text goes.
3. near_copies: one document of each class of near copies stays.
4. decontamination: documents that hold a passage of the benchmark go.
5. packing: what is left is packed into token sequences; a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm.catalog import read
from tablemend.llm.decontaminate import clean
from tablemend.llm.lines import drop_lines
from tablemend.llm.near_copies import near_copies
from tablemend.llm.packing import pack
from tablemend.llm.sieve import sieve
from tablemend.llm.store import fresh, written
from tablemend.llm.toxicity import fit, held_out, score


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the doc_ids of ``gone``; only rows that may match are shuffled."""
    gone = written(gone.select("doc_id").distinct(), "gone")
    name = fresh(docs, "maybe")
    maybe = docs.withColumn(name, F.coalesce(sieve(gone, "doc_id")(F.col("doc_id").cast("long")), F.lit(False)))
    kept = maybe.filter(~F.col(name)).drop(name)
    return kept.unionByName(maybe.filter(name).drop(name).join(gone, "doc_id", "left_anti"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7."""
    labels = read(spark, sf_dir, "labels").filter(~held_out()).selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) label")
    model = fit(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), labels)
    name = fresh(docs, "toxicity")
    return score(docs, model, name).filter(F.col(name) < 0.7).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines. One that lost lines and has only white space left goes; n_chars follows the text."""
    cut = drop_lines(docs).filter("n_dropped = 0 or text rlike '\\\\S'")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies."""
    return without(docs, near_copies(docs).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 2,048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
