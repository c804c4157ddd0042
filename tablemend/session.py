"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written in each open ``scratch``, the innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("_WRITTEN", default=())


def build_session(app: str = "tablemend", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Shuffle width is left to adaptive execution (it coalesces small partitions and
    splits skewed join partitions); pass ``spark.sql.shuffle.partitions`` to override.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder: executors of a cluster do not share one.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint()
    for paths in _WRITTEN.get()[-1:]:
        paths.append(done._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return done


def stored(df: DataFrame) -> DataFrame:
    """Like ``settle``, as compressed columns: for tables many times wider or longer than the input."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    for paths in _WRITTEN.get()[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``settle`` and ``stored`` write inside when it ends: for work whose result is on the driver by then, or
    was written outside.

    Shuffle files go when the plans that wrote them are collected, which is asked for as well.
    """
    paths: list[str] = []
    outer = _WRITTEN.set((*_WRITTEN.get(), paths))
    try:
        yield
    finally:
        _WRITTEN.reset(outer)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        gc.collect()
        jvm.System.gc()


@contextmanager
def outside() -> Iterator[None]:
    """What is written here outlives the innermost ``scratch``; the one around that still counts."""
    inner = _WRITTEN.set(_WRITTEN.get()[:-1])
    try:
        yield
    finally:
        _WRITTEN.reset(inner)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set up if need be."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tablemend-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
