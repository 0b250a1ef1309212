"""Tables written between jobs, in the folder that the cluster shares."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/llm/{name}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables written inside the block are deleted at its end; nothing may read them later.  ``written(..., stays=True)`` is spared."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: later jobs start from files, so lost executors cost no recomputation of it."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES and not stays:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its rows placed by ``key`` in as many partitions as shuffles have; ``kept_dealt`` keeps them so."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept_dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """``written`` for rows that ``dealt`` has placed by the same key: later joins on ``key`` leave them where they are."""
    spark = df.sparkSession
    path = folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.table(table)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Later jobs of the session hand at most about ``size`` bytes to a Python worker at a time (one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_column(docs: DataFrame, name: str = "text") -> DataFrame:
    """``docs`` with ``name`` as a string column (an untyped null column counts as null texts)."""
    return docs.withColumn(name, docs[name].cast("string"))
