"""Session settings and the shared folder for written intermediate tables."""
from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET = 1 << 17
_LOCAL: dict[str, str] = {}  # temporary folders of plain local sessions without the setting


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "barwright") -> SparkSession:
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # joins on (symbol, et_date, ...) reuse the (symbol, et_date) bucketing instead of shuffling again
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # executors of a local-cluster are processes of their own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="barwright-")
    return _LOCAL[app]


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation: unlike a table made of an RDD it has a known size."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    def plain(value, kind):
        if value is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, value)}
        if isinstance(kind, T.ArrayType):
            return [plain(v, kind.elementType) for v in value]
        return value
    kind = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.Table.from_pylist([plain(r, kind) for r in rows], schema=to_arrow_schema(kind)), kind)


def bucket_count(source: DataFrame) -> int:
    """Buckets for tables derived from ``source``: about 131,072 of its rows each, never fewer than the cores.

    Rows are counted and not bytes: files may be packed 20 to 1, and a task sorts and holds rows.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    return int(max(cores, source.count() // ROWS_PER_BUCKET + 1))


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int):
    """Exchanges of what runs inside have ``n`` partitions, so that they meet a table of ``n`` buckets as it lies."""
    name = "spark.sql.shuffle.partitions"
    held = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, held)


@contextmanager
def unmeasured_batches(spark: SparkSession):
    """What starts inside hands rows to Python by number alone (10,000 at a time): Spark otherwise measures every column of the batch again after each row.

    For rows of plain numbers and short texts only; a stream keeps the setting it was started with.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(2 ** 31 - 1))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def write_bucketed(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """Write ``df`` once, bucketed on ``keys``: later windows and joins on these keys need no shuffle.

    ``repartition`` on the bucket keys gives every task exactly one bucket, so one file per bucket is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    (df.repartition(buckets, *keys).write.mode("overwrite")
       .bucketBy(buckets, *keys).sortBy(*keys, *order)
       .option("path", path).format("parquet").saveAsTable(name))
    return spark.table(name)
