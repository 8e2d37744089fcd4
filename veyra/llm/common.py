"""Shared folders and table reading for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the folders that operators of this process have made, once their results are no longer read; their number."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; one in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends, and lost executors take nothing along. rows,
    where about known, keeps small tables in few files: one for each million rows, eight at least."""
    path = shared_dir(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(8 + rows // 1_000_000)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on tasks hand texts to Python in batches of so many rows, unless the session asks for others than 10,000 by
    itself: what the JVM and a worker hold of whole texts at once is a tenth."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
