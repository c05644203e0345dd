"""The shared folder: where tables that cut lineage are written, so that a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
        _forget_at_exit(spark, base)
    return base.rstrip("/")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """The driver deletes the path when it ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which is deleted when the application ends, or earlier by discard()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    path = getattr(df, "_table_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
