"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where the session names none, as in tests, a local one is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or tempfile.mkdtemp(prefix="tidefold-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once; its lineage ends in ``shared_dir``, so lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table: its true size is known to Spark, which then joins a small
    one without moving the other side."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tidefold-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """As ``stored``, as a table in buckets by ``key``: a join on it moves the other side only."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tidefold_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}.parquet").saveAsTable(name, format="parquet")
    return spark.table(name)
