"""Small helpers shared by the training-data operators.

Conventions of every operator here:

* a word is ``[^\\x20\\x09-\\x0D]+`` unless an operator says otherwise,
* a null text counts as an empty text,
* only ``doc_id`` and ``text`` (and columns that a docstring names) are read, so
  any further column of the input, whatever its name, is ignored or passed on,
* an empty table gives an empty result of the same schema,
* rows that repeat a ``doc_id`` are rows of their own.
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python agree on this class; it is exactly what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in tests, a folder of this machine is set.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="tidefold-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table, for wide rows of which later steps read some columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidefold-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text without nulls, and further columns by name."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def per_worker(key: tuple, make: Callable):
    """``make()`` once in a Python worker, however many of its tasks ask for it."""
    kept = sys.modules.setdefault("_tidefold_per_worker", types.ModuleType("_tidefold_per_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
