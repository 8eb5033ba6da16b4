"""Logs as streams: the batch folds with kept state, tails, windows and once-only delivery.

A stream is any streaming DataFrame of a log table; ``read_log`` makes one of Parquet files.  State
lives in Spark's state store and its checkpoint, so a lost executor or a restart goes on from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidefold.functions.exprs import filter_matches
from tidefold.operators.folds import Step


def read_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of ``path`` (one file, or a folder of files) as they come; the schema is
    that of the files there now.  Streams take no path of one file, but a pattern that fits it."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path}*")


def fold_stream(log: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """``operators.folds.fold`` on a stream: the same step, its state kept between micro-batches.

    Within a micro-batch a key's commands are taken in ``order``; later batches come after."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(_key, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(kept.get[0]) if kept.exists else None
        out = []
        log = pd.concat(frames).sort_values(order)
        for command in log.astype(object).where(log.notna(), None).to_dict("records"):
            state, rows = step(state, command)
            out += rows
        kept.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return log.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def tail(frames: DataFrame, after_ms: int) -> DataFrame:
    """Frames after a cursor, best-effort ones hidden; only the cursor's columns are read to filter."""
    return frames.where((F.col("ts_ms") > after_ms) & (F.coalesce("mode", F.lit("durable")) != "best_effort"))


def subscribe(events: DataFrame, after_id: int, namespace: str | None = None) -> DataFrame:
    """Outbox events after a cursor that pass a scanner's filter (a missing namespace passes none)."""
    return events.where((F.col("event_id") > after_id) & filter_matches(F.col("namespace"), F.lit(None), namespace))


def at_time(log: DataFrame, ms: str = "now_ms") -> DataFrame:
    """``log`` with event time ``at``."""
    return log.withColumn("at", F.timestamp_millis(F.col(ms)))


def once(log: DataFrame, key: str, ttl: str = "24 hours") -> DataFrame:
    """The first row of each key within ``ttl``; the state of older keys is dropped."""
    return at_time(log).withWatermark("at", ttl).dropDuplicatesWithinWatermark([key]).drop("at")


def counts(log: DataFrame, keys: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """Rows by key and tumbling window; windows end for good once ``late`` has passed."""
    w = F.window("at", width)
    return at_time(log).withWatermark("at", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("from_ms"), *keys, "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Work off what is there now, into Parquet under ``folder``, then stop.  Run again to go on:
    the checkpoint beside the rows makes each input row count once."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
