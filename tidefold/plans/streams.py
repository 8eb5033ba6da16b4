"""Streams as queries: a table's files are replayed as a stream until all are worked off."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidefold.operators import folds
from tidefold.operators.store import shared_dir
from tidefold.plans.folds import BUDGET_SQL, QUOTA_MS, QUOTA_RATE, QUOTA_SQL
from tidefold.plans.registry import query
from tidefold.sources.model import FILES, Model
from tidefold.streaming import outbox


def events(m):
    return outbox.read_log(m.spark, f"{m.sf_dir}/events.parquet").select("user_id", "event_type", F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), F.floor(F.col("value") * 100).cast("long").alias("delta"), F.concat_ws(":", F.col("user_id").cast("string"), "props").alias("dedup_key"))


class StreamModel(Model):
    """The model's tables over streams of the same files (those that are plain projections)."""

    def __getattr__(self, name):
        return outbox.read_log(self.spark, f"{self.sf_dir}/{name}.parquet") if name in FILES else super().__getattr__(name)


def drained(m, stream, mode="append"):
    folder = f"{shared_dir(m.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    outbox.drain(stream, folder, mode)
    return m.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("stream_budget_spend", BUDGET_SQL)
def stream_budget_spend(m):
    log = events(m).withColumnRenamed("user_id", "budget_id").join(m.budget_policy.select("budget_id", "hard_limit", "soft_limit"), "budget_id")
    return drained(m, outbox.fold_stream(log, "budget_id", ["now_ms", "seq"], folds.budget_step, folds.BUDGET))


@query("stream_quota_admission", QUOTA_SQL)
def stream_quota_admission(m):
    log = events(m).select(F.col("user_id").alias("policy_id"), "seq", "now_ms", F.col("seq").alias("execution_id"))
    return drained(m, outbox.fold_stream(log, "policy_id", ["now_ms", "seq"], folds.quota_step(QUOTA_MS, QUOTA_RATE), folds.QUOTA))


@query("stream_outbox_tail", "SELECT budget_id AS user_id, seq, now_ms FROM usage WHERE now_ms > 0 AND dim <> 'view'")
def stream_outbox_tail(m):
    log = events(m).withColumns({"ts_ms": F.col("now_ms"), "mode": F.when(F.col("event_type") == "view", "best_effort")})
    return drained(m, outbox.tail(log, 0).select("user_id", "seq", "now_ms"))


#: The last hours stay open until later rows come, so only windows that the watermark has passed are given.
@query("stream_outbox_counts", "WITH w AS (SELECT CAST(floor(now_ms / 3600000) AS BIGINT) * 3600000 AS from_ms, dim AS event_type, count(*) AS n, (SELECT max(now_ms) FROM usage) AS newest FROM usage GROUP BY 1, 2) SELECT from_ms, event_type, n FROM w WHERE from_ms + 3600000 <= newest - 3600000")
def stream_outbox_counts(m):
    return drained(m, outbox.counts(events(m), ["event_type"], "1 hour"))


@query("stream_completions", "SELECT event_id, execution_id, outcome, committed_at_ms FROM completion WHERE event_id > 100 AND namespace = 'ns-1'")
def stream_completions(m):
    events = StreamModel(m.spark, m.sf_dir).completion
    return drained(m, outbox.subscribe(events, 100, "ns-1").select("event_id", "execution_id", "outcome", "committed_at_ms"))


@query("stream_signal_deliveries", "SELECT signal_id, execution_id, waitpoint_id, signal_name, source_identity FROM signal WHERE signal_id > 100 AND signal_name <> 'view'")
def stream_signal_deliveries(m):
    """Signal deliveries after a cursor, of the names a subscriber asks for."""
    rows = StreamModel(m.spark, m.sf_dir).signal.where("signal_name <> 'view'").withColumn("event_id", F.col("signal_id")).withColumn("namespace", F.lit(None).cast("string"))
    return drained(m, outbox.subscribe(rows, 100).select("signal_id", "execution_id", "waitpoint_id", "signal_name", "source_identity"))


@query("stream_lease_history", "SELECT event_id, execution_id, event, at_ms FROM lease_event WHERE event_id > 100 AND event <> 'acquired'")
def stream_lease_history(m):
    """How leases ended, after a cursor: an outbox of one row per change of a lease."""
    rows = StreamModel(m.spark, m.sf_dir).lease_event.where("event <> 'acquired'").withColumn("namespace", F.lit(None).cast("string"))
    return drained(m, outbox.subscribe(rows, 100).select("event_id", "execution_id", "event", "at_ms"))


@query("stream_completion_edges", "SELECT c.event_id, e.edge_id, e.downstream_eid, c.outcome FROM completion c JOIN edge e ON c.execution_id = e.upstream_eid")
def stream_completion_edges(m):
    """Completions as they come, each with the outgoing edges of a table: what a resolver works on."""
    events = StreamModel(m.spark, m.sf_dir).completion.select("event_id", F.col("execution_id").alias("upstream_eid"), "outcome")
    return drained(m, events.join(m.edge, "upstream_eid").select("event_id", "edge_id", "downstream_eid", "outcome"))
