"""Read models: point reads, keyset pages, joins and rollups over the folded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions import exprs as X

STATES = ("waiting", "delayed", "rate_limited", "waiting_children", "active", "suspended", "completed", "failed", "cancelled", "expired", "skipped")


def page(df: DataFrame, keys: list[str], after: tuple | None, limit: int, where: Column | None = None) -> DataFrame:
    """Keyset page: the first ``limit`` rows after the cursor in the order of ``keys``.

    The first key's bound is stated apart, so that it reaches the scan as a pushed filter."""
    if where is not None:
        df = df.where(where)
    if after is not None:
        bounds = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, after, strict=True)]
        beyond = [reduce(lambda a, b: a & b, [F.col(keys[j]) == bounds[j] for j in range(i)], F.col(keys[i]) > bounds[i]) for i in range(len(keys))]
        df = df.where(F.col(keys[0]) >= bounds[0]).where(reduce(lambda a, b: a | b, beyond))
    return df.orderBy(*keys).limit(limit)


def next_cursor(df: DataFrame, keys: list[str], after: tuple | None, limit: int, where: Column | None = None) -> tuple[list, tuple | None]:
    """Rows of a page and the cursor of the next one (None at the end), by reading one row more."""
    rows = page(df, keys, after, limit + 1, where).collect()
    return rows[:limit], tuple(rows[limit - 1][k] for k in keys) if len(rows) > limit else None


def current_attempt(attempt: DataFrame) -> DataFrame:
    """The attempt of the highest index of each execution: one aggregation, no sort."""
    rest = [c for c in attempt.columns if c != "execution_id"]
    latest = attempt.groupBy("execution_id").agg(F.max_by(F.struct(*rest), "attempt_index").alias("latest_row"))
    return latest.select("execution_id", "latest_row.*")


def describe(executions: DataFrame, attempt: DataFrame) -> DataFrame:
    """Executions with their current attempt, if any."""
    return executions.join(current_attempt(attempt), "execution_id", "left")


def execution_info(executions: DataFrame, attempt: DataFrame) -> DataFrame:
    """Set-once start, attempts so far, and current lease epoch of each execution."""
    per = attempt.groupBy("execution_id").agg(
        F.min_by("started_at_ms", "attempt_index").alias("first_started_at_ms"),
        F.count(F.lit(1)).alias("total_attempts"),
        F.max("attempt_index").alias("current_attempt_index"),
        F.max_by("lease_epoch", "attempt_index").alias("lease_epoch"),
    )
    return executions.select("execution_id", "flow_id", "public_state").join(per, "execution_id", "left").withColumn("total_attempts", F.coalesce("total_attempts", F.lit(0)))


def flow_summary(executions: DataFrame) -> DataFrame:
    """Members of each flow by public state, and the flow's own state."""
    rows = executions.groupBy("flow_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("public_state") == s).alias(s) for s in STATES])
    bad = F.col("failed") + F.col("cancelled") + F.col("expired")
    terminal = bad + F.col("completed") + F.col("skipped")
    blocked = F.col("suspended") + F.col("delayed") + F.col("rate_limited") + F.col("waiting_children")
    return rows.withColumn("public_flow_state", X.flow_state(F.col("total"), terminal, bad, F.col("active"), blocked))


def flow_summary_pivot(executions: DataFrame) -> DataFrame:
    """The same counts by pivot over the fixed list of states."""
    return executions.groupBy("flow_id").pivot("public_state", list(STATES)).count().fillna(0)


def sampled_summary(executions: DataFrame, members: int = 50) -> DataFrame:
    """Flow state from at most ``members`` members of each flow (those of the smallest hashes)."""
    order = F.row_number().over(Window.partitionBy("flow_id").orderBy(F.xxhash64("execution_id"), "execution_id"))
    return flow_summary(executions.withColumn("n", order).where(F.col("n") <= members)).select("flow_id", "total", "public_flow_state")


def fields(executions: DataFrame, names: list[str]) -> DataFrame:
    """A chosen subset of columns as a map of strings."""
    return executions.select("execution_id", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]).alias("fields"))


def expired_leases(executions: DataFrame, attempt: DataFrame, now: int) -> DataFrame:
    """Active executions whose current attempt's lease has run out."""
    active = executions.where("lifecycle_phase = 'active'").select("execution_id", "flow_id", "lane_id")
    late = current_attempt(attempt).where(F.col("lease_expires_at_ms") <= now).select("execution_id", "attempt_index", "worker_id", "lease_epoch", "lease_expires_at_ms")
    return active.join(late, "execution_id")


def siblings(edge: DataFrame, executions: DataFrame) -> DataFrame:
    """Upstream members of each downstream that still run."""
    live = executions.where("lifecycle_phase <> 'terminal'").select(F.col("execution_id").alias("upstream_eid"), "public_state")
    return edge.join(live, "upstream_eid").select("downstream_eid", "upstream_eid", "public_state")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins per key (``order`` decides, new rows over old ones at a tie)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("kept_row")).select(key, "kept_row.*").select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """First write wins: new keys only, each with its first row."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("kept_row")).select(key, "kept_row.*")
    return first.join(old.select(key), key, "left_anti").select(*new.columns)


def select_or_default(keys: DataFrame, rows: DataFrame, key: str, **defaults) -> DataFrame:
    """Rows of ``rows``, and for keys without any a row of defaults."""
    absent = keys.join(rows, key, "left_anti").select(key, *[F.lit(v).alias(k) for k, v in defaults.items()])
    return rows.select(key, *defaults).unionByName(absent)
