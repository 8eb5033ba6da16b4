"""Background sweeps: each is a temporal predicate over a table, and the transition it asks for.

``now`` is always a parameter.  A deadline is due when it is at or before now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.reads import expired_leases


def due(df: DataFrame, column: str, now: int) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) <= now))


def first_due(df: DataFrame, column: str, now: int, n: int, key: str = "execution_id") -> DataFrame:
    """The ``n`` rows that have been due longest, ties by key: one batch of a sweep.  Spark takes the
    first ``n`` of each partition before it merges them."""
    return due(df, column, now).orderBy(column, key).limit(n)


def lease_expiry(executions: DataFrame, attempt: DataFrame, now: int) -> DataFrame:
    """Leased executions whose lease has run out become reclaimable."""
    leased = executions.where("ownership_state = 'leased'")
    return expired_leases(leased, attempt, now).select("execution_id", "lease_epoch", F.lit("lease_expired_reclaimable").alias("ownership_state"))


def promote_delayed(executions: DataFrame, now: int) -> DataFrame:
    return due(executions.where("eligibility_state = 'not_eligible_until_time'"), "delay_until_ms", now).select("execution_id", "lane_id", F.lit("eligible_now").alias("eligibility_state"))


def attempt_timeout(executions: DataFrame, attempt: DataFrame, now: int, timeout_ms: int, grace_ms: int) -> DataFrame:
    """Active executions whose running attempt has lasted longer than allowed, with some grace."""
    running = attempt.where("outcome = 'running'").groupBy("execution_id").agg(F.max_by("started_at_ms", "attempt_index").alias("started_at_ms"))
    active = executions.where("lifecycle_phase = 'active'").select("execution_id", "flow_id")
    return active.join(running.where(F.col("started_at_ms") <= now - timeout_ms - grace_ms), "execution_id").withColumn("terminal_outcome", F.lit("expired"))


def deadline(executions: DataFrame, now: int) -> DataFrame:
    return due(executions.where("lifecycle_phase <> 'terminal'"), "deadline_at_ms", now).select("execution_id", "deadline_at_ms", F.lit("expired").alias("terminal_outcome"))


def suspension_timeout(waitpoint: DataFrame, now: int) -> DataFrame:
    """What becomes of a suspension whose time is up, by its declared behaviour."""
    phase = F.when(F.col("timeout_behavior") == "auto_resume_with_timeout_signal", "runnable").when(F.col("timeout_behavior") == "escalate", "suspended").otherwise("terminal")
    outcome = F.when(phase == "terminal", F.element_at(F.create_map(*map(F.lit, ("fail", "failed", "cancel", "cancelled", "expire", "expired"))), F.col("timeout_behavior"))).otherwise("none")
    blocked = F.when(F.col("timeout_behavior") == "escalate", "paused_by_operator").when(phase == "runnable", "waiting_for_worker").otherwise("none")
    return due(waitpoint.where("status = 'pending'"), "timeout_at_ms", now).select("execution_id", "waitpoint_id", phase.alias("lifecycle_phase"), outcome.alias("terminal_outcome"), blocked.alias("blocking_reason"))


def waitpoint_expiry(waitpoint: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    late = waitpoint.where("status = 'pending'").withColumn("expires_at_ms", F.col("created_at_ms") + ttl_ms)
    return due(late, "expires_at_ms", now).select("waitpoint_id", "expires_at_ms", F.lit("closed").alias("status"))


def retention(executions: DataFrame, now: int, keep_ms: int) -> DataFrame:
    """Ids whose terminal state is older than the retention."""
    return due(executions.where("lifecycle_phase = 'terminal'"), "terminal_at_ms", now - keep_ms).select("execution_id")


def trimmed(df: DataFrame, doomed: DataFrame) -> DataFrame:
    """A sibling table without the rows of doomed executions."""
    return df.join(doomed, "execution_id", "left_anti")


def budget_reset(policy: DataFrame, now: int) -> DataFrame:
    """Budgets whose tumbling interval has ended, and when the next one ends."""
    timed = policy.where("reset_interval_ms > 0").withColumn("next_reset_at_ms", F.col("created_at_ms") + F.col("reset_interval_ms"))
    return due(timed, "next_reset_at_ms", now).select("budget_id", "next_reset_at_ms", (F.lit(now) + F.col("reset_interval_ms")).alias("following_reset_at_ms"))


def budget_breaches(policy: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage recounted against both limits."""
    used = usage.groupBy("budget_id").agg(F.sum("delta").alias("used"))
    rows = policy.join(used, "budget_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.select("budget_id", "used", (F.col("used") > F.col("hard_limit")).alias("hard_breached"), (F.col("used") > F.col("soft_limit")).alias("soft_breached"))


def dim_breaches(policy: DataFrame, usage: DataFrame, share: int) -> DataFrame:
    """Usage recounted per dimension, against a ``share``-th of both limits."""
    used = usage.groupBy("budget_id", "dim").agg(F.sum("delta").alias("used"))
    rows = used.join(policy.select("budget_id", "hard_limit", "soft_limit"), "budget_id")
    return rows.select("budget_id", "dim", "used", *[(F.col("used") > F.floor(F.col(f"{x}_limit") / share)).alias(f"{x}_breached") for x in ("hard", "soft")])


def quota_recount(admission: DataFrame, now: int) -> DataFrame:
    """Admissions that are still alive, per policy."""
    return admission.groupBy("policy_id").agg(F.count_if(F.col("expires_at_ms") > now).alias("live"), F.count(F.lit(1)).alias("ever"))


def unblock(executions: DataFrame, breaches: DataFrame, live: DataFrame, cap: int, lane_caps: DataFrame) -> DataFrame:
    """Blocked executions whose cause is gone: budget within its limit, quota below its cap, or a
    lane whose workers, together, have all that is required.  Small sides join by broadcast if
    Spark finds them small."""
    blocked = executions.where(F.col("eligibility_state").isin("blocked_by_budget", "blocked_by_quota", "blocked_by_route"))
    rows = (
        blocked.join(breaches.select(F.col("budget_id").alias("flow_id"), "hard_breached"), "flow_id", "left")
        .join(live.select(F.col("policy_id").alias("flow_id"), "live"), "flow_id", "left")
        .join(lane_caps, "lane_id", "left")
    )
    ok = (
        F.when(F.col("eligibility_state") == "blocked_by_budget", ~F.coalesce("hard_breached", F.lit(False)))
        .when(F.col("eligibility_state") == "blocked_by_quota", F.coalesce("live", F.lit(0)) < cap)
        .otherwise(F.coalesce(F.size(F.array_except("required_capabilities", "lane_capabilities")) == 0, F.lit(False)))
    )
    return rows.where(ok).select("execution_id", F.col("eligibility_state").alias("was"), F.lit("eligible_now").alias("eligibility_state"))


def stuck_dependencies(edge: DataFrame, executions: DataFrame, now: int, stale_ms: int) -> DataFrame:
    """Children that still wait although all their upstreams ended a while ago."""
    state = executions.select("execution_id", "lifecycle_phase", "terminal_at_ms")
    ups = edge.join(state.withColumnRenamed("execution_id", "upstream_eid"), "upstream_eid").groupBy(F.col("downstream_eid").alias("execution_id")).agg(F.bool_and(F.col("lifecycle_phase") == "terminal").alias("ended"), F.max("terminal_at_ms").alias("last_ms"), F.count(F.lit(1)).alias("upstreams"))
    return executions.where("eligibility_state = 'blocked_by_dependencies'").select("execution_id").join(ups.where(F.col("ended") & (F.col("last_ms") < now - stale_ms)).drop("ended"), "execution_id")


def undispatched(completion: DataFrame, now: int, stale_ms: int) -> DataFrame:
    """Outbox rows that nobody dispatched in time."""
    return completion.where(F.col("dispatched_at_ms").isNull() & (F.col("committed_at_ms") < now - stale_ms)).select("event_id", "execution_id", "outcome")


def cancel_due(backlog: DataFrame, now: int) -> DataFrame:
    return due(backlog, "grace_until_ms", now).select("flow_id", "execution_id", "policy")


def index_drift(executions: DataFrame, eligible_index: DataFrame) -> DataFrame:
    """Where the eligible index and the state vectors disagree."""
    expected = executions.where("lifecycle_phase = 'runnable' AND eligibility_state = 'eligible_now'").select("execution_id", F.lit(True).alias("expected"))
    both = expected.join(eligible_index.select("execution_id", F.lit(True).alias("indexed")), "execution_id", "full")
    drift = F.when(F.col("indexed").isNull(), "missing").when(F.col("expected").isNull(), "stray")
    return both.select("execution_id", drift.alias("drift")).where("drift IS NOT NULL")


def dead_workers(worker: DataFrame, now: int) -> DataFrame:
    return worker.where(F.col("last_heartbeat_ms") + F.col("liveness_ttl_ms") < now).select("namespace", "worker_instance_id", F.lit("ttl_swept").alias("event"))
