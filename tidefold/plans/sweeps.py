"""The background sweeps as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.operators import scheduling as S
from tidefold.operators import sweeps as W
from tidefold.operators.reads import expired_leases
from tidefold.plans.read_models import LATEST
from tidefold.plans.registry import query
from tidefold.sources.model import DAY, NOW

#: The clock of the events table's month.
MARCH = 1_706_000_000_000


@query("due_lease_expiry", f"SELECT e.execution_id, a.lease_epoch, 'lease_expired_reclaimable' AS ownership_state FROM exec_core e JOIN {LATEST} a ON e.execution_id = a.execution_id WHERE e.ownership_state = 'leased' AND e.lifecycle_phase = 'active' AND a.lease_expires_at_ms <= {NOW}")
def due_lease_expiry(m):
    return W.lease_expiry(m.exec_core, m.attempt, NOW)


@query("due_delayed", f"SELECT execution_id, lane_id, 'eligible_now' AS eligibility_state FROM exec_core WHERE eligibility_state = 'not_eligible_until_time' AND delay_until_ms <= {NOW}")
def due_delayed(m):
    return W.promote_delayed(m.exec_core, NOW)


@query("due_attempt_timeout", f"SELECT e.execution_id, e.flow_id, a.started_at_ms, 'expired' AS terminal_outcome FROM exec_core e JOIN (SELECT execution_id, arg_max(started_at_ms, attempt_index) AS started_at_ms FROM attempt WHERE outcome = 'running' GROUP BY execution_id) a ON e.execution_id = a.execution_id WHERE e.lifecycle_phase = 'active' AND a.started_at_ms <= {NOW - 3_600_000 - 5_000}")
def due_attempt_timeout(m):
    return W.attempt_timeout(m.exec_core, m.attempt, NOW, 3_600_000, 5_000)


@query("due_deadline", f"SELECT execution_id, deadline_at_ms, 'expired' AS terminal_outcome FROM exec_core WHERE lifecycle_phase <> 'terminal' AND deadline_at_ms <= {NOW}")
def due_deadline(m):
    return W.deadline(m.exec_core, NOW)


#: Rows of one batch of a sweep.
BATCH = 1000


@query("due_deadline_batch", f"SELECT execution_id, deadline_at_ms FROM exec_core WHERE lifecycle_phase <> 'terminal' AND deadline_at_ms <= {NOW} ORDER BY deadline_at_ms, execution_id LIMIT {BATCH}")
def due_deadline_batch(m):
    return W.first_due(m.exec_core.where("lifecycle_phase <> 'terminal'"), "deadline_at_ms", NOW, BATCH).select("execution_id", "deadline_at_ms")


@query("due_delayed_batch", f"SELECT execution_id, delay_until_ms FROM exec_core WHERE eligibility_state = 'not_eligible_until_time' AND delay_until_ms <= {NOW} ORDER BY delay_until_ms, execution_id LIMIT {BATCH}")
def due_delayed_batch(m):
    return W.first_due(m.exec_core.where("eligibility_state = 'not_eligible_until_time'"), "delay_until_ms", NOW, BATCH).select("execution_id", "delay_until_ms")


@query("due_lease_expiry_batch", f"SELECT e.execution_id, a.lease_epoch, a.lease_expires_at_ms FROM exec_core e JOIN {LATEST} a ON e.execution_id = a.execution_id WHERE e.ownership_state = 'leased' AND e.lifecycle_phase = 'active' AND a.lease_expires_at_ms <= {NOW} ORDER BY a.lease_expires_at_ms, e.execution_id LIMIT {BATCH}")
def due_lease_expiry_batch(m):
    rows = expired_leases(m.exec_core.where("ownership_state = 'leased'"), m.attempt, NOW)
    return W.first_due(rows, "lease_expires_at_ms", NOW, BATCH).select("execution_id", "lease_epoch", "lease_expires_at_ms")


@query(
    "due_suspension",
    f"""SELECT execution_id, waitpoint_id, CASE timeout_behavior WHEN 'auto_resume_with_timeout_signal' THEN 'runnable' WHEN 'escalate' THEN 'suspended' ELSE 'terminal' END AS lifecycle_phase,
  CASE timeout_behavior WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'expire' THEN 'expired' ELSE 'none' END AS terminal_outcome,
  CASE timeout_behavior WHEN 'escalate' THEN 'paused_by_operator' WHEN 'auto_resume_with_timeout_signal' THEN 'waiting_for_worker' ELSE 'none' END AS blocking_reason FROM waitpoint WHERE status = 'pending' AND timeout_at_ms <= {NOW}""",
)
def due_suspension(m):
    return W.suspension_timeout(m.waitpoint, NOW)


@query("due_waitpoint", f"SELECT waitpoint_id, created_at_ms + {30 * DAY} AS expires_at_ms, 'closed' AS status FROM waitpoint WHERE status = 'pending' AND created_at_ms + {30 * DAY} <= {NOW}")
def due_waitpoint(m):
    return W.waitpoint_expiry(m.waitpoint, NOW, 30 * DAY)


@query("retention_trim", f"SELECT a.execution_id, a.attempt_index FROM attempt a WHERE a.execution_id NOT IN (SELECT execution_id FROM exec_core WHERE lifecycle_phase = 'terminal' AND terminal_at_ms <= {NOW - DAY})")
def retention_trim(m):
    return W.trimmed(m.attempt, W.retention(m.exec_core, NOW, DAY)).select("execution_id", "attempt_index")


@query("due_budget_reset", f"SELECT budget_id, created_at_ms + reset_interval_ms AS next_reset_at_ms, {MARCH} + reset_interval_ms AS following_reset_at_ms FROM budget_policy WHERE reset_interval_ms > 0 AND created_at_ms + reset_interval_ms <= {MARCH}")
def due_budget_reset(m):
    return W.budget_reset(m.budget_policy, MARCH)


@query("budget_breach_dims", "SELECT u.budget_id, dim, used, used > hard_limit // 4 AS hard_breached, used > soft_limit // 4 AS soft_breached FROM (SELECT budget_id, dim, sum(delta)::BIGINT AS used FROM usage GROUP BY budget_id, dim) u JOIN budget_policy p ON u.budget_id = p.budget_id")
def budget_breach_dims(m):
    return W.dim_breaches(m.budget_policy, m.usage, 4)


@query("budget_breach_reconcile", "SELECT p.budget_id, coalesce(u.used, 0) AS used, coalesce(u.used, 0) > hard_limit AS hard_breached, coalesce(u.used, 0) > soft_limit AS soft_breached FROM budget_policy p LEFT JOIN (SELECT budget_id, sum(delta)::BIGINT AS used FROM usage GROUP BY budget_id) u ON p.budget_id = u.budget_id")
def budget_breach_reconcile(m):
    return W.budget_breaches(m.budget_policy, m.usage)


@query("quota_recount", f"SELECT policy_id, count(*) FILTER (WHERE expires_at_ms > {MARCH}) AS live, count(*) AS ever FROM admission GROUP BY policy_id")
def quota_recount(m):
    return W.quota_recount(m.admission, MARCH)


@query(
    "unblock_candidates",
    f"""WITH u AS (SELECT budget_id, sum(delta) AS used FROM usage GROUP BY budget_id), q AS (SELECT policy_id, count(*) FILTER (WHERE expires_at_ms > {MARCH}) AS live FROM admission GROUP BY policy_id),
  c AS (SELECT lane_id, list(DISTINCT t) AS caps FROM (SELECT lane_id, unnest(capabilities) AS t FROM worker) x GROUP BY lane_id)
SELECT execution_id, eligibility_state AS was, 'eligible_now' AS eligibility_state FROM exec_core e LEFT JOIN budget_policy p ON e.flow_id = p.budget_id LEFT JOIN u ON e.flow_id = u.budget_id LEFT JOIN q ON e.flow_id = q.policy_id LEFT JOIN c ON e.lane_id = c.lane_id
WHERE (eligibility_state = 'blocked_by_budget' AND NOT coalesce(u.used > p.hard_limit, false)) OR (eligibility_state = 'blocked_by_quota' AND coalesce(q.live, 0) < 20)
  OR (eligibility_state = 'blocked_by_route' AND coalesce(len(list_filter(required_capabilities, lambda r: NOT list_contains(c.caps, r))) = 0, false))""",
)
def unblock_candidates(m):
    caps = m.worker.select("lane_id", F.explode("capabilities").alias("token")).groupBy("lane_id").agg(F.collect_set("token").alias("lane_capabilities"))
    return W.unblock(m.exec_core, W.budget_breaches(m.budget_policy, m.usage), W.quota_recount(m.admission, MARCH), 20, caps)


@query(
    "dependency_stuck",
    f"SELECT e.execution_id, u.last_ms, u.upstreams FROM exec_core e JOIN (SELECT g.downstream_eid, bool_and(x.lifecycle_phase = 'terminal') AS ended, max(x.terminal_at_ms) AS last_ms, count(*) AS upstreams FROM edge g JOIN exec_core x ON g.upstream_eid = x.execution_id GROUP BY g.downstream_eid) u ON e.execution_id = u.downstream_eid WHERE e.eligibility_state = 'blocked_by_dependencies' AND u.ended AND u.last_ms < {NOW - 15_000}",
)
def dependency_stuck(m):
    return W.stuck_dependencies(m.edge, m.exec_core, NOW, 15_000)


@query("outbox_undispatched", f"SELECT event_id, execution_id, outcome FROM completion WHERE dispatched_at_ms IS NULL AND committed_at_ms < {NOW - 1000}")
def outbox_undispatched(m):
    return W.undispatched(m.completion, NOW, 1000)


@query("cancel_backlog_due", f"SELECT flow_id, execution_id, policy FROM cancel_backlog WHERE grace_until_ms <= {NOW}")
def cancel_backlog_due(m):
    return W.cancel_due(m.cancel_backlog, NOW)


@query("cancel_ack", "SELECT flow_id, count(*) AS members FROM cancel_backlog WHERE execution_id % 2 = 0 GROUP BY flow_id")
def cancel_ack(m):
    acked = m.exec_core.where("execution_id % 2 <> 0").select("execution_id")
    return m.cancel_backlog.join(acked, "execution_id", "left_anti").groupBy("flow_id").agg(F.count(F.lit(1)).alias("members"))


@query(
    "index_drift",
    "SELECT coalesce(e.execution_id, i.execution_id) AS execution_id, CASE WHEN i.execution_id IS NULL THEN 'missing' ELSE 'stray' END AS drift FROM (SELECT execution_id FROM exec_core WHERE lifecycle_phase = 'runnable' AND eligibility_state = 'eligible_now') e FULL JOIN (SELECT execution_id FROM exec_core WHERE public_state IN ('waiting', 'delayed')) i ON e.execution_id = i.execution_id WHERE e.execution_id IS NULL OR i.execution_id IS NULL",
)
def index_drift(m):
    return W.index_drift(m.exec_core, m.exec_core.where("public_state IN ('waiting', 'delayed')"))


@query("worker_ttl_sweep", f"SELECT namespace, worker_instance_id, 'ttl_swept' AS event FROM worker WHERE last_heartbeat_ms + liveness_ttl_ms < {NOW}")
def worker_ttl_sweep(m):
    return W.dead_workers(m.worker, NOW)


@query("reclaim_grants", "SELECT execution_id, ownership_state, array_to_string(list_sort(required_capabilities), ',') AS needs FROM exec_core WHERE ownership_state IN ('lease_expired_reclaimable', 'lease_revoked') AND len(list_filter(required_capabilities, lambda c: NOT list_contains(['gpu', 'large', 'eu'], c))) = 0")
def reclaim_grants(m):
    from tidefold.functions.exprs import has_all

    ok = has_all(F.col("required_capabilities"), F.array(*map(F.lit, ("gpu", "large", "eu"))))
    return m.exec_core.where(F.col("ownership_state").isin("lease_expired_reclaimable", "lease_revoked") & ok).select("execution_id", "ownership_state", F.array_join(F.array_sort("required_capabilities"), ",").alias("needs"))
