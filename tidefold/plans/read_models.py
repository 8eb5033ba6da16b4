"""Read models over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import exprs as X
from tidefold.operators import reads as R
from tidefold.plans.registry import query
from tidefold.sources.model import NOW

COUNTS = ", ".join(f"count(*) FILTER (WHERE public_state = '{s}') AS {s}" for s in R.STATES)


@query(
    "flow_summary",
    f"""SELECT *, CASE WHEN total > 0 AND failed + cancelled + expired + completed + skipped = total THEN CASE WHEN failed + cancelled + expired > 0 THEN 'failed' ELSE 'completed' END
  WHEN active > 0 THEN 'running' WHEN suspended + delayed + rate_limited + waiting_children > 0 THEN 'blocked' ELSE 'open' END AS public_flow_state
FROM (SELECT flow_id, count(*) AS total, {COUNTS} FROM exec_core GROUP BY flow_id) f""",
)
def flow_summary(m):
    return R.flow_summary(m.exec_core)


@query("flow_summary_pivot", f"SELECT flow_id, {COUNTS} FROM exec_core GROUP BY flow_id")
def flow_summary_pivot(m):
    return R.flow_summary_pivot(m.exec_core)


@query("flow_summary_sampled")
def flow_summary_sampled(m):
    return R.sampled_summary(m.exec_core)


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY attempt_index DESC) AS rn FROM attempt) z WHERE rn = 1)"


@query("describe_execution", f"SELECT e.execution_id, e.flow_id, e.lane_id, e.public_state, a.attempt_index, a.worker_id, a.lease_epoch, a.lease_expires_at_ms, a.outcome FROM exec_core e LEFT JOIN {LATEST} a ON e.execution_id = a.execution_id")
def describe_execution(m):
    return R.describe(m.exec_core, m.attempt).select("execution_id", "flow_id", "lane_id", "public_state", "attempt_index", "worker_id", "lease_epoch", "lease_expires_at_ms", "outcome")


@query(
    "read_execution_info",
    """SELECT e.execution_id, e.flow_id, e.public_state, a.first_started_at_ms, coalesce(a.total_attempts, 0) AS total_attempts, a.current_attempt_index, a.lease_epoch
FROM exec_core e LEFT JOIN (SELECT execution_id, arg_min(started_at_ms, attempt_index) AS first_started_at_ms, count(*) AS total_attempts, max(attempt_index) AS current_attempt_index, arg_max(lease_epoch, attempt_index) AS lease_epoch FROM attempt GROUP BY execution_id) a ON e.execution_id = a.execution_id""",
)
def read_execution_info(m):
    return R.execution_info(m.exec_core, m.attempt)


@query("execution_point_lookup", "SELECT execution_id, public_state, priority FROM exec_core WHERE execution_id = 42")
def execution_point_lookup(m):
    return m.exec_core.where(F.col("execution_id") == 42).select("execution_id", "public_state", "priority")


@query("list_executions_page", "SELECT execution_id, public_state, lane_id FROM exec_core WHERE partition = 7 AND execution_id > 100 ORDER BY execution_id LIMIT 50")
def list_executions_page(m):
    return R.page(m.exec_core, ["execution_id"], (100,), 50, F.col("partition") == 7).select("execution_id", "public_state", "lane_id")


@query("list_flows_page", "SELECT flow_id, count(*) AS members FROM exec_core WHERE flow_id > 20 GROUP BY flow_id ORDER BY flow_id LIMIT 50")
def list_flows_page(m):
    return R.page(m.exec_core.where("flow_id > 20").groupBy("flow_id").agg(F.count(F.lit(1)).alias("members")), ["flow_id"], None, 50)


@query("list_lanes", "SELECT DISTINCT lane_id FROM exec_core ORDER BY lane_id LIMIT 100")
def list_lanes(m):
    return R.page(m.exec_core.select("lane_id").distinct(), ["lane_id"], None, 100)


@query("list_suspended_page", "SELECT execution_id, suspended_at_ms, blocking_reason FROM exec_core WHERE public_state = 'suspended' AND (suspended_at_ms > 850000000000 OR (suspended_at_ms = 850000000000 AND execution_id > 5)) ORDER BY suspended_at_ms, execution_id LIMIT 100")
def list_suspended_page(m):
    return R.page(m.exec_core, ["suspended_at_ms", "execution_id"], (850_000_000_000, 5), 100, F.col("public_state") == "suspended").select("execution_id", "suspended_at_ms", "blocking_reason")


@query("list_edges_in", "SELECT downstream_eid, edge_id, upstream_eid FROM edge WHERE downstream_eid BETWEEN 100 AND 400")
def list_edges_in(m):
    return m.edge.where(F.col("downstream_eid").between(100, 400)).select("downstream_eid", "edge_id", "upstream_eid")


@query("list_edges_out", "SELECT upstream_eid, edge_id, downstream_eid FROM edge WHERE upstream_eid BETWEEN 100 AND 400")
def list_edges_out(m):
    return m.edge.where(F.col("upstream_eid").between(100, 400)).select("upstream_eid", "edge_id", "downstream_eid")


@query("list_workers_page", "SELECT namespace, worker_instance_id, last_heartbeat_ms FROM worker WHERE last_heartbeat_ms + liveness_ttl_ms >= 915148800000 ORDER BY namespace, worker_instance_id LIMIT 40")
def list_workers_page(m):
    return R.page(m.worker, ["namespace", "worker_instance_id"], None, 40, F.col("last_heartbeat_ms") + F.col("liveness_ttl_ms") >= NOW).select("namespace", "worker_instance_id", "last_heartbeat_ms")


@query(
    "list_expired_leases",
    f"SELECT e.execution_id, e.flow_id, e.lane_id, a.attempt_index, a.worker_id, a.lease_epoch, a.lease_expires_at_ms FROM exec_core e JOIN {LATEST} a ON e.execution_id = a.execution_id WHERE e.lifecycle_phase = 'active' AND a.lease_expires_at_ms <= {NOW} ORDER BY a.lease_expires_at_ms, e.execution_id LIMIT 200",
)
def list_expired_leases(m):
    return R.page(R.expired_leases(m.exec_core, m.attempt, NOW), ["lease_expires_at_ms", "execution_id"], None, 200)


@query("pending_waitpoints_page", "SELECT waitpoint_id, execution_id, sha256(CAST(waitpoint_id AS STRING)) AS token_fingerprint FROM waitpoint WHERE status = 'pending' AND waitpoint_id > 1000 ORDER BY waitpoint_id LIMIT 60")
def pending_waitpoints_page(m):
    return R.page(m.waitpoint, ["waitpoint_id"], (1000,), 60, F.col("status") == "pending").select("waitpoint_id", "execution_id", F.sha2(F.col("waitpoint_id").cast("string"), 256).alias("token_fingerprint"))


@query("tag_lookup", "SELECT execution_id, json_extract_string(raw_fields, '$.tags.\"team.name\"') AS team FROM exec_core WHERE json_extract_string(raw_fields, '$.namespace') = 'ns-1' AND json_extract_string(raw_fields, '$.tags.\"team.name\"') = 't3'")
def tag_lookup(m):
    team = F.get_json_object("raw_fields", "$.tags['team.name']")
    return m.exec_core.where(X.filter_matches(F.get_json_object("raw_fields", "$.namespace"), team, "ns-1", "t3")).select("execution_id", team.alias("team"))


@query("exec_core_fields", "SELECT execution_id, public_state AS f_public_state, CAST(priority AS STRING) AS f_priority, CAST(terminal_at_ms AS STRING) AS f_terminal_at_ms FROM exec_core")
def exec_core_fields(m):
    f = R.fields(m.exec_core, ["public_state", "priority", "terminal_at_ms"])
    return f.select("execution_id", *[F.col("fields")[n].alias(f"f_{n}") for n in ("public_state", "priority", "terminal_at_ms")])


@query(
    "derived_public_state",
    """SELECT execution_id, CASE WHEN lifecycle_phase = 'terminal' THEN CASE terminal_outcome WHEN 'success' THEN 'completed' ELSE terminal_outcome END WHEN lifecycle_phase IN ('suspended', 'active') THEN lifecycle_phase
  WHEN eligibility_state = 'not_eligible_until_time' THEN 'delayed' WHEN eligibility_state IN ('blocked_by_budget', 'blocked_by_quota') THEN 'rate_limited' WHEN eligibility_state = 'blocked_by_dependencies' THEN 'waiting_children' ELSE 'waiting' END AS derived, public_state FROM exec_core""",
)
def derived_public_state(m):
    return m.exec_core.select("execution_id", X.derive_public_state(F.col("lifecycle_phase"), F.col("eligibility_state"), F.col("terminal_outcome")).alias("derived"), "public_state")


@query("derived_terminal_outcome", "SELECT execution_id, CASE WHEN public_state = 'completed' THEN 'success' WHEN public_state IN ('failed', 'cancelled', 'expired', 'skipped') THEN public_state ELSE 'none' END AS outcome FROM exec_core")
def derived_terminal_outcome(m):
    return m.exec_core.select("execution_id", X.terminal_outcome(F.col("public_state")).alias("outcome"))


@query(
    "normalised_state",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'waiting' WHEN 'error' THEN 'failed' ELSE event_type END AS state FROM events",
)
def normalised_state(m):
    raw = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return m.events.select("event_id", X.normalised(raw).alias("state"))


@query("tag_key_valid", "SELECT c_custkey, regexp_matches(lower(c_mktsegment) || '.' || c_name, '^[a-z][a-z0-9_]*[.]') AS ok, length(c_name) BETWEEN 1 AND 64 AND NOT regexp_matches(c_name, '[ \\t\\n]') AS lane_ok FROM customer")
def tag_key_valid(m):
    return m.customer.select("c_custkey", X.tag_key_ok(F.concat(F.lower("c_mktsegment"), F.lit("."), "c_name")).alias("ok"), X.lane_ok(F.col("c_name")).alias("lane_ok"))


@query("siblings", "SELECT g.downstream_eid, g.upstream_eid, e.public_state FROM edge g JOIN exec_core e ON g.upstream_eid = e.execution_id WHERE e.lifecycle_phase <> 'terminal'")
def siblings(m):
    return R.siblings(m.edge, m.exec_core)


@query("worker_upsert", "SELECT worker_instance_id, max(last_heartbeat_ms) AS last_heartbeat_ms FROM (SELECT worker_instance_id, last_heartbeat_ms FROM worker UNION ALL SELECT worker_id, max(started_at_ms) FROM attempt GROUP BY worker_id) u GROUP BY worker_instance_id")
def worker_upsert(m):
    beats = m.attempt.groupBy(F.col("worker_id").alias("worker_instance_id")).agg(F.max("started_at_ms").alias("last_heartbeat_ms"))
    return R.upsert(m.worker.select("worker_instance_id", "last_heartbeat_ms"), beats, "worker_instance_id", "last_heartbeat_ms")


@query("insert_new_flows", "SELECT flow_id, min(created_at_ms) AS created_at_ms FROM exec_core WHERE flow_id NOT IN (SELECT DISTINCT flow_id FROM edge WHERE flow_id IS NOT NULL) GROUP BY flow_id")
def insert_new_flows(m):
    return R.insert_new(m.edge.select("flow_id").distinct(), m.exec_core.select("flow_id", "created_at_ms"), "flow_id", "created_at_ms")


@query("select_or_default", "SELECT flow_id, CAST(coalesce(n, 0) AS BIGINT) AS edges FROM (SELECT DISTINCT flow_id FROM exec_core) f LEFT JOIN (SELECT flow_id, count(*) AS n FROM edge GROUP BY flow_id) e USING (flow_id)")
def select_or_default(m):
    return R.select_or_default(m.exec_core.select("flow_id").distinct(), m.edge.groupBy("flow_id").agg(F.count(F.lit(1)).alias("edges")), "flow_id", edges=0)


@query("budget_status", "SELECT p.budget_id, p.hard_limit, p.soft_limit, coalesce(u.used, 0) AS used, u.dims FROM budget_policy p LEFT JOIN (SELECT budget_id, sum(delta)::BIGINT AS used, count(DISTINCT dim) AS dims FROM usage GROUP BY budget_id) u ON p.budget_id = u.budget_id")
def budget_status(m):
    used = m.usage.groupBy("budget_id").agg(F.sum("delta").alias("used"), F.count_distinct("dim").alias("dims"))
    return m.budget_policy.join(used, "budget_id", "left").select("budget_id", "hard_limit", "soft_limit", F.coalesce("used", F.lit(0)).alias("used"), "dims")


@query("hmac_active_kid", f"SELECT arg_max(kid, rotated_at_ms) AS kid, max(rotated_at_ms) AS rotated_at_ms FROM hmac_kid WHERE active")
def hmac_active_kid(m):
    return m.hmac_kid.where("active").agg(F.max_by("kid", "rotated_at_ms").alias("kid"), F.max("rotated_at_ms").alias("rotated_at_ms"))


@query("hmac_kids", f"SELECT kid, expires_at_ms FROM hmac_kid WHERE expires_at_ms > {NOW}")
def hmac_kids(m):
    return m.hmac_kid.where(F.col("expires_at_ms") > NOW).select("kid", "expires_at_ms")


@query("outbox_tail_cursor", "SELECT namespace, coalesce(max(event_id), 0) AS tail FROM completion GROUP BY namespace")
def outbox_tail_cursor(m):
    return m.completion.groupBy("namespace").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("tail"))


@query("completion_replay", "SELECT event_id, execution_id, outcome FROM completion WHERE event_id > 3000 AND namespace = 'ns-1' ORDER BY event_id LIMIT 256")
def completion_replay(m):
    return R.page(m.completion, ["event_id"], (3000,), 256, X.filter_matches(F.col("namespace"), F.lit(None), "ns-1")).select("event_id", "execution_id", "outcome")
