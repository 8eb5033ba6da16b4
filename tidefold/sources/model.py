"""The engine's tables, derived from the driver's Parquet by one SQL text per table.

The same text runs in Spark and, for the oracle, in DuckDB; where the dialects differ it names a
macro (MS, CAPS, NOTE) that ``sql`` expands.  Each table is an ordinary DataFrame with the columns
of ``schemas``; any other source with these columns (a lakehouse table, a stream's sink) will do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: 1999-01-01, the "now" of all queries; operators take it as a parameter.
NOW = 915_148_800_000
DAY = 86_400_000

TABLES = {
    "exec_core": """
SELECT e.*,
  CASE WHEN public_state IN ('completed','failed','cancelled','expired','skipped') THEN 'terminal' WHEN public_state = 'active' THEN 'active' WHEN public_state = 'suspended' THEN 'suspended' ELSE 'runnable' END AS lifecycle_phase,
  CASE WHEN public_state = 'active' THEN CASE execution_id % 7 WHEN 0 THEN 'lease_expired_reclaimable' WHEN 1 THEN 'lease_revoked' ELSE 'leased' END ELSE 'unowned' END AS ownership_state,
  CASE public_state WHEN 'waiting' THEN CASE WHEN execution_id % 11 = 0 THEN 'blocked_by_route' ELSE 'eligible_now' END WHEN 'resumable' THEN 'eligible_now' WHEN 'delayed' THEN 'not_eligible_until_time' WHEN 'rate_limited' THEN CASE WHEN execution_id % 3 = 0 THEN 'blocked_by_budget' ELSE 'blocked_by_quota' END WHEN 'waiting_children' THEN 'blocked_by_dependencies' ELSE 'not_applicable' END AS eligibility_state,
  CASE public_state WHEN 'waiting' THEN CASE WHEN execution_id % 11 = 0 THEN 'waiting_for_capable_worker' ELSE 'waiting_for_worker' END WHEN 'resumable' THEN 'waiting_for_worker' WHEN 'delayed' THEN 'waiting_for_delay' WHEN 'rate_limited' THEN CASE WHEN execution_id % 3 = 0 THEN 'waiting_for_budget' ELSE 'waiting_for_quota' END WHEN 'waiting_children' THEN 'waiting_for_children' WHEN 'suspended' THEN 'waiting_for_signal' ELSE 'none' END AS blocking_reason,
  CASE public_state WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'failed' WHEN 'cancelled' THEN 'cancelled' WHEN 'expired' THEN 'expired' WHEN 'skipped' THEN 'skipped' ELSE 'none' END AS terminal_outcome,
  CASE WHEN public_state IN ('completed','failed','cancelled','expired') THEN 'attempt_terminal' WHEN public_state = 'active' THEN CASE WHEN execution_id % 7 < 2 THEN 'attempt_interrupted' ELSE 'running_attempt' END WHEN public_state IN ('suspended','resumable') THEN 'attempt_interrupted' WHEN public_state = 'skipped' THEN 'none' ELSE 'pending_first_attempt' END AS attempt_state,
  CASE WHEN public_state IN ('completed','failed','cancelled','expired','skipped') THEN created_at_ms + (execution_id % 100) * 3600000 END AS terminal_at_ms,
  CASE WHEN public_state = 'delayed' THEN created_at_ms + (execution_id % 1000) * 86400000 END AS delay_until_ms,
  CASE WHEN execution_id % 4 = 0 THEN created_at_ms + (execution_id % 400) * 86400000 END AS deadline_at_ms,
  CASE WHEN public_state = 'suspended' THEN created_at_ms + (execution_id % 50) * 60000 END AS suspended_at_ms
FROM (
  SELECT o_orderkey AS execution_id, o_custkey AS flow_id, 'lane-' || CAST(o_custkey % 4 AS STRING) AS lane_id, CAST(o_custkey % 256 AS INT) AS partition,
    'ns-' || CAST(o_custkey % 3 AS STRING) AS namespace,
    (6 - CAST(substr(o_orderpriority, 1, 1) AS INT)) * 1000 AS priority, MS(o_orderdate) AS created_at_ms,
    CASE o_orderstatus
      WHEN 'F' THEN CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'expired' WHEN 3 THEN 'skipped' ELSE 'completed' END
      WHEN 'O' THEN CASE o_orderkey % 10 WHEN 0 THEN 'delayed' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'waiting_children' WHEN 3 THEN 'suspended' WHEN 4 THEN 'active' WHEN 5 THEN 'active' ELSE 'waiting' END
      ELSE CASE o_orderkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' WHEN 2 THEN 'resumable' ELSE 'completed' END END AS public_state,
    CAPS(o_orderkey) AS required_capabilities,
    '{"namespace":"ns-' || CAST(o_custkey % 3 AS STRING) || '","tags":{"team.name":"t' || CAST(o_orderkey % 7 AS STRING) || '"}}' AS raw_fields,
    CAST(o_orderkey % 13 AS INT) AS retry_count, CAST(o_orderkey % 12 AS INT) AS replay_count
  FROM {orders}) e""",
    "attempt": """
SELECT execution_id, attempt_index, worker_id, lease_epoch, started_at_ms, lease_expires_at_ms, outcome,
  CASE WHEN outcome = 'running' THEN NULL ELSE lease_expires_at_ms END AS ended_at_ms
FROM (SELECT l_orderkey AS execution_id, CAST(l_linenumber - 1 AS INT) AS attempt_index, 'w-' || CAST(min(l_suppkey) AS STRING) AS worker_id, CAST(l_linenumber AS BIGINT) AS lease_epoch,
  max(MS(l_shipdate)) - 86400000 AS started_at_ms, max(MS(l_shipdate)) AS lease_expires_at_ms,
  CASE max(l_returnflag) WHEN 'A' THEN 'ended_success' WHEN 'R' THEN 'ended_failure' ELSE 'running' END AS outcome
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) a""",
    "lease_event": """
SELECT (l_orderkey * 8 + l_linenumber) * 2 AS event_id, l_orderkey AS execution_id, 'acquired' AS event, MS(l_shipdate) - 86400000 AS at_ms FROM {lineitem}
UNION ALL SELECT (l_orderkey * 8 + l_linenumber) * 2 + 1, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'released' WHEN 'R' THEN 'revoked' ELSE 'expired' END, MS(l_shipdate) FROM {lineitem}""",
    "edge": """
SELECT downstream * 4 + k AS edge_id, flow_id, upstream AS upstream_eid, downstream AS downstream_eid
FROM (SELECT o_custkey AS flow_id, o_orderkey AS downstream, 1 AS k, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upstream FROM {orders}
  UNION ALL SELECT o_custkey, o_orderkey, 2, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM {orders}
  UNION ALL SELECT o_custkey, o_orderkey, 3, lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM {orders}) e
WHERE upstream IS NOT NULL AND (downstream + k) % 5 < 3""",
    "edge_policy": """
SELECT o_custkey AS flow_id, o_orderkey AS downstream_eid, CASE o_orderkey % 3 WHEN 0 THEN 'all_of' WHEN 1 THEN 'any_of' ELSE 'quorum' END AS kind, CAST(CASE o_orderkey % 3 WHEN 2 THEN 2 ELSE 1 END AS INT) AS k,
  CASE WHEN o_orderkey % 2 = 0 THEN 'cancel_remaining' ELSE 'let_run' END AS on_satisfied FROM {orders}""",
    "worker": """
SELECT 'w-' || CAST(s_suppkey AS STRING) AS worker_instance_id, n_name AS namespace, 'lane-' || CAST(s_suppkey % 4 AS STRING) AS lane_id, CAPS(s_suppkey * 7) AS capabilities,
  915148800000 - (s_suppkey % 50) * 1000 AS last_heartbeat_ms, CAST(30000 AS BIGINT) AS liveness_ttl_ms
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "usage": """
SELECT user_id AS budget_id, event_type AS dim, CAST(floor(value * 100) AS BIGINT) AS delta, event_id AS seq, MS(ts) AS now_ms, CAST(user_id AS STRING) || ':' || props AS dedup_key, event_id % 20 AS execution_id FROM {events}""",
    "budget_policy": """
SELECT user_id AS budget_id, CAST(150000 + (user_id % 5) * 50000 AS BIGINT) AS hard_limit, CAST(100000 AS BIGINT) AS soft_limit, CAST(CASE WHEN user_id % 2 = 0 THEN 604800000 ELSE 0 END AS BIGINT) AS reset_interval_ms, min(MS(ts)) AS created_at_ms FROM {events} GROUP BY user_id""",
    "quota_op": """
SELECT user_id AS policy_id, event_id AS execution_id, MS(ts) AS now_ms, event_id AS seq FROM {events}""",
    "signal": """
SELECT event_id AS signal_id, user_id AS execution_id, event_type AS signal_name, props AS source_identity, user_id % 3 * 10 + event_id % 3 AS waitpoint_id, MS(ts) AS created_at_ms FROM {events}""",
    "waitpoint": """
SELECT execution_id * 10 + execution_id % 3 AS waitpoint_id, execution_id, CASE WHEN execution_id % 4 = 0 THEN 'closed' ELSE 'pending' END AS status, suspended_at_ms AS created_at_ms, suspended_at_ms + (execution_id % 90) * 86400000 AS timeout_at_ms,
  CASE execution_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'cancel' WHEN 2 THEN 'expire' WHEN 3 THEN 'auto_resume_with_timeout_signal' ELSE 'escalate' END AS timeout_behavior
FROM exec_core WHERE public_state = 'suspended'""",
    "frame": """
SELECT conv_id AS execution_id, 0 AS attempt_index, turn * 1000 AS ts_ms, turn AS arrival, role AS frame_type, text AS payload, CASE turn % 3 WHEN 0 THEN 'durable' WHEN 1 THEN 'summary' ELSE 'best_effort' END AS mode FROM {conversations}""",
    "patch": """
SELECT user_id AS execution_id, event_id AS seq, MS(ts) AS ts_ms, '{"' || event_type || '":' || CASE WHEN event_id % 10 = 0 THEN 'null' ELSE CAST(event_id % 100 AS STRING) END || ',"meta":{"' || substr(event_type, 1, 1) || '":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(event_id % 5 AS STRING) END || '}}' AS patch FROM {events}""",
    "completion": """
SELECT execution_id AS event_id, execution_id, flow_id, terminal_outcome AS outcome, namespace, terminal_at_ms AS occurred_at_ms, terminal_at_ms + 5 AS committed_at_ms, CASE WHEN execution_id % 3 = 0 THEN NULL ELSE terminal_at_ms + 50 END AS dispatched_at_ms FROM exec_core WHERE lifecycle_phase = 'terminal'""",
    "admission": """
SELECT user_id AS policy_id, event_id AS execution_id, MS(ts) AS admitted_at_ms, MS(ts) + 60000 * (event_id % 90) AS expires_at_ms FROM {events}""",
    "cancel_backlog": """
SELECT flow_id, execution_id, NOTE AS policy, created_at_ms AS requested_at_ms, created_at_ms + (execution_id % 600) * 86400000 AS grace_until_ms FROM exec_core WHERE lifecycle_phase <> 'terminal' AND flow_id % 5 = 0""",
    "hmac_kid": """
SELECT 'kid-' || CAST(n_nationkey AS STRING) AS kid, n_nationkey % 4 <> 0 AS active, CAST(n_nationkey AS BIGINT) * 86400000 AS rotated_at_ms, CAST(n_nationkey AS BIGINT) * 86400000 + 915000000000 AS expires_at_ms FROM {nation}""",
}

FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
#: Capabilities of an id: one for each of its four low bits.
NAMES = ("gpu", "large", "eu", "fast")


def sql(text: str, spark: bool) -> str:
    """``text`` in one of the two dialects."""
    bits = [f"CASE WHEN (\\1) % {2 << i} >= {1 << i} THEN '{n}' END" for i, n in enumerate(NAMES)]
    if spark:
        text = re.sub(r"MS\((\w+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", text)
        text = re.sub(r"CAPS\(([^)]*)\)", f"array_compact(array({', '.join(bits)}))", text)
    else:
        text = re.sub(r"MS\((\w+)\)", r"(epoch_us(\1) // 1000)", text)
        text = re.sub(r"CAPS\(([^)]*)\)", f"list_filter([{', '.join(bits)}], lambda x: x IS NOT NULL)", text)
        text = re.sub(r"\{(\w+)\}", r"\1", text).replace("AS STRING", "AS VARCHAR")
    return text.replace("NOTE", "'cancel_all'")


def oracle(text: str) -> str:
    """DuckDB SQL: ``text`` with the model tables that it names put before it."""
    need: list[str] = []

    def add(body: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"\b{name}\b", body):
                add(TABLES[name].replace(f"AS {name}", ""))
                need.append(name)

    add(text)
    ctes = [f"{n} AS ({sql(TABLES[n], False)})" for n in need]
    text = sql(text, False)
    if not ctes:
        return text
    m = re.match(r"\s*WITH( RECURSIVE)?\s", text)
    return f"WITH{m and m[1] or ''} " + ", ".join(ctes) + ("," + text[m.end() - 1 :] if m else text)


class Model:
    """The tables of one folder: ``Model(spark, sf_dir).exec_core`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FILES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in TABLES:
            raise AttributeError(name)
        text = re.sub(r"FROM exec_core", "FROM {exec_core}", sql(TABLES[name], True))
        braces = set(re.findall(r"\{(\w+)\}", text))
        # other braces are JSON in string literals
        text = re.sub(r"\{(?!\w+\})|(?<!\w)\}", lambda m: m[0] * 2, text) if '{"' in text else text
        return self.spark.sql(text, **{b: getattr(self, b) for b in braces})
