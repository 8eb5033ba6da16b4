"""Scheduling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import exprs as X
from tidefold.operators import scheduling as S
from tidefold.plans.registry import query

ELIGIBLE = "lifecycle_phase = 'runnable' AND ownership_state = 'unowned' AND eligibility_state = 'eligible_now'"
RANK = f"(SELECT *, row_number() OVER (PARTITION BY lane_id ORDER BY priority DESC, created_at_ms, execution_id) AS rank FROM exec_core WHERE {ELIGIBLE})"
#: A worker has all that an execution requires.
FITS = "len(list_filter(e.required_capabilities, lambda c: NOT list_contains(w.capabilities, c))) = 0"


@query("eligible_rank", f"SELECT execution_id, lane_id, CAST(rank AS INT) AS rank FROM {RANK} r")
def eligible_rank(m):
    return S.ranked(m.exec_core, "lane_id").select("execution_id", "lane_id", "rank")


@query("claim_topk", f"SELECT lane_id, execution_id, CAST(rank AS INT) AS rank FROM {RANK} r WHERE rank <= 10")
def claim_topk(m):
    return S.heads(m.exec_core, 10, "lane_id").select("lane_id", "execution_id", "rank")


@query("claim_for_worker", f"SELECT w.worker_instance_id, arg_min(e.execution_id, e.rank) AS execution_id, CAST(min(e.rank) AS INT) AS rank FROM {RANK} e JOIN worker w ON e.lane_id = w.lane_id AND {FITS} WHERE e.rank <= 10 GROUP BY w.worker_instance_id")
def claim_for_worker(m):
    return S.claims(m.exec_core, m.worker)


@query("capability_match", f"SELECT e.execution_id, count(*) AS workers FROM exec_core e JOIN worker w ON e.lane_id = w.lane_id AND {FITS} WHERE {ELIGIBLE} GROUP BY e.execution_id")
def capability_match(m):
    return S.capable_counts(S.eligible(m.exec_core), m.worker)


@query("missing_capabilities", "SELECT execution_id, array_to_string(list_sort(list_filter(required_capabilities, lambda c: NOT list_contains(['gpu', 'eu'], c))), ',') AS missing FROM exec_core")
def missing_capabilities(m):
    return m.exec_core.select("execution_id", X.missing(F.col("required_capabilities"), F.array(F.lit("gpu"), F.lit("eu"))).alias("missing"))


@query("capability_subset", "SELECT execution_id, len(list_filter(required_capabilities, lambda c: NOT list_contains(['gpu', 'eu'], c))) = 0 AS fits, array_to_string(required_capabilities, ',') AS csv FROM exec_core")
def capability_subset(m):
    return m.exec_core.select("execution_id", X.has_all(F.col("required_capabilities"), F.array(F.lit("gpu"), F.lit("eu"))).alias("fits"), F.array_join("required_capabilities", ",").alias("csv"))


@query("worker_caps_union", "SELECT namespace, string_agg(DISTINCT c, ',' ORDER BY c) AS capabilities FROM (SELECT namespace, unnest(capabilities) AS c FROM worker) u GROUP BY namespace")
def worker_caps_union(m):
    return S.caps_union(m.worker)


@query("lane_depth", f"SELECT lane_id, count(*) AS depth, count(*) FILTER (WHERE {ELIGIBLE}) AS eligible, min(created_at_ms) FILTER (WHERE {ELIGIBLE}) AS oldest_ms FROM exec_core GROUP BY lane_id")
def lane_depth(m):
    ok = F.expr(ELIGIBLE)
    return m.exec_core.groupBy("lane_id").agg(F.count(F.lit(1)).alias("depth"), F.count_if(ok).alias("eligible"), F.min(F.when(ok, F.col("created_at_ms"))).alias("oldest_ms"))


@query(
    "partition_fairness",
    f"SELECT partition, execution_id, CAST((partition - 100 + 256) % 256 AS INT) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY priority DESC, created_at_ms, execution_id) AS rank FROM exec_core WHERE {ELIGIBLE}) r WHERE rank = 1 ORDER BY turn LIMIT 32",
)
def partition_fairness(m):
    return S.fair_scan(m.exec_core, 256, 100, 32).select("partition", "execution_id", "turn")


@query("priority_clamp", "SELECT execution_id, CAST(least(greatest(priority * 3 - 4000, 0), 9000) AS INT) AS priority FROM exec_core")
def priority_clamp(m):
    return m.exec_core.select("execution_id", X.clamp_priority(F.col("priority") * 3 - 4000).alias("priority"))


@query("retry_backoff_schedule", "SELECT execution_id, retry_count, CAST(least(floor(1000 * pow(2.0, retry_count)), 60000) AS BIGINT) AS delay_ms FROM exec_core WHERE public_state = 'failed'")
def retry_backoff_schedule(m):
    return m.exec_core.where("public_state = 'failed'").select("execution_id", "retry_count", X.backoff_ms(F.lit("exponential"), F.col("retry_count")).alias("delay_ms"))


@query("lease_renewal_deadline", "SELECT execution_id, attempt_index, started_at_ms + CAST(floor((lease_expires_at_ms - started_at_ms) * 2 / 3) AS BIGINT) AS renew_by_ms, row_number() OVER (PARTITION BY execution_id ORDER BY attempt_index) AS claims FROM attempt")
def lease_renewal_deadline(m):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("execution_id").orderBy("attempt_index")).cast("long")
    return m.attempt.select("execution_id", "attempt_index", X.renewal_deadline(F.col("started_at_ms"), F.col("lease_expires_at_ms") - F.col("started_at_ms")).alias("renew_by_ms"), nth.alias("claims"))


@query("claim_grants", f"SELECT execution_id, sha256('grant:' || CAST(execution_id AS STRING)) AS grant_id, created_at_ms + 30000 AS expires_at_ms FROM {RANK} r WHERE rank = 1")
def claim_grants(m):
    return S.heads(m.exec_core, 1, "lane_id").select("execution_id", X.grant_id(F.concat(F.lit("grant:"), F.col("execution_id").cast("string"))).alias("grant_id"), (F.col("created_at_ms") + 30000).alias("expires_at_ms"))
