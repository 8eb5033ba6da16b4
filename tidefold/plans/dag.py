"""Dependency graphs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.operators import dag as D
from tidefold.operators.store import stored
from tidefold.plans.registry import query

BAD = "terminal_outcome IN ('failed', 'cancelled', 'expired')"


def decided(edges: str = "edge", outcomes: str = "exec_core") -> str:
    return f"""SELECT g.*, p.kind, p.k, p.on_satisfied, CASE WHEN success >= need THEN 'satisfied' WHEN fail + skip > n - need THEN 'impossible' ELSE 'pending' END AS state
FROM (SELECT flow_id, downstream_eid, count(*) AS n, count(*) FILTER (WHERE terminal_outcome = 'success') AS success, count(*) FILTER (WHERE {BAD}) AS fail, count(*) FILTER (WHERE terminal_outcome = 'skipped') AS skip, count(*) FILTER (WHERE coalesce(terminal_outcome, 'none') = 'none') AS running
  FROM (SELECT e.flow_id, e.downstream_eid, o.terminal_outcome FROM {edges} e LEFT JOIN {outcomes} o ON e.upstream_eid = o.execution_id) x GROUP BY flow_id, downstream_eid) g
JOIN (SELECT *, CASE kind WHEN 'any_of' THEN 1 ELSE k END AS base FROM edge_policy) p ON g.downstream_eid = p.downstream_eid, LATERAL (SELECT CASE WHEN p.kind = 'all_of' THEN g.n ELSE p.base END AS need) l"""


CANCELS = "state <> 'pending' AND kind <> 'all_of' AND on_satisfied = 'cancel_remaining'"


@query("edge_group_decision", f"SELECT flow_id, downstream_eid, n, success, fail, skip, running, kind, state, {CANCELS} AND running > 0 AS cancel_siblings FROM ({decided()}) d")
def edge_group_decision(m):
    return D.decisions(m.edge, m.edge_policy, m.exec_core).select("flow_id", "downstream_eid", "n", "success", "fail", "skip", "running", "kind", "state", "cancel_siblings")


@query("flow_edge_groups", f"SELECT flow_id, state, count(*) AS groups, CAST(sum(n) AS BIGINT) AS edges FROM ({decided()}) d GROUP BY flow_id, state")
def flow_edge_groups(m):
    return D.decisions(m.edge, m.edge_policy, m.exec_core).groupBy("flow_id", "state").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("edges"))


@query("sibling_cancel_members", f"SELECT d.downstream_eid, e.upstream_eid, CASE d.state WHEN 'satisfied' THEN 'sibling_quorum_satisfied' ELSE 'sibling_quorum_impossible' END AS reason FROM ({decided()}) d JOIN edge e ON d.downstream_eid = e.downstream_eid JOIN exec_core x ON e.upstream_eid = x.execution_id WHERE {CANCELS} AND d.running > 0 AND x.lifecycle_phase <> 'terminal'")
def sibling_cancel_members(m):
    return D.sibling_cancels(m.edge, D.decisions(m.edge, m.edge_policy, m.exec_core), m.exec_core)


@query("sibling_cancel_reconcile", f"SELECT d.downstream_eid, CASE WHEN d.running = 0 THEN 'drained' ELSE 'no_op' END AS action FROM ({decided()}) d WHERE {CANCELS}")
def sibling_cancel_reconcile(m):
    return D.sibling_reconcile(m.edge, D.decisions(m.edge, m.edge_policy, m.exec_core), m.exec_core)


@query(
    "flow_eligibility",
    """SELECT e.execution_id, CASE WHEN lifecycle_phase <> 'runnable' THEN 'not_runnable' WHEN ownership_state <> 'unowned' THEN 'owned' WHEN coalesce(u.impossible, 0) > 0 THEN 'impossible' WHEN coalesce(u.unsatisfied, 0) > 0 THEN 'blocked_by_dependencies' ELSE 'eligible' END AS status
FROM exec_core e LEFT JOIN (SELECT g.downstream_eid, sum(CASE WHEN x.terminal_outcome IN ('failed', 'cancelled', 'expired', 'skipped') THEN 1 ELSE 0 END) AS impossible, sum(CASE WHEN coalesce(x.terminal_outcome, 'none') <> 'success' THEN 1 ELSE 0 END) AS unsatisfied FROM edge g LEFT JOIN exec_core x ON g.upstream_eid = x.execution_id GROUP BY g.downstream_eid) u ON e.execution_id = u.downstream_eid""",
)
def flow_eligibility(m):
    return D.flow_eligibility(m.exec_core, m.edge)


#: Only all_of groups, where one bad upstream is enough, so plain reachability is the oracle.
@query(
    "skip_cascade",
    """WITH RECURSIVE s(execution_id, level) AS (
  SELECT DISTINCT g.downstream_eid, 1 FROM edge g JOIN exec_core u ON g.upstream_eid = u.execution_id JOIN exec_core d ON g.downstream_eid = d.execution_id WHERE u.terminal_outcome IN ('failed', 'cancelled', 'expired', 'skipped') AND d.terminal_outcome = 'none'
  UNION SELECT g.downstream_eid, s.level + 1 FROM s JOIN edge g ON g.upstream_eid = s.execution_id JOIN exec_core d ON g.downstream_eid = d.execution_id WHERE d.terminal_outcome = 'none' AND s.level < 50)
SELECT execution_id, CAST(min(level) AS INT) AS level FROM s GROUP BY execution_id""",
)
def skip_cascade(m):
    return D.skip_cascade(m.edge, m.edge_policy.withColumn("kind", F.lit("all_of")), m.exec_core, D.MAX_CASCADE)


@query("skip_cascade_mixed")
def skip_cascade_mixed(m):
    return D.skip_cascade(m.edge, m.edge_policy, m.exec_core, D.MAX_CASCADE)


@query(
    "topo_levels",
    "WITH RECURSIVE l(execution_id, level) AS (SELECT DISTINCT upstream_eid, 0 FROM edge WHERE upstream_eid NOT IN (SELECT downstream_eid FROM edge) UNION SELECT e.downstream_eid, l.level + 1 FROM l JOIN edge e ON e.upstream_eid = l.execution_id) SELECT execution_id, CAST(max(level) AS INT) AS level FROM l GROUP BY execution_id",
)
def topo_levels(m):
    return D.levels(stored(m.edge))


#: Every seventh edge reversed, as candidates: all close a cycle; so do self loops.
CANDIDATES = "SELECT edge_id, downstream_eid AS upstream_eid, upstream_eid AS downstream_eid FROM edge WHERE edge_id % 7 = 0 UNION ALL SELECT -edge_id, upstream_eid, downstream_eid FROM edge WHERE edge_id % 7 = 1"


@query(
    "cycle_check",
    f"""WITH RECURSIVE c AS ({CANDIDATES}), w(edge_id, node) AS (SELECT edge_id, downstream_eid FROM c UNION SELECT w.edge_id, e.downstream_eid FROM w JOIN edge e ON e.upstream_eid = w.node)
SELECT DISTINCT c.edge_id, c.upstream_eid, c.downstream_eid FROM c JOIN w ON c.edge_id = w.edge_id AND c.upstream_eid = w.node""",
)
def cycle_check(m):
    edge = stored(m.edge)
    back = edge.where("edge_id % 7 = 0").select("edge_id", F.col("downstream_eid").alias("upstream_eid"), F.col("upstream_eid").alias("downstream_eid"))
    forth = edge.where("edge_id % 7 = 1").select((-F.col("edge_id")).alias("edge_id"), "upstream_eid", "downstream_eid")
    return D.would_cycle(edge, back.unionByName(forth))


FLOWS = "SELECT DISTINCT flow_id, CASE flow_id % 3 WHEN 0 THEN 'cancel_all' WHEN 1 THEN 'cancel_pending' ELSE 'flow_only' END AS policy FROM exec_core WHERE flow_id % 5 = 0"


@query("cancel_flow_members", f"SELECT e.flow_id, e.execution_id, 'flow_cancelled' AS reason FROM exec_core e JOIN ({FLOWS}) f ON e.flow_id = f.flow_id WHERE e.lifecycle_phase <> 'terminal' AND (f.policy = 'cancel_all' OR (f.policy = 'cancel_pending' AND e.lifecycle_phase = 'runnable'))")
def cancel_flow_members(m):
    executions = m.exec_core
    return D.cancel_members(executions, m.spark.sql(FLOWS.replace("exec_core", "{exec_core}"), exec_core=executions))


@query("data_passing", "SELECT e.downstream_eid, string_agg(CAST(e.edge_id AS STRING) || '=' || x.terminal_outcome, ',' ORDER BY e.edge_id) AS inputs FROM edge e JOIN exec_core x ON e.upstream_eid = x.execution_id WHERE x.lifecycle_phase = 'terminal' GROUP BY e.downstream_eid")
def data_passing(m):
    results = m.exec_core.where("lifecycle_phase = 'terminal'").select("execution_id", F.col("terminal_outcome").alias("result"))
    rows = D.data_passing(m.edge, results)
    return rows.select("downstream_eid", F.array_join(F.transform("inputs", lambda i: F.concat_ws("=", i["edge_id"], i["result"])), ",").alias("inputs"))


@query("graph_counts", "SELECT flow_id, count(DISTINCT node) AS nodes, count(DISTINCT edge_id) AS edges, count(DISTINCT node) + count(DISTINCT edge_id) AS graph_revision FROM (SELECT flow_id, edge_id, upstream_eid AS node FROM edge UNION ALL SELECT flow_id, edge_id, downstream_eid FROM edge) x GROUP BY flow_id")
def graph_counts(m):
    return D.edge_degree(m.edge)
