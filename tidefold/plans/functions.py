"""Scalar functions, filters and validations over the model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import exprs as E
from tidefold.operators import dag as D
from tidefold.operators.store import stored
from tidefold.plans.dag import CANDIDATES
from tidefold.plans.registry import query


@query("scanner_filter", """SELECT execution_id FROM exec_core WHERE (raw_fields::JSON->>'$.namespace') = 'ns-1' AND (raw_fields::JSON->'tags'->>'team.name') = 't3'""")
def scanner_filter(m):
    tag = F.get_json_object("raw_fields", "$.tags['team.name']")
    return m.exec_core.where(E.filter_matches(F.get_json_object("raw_fields", "$.namespace"), tag, "ns-1", "t3")).select("execution_id")


@query("execution_id_parts", "SELECT execution_id, partition AS parsed, '{fp:' || CAST(partition AS VARCHAR) || '}:' || CAST(execution_id AS VARCHAR) AS id FROM exec_core")
def execution_id_parts(m):
    rows = m.exec_core.select("execution_id", F.format_string("{fp:%d}:%d", "partition", "execution_id").alias("id"))
    return rows.select("execution_id", E.partition_of(F.col("id")).alias("parsed"), "id")


@query("cursor_parts", "SELECT event_id, event_id * 1000 AS ts_ms, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END AS seq FROM events")
def cursor_parts(m):
    text = F.when(F.col("event_id") % 2 == 0, F.concat_ws("-", (F.col("event_id") * 1000).cast("string"), (F.col("event_id") % 7).cast("string"))).otherwise((F.col("event_id") * 1000).cast("string"))
    return m.events.withColumn("c", E.cursor(text)).select("event_id", "c.ts_ms", "c.seq")


@query("lane_names", "SELECT execution_id, execution_id % 3 = 0 AS valid FROM exec_core")
def lane_names(m):
    shown = F.when(F.col("execution_id") % 3 == 0, F.col("lane_id")).when(F.col("execution_id") % 3 == 1, F.concat("lane_id", F.lit(" x"))).otherwise(F.repeat(F.lit("l"), 65))
    return m.exec_core.select("execution_id", E.lane_ok(shown).alias("valid"))


@query("capability_csv", "SELECT worker_instance_id, list_sort(list_distinct(list_filter(list_transform(string_split(array_to_string(capabilities, ' , ,') || ',x, x', ','), lambda t: trim(t)), lambda t: t <> ''))) AS tokens FROM worker")
def capability_csv(m):
    return m.worker.select("worker_instance_id", E.csv_tokens(F.concat(F.array_join("capabilities", " , ,"), F.lit(",x, x"))).alias("tokens"))


@query("grant_ids", "SELECT execution_id, sha256('grant:' || CAST(execution_id AS VARCHAR)) AS grant_id FROM exec_core")
def grant_ids(m):
    return m.exec_core.select("execution_id", E.grant_id(F.concat(F.lit("grant:"), F.col("execution_id").cast("string"))).alias("grant_id"))


@query("key_partitions")
def key_partitions(m):
    """CRC32 modulo the partitions; DuckDB has no CRC, so tests hold it to zlib."""
    return m.exec_core.select("execution_id", E.hash_partition(F.col("lane_id"), 256).alias("partition"))


@query(
    "tags_set",
    """SELECT execution_id, CASE WHEN execution_id % 5 = 0 THEN 'new' ELSE raw_fields::JSON->'tags'->>'team.name' END AS team, CASE WHEN execution_id % 5 = 1 THEN 'added' END AS extra FROM exec_core""",
)
def tags_set(m):
    tags = F.from_json(F.get_json_object("raw_fields", "$.tags"), "map<string,string>")
    change = F.when(F.col("execution_id") % 5 == 0, F.create_map(F.lit("team.name"), F.lit("new"))).when(F.col("execution_id") % 5 == 1, F.create_map(F.lit("extra.note"), F.lit("added")))
    # the later value of a key wins
    merged = F.when(change.isNull(), tags).otherwise(F.map_concat(F.map_filter(tags, lambda k, _: ~F.map_contains_key(change, k)), change))
    return m.exec_core.select("execution_id", merged.alias("tags")).select("execution_id", F.try_element_at("tags", F.lit("team.name")).alias("team"), F.try_element_at("tags", F.lit("extra.note")).alias("extra"))


@query("execution_states", "SELECT execution_id, public_state, namespace, flow_id, CASE WHEN lifecycle_phase = 'terminal' THEN terminal_outcome END AS result FROM exec_core")
def execution_states(m):
    return m.exec_core.select("execution_id", "public_state", "namespace", "flow_id", F.when(F.col("lifecycle_phase") == "terminal", F.col("terminal_outcome")).alias("result"))


STAGED = f"SELECT edge_id, upstream_eid, downstream_eid FROM ({CANDIDATES}) c UNION ALL SELECT edge_id, upstream_eid, upstream_eid FROM edge WHERE edge_id % 7 = 2 UNION ALL SELECT edge_id, upstream_eid, -1 FROM edge WHERE edge_id % 7 = 3"


@query(
    "stage_edges",
    f"""WITH RECURSIVE c AS ({STAGED}), w(edge_id, node) AS (SELECT edge_id, downstream_eid FROM c UNION SELECT w.edge_id, e.downstream_eid FROM w JOIN edge e ON e.upstream_eid = w.node),
cyc AS (SELECT DISTINCT c.edge_id, c.downstream_eid FROM c JOIN w ON c.edge_id = w.edge_id AND c.upstream_eid = w.node)
SELECT c.edge_id, c.upstream_eid, c.downstream_eid, CASE WHEN c.upstream_eid = c.downstream_eid THEN 'self_referencing_edge' WHEN x.execution_id IS NULL THEN 'execution_not_in_flow' WHEN e.upstream_eid IS NOT NULL THEN 'dependency_already_exists' WHEN y.edge_id IS NOT NULL THEN 'cycle_detected' ELSE 'ok' END AS status
FROM c LEFT JOIN exec_core x ON c.downstream_eid = x.execution_id LEFT JOIN (SELECT DISTINCT upstream_eid, downstream_eid FROM edge) e ON e.upstream_eid = c.upstream_eid AND e.downstream_eid = c.downstream_eid LEFT JOIN cyc y ON y.edge_id = c.edge_id""",
)
def stage_edges(m):
    edge = stored(m.edge)
    staged = m.spark.sql(STAGED.replace("FROM edge", "FROM {edge}"), edge=edge)
    return D.staged(edge, staged, m.exec_core)


@query("resolved_flows", "SELECT flow_id, count(*) AS members, min(created_at_ms) AS created_at_ms FROM exec_core GROUP BY flow_id")
def resolved_flows(m):
    return m.exec_core.groupBy("flow_id").agg(F.count(F.lit(1)).alias("members"), F.min("created_at_ms").alias("created_at_ms"))
