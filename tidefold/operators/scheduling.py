"""Eligible queues, capability matching and claim candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(executions: DataFrame) -> DataFrame:
    return executions.where("lifecycle_phase = 'runnable' AND ownership_state = 'unowned' AND eligibility_state = 'eligible_now'")


#: Highest priority first, then oldest, then the id.
ORDER = (F.desc, "priority"), (F.asc, "created_at_ms"), (F.asc, "execution_id")


def queue_order() -> list[Column]:
    return [f(c) for f, c in ORDER]


def ranked(executions: DataFrame, *by: str) -> DataFrame:
    """Place of each eligible execution in its queue."""
    return eligible(executions).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*queue_order())))


def heads(executions: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` of each queue; the limit is pushed below the shuffle by the window-group limit."""
    return ranked(executions, *by).where(F.col("rank") <= n)


def needs(executions: DataFrame) -> DataFrame:
    return executions.select("execution_id", "lane_id", F.array_sort(F.array_distinct(F.array_remove("required_capabilities", ""))).alias("need"))


def fitting(need: DataFrame, workers: DataFrame) -> DataFrame:
    """(lane_id, need, worker_instance_id) of the workers that have all of a requirement set: an
    equi-join on lane and token, then a count, instead of a nested-loop join.

    Requirements repeat a lot, so it runs over the distinct requirement sets of a lane."""
    sets = need.select("lane_id", "need").distinct()
    have = workers.select("lane_id", "worker_instance_id", F.explode(F.array_distinct("capabilities")).alias("token"))
    some = sets.where(F.size("need") > 0).select("lane_id", "need", F.explode("need").alias("token"))
    full = some.join(have, ["lane_id", "token"]).groupBy("lane_id", "need", "worker_instance_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("need")).drop("n")
    free = sets.where(F.size("need") == 0).join(workers.select("lane_id", "worker_instance_id").distinct(), "lane_id")
    return full.unionByName(free.select(*full.columns))


def capable(executions: DataFrame, workers: DataFrame) -> DataFrame:
    """(execution_id, worker_instance_id) of every pair of a lane where the worker has all that is
    required."""
    need = needs(executions)
    return need.join(fitting(need, workers), ["lane_id", "need"]).select("execution_id", "worker_instance_id")


def capable_counts(executions: DataFrame, workers: DataFrame) -> DataFrame:
    """How many workers fit each execution (none: no row).  Workers are counted per requirement set
    before executions are joined, so no pair of both is ever made."""
    need = needs(executions)
    counts = fitting(need, workers).groupBy("lane_id", "need").agg(F.count(F.lit(1)).alias("workers"))
    return need.join(counts, ["lane_id", "need"]).select("execution_id", "workers")


def claims(executions: DataFrame, workers: DataFrame, overfetch: int = 10) -> DataFrame:
    """For each worker, the first execution among its lane's ``overfetch`` heads that it can run."""
    head = heads(executions, overfetch, "lane_id").select("execution_id", "lane_id", "rank", "required_capabilities")
    pairs = capable(head, workers).join(head.select("execution_id", "rank"), "execution_id")
    return pairs.groupBy("worker_instance_id").agg(F.min_by("execution_id", "rank").alias("execution_id"), F.min("rank").alias("rank"))


def caps_union(workers: DataFrame) -> DataFrame:
    """All capabilities that any worker of a namespace has."""
    tokens = workers.select("namespace", F.explode("capabilities").alias("token")).distinct()
    return tokens.groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("capabilities"))


def fair_scan(executions: DataFrame, partitions: int, start: int, limit: int) -> DataFrame:
    """Heads of up to ``limit`` partitions, from ``start`` on and around: a worker's rotating scan."""
    turn = F.pmod(F.col("partition") - F.lit(start), F.lit(partitions))
    first = heads(executions, 1, "partition").withColumn("turn", turn)
    return first.orderBy("turn").limit(limit)
