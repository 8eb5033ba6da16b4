"""Dependency graphs: edge groups, eligibility, cascades, cycles, levels, cancellation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deepest cascade that one sweep follows, and most nodes that one cycle check visits (fixed values).
MAX_CASCADE, MAX_VISITED = 50, 1000


def group_counts(edge: DataFrame, outcome: DataFrame) -> DataFrame:
    """n, success, fail, skip and running of each downstream's edge group."""
    state = outcome.select(F.col("execution_id").alias("upstream_eid"), "terminal_outcome")
    t = F.coalesce("terminal_outcome", F.lit("none"))
    return (
        edge.join(state, "upstream_eid", "left")
        .groupBy("flow_id", "downstream_eid")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(t == "success").alias("success"),
            F.count_if(t.isin("failed", "cancelled", "expired")).alias("fail"),
            F.count_if(t == "skipped").alias("skip"),
            F.count_if(t == "none").alias("running"),
        )
    )


def group_state(kind: Column, k: Column, n: Column, success: Column, bad: Column) -> Column:
    """all_of: every edge succeeds; any_of: one; quorum: k.  Impossible once that can't come true."""
    need = F.when(kind == "all_of", n).when(kind == "any_of", F.lit(1)).otherwise(k)
    return F.when(success >= need, "satisfied").when(bad > n - need, "impossible").otherwise("pending")


def decisions(edge: DataFrame, policy: DataFrame, outcome: DataFrame) -> DataFrame:
    """State of each edge group, and whether its running siblings are to be cancelled."""
    rows = group_counts(edge, outcome).join(policy.select("downstream_eid", "kind", "k", "on_satisfied"), "downstream_eid")
    state = group_state(F.col("kind"), F.col("k"), F.col("n"), F.col("success"), F.col("fail") + F.col("skip"))
    rows = rows.withColumn("state", state)
    cancel = (F.col("state") != "pending") & (F.col("kind") != "all_of") & (F.col("on_satisfied") == "cancel_remaining") & (F.col("running") > 0)
    return rows.withColumn("cancel_siblings", cancel)


def sibling_cancels(edge: DataFrame, decided: DataFrame, executions: DataFrame) -> DataFrame:
    """Members to cancel: running upstreams of settled groups that cancel the rest."""
    groups = decided.where("cancel_siblings").select("downstream_eid", "state")
    live = executions.where("lifecycle_phase <> 'terminal'").select(F.col("execution_id").alias("upstream_eid"))
    reason = F.when(F.col("state") == "satisfied", "sibling_quorum_satisfied").otherwise("sibling_quorum_impossible")
    return edge.join(groups, "downstream_eid").join(live, "upstream_eid").select("downstream_eid", "upstream_eid", reason.alias("reason"))


def sibling_reconcile(edge: DataFrame, decided: DataFrame, executions: DataFrame) -> DataFrame:
    """Of groups with cancels pending: drain once all members ended, else nothing to do."""
    ended = edge.join(executions.select(F.col("execution_id").alias("upstream_eid"), "lifecycle_phase"), "upstream_eid").groupBy("downstream_eid").agg(F.bool_and(F.col("lifecycle_phase") == "terminal").alias("ended"))
    rows = decided.where("state <> 'pending' AND kind <> 'all_of' AND on_satisfied = 'cancel_remaining'").select("downstream_eid", "state")
    return rows.join(ended, "downstream_eid").select("downstream_eid", F.when(F.col("ended"), "drained").otherwise("no_op").alias("action"))


def flow_eligibility(executions: DataFrame, edge: DataFrame) -> DataFrame:
    """Why an execution may or may not run."""
    ups = edge.join(executions.select(F.col("execution_id").alias("upstream_eid"), F.col("terminal_outcome").alias("up")), "upstream_eid", "left").groupBy(F.col("downstream_eid").alias("execution_id")).agg(
        F.count_if(F.col("up").isin("failed", "cancelled", "expired", "skipped")).alias("impossible"), F.count_if(F.coalesce("up", F.lit("none")) != "success").alias("unsatisfied")
    )
    rows = executions.select("execution_id", "lifecycle_phase", "ownership_state").join(ups, "execution_id", "left")
    status = (
        F.when(F.col("lifecycle_phase") != "runnable", "not_runnable")
        .when(F.col("ownership_state") != "unowned", "owned")
        .when(F.coalesce("impossible", F.lit(0)) > 0, "impossible")
        .when(F.coalesce("unsatisfied", F.lit(0)) > 0, "blocked_by_dependencies")
        .otherwise("eligible")
    )
    return rows.select("execution_id", status.alias("status"))


def skip_cascade(edge: DataFrame, policy: DataFrame, outcome: DataFrame, depth: int | None = None) -> DataFrame:
    """Executions that end skipped because their edge group can't be satisfied, to the fixed point,
    or for ``depth`` rounds: then what lies deeper is left for the next call.

    One pass over the edges counts the groups of executions that haven't ended.  It keeps a row of
    each group that is impossible, and of groups that are pending the edges from executions that
    haven't ended, the only ones that pass a skip on.  These are dealt out by upstream once, so a round
    moves the nodes skipped in the round before and what they add to their groups; a group is in the
    round's result when that makes it impossible."""
    from tidefold.operators.store import dealt, stored

    t = F.col("terminal_outcome")
    ends = F.when(t == "none", 0).when(t == "success", 1).when(t.isin("failed", "cancelled", "expired", "skipped"), 2).cast("byte")
    ups = outcome.select(F.col("execution_id").alias("upstream_eid"), ends.alias("up"))
    waits = outcome.where("terminal_outcome = 'none'").select(F.col("execution_id").alias("downstream_eid")).distinct()
    # all_of needs more than any k; a group of several policies has several rows, each edge then counts for each of them
    every = 1 << 40
    rules = policy.select("downstream_eid", F.when(F.col("kind") == "all_of", every).when(F.col("kind") == "any_of", 1).otherwise(F.col("k")).cast("long").alias("need")).distinct()
    rows = edge.select("flow_id", "upstream_eid", "downstream_eid").join(ups, "upstream_eid", "left").join(waits, "downstream_eid", "left_semi")
    # the joins before and after are by downstream, so the counts move nothing
    group = Window.partitionBy("downstream_eid", "flow_id")
    counts = {"n": F.count(F.lit(1)), "good": F.count_if(F.col("up") == 1), "bad": F.count_if(F.col("up") == 2), "least": F.min("upstream_eid")}
    rows = rows.withColumns({c: f.over(group) for c, f in counts.items()}).join(rules, "downstream_eid")
    # spare: how many more bad upstreams a group bears
    rows = rows.withColumn("all", F.when(F.col("need") == every, F.col("n")).otherwise(F.col("need"))).where("good < all").withColumn("spare", F.col("n") - F.col("all") - F.col("bad"))
    rows = rows.where("IF(spare < 0, upstream_eid <=> least, up = 0)")
    passing = dealt(rows.select("flow_id", "upstream_eid", "downstream_eid", "need", "spare"), "upstream_eid")

    def at(rows, level):
        return stored(rows.select(F.col("downstream_eid").alias("execution_id"), F.lit(level).alias("level")).distinct())

    new = at(passing.where("spare < 0"), 1)
    skipped, hurt = new, None
    for level in itertools.count(2) if depth is None else range(2, depth + 1):
        if new.isEmpty():
            break
        keys = ["flow_id", "downstream_eid", "need", "spare"]
        # the hint keeps the dealt edges where they are, unsorted; new nodes are distinct
        more = passing.where("spare >= 0").join(new.select(F.col("execution_id").alias("upstream_eid")).hint("shuffle_hash"), "upstream_eid", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("bad"))
        if hurt is not None:
            more = more.unionByName(hurt).groupBy(*keys).agg(F.sum("bad").alias("bad"))
        hurt = stored(more)
        # what is skipped for good leaves; a node of several groups is skipped once
        doomed = hurt.where("bad > spare")
        new = at(doomed.join(skipped.select(F.col("execution_id").alias("downstream_eid")), "downstream_eid", "left_anti"), level)
        hurt = hurt.where("bad <= spare")
        skipped = skipped.unionByName(new)
        if level % 8 == 0:
            skipped = stored(skipped)
    return skipped


def levels(edge: DataFrame) -> DataFrame:
    """Longest distance of each node from a root, by Kahn's algorithm: a round settles the nodes all
    of whose upstreams are settled, and writes only these and the nodes that still miss some.  Each
    edge carries how many its downstream has.  Nodes on a cycle that a root reaches, or beyond it,
    have no longest distance and are left out; what no root reaches counts for nothing."""
    from tidefold.operators.store import dealt, stored

    steps = edge.select("upstream_eid", "downstream_eid").where("upstream_eid IS NOT NULL AND downstream_eid IS NOT NULL")
    roots = stored(steps.select("upstream_eid").distinct().join(steps.select(F.col("downstream_eid").alias("upstream_eid")).distinct(), "upstream_eid", "left_anti").select(F.col("upstream_eid").alias("execution_id"), F.lit(0).alias("level")))

    def settled(steps):
        counted = dealt(steps.join(steps.groupBy("downstream_eid").agg(F.count(F.lit(1)).alias("n")), "downstream_eid"), "upstream_eid")
        at, done, missing, level = roots, roots, None, 0
        while not at.isEmpty():
            level += 1
            found = counted.join(at.select(F.col("execution_id").alias("upstream_eid")).hint("shuffle_hash"), "upstream_eid").groupBy("downstream_eid", "n").agg(F.count(F.lit(1)).alias("got"))
            if missing is not None:
                found = found.unionByName(missing).groupBy("downstream_eid", "n").agg(F.sum("got").alias("got"))
            found = stored(found)
            at = found.where("got = n").select(F.col("downstream_eid").alias("execution_id"), F.lit(level).alias("level"))
            missing = found.where("got < n")
            done = done.unionByName(at)
            if level % 8 == 0:
                done = stored(done)
        return stored(done)

    done = settled(steps)
    if steps.join(done.select(F.col("execution_id").alias("upstream_eid")), "upstream_eid", "left_anti").isEmpty():
        return done
    # a cycle: edges from nodes that no root reaches hold nothing back
    at = reached = roots.select("execution_id")
    while not at.isEmpty():
        below = at.select(F.col("execution_id").alias("upstream_eid")).join(steps, "upstream_eid").select(F.col("downstream_eid").alias("execution_id")).distinct()
        at = stored(below.join(reached, "execution_id", "left_anti"))
        reached = stored(reached.unionByName(at))
    return settled(stored(steps.join(reached.select(F.col("execution_id").alias("upstream_eid")), "upstream_eid", "left_semi")))


def unsettled(edge: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """Candidates but those that can't close a cycle or pass the bound, as their flow tells: it shares
    no node with another flow, has ``most`` nodes at most, and all its edges lead to greater ids, while
    the candidate leads to a greater id too.  Such a walk would stay above its goal and within the flow."""
    rising = F.coalesce(F.col("flow_id").isNotNull() & (F.col("upstream_eid") < F.col("downstream_eid")), F.lit(False))
    ends = edge.select(F.explode(F.array("upstream_eid", "downstream_eid")).alias("node"), "flow_id", rising.alias("rising"))
    nodes = ends.groupBy("node").agg(F.min("flow_id").alias("flow_id"), F.max("flow_id").alias("last"), F.bool_and("rising").alias("rising"))
    shared = ends.select("node", "flow_id").join(nodes.where("flow_id < last").select("node"), "node", "left_semi").select("flow_id").distinct()
    flows = nodes.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("rising").alias("rising")).where(F.col("rising") & (F.col("n") <= most)).join(shared, "flow_id", "left_anti")
    up = candidates.where("upstream_eid < downstream_eid").join(nodes.select(F.col("node").alias("downstream_eid"), "flow_id"), "downstream_eid").join(flows.select("flow_id"), "flow_id", "left_semi")
    return candidates.join(up.select("edge_id"), "edge_id", "left_anti")


def would_cycle(edge: DataFrame, candidates: DataFrame, most: int = MAX_VISITED) -> DataFrame:
    """Candidate edges (edge_id, upstream_eid, downstream_eid) that would close a cycle: those from
    whose downstream the upstream can be reached.  Self loops count.  One that visits more than
    ``most`` nodes without an answer is rejected too.

    Where edges have a flow_id, only candidates that are ``unsettled`` by it walk.  All walk at once,
    and each leaves the walk once it has its answer or has passed the bound, so what is kept of one is bounded by ``most`` nodes and the neighbours of the last ones.
    A round writes only the nodes that are new in it, each with its walk's count and whether that
    has met its goal, so walks that ended are told without a join."""
    from tidefold.operators.store import stored

    steps = edge.select(F.col("upstream_eid").alias("node"), F.col("downstream_eid").alias("next"))
    every = candidates
    if "flow_id" in edge.columns:
        candidates = unsettled(edge, candidates, most)
    walk = Window.partitionBy("edge_id")

    def reached(rows):
        ended = F.coalesce(F.max(F.col("node") == F.col("goal")).over(walk), F.lit(False)) | (F.col("visited") > most)
        return stored(rows.withColumn("visited", F.col("visited") + F.count(F.lit(1)).over(walk)).withColumn("ended", ended))

    front = reached(candidates.select("edge_id", F.col("upstream_eid").alias("goal"), F.col("downstream_eid").alias("node"), F.lit(0).cast("long").alias("visited")))
    seen, rejected, level = front.select("edge_id", "node"), None, 0
    while not front.isEmpty():
        level += 1
        ended = front.where("ended").select("edge_id")
        rejected = ended if rejected is None else rejected.unionByName(ended)
        on = front.where("NOT ended")
        if on.isEmpty():
            break
        near = on.join(steps, "node").select("edge_id", "goal", F.col("next").alias("node"), "visited").distinct()
        front = reached(near.join(seen, ["edge_id", "node"], "left_anti").select("edge_id", "goal", "node", "visited"))
        seen = seen.unionByName(front.select("edge_id", "node"))
        if level % 4 == 0:
            seen, rejected = stored(seen.join(front.select("edge_id").distinct(), "edge_id", "left_semi")), stored(rejected.distinct())
    return every.where("false").select("edge_id", "upstream_eid", "downstream_eid") if rejected is None else every.join(rejected, "edge_id", "left_semi").select("edge_id", "upstream_eid", "downstream_eid")


def staged(edge: DataFrame, candidates: DataFrame, executions: DataFrame) -> DataFrame:
    """What staging each candidate edge answers: ok, or the first check that it fails."""
    members = executions.select(F.col("execution_id").alias("downstream_eid"), F.lit(True).alias("member"))
    there = edge.select("upstream_eid", "downstream_eid", F.lit(True).alias("there")).distinct()
    cycles = would_cycle(edge, candidates).select("edge_id", F.lit(True).alias("cycle"))
    rows = candidates.join(members, "downstream_eid", "left").join(there, ["upstream_eid", "downstream_eid"], "left").join(cycles, "edge_id", "left")
    status = (
        F.when(F.col("upstream_eid") == F.col("downstream_eid"), "self_referencing_edge")
        .when(F.col("member").isNull(), "execution_not_in_flow")
        .when(F.col("there"), "dependency_already_exists")
        .when(F.col("cycle"), "cycle_detected")
        .otherwise("ok")
    )
    return rows.select("edge_id", "upstream_eid", "downstream_eid", status.alias("status"))


def cancel_members(executions: DataFrame, flows: DataFrame) -> DataFrame:
    """Commands of a flow's cancellation: cancel_all reaches every live member, cancel_pending only
    those not yet active, flow_only none."""
    live = executions.where("lifecycle_phase <> 'terminal'").join(flows, "flow_id")
    hit = (F.col("policy") == "cancel_all") | ((F.col("policy") == "cancel_pending") & (F.col("lifecycle_phase") == "runnable"))
    return live.where(hit).select("flow_id", "execution_id", F.lit("flow_cancelled").alias("reason"))


def data_passing(edge: DataFrame, results: DataFrame) -> DataFrame:
    """Inputs of each downstream: its upstreams' results by edge."""
    rows = edge.join(results.select(F.col("execution_id").alias("upstream_eid"), "result"), "upstream_eid")
    return rows.groupBy("downstream_eid").agg(F.sort_array(F.collect_list(F.struct("edge_id", "result"))).alias("inputs"))


def edge_degree(edge: DataFrame) -> DataFrame:
    """Nodes, edges and the graph's revision (a change per staged edge and member) of each flow."""
    ends = edge.select("flow_id", "edge_id", F.explode(F.array("upstream_eid", "downstream_eid")).alias("node"))
    return ends.groupBy("flow_id").agg(F.count_distinct("node").alias("nodes"), F.count_distinct("edge_id").alias("edges")).withColumn("graph_revision", F.col("nodes") + F.col("edges"))
