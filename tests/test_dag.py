"""Dependency graphs by example."""

from tidefold.operators import dag


def levels(spark, edges):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "edge_id long, upstream_eid long, downstream_eid long")
    return {r["execution_id"]: r["level"] for r in dag.levels(df).collect()}


def test_levels_of_a_deep_graph(spark):
    chain = [(i, i + 1) for i in range(60)]
    assert levels(spark, [*chain, (0, 60), (0, 100), (30, 100)]) == {i: i for i in range(61)} | {100: 31}


def test_levels_with_cycles(spark):
    # 1 -> 2 -> 3 and 7 <-> 8 -> 3, which no root reaches
    assert levels(spark, [(1, 2), (2, 3), (7, 8), (8, 7), (8, 3)]) == {1: 0, 2: 1, 3: 2}
    # the cycle 2 <-> 3 that a root reaches, and 4 beyond it
    assert levels(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (1, 5)]) == {1: 0, 5: 1}
    assert levels(spark, []) == {}


def rejected(spark, edges, candidates, **more):
    edge = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "edge_id long, upstream_eid long, downstream_eid long")
    tried = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(candidates)], edge.schema)
    return sorted(r["edge_id"] for r in dag.would_cycle(edge, tried, **more).collect())


def test_cycles_and_the_bound_of_a_walk(spark):
    chain = [(i, i + 1) for i in range(6)]
    assert rejected(spark, chain, [(6, 0), (0, 6), (3, 3), (5, 2), (9, 0)]) == [0, 2, 3]
    assert rejected(spark, chain, []) == []
    # from 0 seven nodes are visited: no more than seven may be, but six are too few
    assert rejected(spark, chain, [(9, 0)], most=7) == [] and rejected(spark, chain, [(9, 0)], most=6) == [0]
    fan = [(1, i) for i in range(2, 1001)]
    assert rejected(spark, fan, [(5000, 1)]) == [] and rejected(spark, [*fan, (1, 1001)], [(5000, 1)]) == [0]


def test_skip_cascade_beyond_fifty_levels(spark):
    edge = spark.createDataFrame([(1, i, i, i + 1) for i in range(55)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
    policy = spark.createDataFrame([(i + 1, "all_of", 1, "let_run") for i in range(55)], "downstream_eid long, kind string, k int, on_satisfied string")
    outcome = spark.createDataFrame([(i, "none" if i else "failed") for i in range(56)], "execution_id long, terminal_outcome string")
    assert sorted((r["execution_id"], r["level"]) for r in dag.skip_cascade(edge, policy, outcome).collect()) == [(i, i) for i in range(1, 56)]
    assert dag.skip_cascade(edge, policy, outcome, 3).count() == 3


def moved(spark, run):
    """Rows that all shuffles of ``run`` wrote."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for stage, n in total().items() if stage not in before)


def test_rounds_move_new_rows_only(spark):
    chain = [(i, i + 1) for i in range(12)]
    edge = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(chain)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
    policy = edge.selectExpr("downstream_eid", "'all_of' AS kind", "1 AS k", "'let_run' AS on_satisfied")
    outcome = spark.range(13).selectExpr("id AS execution_id", "IF(id = 0, 'failed', 'none') AS terminal_outcome")
    # twelve rounds over twelve edges: 144 rows for each shuffle of all edges in each round
    assert moved(spark, lambda: dag.levels(edge).collect()) < 300
    assert moved(spark, lambda: dag.skip_cascade(edge, policy, outcome).collect()) < 300
    assert moved(spark, lambda: dag.would_cycle(edge, edge.where("edge_id = 0").selectExpr("-1L AS edge_id", "999L AS upstream_eid", "downstream_eid")).collect()) < 300


def test_cascades_and_cycles_against_brute_force(spark):
    import random

    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    flow = {b: rng.choice([1, 2, None]) for _, b in edges}
    policy = {b: (rng.choice(["all_of", "any_of", "quorum"]), 2) for _, b in edges}
    outcome = {i: rng.choice(["none"] * 5 + ["success", "failed", "skipped"]) for i in range(60)}
    edge = spark.createDataFrame([(flow[b], i, a, b) for i, (a, b) in enumerate(edges)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
    rules = spark.createDataFrame([(b, kind, k, "let_run") for b, (kind, k) in policy.items()], "downstream_eid long, kind string, k int, on_satisfied string")
    ends = spark.createDataFrame(list(outcome.items()), "execution_id long, terminal_outcome string")
    want, now, level = {}, dict(outcome), 0
    while True:
        level += 1
        new = []
        for b, (kind, k) in policy.items():
            ups = [now[a] for a, c in edges if c == b]
            need = {"all_of": len(ups), "any_of": 1}.get(kind, k)
            bad = sum(u in ("failed", "cancelled", "expired", "skipped") for u in ups)
            if now[b] == "none" and ups.count("success") < need and bad > len(ups) - need:
                new.append(b)
        if not new:
            break
        want |= dict.fromkeys(new, level)
        now |= dict.fromkeys(new, "skipped")
    assert max(want.values()) > 1
    assert sorted((r["execution_id"], r["level"]) for r in dag.skip_cascade(edge, rules, ends).collect()) == sorted(want.items())

    loops = [*edges, *[(b, a) for a, b in edges[::9]]]
    below = {i: {i} for i in range(60)}
    for _ in range(60):
        below = {i: s.union(*[below[b] for a, b in loops if a in s]) for i, s in below.items()}
    tried = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)]
    assert rejected(spark, loops, tried) == [i for i, (a, b) in enumerate(tried) if a in below[b]]
    assert rejected(spark, loops, tried, most=5) == [i for i, (a, b) in enumerate(tried) if a in below[b] or len(below[b]) > 5]


def test_rounds_leave_the_edges_where_they_are(spark):
    # a chain of six, and 2000 edges that no skip reaches: nothing is small enough to be broadcast
    pairs = [(i, i + 1) for i in range(6)] + [(1000 + i, 2000 + i) for i in range(2000)]
    edge = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(pairs)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
    ends = spark.createDataFrame([(i, "none" if i else "failed") for i in sorted({x for p in pairs for x in p})], "execution_id long, terminal_outcome string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for kind in ("all_of",):
            policy = edge.selectExpr("downstream_eid", f"'{kind}' AS kind", "1 AS k", "'let_run' AS on_satisfied")
            found = []
            assert moved(spark, lambda policy=policy, found=found: found.extend(dag.skip_cascade(edge, policy, ends).collect())) < 25000
            assert sorted((r["execution_id"], r["level"]) for r in found) == [(i, i) for i in range(1, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_flows_that_tell_without_a_walk(spark):
    chain = [(i, i + 1) for i in range(12)]
    edge = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(chain)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
    tried = edge.selectExpr("-edge_id AS edge_id", "upstream_eid", "downstream_eid")
    # walks from each of twelve nodes to the end of the chain move 66 nodes again and again
    assert moved(spark, lambda: dag.would_cycle(edge, tried).collect()) < 140
    assert dag.would_cycle(edge, tried).isEmpty()
    # one node more than the bound has: the walk decides
    assert [r["edge_id"] for r in dag.would_cycle(edge, tried, most=11).orderBy("edge_id").collect()] == [0]


def test_cycles_across_flows_against_brute_force(spark):
    import random

    for seed in (0, 2):
        rng = random.Random(seed)
        # flows of ten nodes; in the second graph some edges lead elsewhere, or down, or have no flow
        edges = [(f, *sorted(rng.sample(range(10 * f, 10 * f + 10), 2))) for f in range(6) for _ in range(9)]
        edges += [(rng.randrange(6), *sorted(rng.sample(range(60), 2))) for _ in range(4 if seed else 0)]
        edges += [(rng.choice([2, None]), 27, 22), (None, 55, 51), (4, None, 41), (3, 30, None)] if seed == 2 else []
        edge = spark.createDataFrame([(f, i, a, b) for i, (f, a, b) in enumerate(edges)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
        tried = [(rng.randrange(60), rng.randrange(60)) for _ in range(60)] + [(a, b) for _, a, b in edges if a and b][::3]
        below = {i: {i} for i in range(60)}
        for _ in range(60):
            below = {i: s.union(*[below.get(b, set()) | {b} for _, a, b in edges if a in s]) - {None} for i, s in below.items()}
        more = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(tried)], "edge_id long, upstream_eid long, downstream_eid long")
        for most in (1000, 4):
            got = sorted(r["edge_id"] for r in dag.would_cycle(edge, more, most).collect())
            assert got == [i for i, (a, b) in enumerate(tried) if a in below[b] or len(below[b]) > most], (seed, most)


def test_cascades_of_groups_with_several_policies(spark):
    edge = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 2, 3), (2, 3, 2, 3), (1, 4, 3, 4), (1, 5, 3, 4), (1, 6, 9, 4), (1, 7, 4, 5)], "flow_id long, edge_id long, upstream_eid long, downstream_eid long")
    rules = [(3, "quorum", 3), (3, "any_of", 1), (3, "quorum", 1), (4, "quorum", 2), (4, "all_of", 1), (4, "all_of", 7), (5, "quorum", None), (5, "any_of", None)]
    policy = spark.createDataFrame([(d, kind, k, "let_run") for d, kind, k in rules], "downstream_eid long, kind string, k int, on_satisfied string")
    outcome = spark.createDataFrame([(i, "none") for i in range(1, 6)] + [(9, None)], "execution_id long, terminal_outcome string")
    # three of two edges can never be had, so 3 is skipped without a bad upstream
    assert sorted((r["execution_id"], r["level"]) for r in dag.skip_cascade(edge, policy, outcome).collect()) == [(3, 1), (4, 2), (5, 3)]
