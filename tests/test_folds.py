"""Folds by example: budgets, quotas, signals, frame summaries, bounds."""

import pytest

from tidefold.operators import folds, frames, signals, windows


def run(step, log, finish=None):
    state, rows = None, []
    for c in log:
        state, more = step(state, c)
        rows += more
    return finish(0, state) if finish else rows


def spend(seq, delta, key=None):
    return {"budget_id": 1, "seq": seq, "delta": delta, "dedup_key": key, "hard_limit": 100, "soft_limit": 60, "now_ms": seq}


def test_budget_statuses():
    rows = run(folds.budget_step, [spend(1, 50, "a"), spend(2, 50, "a"), spend(3, 20, "b"), spend(4, 31, "c"), spend(5, 30, "c")])
    assert [(r["status"], r["used"]) for r in rows] == [("ok", 50), ("already_applied", 50), ("soft_breach", 70), ("hard_breach", 70), ("soft_breach", 100)]


def report(now, key=None, **deltas):
    hard, soft = {"tokens": 100, "calls": 3}, {"tokens": 60, "calls": None}
    return {"budget_id": 1, "seq": now, "now_ms": now, "dedup_key": key, "dims": list(deltas), "deltas": list(deltas.values()), "hard": [hard.get(d) for d in deltas], "soft": [soft.get(d) for d in deltas]}


def test_budget_by_dimension():
    log = [report(0, "a", tokens=50, calls=1), report(5, "a", tokens=50, calls=1), report(6, "b", calls=1, tokens=51), report(7, "b", calls=1, tokens=20, free=9), report(10, "a", tokens=1, calls=1), report(11, "c", tokens=1, calls=1), report(12, "a", tokens=1)]
    rows = run(folds.budget_dims_step(10), log)
    # all or nothing; a key is known for ten milliseconds after it was accepted, and not at the tenth
    assert [(r["status"], r["dim"], r["used"]) for r in rows] == [
        ("ok", None, 51), ("already_applied", None, 51), ("hard_breach", "tokens", 51), ("soft_breach", "tokens", 81),
        ("soft_breach", "tokens", 83), ("hard_breach", "calls", 83), ("already_applied", None, 83),
    ]


def test_budget_forgets_old_keys():
    step, state = folds.budget_dims_step(10), None
    for i in range(1000):
        state, _ = step(state, report(i, str(i), free=1))
    assert len(state["seen"]) <= 11


def test_ledger_floor_and_reset():
    kinds = [("spend", 1, 40), ("spend", 2, 30), ("reset", None, 0), ("spend", 2, 10), ("release", 1, 0), ("release", 2, 0)]
    (end,) = run(folds.ledger_step, [{"kind": k, "execution_id": e, "delta": d} for k, e, d in kinds], folds.ledger_end)
    assert end == {"budget_id": 0, "used": 0, "open_ledgers": 0, "resets": 1}


def call(e, now):
    return {"policy_id": 1, "execution_id": e, "now_ms": now, "seq": now}


def test_quota():
    step = folds.quota_step(60_000, 2)
    rows = run(step, [call("a", 0), call("a", 10), call("b", 20), call("c", 30), call("c", 60_000)])
    assert [r["status"] for r in rows] == ["admitted", "already_admitted", "admitted", "rate_exceeded", "admitted"]
    assert rows[3]["retry_after_ms"] == 59_970


def test_quota_against_plain_lists():
    import random

    rng, times, guards, now = random.Random(3), [], {}, 0
    state, step = None, folds.quota_step(50, 5)
    for _ in range(3000):
        now += rng.randrange(-3, 8)
        c = call(rng.randrange(30), now)
        times, guards = [t for t in times if t > now - 50], {e: t for e, t in guards.items() if t > now}
        want = "already_admitted" if c["execution_id"] in guards else "rate_exceeded" if len(times) >= 5 else "admitted"
        if want == "admitted":
            times.append(now)
            guards[c["execution_id"]] = now + 50
        state, (row,) = step(state, c)
        assert row["status"] == want and (want != "rate_exceeded" or row["retry_after_ms"] == min(times) + 50 - now)


def test_quota_concurrency():
    rows = run(folds.quota_step(60_000, 10, cap=2), [call(e, i) for i, e in enumerate("abc")])
    assert [r["status"] for r in rows] == ["admitted", "admitted", "concurrency_exceeded"]


def deliver(i, name="go", source="s", waitpoint=1, key=None):
    return {"execution_id": 1, "signal_id": i, "signal_name": name, "source_identity": source, "waitpoint_id": waitpoint, "idempotency_key": key}


@pytest.mark.parametrize(
    ("condition", "log", "statuses"),
    [
        ({"count": 1, "kind": "signals"}, [deliver(1), deliver(2)], ["resumed", "waitpoint_closed"]),
        ({"count": 2, "kind": "sources"}, [deliver(1), deliver(2), deliver(3, source="t")], ["accepted", "accepted", "resumed"]),
        ({"count": 2, "kind": "waitpoints"}, [deliver(1), deliver(2, waitpoint=2)], ["accepted", "resumed"]),
        ({"count": 2, "kind": "signals"}, [deliver(1, key="k"), deliver(2, key="k"), deliver(3)], ["accepted", "duplicate", "resumed"]),
        ({"count": 1, "kind": "signals", "names": ["stop"]}, [deliver(1), deliver(2, "stop")], ["accepted", "resumed"]),
        ({"all": [{"count": 1, "kind": "signals", "waitpoints": [w]} for w in (1, 2, 3)]}, [deliver(1, waitpoint=w) for w in (1, 2, 2, 3)], ["accepted", "accepted", "accepted", "resumed"]),
        ({"mode": "any", "names": ["stop", "halt"]}, [deliver(1), deliver(2, "halt")], ["accepted", "resumed"]),
        ({"mode": "all", "names": ["go", "stop"]}, [deliver(1), deliver(2), deliver(3, "stop")], ["accepted", "accepted", "resumed"]),
        ({"mode": "all", "names": ["go", "go"]}, [deliver(1), deliver(2)], ["accepted", "resumed"]),
        ({"mode": "count", "names": ["a", "b", "c"], "minimum": 2}, [deliver(1, "a"), deliver(2, "a"), deliver(3, "c")], ["accepted", "accepted", "resumed"]),
        ({"mode": "any", "names": []}, [deliver(1, "whatever")], ["resumed"]),
        ({"mode": "some"}, [deliver(1)], ["unknown_mode"]),
        ({"count": 0, "kind": "signals"}, [deliver(1)], ["count_below_one"]),
        ({"all": []}, [deliver(1)], ["empty_all"]),
        ({"all": [{"all": [{"all": [{"all": [{"count": 1, "kind": "signals"}]}]}]}]}, [deliver(1)], ["condition_too_deep"]),
    ],
)
def test_conditions(condition, log, statuses):
    assert [r["status"] for r in run(signals.signal_step(condition), log)] == statuses


def test_summary_versions_and_null_sentinel():
    patches = ['{"a": 1, "b": {"c": 2, "d": 3}}', '{"b": {"c": null}, "e": "__null__"}', '{"a": null}']
    (end,) = run(frames.summary_step, [{"patch": p} for p in patches], frames.summary_end)
    assert end["version"] == 3 and end["document"] == '{"b":{"d":3},"e":null}'


def test_frame_bound_stays_between_floor_and_ceiling():
    step = frames.ema_step(60_000)
    burst = run(step, [{"execution_id": 1, "seq": i, "ts_ms": i} for i in range(2000)])
    idle = run(step, [{"execution_id": 1, "seq": i, "ts_ms": i * 600_000} for i in range(20)])
    assert burst[0]["maxlen"] == 64 and burst[-1]["maxlen"] == 16_384 and idle[-1]["maxlen"] == 64


def test_fold_keeps_keys_apart_and_takes_nulls(spark):
    log = spark.createDataFrame([(1, 2, 10, None), (1, 1, 95, None), (None, 1, 5, "x"), (2, 1, 1, "x")], "budget_id long, seq long, delta long, dedup_key string")
    log = log.selectExpr("*", "100L AS hard_limit", "60L AS soft_limit", "7 AS status", "seq AS now_ms")
    rows = {(r["budget_id"], r["seq"]): (r["status"], r["used"]) for r in folds.fold(log, "budget_id", ["now_ms"], folds.budget_step, folds.BUDGET).collect()}
    assert rows == {(1, 1): ("soft_breach", 95), (1, 2): ("hard_breach", 95), (None, 1): ("ok", 5), (2, 1): ("ok", 1)}
    assert folds.fold(log.limit(0), "budget_id", ["now_ms"], folds.budget_step, folds.BUDGET).collect() == []


def test_hmac_matches_the_standard_library(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("hello",), ("",)], "m string").select(windows.hmac_sha1(key, F.col("m")).alias("h")).collect()
        assert [r["h"] for r in got] == [hmac.new(key, m, hashlib.sha1).hexdigest() for m in (b"hello", b"")]


def test_key_partitions_are_crc32(spark):
    import zlib

    from pyspark.sql import functions as F

    from tidefold.functions.exprs import hash_partition

    keys = ["lane-1", "", "\u00fc", None]
    got = [r["p"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(hash_partition(F.col("k"), 256).alias("p")).collect()]
    assert got == [None if k is None else zlib.crc32(k.encode()) % 256 for k in keys]


def test_fold_over_a_join_that_is_read_by_mappers(spark):
    from pyspark.sql import functions as F

    # the join asks for a shuffle by the key and becomes a broadcast at run time, so its shuffle is read by mapper
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        log = spark.range(0, 4000, 1, 4).select((F.col("id") % 5).alias("budget_id"), F.col("id").alias("seq"), F.col("id").alias("now_ms"), F.lit(1).cast("long").alias("delta"), F.lit(None).cast("string").alias("dedup_key"))
        policy = spark.range(5).selectExpr("id AS budget_id", "100000L AS hard_limit", "100000L AS soft_limit").groupBy("budget_id").agg(F.max("hard_limit").alias("hard_limit"), F.max("soft_limit").alias("soft_limit"))
        rows = folds.fold(log.join(policy, "budget_id"), "budget_id", ["now_ms", "seq"], folds.budget_step, folds.BUDGET).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {(r["seq"], r["used"]) for r in rows} == {(i, i // 5 + 1) for i in range(4000)}
