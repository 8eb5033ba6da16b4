"""The execution state machine by example."""

import pytest

from tidefold.operators.execution import PARTS, step


def run(*commands):
    state, out = None, []
    for i, c in enumerate(commands):
        state, (row,) = step(state, {"execution_id": 1, "seq": i, "now_ms": i} | c)
        out.append(row)
    return state, [r["status"] for r in out], out


CREATE, CLAIM = {"kind": "create"}, {"kind": "claim", "lease_id": "l", "ttl_ms": 100}


def fence(kind, epoch=1, attempt=0, **more):
    return {"kind": kind, "lease_id": "l", "lease_epoch": epoch, "attempt_index": attempt} | more


def test_every_part_is_always_set():
    _, _, rows = run(CREATE, CLAIM, fence("complete"))
    assert all(r[p] for r in rows for p in PARTS)
    assert [r["public_state"] for r in rows] == ["waiting", "active", "completed"]


def test_create_is_idempotent_and_clamps_priority():
    s, said, _ = run(CREATE | {"priority": 99_999}, CREATE)
    assert said == ["ok", "duplicate"] and s["priority"] == 9000


def test_delayed_until_due():
    _, said, rows = run(CREATE | {"delay_until": 50}, CLAIM, {"kind": "promote", "now_ms": 49}, {"kind": "promote", "now_ms": 50}, CLAIM)
    assert said == ["ok", "execution_not_eligible", "not_due", "ok", "ok"] and rows[0]["public_state"] == "delayed"


@pytest.mark.parametrize(
    ("command", "status"),
    [
        (fence("complete", epoch=2), "stale_lease"),
        (fence("complete", attempt=1), "stale_lease"),
        ({"kind": "complete"}, "fence_required"),
        ({"kind": "complete", "lease_id": "l"}, "partial_fence_triple"),
        (fence("complete", now_ms=1000), "lease_expired"),
        ({"kind": "complete", "source": "operator_override"}, "ok"),
        ({"kind": "nonsense"}, "unknown_command"),
        ({"kind": "resume"}, "execution_not_suspended"),
    ],
)
def test_fencing(command, status):
    assert run(CREATE, CLAIM, command)[1][-1] == status


def test_retries_then_failure():
    fail = {"max_retries": 1, "backoff": "exponential", "backoff_ms": 10}
    s, said, rows = run(CREATE, CLAIM, fence("fail", **fail), {"kind": "promote", "now_ms": 20}, CLAIM | {"now_ms": 21}, fence("fail", 2, 1, now_ms=22, **fail))
    assert set(said) == {"ok"} and rows[2]["public_state"] == "delayed" and s["public_state"] == "failed" and s["attempt_type"] == "retry"


def test_reclaim_up_to_the_cap():
    s, said, _ = run(CREATE, CLAIM, {"kind": "expire_lease", "now_ms": 500}, {"kind": "reclaim", "max_reclaims": 1}, {"kind": "revoke"}, {"kind": "reclaim", "max_reclaims": 1})
    assert set(said) == {"ok"} and (s["public_state"], s["reason"], s["lease_epoch"]) == ("failed", "max_retries_exhausted", 2)


@pytest.mark.parametrize(("how", "state"), [("fail", "failed"), ("cancel", "cancelled"), ("expire", "expired"), ("escalate", "suspended"), ("auto_resume_with_timeout_signal", "waiting")])
def test_suspension_timeouts(how, state):
    s, said, _ = run(CREATE, CLAIM, fence("suspend", timeout_at=10, timeout_behavior=how), {"kind": "suspension_timeout", "now_ms": 10})
    assert set(said) == {"ok"} and s["public_state"] == state


def test_resume_keeps_the_attempt():
    s, said, _ = run(CREATE, CLAIM, fence("suspend"), {"kind": "resume"}, CLAIM, {"kind": "claim_resumed", "lease_id": "l"})
    assert said[-2:] == ["use_claim_resumed_execution", "ok"] and (s["attempt_index"], s["lease_epoch"]) == (0, 2)


def test_dependencies():
    add, done = {"kind": "apply_dependency"}, {"kind": "dependency", "outcome": "success"}
    _, _, rows = run(CREATE, add, add, done, done)
    assert [r["public_state"] for r in rows] == ["waiting", "waiting_children", "waiting_children", "waiting_children", "waiting"]
    s, _, _ = run(CREATE, add, done | {"outcome": "failed"})
    assert s["public_state"] == "skipped"
    s, said, _ = run(CREATE, add, done | {"outcome": "failed"}, {"kind": "replay"})
    assert said[-1] == "ok" and s["public_state"] == "waiting_children"


def test_blocking():
    _, said, rows = run(CREATE, {"kind": "block", "reason": "waiting_for_quota"}, {"kind": "unblock", "reason": "waiting_for_budget"}, {"kind": "unblock", "reason": "waiting_for_quota"})
    assert said == ["ok", "ok", "blocking_reason_mismatch", "ok"] and rows[1]["public_state"] == "rate_limited"


def test_nothing_happens_before_creation():
    assert run(CLAIM)[1] == ["execution_not_found"]


def test_last_states_and_counts_are_those_of_all_answers(spark):
    from collections import Counter

    from tidefold.operators import execution, folds
    from tidefold.plans.folds import POLICY, command_log, execution_answers, execution_replay
    from tidefold.sources.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    log = command_log(m)
    assert not set(POLICY) & set(log.columns)  # what all commands share isn't shuffled with each
    every = folds.fold(log, "execution_id", ["seq"], lambda s, c: execution.step(s, POLICY | c), execution.RESULT).collect()
    assert {(r["kind"], r["status"]): r["commands"] for r in execution_answers(m).collect()} == Counter((r["kind"], r["status"]) for r in every)
    final = {r["execution_id"]: r for r in sorted(every, key=lambda r: r["seq"])}
    assert {r["execution_id"]: tuple(r)[1:] for r in execution_replay(m).collect()} == {k: (r["public_state"], r["attempt_index"] + 1, r["retry_count"]) for k, r in final.items()}
    # a log that nothing creates ends in nulls
    lost = log.where("execution_id = 1 AND kind <> 'create'")
    assert {tuple(r) for r in folds.fold(lost, "execution_id", ["seq"], execution.last_step(POLICY), execution.LAST, execution.last).collect()} == {(1, None, None, None)}
