"""The execution state machine: one ``step`` over an execution's commands.

A command is a dict with ``kind``, ``now_ms`` and whatever its kind reads (absent: None); the state
is a dict of the seven-part vector and counters.  A refused command changes nothing and answers an
error code.  ``vector`` sets of each transition are listed together in ``VECTORS``.
"""

from __future__ import annotations

from collections import Counter

PARTS = ("lifecycle_phase", "ownership_state", "eligibility_state", "blocking_reason", "terminal_outcome", "attempt_state", "public_state")
#: New vectors, in the order of PARTS; None keeps a part (fixed values).
VECTORS = {
    "eligible": ("runnable", "unowned", "eligible_now", "waiting_for_worker", "none", None, "waiting"),
    "delayed": ("runnable", "unowned", "not_eligible_until_time", "waiting_for_delay", "none", None, "delayed"),
    "backoff": ("runnable", "unowned", "not_eligible_until_time", "waiting_for_retry_backoff", "none", "pending_retry_attempt", "delayed"),
    "children": ("runnable", "unowned", "blocked_by_dependencies", "waiting_for_children", "none", None, "waiting_children"),
    "active": ("active", "leased", "not_applicable", "none", "none", "running_attempt", "active"),
    "lease_expired": ("active", "lease_expired_reclaimable", None, None, "none", "attempt_interrupted", "active"),
    "lease_revoked": ("active", "lease_revoked", None, "waiting_for_worker", "none", "attempt_interrupted", "active"),
    "suspended": ("suspended", "unowned", "not_applicable", "waiting_for_signal", "none", "attempt_interrupted", "suspended"),
    "escalated": ("suspended", "unowned", "not_applicable", "paused_by_operator", "none", "attempt_interrupted", "suspended"),
    "resume_delay": ("runnable", "unowned", "not_eligible_until_time", "waiting_for_resume_delay", "none", "attempt_interrupted", "delayed"),
    "completed": ("terminal", "unowned", "not_applicable", "none", "success", "attempt_terminal", "completed"),
    "failed": ("terminal", "unowned", "not_applicable", "none", "failed", "attempt_terminal", "failed"),
    "cancelled": ("terminal", "unowned", "not_applicable", "none", "cancelled", "attempt_terminal", "cancelled"),
    "expired": ("terminal", "unowned", "not_applicable", "none", "expired", "attempt_terminal", "expired"),
    "skipped": ("terminal", "unowned", "not_applicable", "none", "skipped", "none", "skipped"),
}
#: Why an execution is kept from its queue: reason to eligibility (fixed values).
BLOCKS = {"waiting_for_budget": "blocked_by_budget", "waiting_for_quota": "blocked_by_quota", "waiting_for_capable_worker": "blocked_by_route", "paused_by_operator": "blocked_by_operator", "paused_by_policy": "blocked_by_lane_state"}
SUSPEND_REASONS = {"signal": "waiting_for_signal", "approval": "waiting_for_approval", "callback": "waiting_for_callback", "tool_result": "waiting_for_tool_result", "operator": "paused_by_operator"}
TIMEOUTS = {"fail": "failed", "cancel": "cancelled", "expire": "expired"}
#: Caps where a command names none (fixed values).
MAX_RECLAIMS, MAX_REPLAYS, MAX_PRIORITY = 100, 10, 9000


class Refused(Exception):
    pass


def need(ok: bool, code: str) -> None:
    if not ok:
        raise Refused(code)


#: What each of VECTORS changes.
CHANGES = {name: {p: v for p, v in zip(PARTS, vector, strict=True) if v is not None} for name, vector in VECTORS.items()}


def become(s: dict, name: str, **more) -> None:
    s.update(CHANGES[name])
    s.update(more)


def leased(s: dict, c: dict, override: bool = False) -> None:
    """Fencing: all of the lease's id, epoch and attempt must be named and match, and it must run."""
    given = (c.get("lease_id") is not None) + (c.get("lease_epoch") is not None) + (c.get("attempt_index") is not None)
    need(given in (0, 3), "partial_fence_triple")
    if not given:
        need(override and c.get("source") == "operator_override", "fence_required")
        return
    need(s["lifecycle_phase"] == "active", "execution_not_active")
    need(s["ownership_state"] != "lease_revoked", "lease_revoked")
    if s["ownership_state"] != "leased" or s["lease_expires_at"] <= c["now_ms"]:
        if s["ownership_state"] == "leased":
            become(s, "lease_expired")
        raise Refused("lease_expired")
    need((c["lease_id"], c["lease_epoch"], c["attempt_index"]) == (s["lease_id"], s["lease_epoch"], s["attempt_index"]), "stale_lease")


def take(s: dict, c: dict) -> None:
    """A new lease: epoch up by one."""
    s.update(lease_id=c.get("lease_id"), lease_epoch=s["lease_epoch"] + 1, lease_expires_at=c["now_ms"] + (c.get("ttl_ms") or 30_000), worker_id=c.get("worker_id"))


NEW = dict.fromkeys(("lease_id", "worker_id", "lease_expires_at", "delay_until", "suspension_id", "timeout_at", "timeout_behavior", "started_at", "terminal_at", "reason"))
NEW |= {"attempt_index": -1, "attempts": 0, "attempt_type": None, "lease_epoch": 0, "retry_count": 0, "reclaim_count": 0, "replay_count": 0, "unsatisfied": 0, "impossible": 0, "priority": 0, "created_at": None}
NEW |= dict.fromkeys(PARTS, "")


def create(c: dict) -> dict:
    s = NEW | {"priority": max(0, min(MAX_PRIORITY, c.get("priority") or 0)), "created_at": c["now_ms"]}
    until = c.get("delay_until")
    become(s, "delayed" if until and until > c["now_ms"] else "eligible", attempt_state="pending_first_attempt", delay_until=until)
    return s


def end(s: dict, c: dict, how: str, reason: str | None = None) -> None:
    had = s["attempts"] > 0
    state = s["attempt_state"]
    become(s, how, terminal_at=c["now_ms"], reason=reason, suspension_id=None, timeout_at=None)
    if how == "skipped":
        s["attempt_state"] = "attempt_terminal" if state == "running_attempt" else "none"
    elif not had:
        s["attempt_state"] = state


def claim(s, c):
    need(s["lifecycle_phase"] == "runnable", "execution_not_leaseable")
    need(s["ownership_state"] == "unowned", "lease_conflict")
    need(s["eligibility_state"] == "eligible_now", "execution_not_eligible")
    need(s["attempt_state"] != "running_attempt", "active_attempt_exists")
    need(s["attempt_state"] != "attempt_interrupted", "use_claim_resumed_execution")
    kind = {"pending_retry_attempt": "retry", "pending_replay_attempt": "replay"}.get(s["attempt_state"], "initial")
    s.update(attempt_index=s["attempts"], attempts=s["attempts"] + 1, attempt_type=kind, started_at=s["started_at"] or c["now_ms"])
    take(s, c)
    become(s, "active")


def claim_resumed(s, c):
    need(s["lifecycle_phase"] == "runnable" and s["attempt_state"] == "attempt_interrupted", "not_a_resumed_execution")
    need(s["eligibility_state"] == "eligible_now", "execution_not_eligible")
    take(s, c)
    become(s, "active")


def renew(s, c):
    leased(s, c)
    s["lease_expires_at"] = c["now_ms"] + (c.get("ttl_ms") or 30_000)


def progress(s, c):
    leased(s, c)
    s["reason"] = c.get("reason")


def complete(s, c):
    leased(s, c, True)
    need(s["lifecycle_phase"] == "active", "execution_not_active")
    end(s, c, "completed")


def fail(s, c):
    leased(s, c, True)
    need(s["lifecycle_phase"] == "active", "execution_not_active")
    if s["retry_count"] < (c.get("max_retries") or 0):
        base, most = c.get("backoff_ms") or 1000, c.get("max_backoff_ms") or 60_000
        wait = min(int(base * 2.0 ** s["retry_count"]), most) if c.get("backoff") == "exponential" else base
        s["retry_count"] += 1
        become(s, "backoff", delay_until=c["now_ms"] + wait, reason=c.get("reason"))
    else:
        end(s, c, "failed", c.get("reason"))


def cancel(s, c):
    need(s["lifecycle_phase"] != "terminal", "execution_not_active")
    if s["lifecycle_phase"] == "active" and c.get("source") != "operator_override":
        leased(s, c)
    end(s, c, "cancelled", c.get("reason"))


def delay(s, c):
    leased(s, c)
    become(s, "delayed", attempt_state="attempt_interrupted", delay_until=c.get("delay_until"))


def wait_children(s, c):
    leased(s, c)
    become(s, "children", attempt_state="attempt_interrupted")


def promote(s, c):
    need(s["eligibility_state"] == "not_eligible_until_time", "not_delayed")
    need(s["delay_until"] is not None and s["delay_until"] <= c["now_ms"], "not_due")
    become(s, "eligible", delay_until=None)


def expire_lease(s, c):
    need(s["lifecycle_phase"] == "active" and s["ownership_state"] == "leased", "not_leased")
    need(s["lease_expires_at"] <= c["now_ms"], "not_due")
    become(s, "lease_expired")


def revoke(s, c):
    need(s["lifecycle_phase"] == "active" and s["ownership_state"] == "leased", "no_active_lease")
    need(c.get("lease_id") in (None, s["lease_id"]), "stale_lease")
    become(s, "lease_revoked", reason=c.get("reason"))


def reclaim(s, c):
    need(s["lifecycle_phase"] == "active" and s["ownership_state"] in ("lease_expired_reclaimable", "lease_revoked"), "execution_not_reclaimable")
    if s["reclaim_count"] >= (c.get("max_reclaims") or MAX_RECLAIMS):
        end(s, c, "failed", "max_retries_exhausted")
        return
    s.update(attempt_index=s["attempts"], attempts=s["attempts"] + 1, attempt_type="reclaim", reclaim_count=s["reclaim_count"] + 1)
    take(s, c)
    become(s, "active")


def expire(s, c):
    need(s["lifecycle_phase"] != "terminal", "execution_not_active")
    end(s, c, "expired", c.get("reason") or "execution_deadline")


def suspend(s, c):
    need(s["lifecycle_phase"] != "suspended", "already_suspended")
    leased(s, c)
    become(s, "suspended", suspension_id=c.get("suspension_id"), timeout_at=c.get("timeout_at"), timeout_behavior=c.get("timeout_behavior"))
    s["blocking_reason"] = SUSPEND_REASONS.get(c.get("reason"), "waiting_for_signal")


def resume(s, c):
    need(s["lifecycle_phase"] == "suspended", "execution_not_suspended")
    until = c.get("delay_until")
    if until and until > c["now_ms"]:
        become(s, "resume_delay", delay_until=until, suspension_id=None, timeout_at=None)
    else:
        become(s, "eligible", attempt_state="attempt_interrupted", suspension_id=None, timeout_at=None)


def suspension_timeout(s, c):
    need(s["lifecycle_phase"] == "suspended", "execution_not_suspended")
    need(s["timeout_at"] is not None and s["timeout_at"] <= c["now_ms"], "not_due")
    how = s["timeout_behavior"]
    if how in TIMEOUTS:
        end(s, c, TIMEOUTS[how], f"suspension_timeout:{how}")
    elif how == "escalate":
        become(s, "escalated", timeout_at=None)
    else:
        become(s, "eligible", attempt_state="attempt_interrupted", suspension_id=None, timeout_at=None)


def block(s, c):
    need(s["lifecycle_phase"] == "runnable" and s["eligibility_state"] == "eligible_now", "execution_not_eligible")
    need(c.get("reason") in BLOCKS, "invalid_blocking_reason")
    s.update(eligibility_state=BLOCKS[c["reason"]], blocking_reason=c["reason"], public_state="rate_limited")


def unblock(s, c):
    need(s["lifecycle_phase"] == "runnable" and s["eligibility_state"] in BLOCKS.values(), "execution_not_blocked")
    need(c.get("reason") in (None, s["blocking_reason"]), "blocking_reason_mismatch")
    become(s, "eligible")


def apply_dependency(s, c):
    need(s["lifecycle_phase"] == "runnable", "execution_not_eligible")
    s["unsatisfied"] += 1
    become(s, "children")


def dependency(s, c):
    """An upstream of an all_of child ended (``outcome``)."""
    need(s["unsatisfied"] > 0, "no_dependency")
    if c.get("outcome") == "success":
        s["unsatisfied"] -= 1
        if s["unsatisfied"] == 0 and s["eligibility_state"] == "blocked_by_dependencies":
            become(s, "eligible")
    else:
        s["impossible"] += 1
        if s["lifecycle_phase"] != "terminal":
            end(s, c, "skipped", "dependency_impossible")


def replay(s, c):
    need(s["lifecycle_phase"] == "terminal", "execution_not_terminal")
    need(s["replay_count"] < (c.get("max_replays") or MAX_REPLAYS), "max_replays_exhausted")
    skipped = s["terminal_outcome"] == "skipped" and s["unsatisfied"] > 0
    become(s, "children" if skipped else "eligible", attempt_state="pending_replay_attempt", replay_count=s["replay_count"] + 1, impossible=0, terminal_at=None, reason=None, retry_count=0)


def change_priority(s, c):
    need(s["lifecycle_phase"] == "runnable" and s["eligibility_state"] == "eligible_now", "execution_not_eligible")
    s["priority"] = max(0, min(MAX_PRIORITY, c.get("priority") or 0))


COMMANDS = {
    f.__name__: f
    for f in (claim, claim_resumed, renew, progress, complete, fail, cancel, delay, wait_children, promote, expire_lease, revoke, reclaim, expire, suspend, resume, suspension_timeout, block, unblock, apply_dependency, dependency, replay, change_priority)
}

RESULT = "execution_id long, seq long, kind string, status string, lifecycle_phase string, ownership_state string, eligibility_state string, blocking_reason string, terminal_outcome string, attempt_state string, public_state string, attempt_index int, lease_epoch long, retry_count int, replay_count int, reclaim_count int, priority int"


def answer(state: dict | None, c: dict) -> tuple[dict | None, str]:
    """One command: the state after it and its status (ok, duplicate or an error code)."""
    kind = c["kind"]
    status = "ok"
    if kind == "create":
        status = "duplicate" if state else "ok"
        state = state or create(c)
    elif state is None:
        status = "execution_not_found"
    elif kind not in COMMANDS:
        status = "unknown_command"
    else:
        try:
            COMMANDS[kind](state, c)
        except Refused as e:
            status = str(e)
    return state, status


def step(state: dict | None, c: dict) -> tuple[dict | None, list[dict]]:
    """One command; the answer names it, its status and the vector."""
    state, status = answer(state, c)
    row = {"execution_id": c["execution_id"], "seq": c["seq"], "kind": c["kind"], "status": status}
    return state, [row | {k: (state or {}).get(k) for k in (*PARTS, "attempt_index", "lease_epoch", "retry_count", "replay_count", "reclaim_count", "priority")}]


def last_step(policy: dict):
    """A step that answers nothing, for logs whose commands share ``policy``; see ``last``."""
    return lambda state, c: (answer(state, policy | c)[0], [])


LAST = "execution_id long, public_state string, attempt_index int, retry_count int"


def last(key, state: dict | None) -> list[dict]:
    """What an execution's log ends in; nulls if none of its commands created it."""
    s = state or {}
    return [{"execution_id": key, **{k: s.get(k) for k in ("public_state", "attempt_index", "retry_count")}}]


def status_step(policy: dict):
    """A step that answers kind and status only; see ``count_answers``."""

    def run(state, c):
        state, status = answer(state, policy | c)
        return state, [{"kind": c["kind"], "status": status}]

    return run


ANSWERS = "kind string, status string, commands long"


def count_answers(rows: list[dict]) -> list[dict]:
    counts = Counter((r["kind"], r["status"]) for r in rows)
    return [{"kind": kind, "status": status, "commands": n} for (kind, status), n in counts.items()]
