"""Suspensions and signals: resume conditions over the signals delivered so far.

A condition is a tree: ``{"all": [...]}`` or ``{"count": n, "kind": "waitpoints" | "signals" |
"sources", "names": [...]}`` (no names: any).  Depth is 4 at most, n at least 1, lists not empty.
Or it is simple: ``{"mode": "any" | "all" | "count", "names": [...], "minimum": n}``, where a signal
meets the first open matcher of its name (no names: one matcher that any signal meets).
"""

from __future__ import annotations

import json

MAX_SIGNALS, MAX_DEPTH = 10_000, 4
FIELD = {"waitpoints": "waitpoint_id", "signals": "signal_id", "sources": "source_identity"}
MODES = ("any", "all", "count")


def check(node: dict, depth: int = 1) -> str | None:
    """None if the condition is well formed, else what is wrong."""
    if depth > MAX_DEPTH:
        return "condition_too_deep"
    if "all" in node:
        if not node["all"]:
            return "empty_all"
        return next((e for n in node["all"] if (e := check(n, depth + 1))), None)
    if "mode" in node:
        return None if node["mode"] in MODES else "unknown_mode"
    if node.get("count", 0) < 1:
        return "count_below_one"
    return None if node.get("kind") in FIELD else "unknown_kind"


def leaves(node: dict) -> list[dict]:
    return [leaf for n in node["all"] for leaf in leaves(n)] if "all" in node else [node]


def begun(leaf: dict):
    """What a leaf remembers: which matchers are met, or the distinct satisfiers so far."""
    return [False] * max(1, len(leaf.get("names") or [])) if "mode" in leaf else set()


def taken(leaf: dict, hits, signal: dict) -> None:
    """Notes a signal; a count remembers no more than it needs."""
    names, waits = leaf.get("names") or [], leaf.get("waitpoints") or []
    if "mode" in leaf:
        open_ = (i for i, name in enumerate(names or [""]) if not hits[i] and name in ("", signal["signal_name"]))
        if (first := next(open_, None)) is not None:
            hits[first] = True
    elif len(hits) < leaf["count"] and (not names or signal["signal_name"] in names) and (not waits or signal["waitpoint_id"] in waits):
        hits.add(signal[FIELD[leaf["kind"]]])


def met(leaf: dict, hits) -> bool:
    if "mode" not in leaf:
        return len(hits) >= leaf["count"]
    return sum(hits) >= (len(hits) if leaf["mode"] == "all" else leaf.get("minimum", 1))


def signal_step(condition: dict):
    """Deliver signals to one suspension; after it resumes, later ones are refused.

    Each leaf keeps what it has counted, so a delivery costs the same however many came before."""
    wrong = check(condition)
    ends = [] if wrong else leaves(condition)

    def step(state, c):
        s = state or {"hits": [begun(leaf) for leaf in ends], "accepted": 0, "keys": set(), "resumed": False}
        key = c.get("idempotency_key")
        if wrong:
            status = wrong
        elif s["resumed"]:
            status = "waitpoint_closed"
        elif s["accepted"] >= MAX_SIGNALS:
            status = "signal_limit_exceeded"
        elif key is not None and key in s["keys"]:
            status = "duplicate"
        else:
            s["accepted"] += 1
            if key is not None:
                s["keys"].add(key)
            for leaf, hits in zip(ends, s["hits"], strict=True):
                taken(leaf, hits, c)
            s["resumed"] = all(map(met, ends, s["hits"]))
            status = "resumed" if s["resumed"] else "accepted"
        return s, [{"execution_id": c["execution_id"], "signal_id": c["signal_id"], "status": status, "accepted": s["accepted"]}]

    return step


SIGNAL = "execution_id long, signal_id long, status string, accepted long"


def parse(text: str) -> dict:
    return json.loads(text)
