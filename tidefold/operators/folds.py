"""Ordered folds: state per key, commands in order.

A fold is a pure ``step(state, command) -> (state, rows)``; ``state`` is None at first.  The same
step runs here in batch and in ``tidefold.streaming`` on a stream.

Batch: rows are hashed by key and sorted by (key, order) in each partition, and one pass over the
sorted rows keeps one key's state at a time.  A key's log may be of any length: it is streamed, not
collected.  (That a self-referential fold of one key runs in one task is its meaning.)
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidefold.operators.store import cut  # noqa: F401  used by callers of folds

Step = Callable[[object, dict], tuple[object, list[dict]]]


def arrow_table(rows: list[dict], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def plain(column: pa.Array) -> list:
    """``to_pylist``, by way of arrays where that is the same and faster."""
    if pa.types.is_integer(column.type) or pa.types.is_string(column.type):
        return column.to_pandas(integer_object_nulls=True).tolist()
    return column.to_pylist()


def commands(batch: pa.RecordBatch) -> list[dict]:
    names = batch.schema.names
    return [dict(zip(names, row, strict=True)) for row in zip(*map(plain, batch.columns), strict=True)]


def fold(log: DataFrame, key: str, order: list[str], step: Step, schema: str, finish: Callable[[object, object], list[dict]] | None = None, pack: Callable[[list[dict]], list[dict]] | None = None, chunk: int = 8192) -> DataFrame:
    """Rows that ``step`` gives, and after a key's last command those of ``finish(key, state)``.

    ``pack`` makes fewer rows of about ``chunk`` rows before they leave the task."""
    types = StructType.fromDDL(schema)
    pack = pack or (lambda rows: rows)

    def run(batches):
        key_now, state, started, out = None, None, False, []
        for batch in batches:
            for command in commands(batch):
                if not started or command[key] != key_now:
                    if started and finish:
                        out += finish(key_now, state)
                    key_now, state, started = command[key], None, True
                state, rows = step(state, command)
                out += rows
                if len(out) >= chunk:
                    yield arrow_table(pack(out), types)
                    out = []
        if started and finish:
            out += finish(key_now, state)
        yield arrow_table(pack(out), types)

    # by a hash of the key: a shuffle by the key itself is dropped where a join below already has one,
    # and that one may be read in other parts (by mapper, or a skewed key by pieces) at run time
    return log.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, types)


# --- budgets -----------------------------------------------------------------------------------


def budget_step(state, c):
    """Check every limit, then add: a report that would pass the hard limit adds nothing.

    A report seen before (same dedup_key, accepted) changes nothing; a rejected one may come again."""
    s = state or {"used": 0, "seen": set(), "breaches": 0}
    if c["dedup_key"] is not None and c["dedup_key"] in s["seen"]:
        status = "already_applied"
    elif s["used"] + c["delta"] > c["hard_limit"]:
        status = "hard_breach"
        s["breaches"] += 1
    else:
        s["used"] += c["delta"]
        if c["dedup_key"] is not None:
            s["seen"].add(c["dedup_key"])
        status = "soft_breach" if s["used"] > c["soft_limit"] else "ok"
    return s, [{"budget_id": c["budget_id"], "seq": c["seq"], "status": status, "used": s["used"]}]


BUDGET = "budget_id long, seq long, status string, used long"


def budget_dims_step(ttl_ms: int) -> Step:
    """A report of several dimensions: every hard limit is checked before anything is added, so one
    that would be passed leaves all as they were; then soft limits, the first one passed is named.

    ``dims``, ``deltas``, ``hard`` and ``soft`` are arrays of one length; a limit that is null or
    not above 0 is none.  An accepted dedup_key is known for ``ttl_ms``, and then forgotten."""

    def over(limits, values):
        return next((i for i, (limit, v) in enumerate(zip(limits, values, strict=True)) if limit is not None and 0 < limit < v), None)

    def step(state, c):
        s = state or {"used": {}, "seen": {}}
        used, seen, key, now = s["used"], s["seen"], c["dedup_key"], c["now_ms"]
        while seen and seen[first := next(iter(seen))] <= now:
            del seen[first]
        totals, dim = {}, None
        for d, delta in zip(c["dims"], c["deltas"], strict=True):
            totals[d] = totals.get(d, used.get(d, 0)) + delta
        after = [totals[d] for d in c["dims"]]
        if key is not None and seen.get(key, now) > now:
            status = "already_applied"
        elif (i := over(c["hard"], after)) is not None:
            status, dim = "hard_breach", c["dims"][i]
        else:
            used.update(totals)
            if key is not None:
                seen.pop(key, None)
                seen[key] = now + ttl_ms
            i = over(c["soft"], after)
            status, dim = ("ok", None) if i is None else ("soft_breach", c["dims"][i])
        return s, [{"budget_id": c["budget_id"], "seq": c["seq"], "status": status, "dim": dim, "used": sum(used.values())}]

    return step


BUDGET_DIMS = "budget_id long, seq long, status string, dim string, used long"


def ledger_step(state, c):
    """Per-execution ledgers of a budget: ``spend`` adds to one, ``release`` gives all of it back
    (usage never below 0), ``reset`` zeroes the usage."""
    s = state or {"used": 0, "ledger": {}, "resets": 0}
    e = c["execution_id"]
    if c["kind"] == "spend":
        s["used"] += c["delta"]
        s["ledger"][e] = s["ledger"].get(e, 0) + c["delta"]
    elif c["kind"] == "release":
        s["used"] = max(0, s["used"] - s["ledger"].pop(e, 0))
    elif c["kind"] == "reset":
        s["used"] = 0
        s["resets"] += 1
    return s, []


LEDGER = "budget_id long, used long, open_ledgers long, resets long"


def ledger_end(key, s):
    return [{"budget_id": key, "used": s["used"], "open_ledgers": len(s["ledger"]), "resets": s["resets"]}]


# --- quotas ------------------------------------------------------------------------------------


def quota_step(window_ms: int, rate: int, cap: int = 0, jitter_ms: int = 0) -> Step:
    """Sliding-window admission: admitted before? rate? concurrency?  Only admitted calls count.

    What has left the window is dropped from the front, so a call costs the same at any rate."""

    def step(state, c):
        s = state or {"times": deque(), "guards": {}, "active": 0}
        now, times, guards = c["now_ms"], s["times"], s["guards"]
        while times and times[0] <= now - window_ms:
            times.popleft()
        while guards and guards[first := next(iter(guards))] <= now:
            del guards[first]
        retry = None
        if guards.get(c["execution_id"], now) > now:
            status = "already_admitted"
        elif len(times) >= rate:
            status, retry = "rate_exceeded", times[0] + window_ms - now + jitter_ms
        elif cap and s["active"] >= cap:
            status = "concurrency_exceeded"
        else:
            status = "admitted"
            times.insert(bisect_right(times, now) if times and now < times[-1] else len(times), now)
            guards.pop(c["execution_id"], None)
            guards[c["execution_id"]] = now + window_ms
            s["active"] += cap > 0
        return s, [{"policy_id": c["policy_id"], "seq": c["seq"], "status": status, "retry_after_ms": retry}]

    return step


QUOTA = "policy_id long, seq long, status string, retry_after_ms long"
