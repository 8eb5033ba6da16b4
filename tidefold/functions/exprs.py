"""Column expressions of the engine's semantics; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled", "expired", "skipped")
#: Raw tokens of older writers and what they mean now (fixed values).
ALIASES = {"pending": "waiting", "eligible": "waiting", "blocked": "waiting_children", "running": "active", "claimed": "active", "leased": "active", "released": "waiting", "success": "completed"}


def derive_public_state(phase: Column, eligibility: Column, outcome: Column) -> Column:
    """The one public state of a (phase, eligibility, outcome) vector."""
    return (
        F.when(phase == "terminal", F.when(outcome == "success", "completed").when(outcome == "none", F.lit(None)).otherwise(outcome))
        .when(phase == "suspended", "suspended")
        .when(phase == "active", "active")
        .when(eligibility == "not_eligible_until_time", "delayed")
        .when(eligibility.isin("blocked_by_budget", "blocked_by_quota"), "rate_limited")
        .when(eligibility == "blocked_by_dependencies", "waiting_children")
        .otherwise("waiting")
    )


def terminal_outcome(public_state: Column) -> Column:
    return F.when(public_state == "completed", "success").when(public_state.isin(*TERMINAL), public_state).otherwise("none")


def normalised(token: Column) -> Column:
    """Canonical form of a raw state token; others pass."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(token)), F.lower(token))


def has_all(required: Column, have: Column) -> Column:
    """Capability test: every required token (empty ones don't count) is there."""
    return F.size(F.array_except(F.array_remove(required, ""), have)) == 0


def missing(required: Column, have: Column) -> Column:
    """Missing tokens, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_except(F.array_remove(required, ""), have)), ",")


def csv_tokens(text: Column) -> Column:
    """Tokens of a comma list: trimmed, sorted, without empty ones or repeats."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")))


def clamp_priority(priority: Column) -> Column:
    return F.least(F.greatest(priority, F.lit(0)), F.lit(9000))


def backoff_ms(kind: Column, retry: Column, initial: int = 1000, mult: float = 2.0, most: int = 60_000) -> Column:
    """Delay before a retry: fixed, or exponential up to ``most``."""
    return F.when(kind == "fixed", F.lit(initial)).otherwise(F.least(F.floor(initial * F.pow(F.lit(mult), retry)), F.lit(most))).cast("long")


def renewal_deadline(now: Column, ttl: Column) -> Column:
    """A lease is to be renewed after two thirds of its time."""
    return now + F.floor(ttl * 2 / 3).cast("long")


def tag_key_ok(key: Column) -> Column:
    """Tag keys have a lower-case namespace before a dot."""
    return key.rlike(r"^[a-z][a-z0-9_]*\.")


def lane_ok(lane: Column) -> Column:
    return (F.octet_length(lane).between(1, 64)) & ~lane.rlike(r"[\s\p{Cntrl}]")


def partition_of(execution_id: Column) -> Column:
    """N of an id of the form ``{fp:N}:uuid``."""
    return F.regexp_extract(execution_id, r"^\{fp:(\d+)\}:", 1).try_cast("int")


def cursor(text: Column) -> Column:
    """struct<ts_ms, seq> of a ``ms-seq`` stream cursor."""
    return F.struct(F.split_part(text, F.lit("-"), F.lit(1)).try_cast("long").alias("ts_ms"), F.coalesce(F.split_part(text, F.lit("-"), F.lit(2)).try_cast("long"), F.lit(0)).alias("seq"))


def hash_partition(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")


def grant_id(key: Column) -> Column:
    return F.sha2(key, 256)


def filter_matches(namespace: Column, tag: Column, want_namespace: str | None = None, want_tag: str | None = None) -> Column:
    """Both set dimensions must match; a missing value matches nothing."""
    ok = F.lit(True)
    if want_namespace is not None:
        ok = ok & F.coalesce(namespace == want_namespace, F.lit(False))
    if want_tag is not None:
        ok = ok & F.coalesce(tag == want_tag, F.lit(False))
    return ok


def flow_state(total: Column, terminal: Column, bad: Column, active: Column, blocked: Column) -> Column:
    """A flow's public state from the counts of its members."""
    return F.when((total > 0) & (terminal == total), F.when(bad > 0, "failed").otherwise("completed")).when(active > 0, "running").when(blocked > 0, "blocked").otherwise("open")
