"""Ordered folds (budgets, quotas, signals, summaries, executions) and frame streams as queries.

The SQL of a fold is a recursive query that goes through each key's log row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.operators import execution, folds, frames, signals, windows
from tidefold.plans.registry import query


def log_sql(rows: str, key: str, order: str, start: str, step: str, out: str, carried: str) -> str:
    """Recursion over ``rows`` in order: ``start`` and ``step`` give the columns ``carried``."""
    return f"""WITH RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({rows}) r),
f({key}, rn, {carried}) AS (SELECT DISTINCT {key}, 0::BIGINT, {start} FROM ops UNION ALL SELECT o.{key}, o.rn, {step} FROM f JOIN ops o ON f.{key} = o.{key} AND o.rn = f.rn + 1)
SELECT {out} FROM f WHERE rn > 0"""


SEEN = "list_contains(f.seen, o.dedup_key)"
BUDGET_SQL = log_sql(
    "SELECT u.*, p.hard_limit, p.soft_limit FROM usage u JOIN budget_policy p ON u.budget_id = p.budget_id",
    "budget_id",
    "now_ms, seq",
    "0::BIGINT, ''::VARCHAR, 0::BIGINT, []::VARCHAR[]",
    f"o.seq, CASE WHEN {SEEN} THEN 'already_applied' WHEN f.used + o.delta > o.hard_limit THEN 'hard_breach' WHEN f.used + o.delta > o.soft_limit THEN 'soft_breach' ELSE 'ok' END, "
    f"CASE WHEN {SEEN} OR f.used + o.delta > o.hard_limit THEN f.used ELSE f.used + o.delta END, CASE WHEN {SEEN} OR f.used + o.delta > o.hard_limit THEN f.seen ELSE list_append(f.seen, o.dedup_key) END",
    "budget_id, seq, status, used",
    "seq, status, used, seen",
)


def budget_log(m):
    return m.usage.join(m.budget_policy.select("budget_id", "hard_limit", "soft_limit"), "budget_id").select("budget_id", "seq", "now_ms", "delta", "dedup_key", "hard_limit", "soft_limit")


@query("budget_spend", BUDGET_SQL)
def budget_spend(m):
    return folds.fold(budget_log(m), "budget_id", ["now_ms", "seq"], folds.budget_step, folds.BUDGET)


#: How long an accepted report's key is known, and the limits of calls, in the query by dimension.
KNOWN_MS, CALLS_HARD, CALLS_SOFT = 86_400_000, 40, 20
DIMS = ("click", "error", "purchase", "signup", "view")
KNOWN = "(len(list_filter(f.seen, lambda s: s.k = o.dedup_key AND s.until_ms > o.now_ms)) > 0)"
HARD = ["f.used[o.i] + o.delta > o.hard_limit // 4", f"f.used[6] + 1 > {CALLS_HARD}"]
SOFT = ["f.used[o.i] + o.delta > o.soft_limit // 4", f"f.used[6] + 1 > {CALLS_SOFT}"]
KEPT = f"{KNOWN} OR {HARD[0]} OR {HARD[1]}"
BUDGET_DIMS_SQL = log_sql(
    f"SELECT u.*, p.hard_limit, p.soft_limit, list_position([{', '.join(repr(d) for d in DIMS)}], u.dim) AS i FROM usage u JOIN budget_policy p ON u.budget_id = p.budget_id",
    "budget_id",
    "now_ms, seq",
    "0::BIGINT, ''::VARCHAR, NULL::VARCHAR, [0, 0, 0, 0, 0, 0]::BIGINT[], []::STRUCT(k VARCHAR, until_ms BIGINT)[]",
    f"o.seq, CASE WHEN {KNOWN} THEN 'already_applied' WHEN {HARD[0]} OR {HARD[1]} THEN 'hard_breach' WHEN {SOFT[0]} OR {SOFT[1]} THEN 'soft_breach' ELSE 'ok' END, "
    f"CASE WHEN {KNOWN} THEN NULL WHEN {HARD[0]} THEN o.dim WHEN {HARD[1]} THEN 'calls' WHEN {SOFT[0]} THEN o.dim WHEN {SOFT[1]} THEN 'calls' END, "
    f"CASE WHEN {KEPT} THEN f.used ELSE list_transform(f.used, lambda v, n: v + CASE WHEN n = o.i THEN o.delta WHEN n = 6 THEN 1 ELSE 0 END) END, "
    f"CASE WHEN {KEPT} THEN f.seen ELSE list_append(f.seen, {{'k': o.dedup_key, 'until_ms': o.now_ms + {KNOWN_MS}}}) END",
    "budget_id, seq, status, dim, CAST(list_sum(used) AS BIGINT) AS used",
    "seq, status, dim, used, seen",
)


@query("budget_spend_dims", BUDGET_DIMS_SQL)
def budget_spend_dims(m):
    """Each report spends in two dimensions: its kind of event, and one call."""
    log = m.usage.join(m.budget_policy.select("budget_id", "hard_limit", "soft_limit"), "budget_id").select(
        "budget_id", "seq", "now_ms", "dedup_key",
        F.array("dim", F.lit("calls")).alias("dims"),
        F.array("delta", F.lit(1).cast("long")).alias("deltas"),
        F.array(F.floor(F.col("hard_limit") / 4), F.lit(CALLS_HARD).cast("long")).alias("hard"),
        F.array(F.floor(F.col("soft_limit") / 4), F.lit(CALLS_SOFT).cast("long")).alias("soft"),
    )
    return folds.fold(log, "budget_id", ["now_ms", "seq"], folds.budget_dims_step(KNOWN_MS), folds.BUDGET_DIMS)


LEDGER_LOG = "SELECT budget_id, execution_id, CASE WHEN seq % 10 = 9 THEN 'release' ELSE 'spend' END AS kind, delta, seq FROM usage"


@query("budget_ledger", f"WITH log AS ({LEDGER_LOG}) SELECT l.budget_id, l.execution_id, CAST(sum(delta) AS BIGINT) AS held FROM log l LEFT JOIN (SELECT budget_id, execution_id, max(seq) AS released FROM log WHERE kind = 'release' GROUP BY ALL) r ON l.budget_id = r.budget_id AND l.execution_id = r.execution_id WHERE kind = 'spend' AND (released IS NULL OR seq > released) GROUP BY l.budget_id, l.execution_id")
def budget_ledger(m):
    return windows.open_ledgers(m.spark.sql(LEDGER_LOG.replace("FROM usage", "FROM {usage}"), usage=m.usage))


@query("budget_resets")
def budget_resets(m):
    """With resets a release can floor at zero, so this one is a fold; tests hold it to examples."""
    log = m.spark.sql("SELECT budget_id, execution_id, CASE WHEN seq % 97 = 0 THEN 'reset' WHEN seq % 10 = 9 THEN 'release' ELSE 'spend' END AS kind, delta, seq, now_ms FROM {usage}", usage=m.usage)
    return folds.fold(log, "budget_id", ["now_ms", "seq"], folds.ledger_step, folds.LEDGER, folds.ledger_end)


#: Window and rate of the quota query.
QUOTA_MS, QUOTA_RATE = 7 * 86_400_000, 2
LIVE = f"list_filter(f.times, lambda t: t > o.now_ms - {QUOTA_MS})"


QUOTA_SQL = log_sql(
    "SELECT * FROM quota_op",
    "policy_id",
    "now_ms, seq",
    "0::BIGINT, ''::VARCHAR, NULL::BIGINT, []::BIGINT[]",
    f"o.seq, CASE WHEN len({LIVE}) >= {QUOTA_RATE} THEN 'rate_exceeded' ELSE 'admitted' END, CASE WHEN len({LIVE}) >= {QUOTA_RATE} THEN {LIVE}[1] + {QUOTA_MS} - o.now_ms END, CASE WHEN len({LIVE}) >= {QUOTA_RATE} THEN {LIVE} ELSE list_append({LIVE}, o.now_ms) END",
    "policy_id, seq, status, retry_after_ms",
    "seq, status, retry_after_ms, times",
)


@query("quota_admission", QUOTA_SQL)
def quota_admission(m):
    return folds.fold(m.quota_op, "policy_id", ["now_ms", "seq"], folds.quota_step(QUOTA_MS, QUOTA_RATE), folds.QUOTA)


@query("quota_offered_load", f"SELECT policy_id, seq, count(*) OVER (PARTITION BY policy_id ORDER BY now_ms RANGE BETWEEN {QUOTA_MS - 1} PRECEDING AND CURRENT ROW) AS offered FROM quota_op")
def quota_offered_load(m):
    return windows.offered_load(m.quota_op, QUOTA_MS)


#: Resume after signals of three different names.
THREE = {"all": [{"count": 3, "kind": "signals", "names": []}, {"count": 2, "kind": "sources", "names": ["click", "purchase"]}]}


@query(
    "signal_delivery",
    log_sql(
        "SELECT * FROM signal",
        "execution_id",
        "created_at_ms, signal_id",
        "0::BIGINT, ''::VARCHAR, 0::BIGINT, []::VARCHAR[], false",
        "o.signal_id, CASE WHEN f.resumed THEN 'waitpoint_closed' WHEN f.accepted >= 2 AND len(list_distinct(CASE WHEN o.signal_name IN ('click', 'purchase') THEN list_append(f.sources, o.source_identity) ELSE f.sources END)) >= 2 THEN 'resumed' ELSE 'accepted' END, "
        "f.accepted + CASE WHEN f.resumed THEN 0 ELSE 1 END, CASE WHEN o.signal_name IN ('click', 'purchase') THEN list_append(f.sources, o.source_identity) ELSE f.sources END, "
        "f.resumed OR (f.accepted >= 2 AND len(list_distinct(CASE WHEN o.signal_name IN ('click', 'purchase') THEN list_append(f.sources, o.source_identity) ELSE f.sources END)) >= 2)",
        "execution_id, signal_id, status, accepted",
        "signal_id, status, accepted, sources, resumed",
    ),
)
def signal_delivery(m):
    return folds.fold(m.signal, "execution_id", ["created_at_ms", "signal_id"], signals.signal_step(THREE), signals.SIGNAL)


@query(
    "signal_first_of_any",
    "SELECT execution_id, min(nth) AS resumed_by FROM (SELECT execution_id, signal_id, signal_name, row_number() OVER (PARTITION BY execution_id ORDER BY created_at_ms, signal_id) AS nth FROM signal) s WHERE signal_name IN ('error', 'signup') GROUP BY execution_id",
)
def signal_first_of_any(m):
    """The simple condition "any of these names": how many deliveries it takes to resume."""
    step = signals.signal_step({"mode": "any", "names": ["error", "signup"]})
    rows = folds.fold(m.signal, "execution_id", ["created_at_ms", "signal_id"], step, signals.SIGNAL)
    return rows.where("status = 'resumed'").select("execution_id", F.col("accepted").alias("resumed_by"))


@query("signal_satisfiers", "SELECT execution_id, count(DISTINCT waitpoint_id) AS waitpoints, count(DISTINCT signal_id) AS signals, count(DISTINCT source_identity) AS sources, count(DISTINCT signal_name) AS names FROM signal GROUP BY execution_id")
def signal_satisfiers(m):
    return windows.distinct_satisfiers(m.signal)


FIELDS = ("click", "error", "purchase", "signup", "view")


@query(
    "summary_document",
    "WITH last AS (SELECT * FROM ("
    + log_sql("SELECT * FROM patch", "execution_id", "ts_ms, seq", "'{}'::JSON", "json_merge_patch(f.doc, o.patch::JSON)", "execution_id, rn, doc", "doc")
    + ") x QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY rn DESC) = 1) SELECT execution_id, rn AS version, "
    + ", ".join(f"json_extract_string(doc, '$.{x}') AS {x}" for x in FIELDS)
    + ", json_extract_string(doc, '$.meta.c') AS meta_c, json_extract_string(doc, '$.meta.p') AS meta_p FROM last",
)
def summary_document(m):
    rows = folds.fold(m.patch, "execution_id", ["ts_ms", "seq"], frames.summary_step, frames.SUMMARY, frames.summary_end)
    at = lambda path, name: F.get_json_object("document", f"$.{path}").alias(name)
    return rows.select("execution_id", "version", *[at(x, x) for x in FIELDS], at("meta.c", "meta_c"), at("meta.p", "meta_p"))


TTL_MS = 30 * 86_400_000
RATE = "CASE WHEN f.last IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE / (greatest(1, o.ts_ms - f.last) / 1000::DOUBLE) + 0.8::DOUBLE * f.rate END"


@query(
    "frame_rate_bounds",
    log_sql(
        "SELECT execution_id, seq, ts_ms FROM patch",
        "execution_id",
        "ts_ms, seq",
        "0::BIGINT, 0.0::DOUBLE, NULL::BIGINT",
        f"o.seq, {RATE}, o.ts_ms",
        f"execution_id, seq, round(rate, 6) AS rate, greatest(64, least(16384, ceil(rate * {TTL_MS} / 1000 * 2)))::BIGINT AS maxlen",
        "seq, rate, last",
    ),
)
def frame_rate_bounds(m):
    return folds.fold(m.patch.select("execution_id", "seq", "ts_ms"), "execution_id", ["ts_ms", "seq"], frames.ema_step(TTL_MS), frames.EMA)


# --- frame streams -----------------------------------------------------------------------------

SEQUENCED = "SELECT *, row_number() OVER (PARTITION BY execution_id, attempt_index, ts_ms ORDER BY arrival) - 1 AS seq FROM frame"


@query("frame_sequence", f"SELECT execution_id, attempt_index, ts_ms, seq, frame_type FROM ({SEQUENCED}) s")
def frame_sequence(m):
    return frames.sequenced(m.frame).select("execution_id", "attempt_index", "ts_ms", F.col("seq").cast("long").alias("seq"), "frame_type")


@query("frame_range_read", f"SELECT execution_id, ts_ms, seq, payload FROM ({SEQUENCED}) s WHERE ts_ms BETWEEN 1000 AND 3000 AND (ts_ms < 3000 OR seq = 0) ORDER BY execution_id, ts_ms, seq LIMIT 500")
def frame_range_read(m):
    return frames.read(m.frame, (1000, 0), (3000, 0), 500).select("execution_id", "ts_ms", F.col("seq").cast("long").alias("seq"), "payload")


@query("frame_tail", "SELECT execution_id, ts_ms, payload FROM frame WHERE ts_ms > 2000 AND coalesce(mode, 'durable') <> 'best_effort'")
def frame_tail(m):
    return m.frame.where((F.col("ts_ms") > 2000) & frames.visible(F.col("mode"))).select("execution_id", "ts_ms", "payload")


@query("frame_retention", "SELECT execution_id, ts_ms, payload FROM frame QUALIFY row_number() OVER (PARTITION BY execution_id, attempt_index ORDER BY ts_ms DESC, arrival DESC) <= 2")
def frame_retention(m):
    return frames.newest(m.frame, 2).select("execution_id", "ts_ms", "payload")


@query("frame_counts", "SELECT execution_id, mode, count(*) AS frames, CAST(sum(length(payload)) AS BIGINT) AS chars FROM frame GROUP BY execution_id, mode")
def frame_counts(m):
    return m.frame.groupBy("execution_id", "mode").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.char_length("payload")).cast("long").alias("chars"))


@query("attempt_history", "SELECT execution_id, attempt_index, row_number() OVER w AS epoch, started_at_ms - lag(started_at_ms) OVER w AS gap_ms, first_value(started_at_ms) OVER w AS first_started_at_ms FROM attempt WINDOW w AS (PARTITION BY execution_id ORDER BY attempt_index)")
def attempt_history(m):
    return windows.attempt_history(m.attempt)


@query("current_attempt", "SELECT execution_id, max(attempt_index) AS attempt_index, count(*) AS attempts FROM attempt GROUP BY execution_id")
def current_attempt(m):
    return m.attempt.groupBy("execution_id").agg(F.max("attempt_index").alias("attempt_index"), F.count(F.lit(1)).alias("attempts"))


DEDUP_MS = 86_400_000


@query("dedup_within_ttl", f"SELECT budget_id, seq FROM (SELECT *, now_ms - lag(now_ms) OVER (PARTITION BY dedup_key ORDER BY now_ms, seq) AS gap FROM usage) x WHERE gap IS NULL OR gap >= {DEDUP_MS}")
def dedup_within_ttl(m):
    return windows.first_within(m.usage, "dedup_key", "now_ms", DEDUP_MS).select("budget_id", "seq")


#: Key of the token queries; both sides build HMAC from plain digests.
KEY = b"k1"
PADS = ["".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("waitpoint_tokens", f"SELECT waitpoint_id, 'kid-1:' || sha1('{PADS[1]}'::BLOB || unhex(sha1('{PADS[0]}'::BLOB || CAST(waitpoint_id AS VARCHAR)::BLOB))) AS token, waitpoint_id % 3 <> 0 AS valid FROM waitpoint")
def waitpoint_tokens(m):
    message = F.col("waitpoint_id").cast("string")
    token = F.concat(F.lit("kid-1:"), windows.hmac_sha1(KEY, message))
    shown = F.when(F.col("waitpoint_id") % 3 == 0, F.concat(token, F.lit("0"))).otherwise(token)
    return m.waitpoint.select("waitpoint_id", token.alias("token"), windows.token_ok(shown, message, {"kid-1": KEY}).alias("valid"))


# --- executions --------------------------------------------------------------------------------

#: Per execution: create, then per attempt the promotion of a retry that waits, a claim and its end
#: (done, failed with two retries, or an expired lease that is reclaimed at once).
COMMANDS = """
SELECT execution_id, CAST(0 AS BIGINT) AS seq, 'create' AS kind, CAST(0 AS BIGINT) AS now_ms, CAST(NULL AS STRING) AS lease_id, CAST(NULL AS BIGINT) AS lease_epoch, CAST(NULL AS INT) AS attempt_index FROM {exec_core}
UNION ALL SELECT execution_id, inline(array(
  struct(10 * lease_epoch + 1, 'promote', CAST(n * 10000 AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS INT)),
  struct(10 * lease_epoch + 2, 'claim', CAST(n * 10000 + 1 AS BIGINT), 'l' || CAST(lease_epoch AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS INT)),
  struct(10 * lease_epoch + 3, CASE outcome WHEN 'ended_success' THEN 'complete' WHEN 'ended_failure' THEN 'fail' ELSE 'expire' END, CAST(n * 10000 + 2 AS BIGINT), CASE WHEN outcome <> 'running' THEN 'l' || CAST(lease_epoch AS STRING) END, CASE WHEN outcome <> 'running' THEN CAST(n AS BIGINT) END, CASE WHEN outcome <> 'running' THEN CAST(n - 1 AS INT) END))) FROM {turns}"""
#: What all of these commands have in common.
POLICY = {"backoff": "fixed", "backoff_ms": 1000, "max_retries": 2, "ttl_ms": 10, "priority": 5000}
TURNS = "SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY attempt_index) AS n FROM attempt"

REPLAY_SQL = f"""WITH turns AS ({TURNS}), ended AS (
  SELECT *, count(*) FILTER (WHERE outcome = 'ended_failure') OVER (PARTITION BY execution_id ORDER BY n) AS failures FROM turns),
last AS (SELECT execution_id, min(n) AS n FROM ended WHERE outcome = 'ended_success' OR outcome = 'running' OR failures = 3 GROUP BY execution_id)
SELECT e.execution_id, CASE WHEN t.n IS NULL THEN CASE WHEN a.n IS NULL THEN 'waiting' ELSE 'delayed' END WHEN t.outcome = 'ended_success' THEN 'completed' WHEN t.outcome = 'running' THEN 'expired' ELSE 'failed' END AS public_state,
  coalesce(t.n, a.n, 0) AS attempts, CAST(least(coalesce(t.failures, a.failures, 0), 2) AS INT) AS retry_count
FROM exec_core e LEFT JOIN last l ON e.execution_id = l.execution_id LEFT JOIN ended t ON t.execution_id = e.execution_id AND t.n = l.n
LEFT JOIN (SELECT execution_id, max(n) AS n, max(failures) AS failures FROM ended GROUP BY execution_id) a ON a.execution_id = e.execution_id"""


def command_log(m):
    """The command log; an execution's attempts come at 10000, 20000, ... of a clock of its own."""
    turns = m.spark.sql(TURNS.replace("FROM attempt", "FROM {attempt}"), attempt=m.attempt)
    return m.spark.sql(COMMANDS, exec_core=m.exec_core, turns=turns)


@query("execution_replay", REPLAY_SQL)
def execution_replay(m):
    final = folds.fold(command_log(m), "execution_id", ["seq"], execution.last_step(POLICY), execution.LAST, execution.last)
    return final.select("execution_id", "public_state", (F.col("attempt_index") + 1).cast("long").alias("attempts"), "retry_count")


@query("execution_answers")
def execution_answers(m):
    """How each kind of command was answered over the whole log; tests hold the fold to examples."""
    rows = folds.fold(command_log(m), "execution_id", ["seq"], execution.status_step(POLICY), execution.ANSWERS, pack=execution.count_answers)
    return rows.groupBy("kind", "status").agg(F.sum("commands").alias("commands"))
