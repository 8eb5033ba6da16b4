"""Window-shaped reads of the logs: offered load, epochs, gaps, ledgers; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offered_load(ops: DataFrame, window_ms: int) -> DataFrame:
    """Calls of the last ``window_ms`` at each call, admitted or not."""
    span = Window.partitionBy("policy_id").orderBy("now_ms").rangeBetween(-window_ms + 1, 0)
    return ops.select("policy_id", "seq", F.count(F.lit(1)).over(span).alias("offered"))


def attempt_history(attempt: DataFrame) -> DataFrame:
    """Each attempt's epoch (claims are counted), its gap to the one before, and the first start."""
    line = Window.partitionBy("execution_id").orderBy("attempt_index")
    return attempt.select(
        "execution_id",
        "attempt_index",
        F.row_number().over(line).cast("long").alias("epoch"),
        (F.col("started_at_ms") - F.lag("started_at_ms").over(line)).alias("gap_ms"),
        F.first("started_at_ms").over(line).alias("first_started_at_ms"),
    )


def open_ledgers(log: DataFrame) -> DataFrame:
    """What each execution still holds of a budget: what it spent after its last release.

    ``log``: budget_id, execution_id, kind (spend or release), delta, seq.  The last release comes
    from an aggregate, not a window over the log, so a hot budget is pre-aggregated before it moves."""
    after = log.where("kind = 'release'").groupBy("budget_id", "execution_id").agg(F.max("seq").alias("released"))
    left = log.where("kind = 'spend'").join(after, ["budget_id", "execution_id"], "left").where("released IS NULL OR seq > released")
    return left.groupBy("budget_id", "execution_id").agg(F.sum("delta").alias("held"))


def distinct_satisfiers(signal: DataFrame) -> DataFrame:
    """Distinct waitpoints, signals and sources that each execution's signals came from."""
    n = lambda c: F.count_distinct(c)
    return signal.groupBy("execution_id").agg(n("waitpoint_id").alias("waitpoints"), n("signal_id").alias("signals"), n("source_identity").alias("sources"), n("signal_name").alias("names"))


def hmac_sha1(key: bytes, message: Column) -> Column:
    """HMAC-SHA1 in hexadecimal.  The key is a constant, so its two pads are literals and the rest
    is two built-in digests."""
    import hashlib

    key = (hashlib.sha1(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha1(F.concat(outer, F.unhex(F.sha1(F.concat(inner, message.cast("binary"))))))


def token_ok(token: Column, message: Column, keys: dict[str, bytes]) -> Column:
    """A ``kid:digest`` token is valid if the digest under that key is the message's."""
    kid, digest = F.split_part(token, F.lit(":"), F.lit(1)), F.split_part(token, F.lit(":"), F.lit(2))
    ok = F.lit(False)
    for name, key in keys.items():
        ok = ok | ((kid == name) & (digest == hmac_sha1(key, message)))
    return ok


def first_within(events: DataFrame, key: str, time: str, ttl_ms: int) -> DataFrame:
    """Rows whose key did not occur in the ``ttl_ms`` before them."""
    line = Window.partitionBy(key).orderBy(time, "seq")
    gap = F.col(time) - F.lag(time).over(line)
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= ttl_ms)).drop("_gap")
