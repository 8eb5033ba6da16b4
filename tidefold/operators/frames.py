"""Frame streams: range reads, visibility, retention, summaries and burst-sized bounds."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most frames of one read; the sentinel that stands for null in a patch (fixed values).
HARD_CAP, NULL = 10_000, "__null__"


def visible(mode: Column) -> Column:
    """Best-effort frames hidden; a frame without a mode is durable."""
    return F.coalesce(mode, F.lit("durable")) != "best_effort"


def sequenced(frame: DataFrame) -> DataFrame:
    """``seq`` among the frames of one millisecond, in the order of arrival."""
    return frame.withColumn("seq", F.row_number().over(Window.partitionBy("execution_id", "attempt_index", "ts_ms").orderBy("arrival")) - 1)


def between(low: tuple[int, int], high: tuple[int, int]) -> Column:
    """Cursor range, both ends included; the ts bound alone reaches the scan."""
    at = F.struct(F.col("ts_ms").cast("long"), F.col("seq").cast("long"))
    pair = lambda p: F.struct(F.lit(p[0]).cast("long"), F.lit(p[1]).cast("long"))
    return F.col("ts_ms").between(low[0], high[0]) & (at >= pair(low)) & (at <= pair(high))


def read(frame: DataFrame, low: tuple[int, int], high: tuple[int, int], limit: int) -> DataFrame:
    return sequenced(frame).where(between(low, high)).orderBy("execution_id", "ts_ms", "seq").limit(min(limit, HARD_CAP))


def newest(frame: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` frames of each stream."""
    last = F.row_number().over(Window.partitionBy("execution_id", "attempt_index").orderBy(F.desc("ts_ms"), F.desc("arrival")))
    return frame.withColumn("_n", last).where(F.col("_n") <= k).drop("_n")


def merge(target, patch):
    """JSON merge patch: null removes, objects merge, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out


def nulled(doc):
    """The sentinel turned into null, anywhere."""
    if isinstance(doc, dict):
        return {k: nulled(v) for k, v in doc.items()}
    if isinstance(doc, list):
        return [nulled(v) for v in doc]
    return None if doc == NULL else doc


def summary_step(state, c):
    s = state or {"doc": {}, "version": 0}
    s["doc"] = merge(s["doc"], json.loads(c["patch"]))
    s["version"] += 1
    return s, []


SUMMARY = "execution_id long, version long, document string"


def summary_end(key, s):
    return [{"execution_id": key, "version": s["version"], "document": json.dumps(nulled(s["doc"]), sort_keys=True, separators=(",", ":"))}]


def ema_step(ttl_ms: int, alpha: float = 0.2, floor: int = 64, ceiling: int = 16_384):
    """Bound of a best-effort stream from the smoothed rate of appends: twice the frames that a
    time to live holds, between floor and ceiling."""

    def step(state, c):
        s = state or {"rate": None, "last": None}
        if s["last"] is None:
            s["rate"] = 0.0
        else:
            dt = max(1, c["ts_ms"] - s["last"]) / 1000
            s["rate"] = alpha / dt + (1 - alpha) * s["rate"]
        s["last"] = c["ts_ms"]
        bound = max(floor, min(ceiling, math.ceil(s["rate"] * ttl_ms / 1000 * 2)))
        return s, [{"execution_id": c["execution_id"], "seq": c["seq"], "rate": round(s["rate"], 6), "maxlen": bound}]

    return step


EMA = "execution_id long, seq long, rate double, maxlen long"
