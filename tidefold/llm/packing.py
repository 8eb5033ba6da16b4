"""Best-fit packing by length patterns.

1. Arrow functions tokenize whole texts and cut long documents into pieces.  Each piece also gets
   its running number among the pieces of its length in its task; the rows are then written to
   the shared folder, so that these numbers stay whatever happens to executors later.
2. The histogram of lengths (at most ``capacity`` rows) goes to the driver.  Patterns of two and
   three lengths that fill a sequence exactly are enumerated, their repeat counts fitted to the
   histogram by non-negative least squares, and rounded down.  Best fit decreasing over the
   remaining histogram packs the residuals, as patterns too.
3. The plan says: of length L, pieces number lo to hi go to sequences base, base + 1, ... at an
   offset.  It grows with the number of lengths, not of documents.  A task's numbers become
   numbers over all tasks by adding the counts of the tasks before it, and a lookup in the plan
   places the piece.  No group of documents ever meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import cut, doc_text, per_worker

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class Encoder:
    """Ids as the tokenizers file gives them (special strings included).

    tiktoken encodes the same vocabulary several times as fast; the two agree on texts without
    special strings (tests compare them).  Texts with one go to tokenizers itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces_of(docs: DataFrame, encoder, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: ids, then ``end_id``; only documents above ``capacity`` are cut,
    and of these only the first piece may be shorter.  ``encoder``: makes an Encoder in a task."""

    def run(batches):
        encode = per_worker(("encoder", encoder.__name__), encoder)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                start = 0
                piece = 0
                while start < len(ids):
                    stop = start + capacity if start else first
                    n = stop - start
                    for column, value in zip(out, (doc_id, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), task, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                    start = stop
                    piece += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return doc_text(docs).mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples (a <= b <= c; a is 0 in a pair) of ``lengths`` that sum to ``capacity``, as rows."""
    has = np.zeros(capacity + 1, dtype=bool)
    has[lengths] = True
    rows = []
    for a in [0, *lengths[lengths <= capacity // 3].tolist()]:
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        c = capacity - a - b
        ok = has[b] & has[c] & (c < capacity)
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)


def fit(hist: np.ndarray, capacity: int, rounds: int = 40, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: patterns and repeat counts (not yet rounded).

    Each round adds the patterns with the steepest gradients that share no length, solves for
    the active ones by conjugate gradients, and drops those that would turn negative.
    """
    pats = patterns(np.flatnonzero(hist[:capacity]), capacity)
    h = hist[: capacity + 1].astype(float)
    h[0] = 0
    if not len(pats):
        return pats, np.zeros(0)

    def apply(p, x):
        return np.bincount(p.ravel(), weights=np.repeat(x, 3), minlength=capacity + 1) * (np.arange(capacity + 1) > 0)

    def transposed(p, r):
        return r[p].sum(axis=1)  # r[0] is 0

    active = np.zeros(0, dtype=np.int64)
    x = np.zeros(0)
    for _ in range(rounds):
        gradient = transposed(pats, h - apply(pats[active], x))
        gradient[active] = -1
        best = np.argpartition(-gradient, min(8 * width, len(gradient) - 1))[: 8 * width]
        best = best[np.argsort(-gradient[best], kind="stable")]
        used = np.zeros(capacity + 1, dtype=bool)
        new = []
        for i in best:
            a, b, c = pats[i]
            if gradient[i] <= 0.5 or len(new) == width:
                break
            if not ((a and used[a]) or used[b] or used[c]):
                new.append(i)
                used[[b, c]] = True
                used[a] = a > 0
        if not new:
            break
        active, x = np.concatenate([active, new]), np.concatenate([x, np.zeros(len(new))])
        for _ in range(20):
            p = pats[active]
            r = transposed(p, h - apply(p, x))
            z, d, rr = x.copy(), r.copy(), r @ r
            for _ in range(60):
                if rr < 1e-6 * (h @ h + 1):
                    break
                q = transposed(p, apply(p, d))
                step = rr / (d @ q)
                z += step * d
                r -= step * q
                d, rr = r + d * ((r @ r) / rr), r @ r
            if z.min() >= 0:
                x = z
                break
            low = z < 0
            t = np.min(x[low] / np.maximum(x[low] - z[low], 1e-12))
            x = np.maximum(x + t * (z - x), 0)
            keep = (x > 1e-9) | ~low
            active, x = active[keep], x[keep]
    return pats[active], x


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: (lengths in a sequence, repeats).  Sequences of equal
    contents are one entry, so the work grows with the number of lengths, not of pieces."""
    bins: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [contents, repeats]
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity, 0, -1):
        left = int(hist[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                # new sequences, each filled with as many of this length as will stay
                each = min(capacity // length, left)
                n = left // each
                room = capacity - each * length
                bins[room].append([(length,) * each, n])
                rooms[room] += n
                left -= n * each
                continue
            room = length + int(fits[0])
            contents, n = bins[room][-1]
            each = min(room // length, left)
            take = min(n, left // each)
            if take == n:
                bins[room].pop()
            else:
                bins[room][-1][1] -= take
            rooms[room] -= take
            rest = room - each * length
            bins[rest].append([contents + (length,) * each, take])
            rooms[rest] += take
            left -= take * each
    return [(tuple(c), n) for group in bins for c, n in group]


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats) that use each length exactly as often as ``hist`` has it."""
    left = hist.astype(np.int64).copy()
    out = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    pats, x = fit(left, capacity)
    for i in np.argsort(-x, kind="stable"):
        contents = tuple(int(v) for v in pats[i][::-1] if v)
        n = int(x[i])
        for v in set(contents):
            n = min(n, int(left[v]) // contents.count(v))
        if n > 0:
            out.append((contents, n))
            for v in contents:
                left[v] -= n
    return out + best_fit(left, capacity)


def pack(docs: DataFrame, encoder, capacity: int = 2048) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text
    is one piece that holds only the end id.  Rows that repeat a doc_id are packed each.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, encoder, capacity))
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        hist[row["length"]] = row["n"]
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    base = 0
    for contents, n in plan(hist, capacity):
        offset = 0
        for length in contents:
            ranges.setdefault(length, []).append((int(used[length]), int(used[length]) + n, base, offset))
            used[length] += n
            offset += length
        base += n
    step_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("lo", "hi", "base", "offset")]))
    # from Arrow: a list of rows would start Python workers of another kind, which stay
    steps = spark.createDataFrame(pa.table({"length": pa.array(list(ranges), pa.int64()), "steps": pa.array([[dict(zip(("lo", "hi", "base", "offset"), r, strict=True)) for r in v] for v in ranges.values()], step_type)}))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # steps has a row per length, capacity at most, whatever the input
    placed = pieces.join(before, ["task", "length"]).join(F.broadcast(steps), "length").withColumn("nth", F.col("nth") + F.col("before"))
    step = F.filter("steps", lambda s: (s["lo"] <= F.col("nth")) & (F.col("nth") < s["hi"]))[0]
    return placed.withColumn("at", step).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at.base") + F.col("nth") - F.col("at.lo")).alias("sequence_id"), F.col("at.offset").alias("offset"))
