"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds its distinct word shingles (64-bit hashes).  Every element has a permutation
of the signature's slots, taken from its hash: slot = (a + rank * b) mod slots, slots prime, b not
0.  Two slots' ranks are distributed as under a uniformly random permutation, which is all that a
signature's variance depends on.  Slot by slot the element of least rank wins (ties: least hash).
Ranks are worked off level by level for a whole batch; a document stops as soon as all its slots
are taken, after one or two levels if it is long.

Documents with equal sets form classes first, so copies cost nothing later.  Signatures are cut
into bands; classes that share a band, at sizes that allow the threshold, are candidates:

1. Each class is tied to the least class of each of its bands (a star, not all pairs).  Components
   of these ties are *families*; a link never leaves a family that shares a band with it.
2. A family's sets are cut into blocks, and each pair of blocks is verified in a task: exact
   intersections of all its sets by products of 0/1 matrices over shared shingles.  Only a spanning
   forest of the links found leaves the task, so pairs are never emitted.
3. Union-find, within tasks and then between them, labels the components of these links.

With 32 bands of 6 slots a link at the threshold of 0.85 shares no band with a chance of 3 in 10
million.

Words: as ``common``; A-Z are lowered.  With fewer words than a shingle has, the whole sequence is
the one shingle.  Without words, and for null texts, the set is empty and linked with nothing.
A null doc_id has no component of its own name: such a row joins the class of its text if that has
another row, else its component is null and it is kept.  Rows that repeat a doc_id are told apart
by their texts only; as nodes of the graph they are one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import cut, doc_text, per_worker, stored
from tidefold.llm.graph import components, star_components, union_find
from tidefold.llm.words import M1, M2, Words, grams, mixed, slices, text_bytes


def shingle_sets(texts: list[bytes], words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, concatenated, and their numbers."""
    w, counts = words(texts)
    ends = np.cumsum(counts)
    sets = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        own = w[end - count : end]
        if count >= n:
            sets.append(np.unique(grams(own, np.zeros(count, np.int8), n)[0]))
        elif count:
            sets.append(grams(np.concatenate([own, np.full(1, count, np.uint64)]), np.zeros(count + 1, np.int8), count + 1)[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set (rows of non-empty sets only are filled)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(elements)[::-1]  # in a later assignment to one place, the least hash is the last
    h, owner = elements[order], owner[order]
    spread = mixed(h ^ M2)
    m = np.uint64(slots)
    a = (spread % m).astype(np.int64)
    b = (1 + (spread >> np.uint64(32)) % (m - np.uint64(1))).astype(np.int64)
    base = owner * slots
    out = np.zeros(len(sizes) * slots, np.uint64)
    taken = np.zeros(len(sizes) * slots, bool)
    at = a.copy()
    for _ in range(slots):
        place = base + at
        free = ~taken[place]
        out[place[free]] = h[free]
        taken[place[free]] = True
        open_ = ~taken.reshape(-1, slots).all(axis=1)
        more = open_[owner]
        if not more.any():
            break
        if not more.all():
            owner, base, at, b, h = owner[more], base[more], at[more], b[more], h[more]
        at = at + b
        at[at >= slots] -= slots
    return out.reshape(-1, slots)


def sketches(docs: DataFrame, n: int, bands: int, rows: int, slots: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (the set's 128-bit key) and bands."""

    def run(batches):
        words = per_worker(("words", True), lambda: Words(lower=True))
        for batch in batches:
            for part in slices(batch):
                elements, sizes = shingle_sets(text_bytes(part), words, n)
                full = np.flatnonzero(sizes)
                firsts = (np.cumsum(sizes) - sizes)[full]
                keys = []
                for seed in (M1, M2):
                    key = np.zeros(len(sizes), np.uint64)
                    if len(full):
                        key[full] = np.add.reduceat(mixed(elements + seed), firsts)
                    keys.append(pa.array(key.view(np.int64)))
                sig = signatures(elements, sizes, slots)
                used = sig[:, : bands * rows].reshape(len(sizes), bands, rows)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sizes), bands)).copy()
                for k in range(rows):
                    band = mixed(band * M1 + used[:, :, k])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32), pa.array(band[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes), *keys, lists], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and its sorted set as bytes, 8 for each shingle."""

    def run(batches):
        words = per_worker(("words", True), lambda: Words(lower=True))
        for batch in batches:
            for part in slices(batch):
                elements, sizes = shingle_sets(text_bytes(part), words, n)
                blobs = [x.tobytes() for x in np.split(elements, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])

    return doc_text(docs).mapInArrow(run, "doc_id long, shingles binary")


def common_sizes(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs, by products of 0/1 matrices over shared shingles only."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, often = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    shared = often[place] > 1
    owner, place = owner[shared], number[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        some = slice(*np.searchsorted(place, (low, low + columns)))
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[some], place[some] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


def linked(ids: np.ndarray, sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links that join all of a block's documents that are linked, by union-find: a spanning forest."""
    both = common_sizes(sets)
    sizes = np.array([len(s) for s in sets])
    rows, cols = np.nonzero(np.triu(100 * both >= per_cent * (sizes[:, None] + sizes[None, :] - both), 1))
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(rows.tolist(), cols.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            out.append((int(ids[x]), int(ids[y])))
    return out


def links(members: DataFrame, per_cent: int) -> DataFrame:
    """Stars (node, root) of the verified links within each block pair of ``members`` (family, i, j,
    rep, shingles).

    Rows arrive sorted by block pair, so a task holds one pair of blocks at a time.  Union-find runs
    in the same Python worker: a second one beside it would stay, with all its memory."""

    def run(batches):
        now, ids, sets = None, [], []

        def done():
            found = linked(np.array(ids), sets, per_cent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            for key, rep, blob in zip(keys, batch.column("rep").to_pylist(), batch.column("shingles"), strict=True):
                if key != now:
                    yield done()
                    now, ids, sets = key, [], []
                ids.append(rep)
                sets.append(np.frombuffer(blob.as_buffer(), np.uint64))
        yield done()

    return members.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").select("family", "i", "j", "rep", "shingles").mapInArrow(lambda batches: union_find(run(batches)), "node long, root long")


def near_duplicates(docs: DataFrame, n: int = 3, per_cent: int = 85, bands: int = 32, rows: int = 6, slots: int = 193, block: int = 64, most_blocks: int = 48, most_block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    sketched = stored(sketches(docs, n, bands, rows, slots))
    classes = sketched.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = stored(classes.where("rep IS NOT NULL"))

    # bands of one size class and the next, so that members of a band can be linked by size
    step = F.floor(F.log(F.col("size")) / math.log(100 / per_cent) + 1e-9)
    entries = classes.select("rep", "bands", F.explode(F.array(step, step + 1)).alias("step"))
    entries = entries.select(F.explode("bands").alias("band"), "step", "rep")
    hubs = entries.groupBy("band", "step").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = entries.join(hubs, ["band", "step"]).where("rep <> hub").select("hub", "rep").distinct()
    roots = components(stars)

    families = roots.select(F.col("root").alias("family"), F.col("node").alias("rep")).unionByName(roots.select(F.col("root").alias("family"), F.col("root").alias("rep")).distinct())
    sized = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.least(F.lit(most_blocks), F.ceil(F.col("n") / block)), F.ceil(F.col("n") / most_block)).cast("int")
    families = families.join(sized.select("family", blocks.alias("blocks")), "family")
    own = sets_of(docs.select("doc_id", "text").join(families.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), n)
    members = own.join(families, F.col("doc_id") == F.col("rep")).withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("family", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "rep", "shingles")
    roots = star_components(links(members, per_cent))

    named = classes.select("k1", "k2", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    out = sketched.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
