"""Exact top-k inner products: a KD-tree per shard, searched best first.

Candidates are dealt into shards of about ``shard_rows`` rows.  A shard's task builds a KD-tree
(median splits of the widest dimension, tight bounding boxes) and answers all queries in blocks.
For a block, nodes are visited in the order of their largest bound (the most that any of the
block's queries can score in the box) and a node is entered only by queries whose bound reaches
their k-th score.  Before that every query is scored in its *home* shard, and the k-th score found
there travels with the query to all other shards as its first threshold.

A shard holds ``shard_rows`` vectors at most by construction of the deal (a pure hash of vec_id
modulo the number of shards).  A group of a task is a shard and the queries at home there, or a
shard and a block of about ``query_rows`` queries (the shard's vectors are sent once for each
block), so a task's memory doesn't grow with the table.
Vectors that are null or hold null or non-finite components take no part; vectors of different
lengths are never compared.  Rows that repeat a vec_id are candidates each (but never for a query
of the same vec_id); as a query, the smallest of their vectors is taken.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score long"


class Tree:
    """KD-tree over integer vectors; arrays only, children of node i at left[i], right[i] (or -1)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(ids))
        self.v, self.ids = vectors, ids
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        self._build(0, len(ids), leaf_rows)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.v, self.ids = vectors[self.order], ids[self.order]

    def _build(self, start: int, stop: int, leaf_rows: int) -> int:
        rows = self.v[self.order[start:stop]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        node = len(self.span)
        self.lo.append(lo)
        self.hi.append(hi)
        self.span.append((start, stop))
        self.kids.append(None)
        if stop - start > leaf_rows and rows.shape[1] and (hi - lo).max() > 0:
            middle = (stop - start) // 2
            part = np.argpartition(rows[:, int((hi - lo).argmax())], middle)
            self.order[start:stop] = self.order[start:stop][part]
            self.kids[node] = (self._build(start, start + middle, leaf_rows), self._build(start + middle, stop, leaf_rows))
        return node

    def bounds(self, node: int, queries: np.ndarray) -> np.ndarray:
        """The most that each query can score in the node's box."""
        return np.maximum(queries, 0) @ self.hi[node] + np.minimum(queries, 0) @ self.lo[node]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


#: Stands for "no candidate yet": below any score.
NONE = np.iinfo(np.int64).min + 1  # one more, so that it can be negated
NO_ID = np.iinfo(np.int64).max


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best rows of the tree that reach ``kth``, per query (NONE: fewer)."""
    scores = np.full((len(own), k), NONE)
    ids = np.full((len(own), k), NO_ID)
    bound = tree.bounds(0, queries)
    heap = [(-bound.max(), 0, bound)] if len(own) else []
    while heap:
        _, node, bound = heapq.heappop(heap)
        live = np.flatnonzero(bound >= np.maximum(kth, scores[:, -1]))  # a tie may still bring a smaller id
        if not len(live):
            continue
        if tree.kids[node]:
            for kid in tree.kids[node]:
                b = tree.bounds(kid, queries)
                if (b >= np.maximum(kth, scores[:, -1])).any():
                    heapq.heappush(heap, (-b.max(), kid, b))
            continue
        start, stop = tree.span[node]
        s = (queries[live] @ tree.v[start:stop].T).astype(np.int64)
        i = np.broadcast_to(tree.ids[start:stop], s.shape)
        same = i == own[live, None]
        s = np.where(same, NONE, s)
        if stop - start > 4 * k:  # only those that reach the k-th of this leaf can matter
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            width = int((s >= least[:, None]).sum(axis=1).max())
            if width < s.shape[1] // 2:
                top = np.argpartition(-s, width - 1, axis=1)[:, :width]
                s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        i = np.where(s == NONE, NO_ID, i)
        scores[live], ids[live] = best(np.concatenate([scores[live], s], axis=1), np.concatenate([ids[live], i], axis=1), k)
    return scores, ids


def exact(vectors: np.ndarray) -> np.ndarray:
    """Doubles where every inner product stays below 2**53, else 64-bit integers (slower)."""
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype(np.float64) if most * most * max(1, vectors.shape[1]) < 1 << 52 else vectors


def usable(table: DataFrame) -> DataFrame:
    """vec_id and v (floor(256 * x) of each component), without rows that take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda e: F.floor(F.lit(256.0) * e))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def dealt(table: DataFrame, every: int, shard_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Candidates with their shard, and queries with their home shard and block; both with the numbers of shards and blocks."""
    rows = usable(table).withColumn("dim", F.size("v"))
    query = F.pmod("vec_id", F.lit(every)) == 0
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.greatest(F.ceil(F.count_if(query) / query_rows), F.lit(1)).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    candidates = rows.join(sizes, "dim").withColumn("shard", home)
    queries = rows.where(query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).join(sizes, "dim")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")
    return candidates, queries.select(F.col("vec_id").alias("query_id"), "v", "dim", "shards", "blocks", home.alias("shard"), block.alias("block"))


def top_k(table: DataFrame, every: int = 50, k: int = 5, shard_rows: int = 2048, leaf_rows: int = 128, block_rows: int = 512, query_rows: int = 2048) -> DataFrame:
    """The k highest integer inner products of each query row (vec_id divisible by ``every``).

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    candidates, asks = dealt(table, every, shard_rows, query_rows)

    def at(frames: DataFrame, asks: DataFrame) -> DataFrame:
        """Each query of ``asks`` against the shard that it names, block by block."""

        def one(key, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(data) and len(ask):
                vectors = np.stack(data["v"].to_numpy()).reshape(len(data), -1)
                asked = np.stack(ask["v"].to_numpy()).reshape(len(ask), -1)
                both = exact(np.concatenate([vectors, asked]))
                tree = Tree(both[: len(data)], data["vec_id"].to_numpy(), leaf_rows)
                for start in range(0, len(ask), block_rows):
                    part = ask.iloc[start : start + block_rows]
                    own = part["query_id"].to_numpy()
                    s, i = search(tree, both[len(data) + start : len(data) + start + len(part)], own, part["kth"].to_numpy(), k)
                    r, c = np.nonzero(s != NONE)
                    out.append(pd.DataFrame({"query_id": own[r], "vec_id": i[r, c], "score": s[r, c]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

        return frames.groupBy("dim", "shard", "block").cogroup(asks.groupBy("dim", "shard", "block")).applyInPandas(one, FOUND)

    first = at(candidates.select("dim", "shard", F.lit(0).alias("block"), "vec_id", "v"), asks.select("dim", "shard", F.lit(0).alias("block"), "query_id", "v", F.lit(NONE).alias("kth")))
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(NONE)).alias("kth"))
    others = asks.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE)))
    others = others.withColumn("home", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard != home")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    rest = at(candidates.where("shards > 1").select("dim", "shard", every_block, "vec_id", "v"), others.select("dim", "shard", "block", "query_id", "v", "kth"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
