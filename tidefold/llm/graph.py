"""Connected components of a table of links, for graphs of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import cut


def gathered(batches, links: int = 10_000):
    """Small batches joined to some of ``links`` rows at least, so that more is contracted at once."""
    some, n = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            n += batch.num_rows
        if n >= links:
            yield pa.concat_batches(some)
            some, n = [], 0
    if some:
        yield pa.concat_batches(some)


def union_find(batches):
    """Links (a, b) of one batch to a forest of stars (node, root), root the least of its tree."""
    for batch in gathered(batches):
        parent: dict[int, int] = {}

        def root(x):
            top = x
            while (p := parent.setdefault(top, top)) != top:
                top = p
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in list(parent) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``star_components`` of links (a, b), which union-find contracts an Arrow batch at a time."""
    return star_components(links.toDF("a", "b").mapInArrow(union_find, "node long, root long"))


def star_components(stars: DataFrame, salts: int = 32) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the least node of the component.

    ``stars``: what ``union_find`` made of each task's links.  Between tasks, each round
    gives a node the least of its roots, links its other roots to that one, and follows roots of
    roots, until nothing changes.  Star-shaped groups settle in two or three rounds.  A root that
    most nodes share is looked up under ``salts`` keys, so its nodes spread over as many tasks.
    """
    stars = cut(stars.distinct())
    while True:
        least = stars.groupBy("node").agg(F.min("root").alias("least"))
        joined = stars.join(least, "node")
        others = joined.where("root != least").select(F.col("root").alias("node"), F.col("least").alias("root"), F.lit(1).alias("moved"))
        own = least.select("node", F.col("least").alias("root"), F.lit(0).alias("moved"))
        roots = stars.select(F.col("root").alias("node")).distinct()  # of these, few have roots themselves
        up = least.join(roots, "node", "left_semi").select(F.col("node").alias("root"), F.col("least").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        new = own.unionByName(others).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(up, ["root", "salt"], "left")
        new = new.select("node", F.coalesce("up", "root").alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(F.col("moved")).alias("moved"))
        new = cut(new.where("node != root").groupBy("node", "root").agg(F.max("moved").alias("moved")))
        stars = new.select("node", "root")
        if new.where("moved = 1").isEmpty():
            return stars
