"""Mixing sources to target weights by Sainte-Laguë apportionment, DataFrame functions only.

Sizes are words.  The targets share the total of all sizes by the sources' weights, none above
``most`` times its source's size (what lies above is shared again by weight).  Targets become
quotas of equal blocks of ``block`` words by highest quotients (target / (2 * seats + 1)): first
for sources, then, within a source, for shards of about ``shard_docs`` documents in proportion to
their sizes.  A shard's documents, in a seeded order, form a stream of blocks.  The quota takes the
whole stream as often as it goes, and then blocks from the stream's start; a document's share of
these blocks, plus its full repeats, is what the mix takes of it.

Only tables with a row per source or per shard are ranked as a whole; documents meet only in their
shard, of which a hot source has more; texts without a doc_id, or that share one, are dealt by the
text's hash too.  Null texts have size 0 and are never taken; a null source
is a source of its own, last in order.  Rows that repeat a doc_id count each.  If all sizes are 0,
all targets are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import WORD, cut


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: word starts are counted, so no word is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From (source, source_size): also target.  One row per source.

    Sources are filled in the order of cap / weight: the first j are at their caps if the level
    that the rest would get, (total - caps of the j) / (weights of the rest), exceeds theirs.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = reduce(lambda c, i: c.when(place == i, F.lit(weights[i])), range(1, len(weights)), F.when(place == 0, F.lit(weights[0])))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the common level is that of the first source not at its cap
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(all_rows)["level"]
    return rows.withColumn("common", level).select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))).cast("double").alias("target"))


def apportion(rows: DataFrame, within: list[str], key: list[str], share: str, seats: str) -> DataFrame:
    """Sainte-Laguë: adds ``quota``, which sums to ``seats`` within each group of ``within``.

    The highest quotients share / 1, share / 3, share / 5 ... get a seat each.  All seats but the
    last few of each row are certain (rounding moves the divisor by half a seat per row at most),
    so only those few compete, and the work doesn't grow with the number of seats.
    """
    group = Window.partitionBy(*within)
    n = F.count(F.lit(1)).over(group)
    fair = F.col(share) * F.col(seats) / F.sum(share).over(group)
    slack = n / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    sure = F.when(F.col(share) > 0, F.greatest(F.lit(0), F.floor(fair * (1 - slack)) - 2)).otherwise(0).cast("long")
    top = F.when(F.col(share) > 0, F.ceil(fair * (1 + slack)) + 2).otherwise(0).cast("long")
    rows = rows.withColumn("sure", sure).withColumn("top", top).withColumn("open", F.col(seats) - F.sum("sure").over(group))
    tries = rows.where("top > sure").select(*within, *key, share, "open", F.explode(F.sequence(F.col("sure"), F.col("top") - 1)).alias("seat"))
    quotient = F.col(share) / (2 * F.col("seat") + 1)
    ranked = tries.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(quotient.desc(), *[F.col(k).asc_nulls_last() for k in key], "seat")))
    won = ranked.where("rank <= open").groupBy(*within, *key).agg(F.count(F.lit(1)).alias("won")).select(*[F.col(k).alias(f"_{k}") for k in within + key], "won")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in within + key])
    return rows.join(won, same, "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "top", "open", "won", *[f"_{k}" for k in within + key])


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 4, shard_docs: int = 1024) -> DataFrame:
    """doc_id, source, size, text_hash, source_size, target, taken: one row per input row."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = cut(sized)  # sizes are read three times below; texts only here
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / shard_docs).cast("long").alias("shards"))
    goal = targets(by_source.select("source", "source_size"), weights, most)
    goal = goal.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    quotas = apportion(goal, [], ["source"], "target", "seats").join(by_source.select(F.col("source").alias("_source"), "shards"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "seats")
    quotas = cut(quotas)  # a row per source
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col("text_hash"))), 1, 15), 16, 10).cast("long")
    few = quotas.select(F.col("source").alias("_source"), "shards", "source_size", "target", F.col("quota").alias("source_quota"))
    dealt = sized.withColumn("at", at).join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.pmod("at", F.col("shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("seats"))
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "seats").select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", (F.col("quota") * block).alias("words"))
    stream = Window.partitionBy("source", "shard").orderBy("at", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    words = F.least("words", most * F.col("shard_size"))
    full = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    over = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    return placed.withColumn("full", full).withColumn("rest", words - F.col("full") * F.col("shard_size")).select("doc_id", "source", "size", "text_hash", "source_size", "target", (F.col("full") * F.col("size") + over).cast("long").alias("taken"))
