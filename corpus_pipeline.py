"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and gets what the one before it kept, with
all columns of documents (and any others, whatever their names).  Decisions take effect:

1. quality: documents that the rules reject go.
2. near_dedup: one document of each group of near-copies stays (that of the smallest doc_id).
   Near copies are op3's: 85 % of their shingles of three words are shared.  Of rows that repeat a doc_id and text one stays; rows without a doc_id can't be named, and stay.
3. secrets: every span found is masked in the text, and n_chars follows.
4. mixing: a document stays as often as the mix takes it, as a whole row each time; where the mix
   takes part of a document, the nearer whole number counts.  Rows alike in doc_id, source and text
   share what is taken of them evenly.
5. packing: rows are the pieces and where they go.

``run`` writes each stage's rows to the shared folder, so that no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import minhash, mixing, packing, quality, secrets
from tidefold.llm.common import stored, table
from tidefold.llm.queries import byte_bpe


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, digest = unused(docs, "kept_id"), unused(docs, "digest")
    ids = minhash.near_duplicates(docs.where("doc_id IS NOT NULL")).where("kept").select(F.col("doc_id").alias(named))
    kept = docs.join(ids, F.col("doc_id") == F.col(named), "left_semi")
    once = kept.withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest])
    return once.select(*[once[c] for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = mixing.mix(docs).where("size > 0").groupBy("doc_id", "source", "text_hash")
    times = mix.agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times")).where("times > 0")
    names = {c: unused(docs, c) for c in times.columns}
    times = times.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = docs["doc_id"].eqNullSafe(times[names["doc_id"]]) & docs["source"].eqNullSafe(times[names["source"]]) & (F.xxhash64(docs["text"]) == times[names["text_hash"]])
    again = docs.join(times, same)
    return again.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times[names["times"]])).alias(unused(docs, "nth"))).select(*[F.col(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe, 2048)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages (hashes, signatures, tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
