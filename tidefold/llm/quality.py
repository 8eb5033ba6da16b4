"""Quality rules: base rules, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed words and word pairs: one of trusted documents, one of the whole raw
corpus.  A document's score is the mean, over its n-grams, of log(p_trusted / p_raw); it is kept
if no base rule fails and the score reaches a threshold.

* The raw counts cover every document.  Every labelled row takes part: a fifth of all ids (by hash)
  checks, the trusted ones of the other four fifths are the trusted side.
* The threshold is fitted on all labelled rows that check, none of which is on the trusted side: of
  all cuts that keep at least ``keep`` of the trusted ones, the one that rejects most of the others,
  set in the middle of the gap to the next score.  Its two order statistics are exact and found by
  Spark.  Without labelled rows nothing but the base rules decides.
* Labels are joined by merging, however few they are, so what is shuffled (the texts, by doc_id)
  grows as the table does.
* Tables of counts and of log ratios have ``2**bits`` entries, whatever the corpus.

Nulls count as empty texts: 0 words, base_failed.  A row without n-grams scores 0.  Each input row
gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import cut, doc_text, per_worker, stored
from tidefold.llm.words import Words, by_size, grams, slices, text_bytes

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
GROUP_CHARS = 1 << 20


def features(texts: list[bytes], words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, repeated words per text, buckets of all n-grams, text of each n-gram)."""
    w, counts = words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    # windows of 8 words: a window's text takes part in its hash, so equal means equal within a text
    h, at = grams(w, owner, 8)
    _, which, often = np.unique(h + owner[at].astype(np.uint64), return_inverse=True, return_counts=True)
    again = at[often[which] > 1]
    edge = np.bincount(again, minlength=len(w) + 9) - np.bincount(again + 8, minlength=len(w) + 9)
    covered = np.cumsum(edge)[: len(w)] > 0
    repeats = np.bincount(owner[covered], minlength=len(texts))
    pair, pair_at = grams(w, owner, 2)
    shift = np.uint64(64 - bits)
    return counts, repeats, np.concatenate([w >> shift, pair >> shift]).astype(np.int64), np.concatenate([owner, owner[pair_at]])


def _counts(docs: DataFrame, trusted: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket in all documents, and in the trusted ones."""

    def run(batches):
        words = per_worker(("words", False), Words)
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch):
                flags = np.array(part.column("trusted").to_pylist(), dtype=bool)
                w, counts = words(text_bytes(part))
                owner = np.repeat(np.arange(len(counts)), counts)
                pair, pair_at = grams(w, owner, 2)
                bucket = (np.concatenate([w, pair]) >> np.uint64(64 - bits)).astype(np.int64)
                raw += np.bincount(bucket, minlength=1 << bits)
                good += np.bincount(bucket[flags[np.concatenate([owner, owner[pair_at]])]], minlength=1 << bits)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    flagged = doc_text(docs).join(trusted.withColumn("trusted", F.lit(True)).hint("merge"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = flagged.mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    for row in sums.collect():  # 2**bits rows at most
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log(p_good / p_raw) of each bucket.  The corpus itself smooths the trusted side: a bucket
    that it lacks gets ``smooth`` times the corpus's share of a count of 1 a bucket."""
    if not good.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 1) / (raw + 1).sum()
    prior = smooth * len(raw) * p_raw
    return np.log((good + prior) / (good.sum() + prior.sum())) - np.log(p_raw)


def measures(texts: list[str], words: Words, table: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and score of each text."""
    bits = len(table).bit_length() - 1
    raw = [t.encode() for t in texts]
    out = []
    for start, stop in by_size(raw, GROUP_CHARS):
        part = raw[start:stop]
        counts, repeats, bucket, owner = features(part, words, bits)
        total = np.bincount(owner, weights=table[bucket], minlength=len(part))
        grams_n = np.bincount(owner, minlength=len(part))
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in part]
        out.append(
            [
                counts,
                np.array([len(t) - len(b) + len(b.translate(None, SPACE)) for t, b in zip(texts[start:stop], part, strict=True)]),
                np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in part]),
                np.array([len(x) - len(set(x)) for x in lines]),
                repeats,
                total / np.maximum(grams_n, 1),
            ]
        )
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]


def measured(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Base counts and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**bits doubles

    def run(batches):
        words = per_worker(("words", False), Words)
        for batch in batches:
            for part in slices(batch):
                columns = measures(part.column("text").to_pylist(), words, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(pa.array, columns)], names=[x.split()[0] for x in COLUMNS.split(", ")])

    return doc_text(docs).mapInArrow(run, COLUMNS)


def threshold(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The cut that keeps at least ``keep`` of ``good`` and rejects most of ``bad``."""
    if not len(good):
        return -np.inf
    good = np.sort(good)
    top = good[int((1 - keep) * len(good))]
    below = bad[bad < top]
    return float((below.max() + top) / 2) if len(below) else float("-inf")


def labelled(labels: DataFrame, quality: int, checks: bool) -> DataFrame:
    """All ids of that label that check, or all others; a fifth of all ids is for checks only."""
    ids = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    fold = F.pmod(F.xxhash64(F.lit("check"), "doc_id"), F.lit(5)) == 0
    return ids.where(fold if checks else ~fold)


def checking(labels: DataFrame) -> DataFrame:
    """doc_id and label (``good``) of all ids that check."""
    return labelled(labels, 1, True).withColumn("good", F.lit(True)).unionByName(labelled(labels, 0, True).withColumn("good", F.lit(False)))


def least_score(scored: DataFrame, keep: float) -> float:
    """``threshold`` over all rows of ``scored`` (score, good); only its two order statistics come back."""
    scored = cut(scored)
    good, bad = scored.where("good"), scored.where("NOT good")
    lost = int((1 - keep) * good.count())
    top = good.orderBy("score").limit(lost + 1).agg(F.max("score")).head()[0]
    if top is None:
        return threshold(np.zeros(0), np.zeros(0), keep)
    below = bad.where(F.col("score") < F.lit(top)).agg(F.max("score")).head()[0]
    return threshold(np.array([top]), np.array([] if below is None else [below]), 1.0)


def fit(docs: DataFrame, labels: DataFrame, bits: int = 14) -> np.ndarray:
    """Log ratios by bucket."""
    return log_ratios(*_counts(docs, labelled(labels, 1, False), bits))


def _base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, bits: int = 14, keep: float = 0.9995) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    rows = stored(measured(docs, fit(docs, labels, bits))).withColumn("base_failed", _base_failed())
    least = least_score(rows.where("NOT base_failed").join(checking(labels), "doc_id").select("score", "good"), keep)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= F.lit(least))).alias("kept"), "score")


def filtered(docs: DataFrame, labels: DataFrame, bits: int = 14, keep: float = 0.9995) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps.  Only texts go to Python and only a
    verdict comes back; the rows wait in the JVM.  Only documents that check are scored before."""
    ratios, checks = fit(docs, labels, bits), checking(labels)
    scored = measured(docs.join(checks.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), ratios)
    least = least_score(scored.join(checks, "doc_id").where(~_base_failed()).select("score", "good"), keep)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("boolean")
    def keeps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = per_worker(("words", False), Words)
        for texts in batches:
            out = []
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                n_words, _, _, _, repeats, score = measures(part.column("text").to_pylist(), words, shared.value)
                out.append(pa.array((n_words >= 20) & (100 * repeats <= 30 * n_words) & (score >= least)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.bool_())

    return docs.where(keeps(F.coalesce("text", F.lit(""))))
