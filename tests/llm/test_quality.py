import re
from collections import Counter

import numpy as np
from samples import prose

from tidefold.llm import quality

W = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(W, text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(W, x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_against_brute_force(spark, nasty, labels, small):
    for docs, lab in ((nasty, labels), (spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))):
        rows = quality.judge(docs, lab).collect()
        texts = docs.select("doc_id", "text").collect()
        key = lambda t: tuple((x is None, x) for x in t)
        got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows), key=key)
        assert got == sorted(((r["doc_id"], *base(r["text"])) for r in texts), key=key)
        assert not any(r["base_failed"] and r["kept"] for r in rows)


def test_ratios_and_scores(spark):
    raw, good = np.array([10.0, 0, 5, 1]), np.array([5.0, 0, 0, 1])
    ratio = quality.log_ratios(raw, good)
    p = (raw + 1) / (raw + 1).sum()
    prior = 4 * p
    assert np.allclose(ratio, np.log((good + prior) / (good + prior).sum() / p))
    assert (quality.log_ratios(raw, np.zeros(4)) == 0).all()


def test_threshold_keeps_and_rejects():
    good, bad = np.linspace(1, 2, 1000), np.linspace(-1, 0.5, 100)
    least = quality.threshold(good, bad, 0.999)
    assert 0.5 < least <= good[1]
    assert quality.threshold(np.zeros(0), bad, 0.9) == -np.inf


def test_junk_goes_and_clean_documents_stay(spark):
    docs = [(i, prose(i, 80)) for i in range(600)] + [(1000 + i, " ".join(f"zq{(7 * i + j) % 50}x" for j in range(60))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000 + i, 0) for i in range(60)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(df, lab).where("kept").collect()}
    assert kept == set(range(600))


def test_every_label_counts(spark):
    from pyspark.sql import functions as F

    lab = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    checks = quality.checking(lab)
    assert checks.count() + quality.labelled(lab, 1, False).count() == 60_000 and checks.count() > 10_000
    # the threshold of all rows, as of arrays
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, 9000), rng.normal(-1, 1, 5000)
    rows = spark.createDataFrame([(float(x), True) for x in good] + [(float(x), False) for x in bad], "score double, good boolean")
    assert quality.least_score(rows, 0.9995) == quality.threshold(good, bad, 0.9995)
    assert quality.least_score(rows.where("NOT good"), 0.9995) == -np.inf
    assert quality.least_score(rows.where("good"), 0.9995) == -np.inf
