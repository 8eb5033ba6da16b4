import random
import re

import numpy as np
import pyarrow as pa
import pytest
from samples import documents, prose

from tidefold.llm import graph, minhash
from tidefold.llm.common import cut
from tidefold.llm.graph import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def edited(text, n, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
    return " ".join(words)


def test_against_brute_force(spark):
    rows = [(i, prose(i, 100 + i)) for i in range(30)]
    rows += [(100 + 10 * i + k, edited(prose(i, 100 + i), k, k)) for i in range(0, 30, 2) for k in range(6)]
    rows += [(900, ""), (901, None), (902, "One TWO"), (903, "one two"), (904, "x"), (905, "a b c"), (906, "A B C")]
    # a chain: neighbours are linked, the ends aren't
    words = prose(77, 200).split()
    rows += [(1000 + k, " ".join(words[8 * k : 8 * k + 120])) for k in range(8)]
    docs = documents(spark, [(i, t, "en", "web") for i, t in rows])
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == brute(rows)


def test_real_documents_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_blocks_of_a_large_family(spark):
    rows = [(i, edited(prose(5, 150), i % 4, i)) for i in range(300)]
    docs = documents(spark, [(i, t, "en", "web") for i, t in rows])
    assert sorted(map(tuple, minhash.near_duplicates(docs, block=16, most_blocks=8).collect())) == brute(rows)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    pool = rng.permutation(np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64)))
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([2000, 2000]), 1009)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.06


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(500)], "star": [(7, i) for i in range(8, 900)], "random": [(rng.randrange(600), rng.randrange(600)) for _ in range(400)]}[shape]
    rng.shuffle(links)
    parent = list(range(1000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    want = {(x, root(x)) for link in links for x in link if root(x) != x}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {tuple(r) for r in got.select("node", "root").collect()} == want


def test_a_task_has_one_python_worker(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = [(i, edited(prose(5, 150), i % 4, i)) for i in range(40)]
    got = minhash.near_duplicates(documents(spark, [(i, t, "en", "web") for i, t in rows]), block=8).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    stages = [stage for plan in plans for stage in plan.split("Exchange ")]
    assert any("MapInArrow" in s for s in stages)
    assert all(s.count("MapInArrow") <= 1 for s in stages)


def test_small_batches_are_contracted_together():
    links = [(i, i + 1) for i in range(50)]
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b}]) for a, b in links]
    stars = [(r["node"], r["root"]) for batch in graph.union_find(batches) for r in batch.to_pylist()]
    assert sorted(stars) == [(i, 0) for i in range(1, 51)]
