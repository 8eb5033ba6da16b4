import numpy as np

from tidefold.llm import topk


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 12)).astype(np.float32)
    v[300:500] = v[300]  # ties
    ids = rng.permutation(2000)[:900]
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = sorted((-int(s), int(i)) for s, i in zip(whole @ whole[q], ids, strict=True) if i != ids[q])[:5]
        want += [(int(ids[q]), k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    for shard_rows in (64, 2048):
        got = topk.top_k(df, shard_rows=shard_rows, leaf_rows=16, block_rows=8)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_queries_meet_a_shard_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, size=(600, 4))
    df = spark.createDataFrame([(50 * i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    _, asks = topk.dealt(df, 50, 64, 32)
    groups = [r["count"] for r in asks.groupBy("dim", "block").count().collect()]
    assert sum(groups) == 600 and max(groups) <= 64
    got = topk.top_k(df, shard_rows=64, leaf_rows=16, block_rows=8, query_rows=32)
    want = []
    for q in range(600):
        scores = sorted((-65536 * int(s), 50 * i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        want += [(50 * q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
