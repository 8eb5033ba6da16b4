import re

from samples import documents, prose

from tidefold.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check(docs, rows):
    sizes, taken = {}, {}
    texts = sorted((r["doc_id"] is None, r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in rows) == texts
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    goal = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * (1 + goal[r["source"]])
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 8 for s in goal), (taken, goal)


def test_targets_and_quotas(spark, nasty, small):
    hot = documents(spark, [(i, prose(i, 5 + i % 60), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)])
    for docs in (nasty, spark.read.parquet(f"{small}/documents.parquet"), hot):
        rows = mixing.mix(docs).collect()
        check(docs, rows)
        assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, rows))


def test_all_sizes_zero(spark):
    rows = mixing.mix(documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in rows} == {(0, 0.0, 0)}


def test_apportion_is_sainte_lague(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 7, "e": 0}
    for seats in (0, 1, 7, 100, 12_345):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max((v / (2 * won[k] + 1), k == "a", k == "b") for k, v in votes.items())[0]
            won[min(k for k, v in votes.items() if v / (2 * won[k] + 1) == best)] += 1
        df = spark.createDataFrame([(k, float(v), seats) for k, v in votes.items()], "k string, v double, seats long")
        assert {r["k"]: r["quota"] for r in mixing.apportion(df, [], ["k"], "v", "seats").collect()} == won
