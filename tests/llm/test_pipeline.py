"""Each stage of the corpus pipeline against a plainer version, and the whole on awkward rows."""

from collections import Counter

import corpus_pipeline as pipe
from test_minhash import brute
from test_secrets import base

from tidefold.llm import mixing, quality, secrets


def stages(spark, docs, sf_dir, folder):
    for i, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        yield name, docs, after
        docs = after


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_stages_against_brute_force(spark, small, tmp_path):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    seen = []
    for name, docs, out in stages(spark, spark.read.parquet(f"{small}/documents.parquet"), small, tmp_path):
        seen.append(name)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
            assert rows(out) == Counter({r: n for r, n in rows(docs).items() if r[0] in kept}) and 0 < out.count() < docs.count()
        elif name == "near dedup":
            kept = {i for i, _, _, keep in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if keep}
            assert rows(out) == Counter({r: n for r, n in rows(docs).items() if r[0] in kept}) and out.count() < docs.count()
        elif name == "secret scans":
            texts = {r["doc_id"]: r["text"] for r in out.collect()}
            assert len(texts) == docs.count() and not any(base(t) for t in texts.values())
            assert all(texts[r["doc_id"]] == r["text"] for r in secrets.scan(docs, whole=True).where("size(spans) = 0").select("row.*").collect())
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "mixing sources":
            want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(docs).collect() if r["taken"]}
            assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in want.items() if n})
        else:
            whole = {}
            for r in out.collect():
                whole.setdefault((r["sequence_id"], r["offset"]), []).append(r["length"])
            assert all(len(v) == 1 for v in whole.values())
            assert Counter(r["doc_id"] for r in out.where("start = 0").collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert seen == ["quality rules", "near dedup", "secret scans", "mixing sources", "best-fit packing"]


def test_awkward_rows_pass_every_stage(spark, nasty, small, tmp_path):
    for (name, stage), docs in zip(pipe.STAGES, [nasty] * 5):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{len(name)}")
        assert stage(spark, docs.limit(0), small).collect() == []
    out = {(r["doc_id"], r["text"]) for r in pipe.near_dedup(spark, nasty, small).collect()}
    assert {i for i, _ in out} == {1, 3, 4, 5, 6, 7, 8, 9, None}
    assert pipe.near_dedup(spark, nasty, small).count() == 10
