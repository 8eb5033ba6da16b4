import zlib

import numpy as np
from pyspark import SparkContext
from tokenizers import Tokenizer

from tidefold.llm import packing
from tidefold.llm.queries import byte_bpe, tokenizer


def test_pieces_and_places(spark, nasty):
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for docs in (nasty.where("doc_id IS NOT NULL"), small):
        rows = packing.pack(docs, byte_bpe, 2048).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
            edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            want += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
        filled = {}
        for r in rows:
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(filled) <= sum(w[3] for w in want) / 2048 * 1.02 + 2


def test_plan_uses_every_length_exactly():
    rng = np.random.default_rng(3)
    for capacity, n in ((16, 50), (64, 5000), (2048, 20_000)):
        hist = np.bincount(np.minimum(capacity, rng.geometric(3 / capacity, n)), minlength=capacity + 1)
        used = np.zeros(capacity + 1, np.int64)
        bins = 0
        for contents, k in packing.plan(hist, capacity):
            assert sum(contents) <= capacity and k > 0
            bins += k
            for length in contents:
                used[length] += k
        assert (used == hist).all()
        assert bins <= np.ceil((hist * np.arange(capacity + 1)).sum() / capacity) * 1.01 + 1


def test_patterns_are_all_exact_fills():
    got = {tuple(p) for p in packing.patterns(np.array([1, 2, 3, 5, 6]), 8).tolist()}
    want = {(0, a, b) for a in (1, 2, 3, 5, 6) for b in (1, 2, 3, 5, 6) if a <= b and a + b == 8}
    want |= {(a, b, c) for a in (1, 2, 3, 5, 6) for b in (1, 2, 3, 5, 6) for c in (1, 2, 3, 5, 6) if a <= b <= c and a + b + c == 8}
    assert got == want


def test_plan_starts_no_python_workers(spark, nasty, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("rows of the plan pass through Python workers")

    docs = nasty.where("doc_id IS NOT NULL")
    n = docs.count()
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert packing.pack(docs, byte_bpe, 2048).where("piece = 0").count() == n
