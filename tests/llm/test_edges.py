"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from collections import Counter

import pytest
from samples import NASTY

from tidefold.llm import chat, minhash, mixing, packing, quality, secrets, substring, tokencount, topk, toxicity
from tidefold.llm.queries import byte_bpe, tokenizer

OPS = {
    "toxicity": lambda d, lab: toxicity.score(d, lab),
    "packing": lambda d, lab: packing.pack(d, byte_bpe, 2048),
    "minhash": lambda d, lab: minhash.near_duplicates(d),
    "quality": lambda d, lab: quality.judge(d, lab),
    "filtered": lambda d, lab: quality.filtered(d, lab),
    "secrets": lambda d, lab: secrets.scan(d),
    "mask": lambda d, lab: secrets.mask(d),
    "substring": lambda d, lab: substring.repeated_passages(d),
    "mixing": lambda d, lab: mixing.mix(d),
    "tokens": lambda d, lab: tokencount.count_tokens(d, tokenizer("piece_bpe_32k.model")),
}
ONE_ROW_EACH = ["toxicity", "minhash", "quality", "secrets", "mask", "mixing", "tokens"]


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_row(nasty, labels, name):
    rows = OPS[name](nasty, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in NASTY)


@pytest.mark.parametrize("name", OPS)
def test_empty_table_gives_an_empty_result(nasty, labels, name):
    assert OPS[name](nasty.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_no_labels(nasty, labels, name):
    assert OPS[name](nasty, labels.limit(0)).count() == len(NASTY)


def test_whole_row_variants_keep_all_columns(nasty, labels):
    for name in ("mask", "filtered"):
        assert OPS[name](nasty, labels).columns == nasty.columns


def test_toxicity_of_empty_texts_is_a_score(nasty, labels):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in OPS["toxicity"](nasty, labels).collect())


def test_minhash_of_empty_and_repeated_rows(nasty, labels):
    by = {}
    for r in OPS["minhash"](nasty, labels).collect():
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[3] == by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[6] == [(1, 6, True)]
    assert by[1] == [(58, 1, True)] and by[2] == [(58, 1, False)] * 2
    assert sorted(by[None]) == [(0, None, True), (68, None, True)]


def test_tokens_of_null_are_none(nasty, labels):
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in OPS["tokens"](nasty, labels).where("doc_id = 3").collect()] == [(0, 0, False)]


def test_chat(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS turns", "'clash' AS segments")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in chat.format_chats(df).select("conv_id", chat.read_back("formatted").alias("t")).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")], 2: [("assistant", "")]}
    assert chat.format_chats(df.limit(0)).collect() == []


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.5]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' AS v", "'clash' AS dim", "'clash' AS shard")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got[:4] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 50, -65536)]
    assert topk.top_k(df.limit(0)).collect() == []
