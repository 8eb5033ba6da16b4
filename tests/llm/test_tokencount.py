import pytest
from samples import NASTY, prose

from tidefold.llm import tokencount
from tidefold.llm.queries import tokenizer


def direct(name):
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(name))
        return lambda t: len(sp.encode(t))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer(name))
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts(spark, nasty, small, name):
    one = direct(name)
    long = spark.createDataFrame([(1, prose(1, 9000)), (2, "a " * 9000), (3, "x" * 30_000), (4, "a  b\n\n c <s> ▁ x" * 2000), (5, "1 2 3" * 5000)], "doc_id long, text string")
    for docs in (nasty, spark.read.parquet(f"{small}/documents.parquet"), long):
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs, tokenizer(name)).collect()))
        want = []
        for r in docs.select("doc_id", "text").collect():
            t = r["text"] or ""
            n = one(t)
            want.append((r["doc_id"] is None, r["doc_id"] or 0, len(t.encode()), n, n > 4096))
        assert got == sorted(want)


def test_parts_join_to_the_whole():
    _, boundary = tokencount._counter(tokenizer("byte_bpe_50k.json"))
    for _, text, *_ in NASTY:
        assert "".join(tokencount.parts_of(text or "", boundary, 50)) == (text or "")
