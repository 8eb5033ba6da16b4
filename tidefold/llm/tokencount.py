"""Token counts: lengths only, from Arrow batches balanced by bytes.

Whole texts are encoded.  A text above ``split_bytes`` is cut at *safe boundaries*, where the
counts of the parts add up to the count of the whole:

* sentencepiece: an ASCII space between two ASCII letters or digits.  The space itself is left
  out, as the dummy prefix of the next part stands for it.  No piece of the vocabulary has the
  space mark behind another character (checked when the model is loaded), so no merge crosses.
* byte-level BPE (tokenizers): before an ASCII space that stands between two ASCII letters; the
  pre-tokenizer always breaks there.  Other tokenizers files are never split.

Nulls count as empty texts (0 tokens), and each input row gives one row, repeated or not.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.llm.common import doc_text, per_worker
from tidefold.llm.words import slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _counter(model: str):
    """A function from a list of texts to token counts, and the pattern of safe boundaries (or None)."""
    if model.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        safe = sp.encode("a", out_type=str)[0].startswith("▁") and not any(re.search("[^▁]▁", p) for p in pieces)
        return (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), (re.compile(r"(?<=[A-Za-z0-9])( )(?=[A-Za-z0-9])") if safe else None)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(model)
    tok.no_truncation()
    tok.no_padding()
    byte_level = "ByteLevel" in str(tok.pre_tokenizer)
    return (lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]), (re.compile(r"(?<=[A-Za-z])()(?= [A-Za-z])") if byte_level else None)


def parts_of(text: str, boundary: re.Pattern | None, least: int) -> list[str]:
    """``text`` cut at the first safe boundary after each ``least`` characters."""
    if boundary is None or len(text) <= least:
        return [text]
    parts, start = [], 0
    while len(text) - start > least and (m := boundary.search(text, start + least)):
        parts.append(text[start : m.start(1)])
        start = m.end(1)
    return [*parts, text[start:]]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, split_chars: int = 8192, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``model`` is the path of a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file that
    every executor has.  At most ``batch_bytes`` bytes (or one part) are encoded at once.
    """

    def run(batches):
        count, boundary = per_worker(("counter", model), lambda: _counter(model))
        for batch in batches:
            for some in slices(batch, batch_bytes):
                texts = some.column("text").to_pylist()
                total = [0] * len(texts)
                rows: list[int] = []
                parts: list[str] = []
                size = 0

                def flush():
                    nonlocal size
                    for row, n in zip(rows, count(parts), strict=True):
                        total[row] += n
                    rows.clear()
                    parts.clear()
                    size = 0

                for row, text in enumerate(texts):
                    for part in parts_of(text, boundary, split_chars):
                        rows.append(row)
                        parts.append(part)
                        size += len(part) if part.isascii() else len(part.encode())
                        if size >= batch_bytes:
                            flush()
                if parts:
                    flush()
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").cast(pa.int64()),
                        pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array([n > limit for n in total], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return doc_text(docs).mapInArrow(run, SCHEMA)
