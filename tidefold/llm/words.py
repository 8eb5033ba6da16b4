"""Words of many texts as one array of 64-bit hashes, for numpy over whole batches.

``bytes.split()`` splits at exactly ``[\\x20\\x09-\\x0D]`` and ``bytes.lower()`` lowers exactly A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tidefold.llm.common import per_worker

#: Odd multipliers of a 64-bit mixer (fixed values).
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S = np.uint64(33)


class _Hashes(dict):
    """Word to hash; forgets all when it holds ``most`` words, so memory stays bounded."""

    most = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> S)) * M1
    x = (x ^ (x >> S)) * M2
    return x ^ (x >> S)


def by_size(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``size`` bytes of text (or one row), so that only a part at a
    time is turned into Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


class Words:
    """Hashes of the words of texts; one bounded cache serves all operators of a worker."""

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.cache = per_worker(("hashes",), _Hashes)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words of each text)."""
        get = self.cache.__getitem__
        lists = [(t.lower() if self.lower else t).split() for t in texts]
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        arrays = [np.fromiter(map(get, x), dtype=np.uint64, count=len(x)) for x in lists]
        return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)), counts


def grams(w: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay within one owner, and where they start."""
    if len(w) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = len(w) - n + 1
    h = w[:stop].copy()
    for k in range(1, n):
        h *= M1
        h += w[k : k + stop]
    at = np.flatnonzero(owner[:stop] == owner[n - 1 :])
    return mixed(h[at]), at
