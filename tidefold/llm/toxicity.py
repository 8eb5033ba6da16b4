"""Toxicity by nearest labelled passages: exact TF-IDF cosine over a block-max inverted index.

* Examples: at most ``per_class`` labelled rows of each label (those with the smallest hashes of
  doc_id), none from the held-out fold; a text that several of them share counts once.  An example
  is cut into passages of about ``passage`` words, of which it gives ``most_passages`` at most,
  evenly spread.  These bounds on what is fitted are parameters; every other count (document
  frequencies, label rates) covers all rows, and every text that is scored is read whole.
* Terms: lower-cased runs of letters, and the first 4 and 5 letters of longer ones.  All terms of
  the passages are indexed, none is chosen by its label.  Terms that no example has can't add to any
  cosine; they are left out of a query's length too, which scales all its cosines alike.
* Weights: (1 + ln tf) * ln((N + 1) / (df + 1)), N and df over the whole corpus; unit length.
* Index: passages, ordered by their heaviest common term (so a language's lie together), in blocks.
  Lists of rare terms are added up as they are.  For terms that many passages share, each block has
  the largest weight, which bounds what they can add; blocks are then worked off from the highest
  bound on, in growing waves, until no bound reaches the k-th best cosine.  That is exact.
* Votes: a neighbour votes with its cosine, each label rescaled from its share of the passages to
  its share of all labelled training rows.  A logistic curve turns the share of the votes for label 1
  into a chance.  The curve, and k out of ``ks``, are those of least log loss over the examples, each
  voted on by all passages but its own (leave one out, so within the training folds).
* A text without any term of the index, an empty or null one too, gets the label's share.

Each input row gives one row; labels, lang, source and doc_id are never inputs of a score.  A null
doc_id is in no held-out fold and is never an example.  Without labelled training rows all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import cut, doc_text, per_worker, stored
from tidefold.llm.words import slices

LETTERS = r"[^\W\d_]+"
#: A word also counts as its stems of so many letters, so that endings don't hide it.
STEMS = (4, 5)
SCORED = "doc_id long, score double, predicted int, nearest array<long>"
#: Terms in more than this share of all passages have a column of weights rather than a list.
COMMON = 1 / 16
#: Texts that are searched together.
QUERIES = 64
#: Keeps log odds of votes finite.
EDGE = 1e-3


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def forms(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def letters(text: str) -> list[str]:
    return per_worker(("letters",), lambda: re.compile(LETTERS)).findall(text.lower())


def terms_of(text: str) -> list[str]:
    return [t for w in letters(text) for t in forms(w)]


class Places(dict):
    """What stands between blanks, to the places in the vocabulary of all forms of its runs of
    letters; keeps the first ``most`` entries."""

    most = 1 << 17

    def __init__(self, known: dict[str, int]):
        self.known = known
        self.stems = [(n, {t[:n]: p for t, p in known.items() if len(t) == n + 1 and t[n] == "-"}) for n in STEMS]

    def __missing__(self, token: str) -> tuple[int, ...]:
        bare = token.rstrip(".,:;!?")
        found = []
        for w in (bare,) if bare.isalpha() else letters(token):
            if (p := self.known.get(w)) is not None:
                found.append(p)
            for n, stem in self.stems:
                if len(w) > n and (p := stem.get(w[:n])) is not None:
                    found.append(p)
        places = tuple(found)
        if len(self) < self.most:
            self[token] = places
        return places

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places, rising, and how often each occurs; what stands again in the text is looked up once."""
        tokens = Counter(text.lower().split())
        found = [self[t] for t in tokens]
        times = np.repeat(np.fromiter(tokens.values(), np.int64, len(tokens)), np.fromiter(map(len, found), np.int64, len(found)))
        places, at = np.unique(np.fromiter(chain.from_iterable(found), np.int64, len(times)), return_inverse=True)
        return places, np.bincount(at, weights=times, minlength=len(places)).astype(np.int64)


def places_of(known: dict[str, int]) -> Places:
    """``Places`` of a broadcast vocabulary, kept for a worker's later tasks with the same one."""
    kept = per_worker(("places",), dict)
    if kept.get("known") is not known:
        kept.update(known=known, places=Places(known))
    return kept["places"]


@dataclass
class Index:
    """Unit vectors of passages: lists of rare terms, columns of common ones with block maxima."""

    idf: np.ndarray
    starts: np.ndarray  # postings of term t: starts[t] to starts[t + 1]
    rows: np.ndarray
    weights: np.ndarray
    column: np.ndarray  # of a common term in dense, or -1
    dense: np.ndarray  # block x row of the block x common term
    tops: np.ndarray  # common term x block: the largest weight
    ids: np.ndarray
    labels: np.ndarray
    scale: np.ndarray  # votes of label 0 and 1 are rescaled by
    prior: np.ndarray  # shares of the labels

    def rare_parts(self, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What the lists of rare terms add to each row, block x row of the block."""
        blocks, block, _ = self.dense.shape
        starts = self.starts[terms]
        lengths = self.starts[terms + 1] - starts
        some = np.flatnonzero(lengths)
        starts, lengths = starts[some], lengths[some]
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        added = self.weights.take(at)
        added *= np.repeat(q[some].astype(np.float32), lengths)
        return np.bincount(self.rows.take(at), weights=added, minlength=blocks * block).astype(np.float32).reshape(blocks, block)

    def nearest(self, terms: np.ndarray, tf: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest passages (ties: earlier row), cosine above 0 only; none of document ``but``."""
        return self.search([(terms, tf)], k, [but])[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several queries, whose surviving blocks are read once for all of them."""
        blocks, block, width = self.dense.shape
        parts, common = [], np.zeros((len(queries), width), np.float32)
        for i, (terms, tf) in enumerate(queries):
            q = (1 + np.log(tf)) * self.idf[terms]
            q = q / (np.sqrt(q @ q) or 1)
            column = self.column[terms]
            parts.append(self.rare_parts(terms[column < 0], q[column < 0]))
            common[i, column[column >= 0]] = q[column >= 0]
            if but and but[i] is not None:
                parts[i].reshape(-1)[np.flatnonzero(self.ids == but[i])] = -np.inf
        bounds = np.stack([p.max(axis=1) for p in parts]) + common @ self.tops
        kth = np.zeros(len(queries), np.float32)
        first = min(blocks, max(4, -(-2 * k // block)))
        if first < blocks:  # the k-th best of the most promising blocks
            for i, some in enumerate(np.argpartition(-bounds, first, axis=1)[:, :first]):
                seen = (parts[i][some] + self.dense[some] @ common[i]).ravel()
                if len(seen) > k:
                    kth[i] = max(0, np.partition(seen, len(seen) - k)[len(seen) - k])
        alive = (bounds > 0) & (bounds >= kth[:, None] - 1e-5)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        alike = np.argsort(common.argmax(axis=1), kind="stable") if width else np.arange(len(queries))
        for group in (alike[i : i + 16] for i in range(0, len(alike), 16)):
            some = np.flatnonzero(alive[group].any(axis=0))
            if 2 * len(some) > blocks:  # then a copy of these costs more than the others' products
                some = np.arange(blocks)
            held = self.dense if len(some) == blocks else self.dense[some]
            added = common[group] @ held.reshape(-1, width).T
            for i, more in zip(group.tolist(), added, strict=True):
                scores = (parts[i] if len(some) == blocks else parts[i][some]).ravel() + more
                low = kth[i] - 1e-5
                best = np.flatnonzero(scores >= low if low > 0 else scores > 0)
                values = scores[best]
                if len(best) > k:  # only the k best, and ties of the last, are sorted
                    good = values >= np.partition(values, len(best) - k)[len(best) - k]
                    best, values = best[good], values[good]
                first_k = np.argsort(-values, kind="stable")[:k]
                best = best[first_k]
                out[i] = some[best // block] * block + best % block, values[first_k].astype(float)
        return out

    def share(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the votes for label 1."""
        votes = np.bincount(self.labels[rows], weights=cosines, minlength=2) * self.scale
        return float(votes[1] / votes.sum()) if votes.sum() else float(self.prior[1])


def build(vectors: list[tuple[int, int, list[int], list[float]]], idf: np.ndarray, shares: tuple[int, int], block: int, smooth: float) -> Index:
    """``vectors``: (doc_id, label, places in the vocabulary, 1 + ln tf) of all passages."""
    prior = (np.array(shares) + smooth) / (sum(shares) + 2 * smooth)
    places = [np.asarray(v[2], dtype=np.int64) for v in vectors]
    weights = [np.asarray(v[3], dtype=float) * idf[p] for v, p in zip(vectors, places, strict=True)]
    norms = [np.sqrt(w @ w) for w in weights]
    kept = [i for i, n in enumerate(norms) if n]
    lists = np.bincount(np.concatenate([places[i] for i in kept]) if kept else np.zeros(0, np.int64), minlength=len(idf))
    often = np.flatnonzero(lists > COMMON * len(kept))
    column = np.full(len(idf), -1)
    column[often] = np.arange(len(often))

    def lead(i: int) -> int:
        seen = column[places[i]] >= 0
        return int(places[i][seen][weights[i][seen].argmax()]) if seen.any() else len(idf)

    kept.sort(key=lambda i: (lead(i), vectors[i][0], i))
    n = len(kept)
    dense = np.zeros((max(1, -(-n // block)), block, len(often)), np.float32)
    terms, at, values = (np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in ((np.int64, [places[i] for i in kept]), (np.int32, [np.full(len(places[i]), r, np.int32) for r, i in enumerate(kept)]), (np.float32, [(weights[i] / norms[i]).astype(np.float32) for i in kept])))
    common = column[terms] >= 0
    dense[at[common] // block, at[common] % block, column[terms[common]]] = values[common]
    terms, at, values = terms[~common], at[~common], values[~common]
    order = np.argsort(terms, kind="stable")
    labels = np.array([vectors[i][1] for i in kept], dtype=np.int64)
    of = np.bincount(labels, minlength=2)
    scale = prior / np.maximum(of / max(1, n), 1e-9) * (of > 0)
    starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))
    return Index(idf, starts, at[order], values[order], column, dense, dense.max(axis=1).T.copy(), np.array([vectors[i][0] for i in kept], dtype=np.int64), labels, scale, prior)


@dataclass
class Model:
    """What scoring needs: vocabulary, index, number of neighbours, and the logistic curve."""

    places: dict[str, int]
    index: Index
    k: int = 0
    slope: float = 1.0
    level: float = 0.0

    def score(self, share: float) -> float:
        return float(1 / (1 + np.exp(-self.slope * log_odds(share) - self.level)))


def log_odds(share: np.ndarray | float) -> np.ndarray | float:
    return np.log((share + EDGE) / (1 - share + EDGE))


def curve(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and mean log loss of the logistic curve of ``labels`` over log odds of ``shares``."""
    x = np.stack([log_odds(shares), np.ones(len(shares))], axis=1)
    b = np.array([1.0, 0.0])
    p = 1 / (1 + np.exp(-x @ b))
    for _ in range(50):  # Newton's method on a convex loss, with a slight pull to (1, 0)
        gradient = x.T @ (weights * (p - labels)) + 1e-3 * (b - (1, 0))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        b = b - np.clip(step, -2, 2)
        p = 1 / (1 + np.exp(-x @ b))
    p = np.clip(p, 1e-9, 1 - 1e-9)
    loss = -(weights * np.where(labels == 1, np.log(p), np.log(1 - p))).sum() / weights.sum()
    return float(max(b[0], 1e-3)), float(b[1]), float(loss)


def examples(docs: DataFrame, truth: DataFrame, per_class: int) -> DataFrame:
    """doc_id, label and text of the bounded sample of labelled rows."""
    pick = [truth.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    # 2 * per_class rows at most
    sample = doc_text(docs).join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")
    return sample.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))


def passages(sample: DataFrame, passage: int, most: int) -> pa.Table:
    """label, doc_id, terms and tf of all passages; ``most`` for each row of ``sample`` at most."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                words = letters(text)
                n = max(1, round(len(words) / passage))
                for j in [i * n // min(n, most) for i in range(min(n, most))]:
                    counts = Counter(t for w in words[j * len(words) // n : (j + 1) * len(words) // n] for t in forms(w))
                    for column, value in zip(out, (doc_id, label, list(counts), list(counts.values())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], names=["doc_id", "label", "terms", "tf"])

    return sample.mapInArrow(run, "doc_id long, label int, terms array<string>, tf array<int>").toArrow()  # a bounded sample


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32, all first bytes first, so that Parquet finds the zeros of small ones together."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def counted(docs: DataFrame, places: dict[str, int]) -> DataFrame:
    """doc_id, terms (places in the vocabulary, each as the step from the one before) and tf of every
    row, written: texts are read once, for document frequencies and scores."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        known = places_of(shared.value)
        for batch in batches:
            for part in slices(batch):
                found = [known.counts(t) for t in part.column("text").to_pylist()]
                blobs = [pa.array(x, pa.binary()) for x in ([packed(np.diff(p, prepend=0)) for p, _ in found], [packed(n) for _, n in found])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *blobs], names=["doc_id", "terms", "tf"])

    return stored(doc_text(docs).mapInArrow(run, "doc_id long, terms binary, tf binary"))


def document_frequencies(counts: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each of ``size`` terms is."""

    def run(batches):
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for blob in batch.column("terms"):
                df[np.cumsum(unpacked(blob.as_py()))] += 1
                df[-1] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(size + 1, np.int64)
    sums = counts.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row per term
    out[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, ks: tuple[int, ...], per_class: int, passage: int, most_passages: int, block: int, smooth: float) -> tuple[Model, DataFrame] | None:
    """The model, and ``counted`` of all rows by its vocabulary."""
    truth = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    sample = cut(examples(docs, truth, per_class))
    shares = {r["label"]: r["n"] for r in truth.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    cuts = passages(sample, passage, most_passages).sort_by([("doc_id", "ascending"), ("label", "ascending")])
    if not cuts.num_rows:
        return None
    lists = cuts.column("terms").combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    places = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
    counts = counted(docs, places)
    n, df = document_frequencies(counts, len(places))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
    terms = np.split(coded.indices.to_numpy().astype(np.int64), ends)
    tf = np.split(1 + np.log(cuts.column("tf").combine_chunks().flatten().to_numpy()), ends)
    vectors = list(zip(cuts.column("doc_id").to_pylist(), cuts.column("label").to_pylist(), terms, tf, strict=True))
    model = Model(places, build(vectors, np.log((n + 1) / (df + 1)), (shares.get(0, 0), shares.get(1, 0)), block, smooth), ks[0])
    votes = left_out(sample, model, ks)
    held = votes.column("label").to_numpy()
    of = np.bincount(held, minlength=2)
    if of.min() < 2:
        return model, counts
    weights = (model.index.prior / of * len(held))[held]
    by = [curve(x, held, weights) for x in np.stack(votes.column("shares").to_pylist()).T]
    best = min(range(len(ks)), key=lambda i: by[i][2])
    model.k, model.slope, model.level = ks[best], *by[best][:2]
    return model, counts


def left_out(sample: DataFrame, model: Model, ks: tuple[int, ...]) -> pa.Table:
    """label and, for each k, the share of the votes of each example by all passages but its own."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known = Places(m.places)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows, cosines = m.index.nearest(*known.counts(text), max(ks), doc_id)
                out.append([m.index.share(rows[:k], cosines[:k]) for k in ks])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "label", "shares"])

    return sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, shares array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])  # 2 * per_class rows at most


def score(docs: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (25, 51, 101, 201), evidence: int = 5, per_class: int = 1000, passage: int = 64, most_passages: int = 32, block: int = 64, smooth: float = 1.0) -> DataFrame:
    """doc_id, score, predicted, nearest (doc_ids of the examples with the nearest passages, the evidence)."""
    fitted = fit(docs, labels, ks, per_class, passage, most_passages, block, smooth)
    if not fitted:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<long>").alias("nearest"))
    model, counts = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class, most_passages and passage

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in (batch.slice(i, QUERIES) for i in range(0, batch.num_rows, QUERIES)):
                scores, nearest = [], []
                queries = [(np.cumsum(unpacked(p)), unpacked(n)) for p, n in zip(part.column("terms").to_pylist(), part.column("tf").to_pylist(), strict=True)]
                for rows, cosines in m.index.search(queries, m.k):
                    scores.append(m.score(m.index.share(rows, cosines)) if len(rows) else float(m.index.prior[1]))
                    nearest.append(list(dict.fromkeys(m.index.ids[rows].tolist()))[:evidence] if len(rows) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(nearest, pa.list_(pa.int64()))],
                    names=["doc_id", "score", "predicted", "nearest"],
                )

    return counts.mapInArrow(run, SCORED)
