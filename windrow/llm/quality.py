"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words, and what a text looks like: letters, digits and white space are folded into classes, and
three neighbouring classes are a term; a word that repeats its predecessor is one more. The weighted term
vectors of labelled documents are decomposed into `DIMENSIONS` latent directions. The labelled vectors,
at most `max_rows` of them, travel to the executors; each document's whole text becomes a vector there,
and its cosines with all labelled vectors are computed in blocks. The nearest ones vote with weights
that grow with their cosine. Labelled vectors that tie for the last place share it, so the order in
which they were read has no influence.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import held_out, sample_rows, slices

#: The marks that are classes of their own.
MARKS = ".,!?*&%$#|-=@/:;()'\"_"
SYMBOLS = 27
TERMS = SYMBOLS**3 + 2
#: Looks and words in the vocabulary, the ones that most labelled documents hold.
LOOKS, WORDS, DIMENSIONS = 2048, 1024, 64
#: Cosines closer than this are equal.
ROUNDING = 1e-6


def _classes() -> bytes:
    table = bytearray([26] * 256)  # marks that are not listed
    for b in range(256):
        if b >= 128 or 97 <= b <= 122:
            table[b] = 0
        elif 65 <= b <= 90:
            table[b] = 1
        elif 48 <= b <= 57:
            table[b] = 2
        elif b == 10:
            table[b] = 4
        elif b <= 32:
            table[b] = 3
    for k, mark in enumerate(MARKS):
        table[ord(mark)] = 5 + k
    return bytes(table)


_TABLE = _classes()


def looks_of(data: bytes, words: list[bytes]) -> np.ndarray:
    """How often each sequence of three classes occurs, and how many words repeat their predecessor and do not."""
    codes = np.frombuffer(data.translate(_TABLE), dtype=np.uint8).astype(np.int32)
    counts = np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=TERMS) if len(codes) > 2 else np.zeros(TERMS, dtype=np.int64)
    same = sum(a == b for a, b in zip(words, words[1:]))
    counts[TERMS - 2], counts[TERMS - 1] = same, max(0, len(words) - 1 - same)
    return counts


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text and their counts: looks by number, words (ASCII letters in lower case) by TERMS and their crc32."""
    data = (text or "").encode()
    words = data.split()
    looks = looks_of(data, words)
    at = np.flatnonzero(looks)
    by_word = Counter(data.lower().split())
    ids = np.fromiter((TERMS + zlib.crc32(w) for w in by_word), dtype=np.int64, count=len(by_word))
    return np.concatenate([at, ids]), np.concatenate([looks[at], np.fromiter(by_word.values(), dtype=np.int64, count=len(by_word))])


class Space:
    """The vocabulary with its weights and the latent directions; labelled vectors and their labels."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.terms, self.weight, self.basis, self.vectors, self.labels = terms, weight, basis, vectors, labels
        self.looks = terms[terms < TERMS]
        self.words = {int(t) - TERMS: k for k, t in enumerate(terms) if t >= TERMS}

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """A row of counts for each text, one column for each term of the vocabulary."""
        out = np.zeros((len(texts), len(self.terms)), dtype=np.float32)
        for row, text in zip(out, texts):
            data = (text or "").encode()
            row[: len(self.looks)] = looks_of(data, data.split())[self.looks]
            for word, n in Counter(data.lower().split()).items():
                column = self.words.get(zlib.crc32(word))
                if column is not None:
                    row[column] += n
        return out

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of counts."""
        latent = (np.log1p(counts).astype(np.float32) * self.weight) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def votes(self, latent: np.ndarray, neighbours: int, block: int = 256) -> np.ndarray:
        """For each row the share of label 1 among its nearest labelled vectors, weighted by cosine."""
        out = np.empty(len(latent))
        k = min(neighbours, len(self.labels))
        for at in range(0, len(latent), block):
            cosine = latent[at : at + block] @ self.vectors.T
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            nearer, tied = cosine > last + ROUNDING, np.abs(cosine - last) <= ROUNDING
            share = (k - nearer.sum(1)) / tied.sum(1)  # of the places left, for each that ties
            row, col = np.nonzero(nearer | tied)
            weight = (np.clip(cosine[row, col].astype(float), 0, 1) ** 16 + 1e-9) * np.where(tied[row, col], share[row], 1.0)
            total, ones = np.bincount(row, weights=weight, minlength=len(cosine)), np.bincount(row, weights=weight * self.labels[col], minlength=len(cosine))
            out[at : at + block] = ones / total
        return np.clip(out, 0, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> Space:
    """rows: terms and their counts, for each labelled document."""
    every, seen = np.unique(np.concatenate([at for at, _ in rows]), return_counts=True)
    chosen = [np.flatnonzero(every < TERMS), np.flatnonzero((every >= TERMS) & (seen > 1))]
    chosen = [c[np.argsort(-seen[c], kind="stable")[:most]] for c, most in zip(chosen, (LOOKS, WORDS))]
    kept = np.sort(np.concatenate(chosen))
    terms, seen = every[kept], seen[kept]
    if not len(terms):
        terms, seen = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    counts = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for k, (at, n) in enumerate(rows):
        place = np.searchsorted(terms, at)
        place[place == len(terms)] = 0
        hit = terms[place] == at
        counts[k, place[hit]] = n[hit]
    weight = (np.log((1 + len(rows)) / (1 + seen)) + 0.3).astype(np.float32)
    raw = np.log1p(counts) * weight
    r = np.random.default_rng(seed)
    width = min(DIMENSIONS, *raw.shape)
    basis = np.linalg.qr(r.normal(size=(raw.shape[1], width)).astype(np.float32))[0]
    for _ in range(6):  # subspace iteration
        basis = np.linalg.qr(raw.T @ (raw @ basis))[0]
    space = Space(terms, weight, basis, np.zeros((0, width)), labels.astype(float))
    space.vectors = space.place(counts)
    return space


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000) -> Space | None:
    """The space of at most max_rows labelled documents that are not held out. Null ids, labels and texts are left out."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = sample_rows(known, F.struct("doc_id", "quality"), max_rows)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(drawn, "doc_id").select("text", "quality")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [terms_of(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch({"at": pa.array([at for at, _ in found], pa.list_(pa.int64())), "n": pa.array([n for _, n in found], pa.list_(pa.int64())), "quality": part.column("quality")})

    got = rows.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(apply, "at array<long>, n array<long>, quality int").toArrow().to_pandas()
    if not len(got):
        return None
    name = lambda k: (int(got["quality"][k]), zlib.crc32(got["at"][k].tobytes() + got["n"][k].tobytes()), len(got["at"][k]), int(np.sum(got["n"][k])))
    order = sorted(range(len(got)), key=name)  # the same in every run
    return fit([(got["at"][k], got["n"][k]) for k in order], got["quality"].to_numpy()[order])


def score_texts(space: Space | None, texts: list[str | None], neighbours: int, at_once: int = 256) -> np.ndarray:
    scores = np.full(len(texts), 0.5)
    if space is not None:
        for at in range(0, len(texts), at_once):
            part = texts[at : at + at_once]
            scores[at : at + len(part)] = np.where([bool(t and t.strip()) for t in part], space.votes(space.place(space.counts(part)), neighbours), 0.0)
    return scores


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, neighbours: int = 25, max_rows: int = 4_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) for each row of docs (doc_id, text).

    A null or empty text has no direction in the space; all labelled vectors are equally far from it, so
    its score is 0. Without labels every score is 0.5. Rows with a null doc_id are scored and count as
    held out; repeated rows come back as often as given, equal texts have equal scores and no rows of docs
    give no rows. Texts of any length are read whole. Other columns are not read.
    """
    space = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))  # max_rows vectors

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = score_texts(space.value, part.column("text").to_pylist(), neighbours)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, neighbours: int = 25, max_rows: int = 4_000) -> DataFrame:
    """The rows of docs, with all their columns, that score_quality predicts 1 for."""
    space = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(score_texts(space.value, part.column("text").to_pylist(), neighbours) >= threshold))

    return docs.mapInArrow(apply, docs.schema)
