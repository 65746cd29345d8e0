"""Toxicity: a logistic classifier with a counterfactual penalty.

Features are the distinct words of a text and their first four and five letters, so that unseen forms
of a known stem count too. Weights are not negative (harmless words do not outweigh a slur, however
long the text is) and sparse. For labelled texts that mention a group, the mention is swapped for
another of the same kind, and the squared change of the score is penalised, which takes from identity
terms the weight that the labels happen to give them.

The classifier is fitted on the driver, on at most `max_rows` labelled rows drawn by a hash; every
text is scored whole, in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import held_out, sample_rows, slices

#: Mentions that may stand for one another, by kind.
IDENTITY_TERMS = [
    "women men girls boys woman man female male".split(),
    "muslims christians jews hindus buddhists atheists catholics muslim christian jewish hindu buddhist atheist catholic".split(),
    "black white asian latino african european arab native".split(),
    "gay lesbian straight bisexual transgender queer heterosexual homosexual".split(),
    "immigrants refugees foreigners migrants natives".split(),
    "frauen männer mädchen jungen femmes hommes filles garçons mujeres hombres niñas niños".split(),
    "muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos".split(),
]
SLOT_BITS = 24
EDGES = ".,;:!?*&%$#|\"'()[]{}<>/\\-_=+~`^@«»„“”‘’¿¡…–—0123456789"
#: The log odds of a text without any known feature. It is not learned: one clear slur must be able to outweigh it.
BIAS = -3.0
_SWAP = {term: terms[(k + 1) % len(terms)] for terms in IDENTITY_TERMS for k, term in enumerate(terms)}


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}


def features_of(word: str) -> tuple[int, ...]:
    """32-bit ids of a word and, if it is longer, of its first four and five letters."""
    ids = [zlib.crc32(word.encode())]
    ids += [zlib.crc32(f"{size}:{word[:size]}".encode()) for size in (4, 5) if len(word) >= size]
    return tuple(ids)


def _ids(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((i for w in words for i in features_of(w)), dtype=np.uint32))


def _places(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where those of the ids that are in a sorted array stand in it."""
    at = np.searchsorted(among, ids)
    at[at == len(among)] = 0
    return at[among[at] == ids]


class Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.columns, self.n = columns, len(rows)
        self.index = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row], minlength=self.columns)


def fit(examples: list[np.ndarray], labels: np.ndarray, swapped: list[tuple[np.ndarray, np.ndarray]], penalty: float = 1.0, sparsity: float = 2e-5, steps: int = 400) -> tuple[dict[int, float], float]:
    """Weights by feature id and the (fixed) bias, by accelerated proximal gradient steps.

    swapped: features of texts before and after their identity terms were swapped.
    """
    if not len(labels) or labels.min() == labels.max():
        return {}, -BIAS if len(labels) and labels.min() == 1 else BIAS
    base = labels.mean()

    def telling(slots: list[np.ndarray], size: int) -> np.ndarray:
        """Which slots are toxic often enough for it not to be chance."""
        seen, hits = np.zeros(size), np.zeros(size)
        for at in range(0, len(slots), 1000):
            part = slots[at : at + 1000]
            every = np.concatenate(part).astype(np.int64)
            seen += np.bincount(every, minlength=size)
            hits += np.bincount(every, weights=np.repeat(labels[at : at + 1000], [len(x) for x in part]), minlength=size)
        z, rate = 1.64, hits / np.maximum(seen, 1)
        n = np.maximum(seen, 1)
        low = (rate + z * z / (2 * n) - z * np.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return (low > max(base, 0.3)) & (hits >= 2)

    # by hash slot first, which leaves few features to count one by one
    slot_of = lambda e: (e * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    toxic_once = np.zeros(2**SLOT_BITS, dtype=bool)
    for e, y in zip(examples, labels):
        if y:
            toxic_once[slot_of(e)] = True
    examples = [e[toxic_once[slot_of(e)]] for e in examples]
    swapped = [(a[toxic_once[slot_of(a)]], b[toxic_once[slot_of(b)]]) for a, b in swapped]
    everything = np.unique(np.concatenate([e for e, y in zip(examples, labels) if y]))
    if not len(everything):
        return {}, BIAS
    kept = everything[telling([_places(e, everything) for e in examples], len(everything))]
    if not len(kept):
        return {}, BIAS

    x, before, after = (Rows([_places(e, kept) for e in side], len(kept)) for side in (examples, [a for a, _ in swapped], [b for _, b in swapped]))
    weight = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base)) / len(labels)
    w, ahead, momentum = np.zeros(len(kept)), np.zeros(len(kept)), 1.0

    def curve(v: np.ndarray) -> np.ndarray:
        """An upper bound of the loss's second derivative along v."""
        out = x.back(0.25 * weight * x.times(v))
        if swapped:
            d = (before.times(v) - after.times(v)) * (2 * penalty / len(swapped))
            out += before.back(d) - after.back(d)
        return out

    v = np.ones(len(kept))
    for _ in range(30):  # power iteration for the steepest direction
        v = curve(v / np.linalg.norm(v))
    step = 0.9 / max(float(np.linalg.norm(v)), 1e-12)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead) + BIAS, -30, 30)))
        r = weight * (p - labels)
        gradient = x.back(r)
        if swapped:
            d = (before.times(ahead) - after.times(ahead)) * (2 * penalty / len(swapped))
            gradient += before.back(d) - after.back(d)
        new = np.maximum(0, ahead - step * gradient - step * sparsity)
        m = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        if ((new - w) * (ahead - new)).sum() > 0:
            m = 1.0  # the momentum points uphill: start it over
        ahead = new + (momentum - 1) / m * (new - w)
        w, momentum = new, m
    return {int(k): float(v) for k, v in zip(kept, w) if v > 1e-3}, BIAS


class Scorer:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        known, weights = self.known, self.weights
        for raw in set((text or "").lower().split()):
            ids = known.get(raw)
            if ids is None:
                if len(known) > 300_000:
                    known.clear()
                word = raw.strip(EDGES)
                ids = known[raw] = tuple(i for i in features_of(word) if i in weights) if word else ()
            if ids:
                found.update(ids)
        total = self.bias + sum(weights[i] for i in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, penalty: float = 1.0) -> Scorer:
    """A scorer fitted on the labelled rows that are not held out, at most max_rows of them.

    Rows with a null doc_id, label or text are not learned from. A document with several labels counts
    with each of them.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = sample_rows(known, F.struct("doc_id", "toxic"), max_rows)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(drawn, "doc_id").select("text", "toxic")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = [words_of(t) for t in part.column("text").to_pylist()]
                other = [{_SWAP.get(w, w) for w in ws} if ws & _SWAP.keys() else None for ws in words]
                listed = lambda sets: pa.array([None if w is None else _ids(w).view(np.int32) for w in sets], pa.list_(pa.int32()))
                yield pa.record_batch({"ids": listed(words), "swapped": listed(other), "toxic": part.column("toxic")})

    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(apply, "ids array<int>, swapped array<int>, toxic int").toArrow().to_pandas()
    examples = [np.asarray(a, dtype=np.int32).view(np.uint32) for a in got["ids"]]
    order = sorted(range(len(examples)), key=lambda k: (int(examples[k].sum(dtype=np.int64)), len(examples[k]), int(got["toxic"][k])))  # the same in every run
    pairs = [(examples[k], np.asarray(got["swapped"][k], dtype=np.int32).view(np.uint32)) for k in order if got["swapped"][k] is not None]
    weights, bias = fit([examples[k] for k in order], got["toxic"].to_numpy(dtype=float)[order], pairs, penalty)
    return Scorer(weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) for each row of docs (doc_id, text).

    A null or empty text has the score of a text without any known feature. Rows with a null doc_id are
    scored and count as held out; repeated rows come back as often as given, equal texts have equal scores
    and no rows of docs give no rows. Without labels of both kinds every text gets one constant score. Texts
    of any length are scored whole. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))  # the weights kept of max_rows texts

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.weights, shared.value.bias)
        for batch in batches:
            for part in slices(batch):
                scores = np.array([scorer.score(t) for t in part.column("text").to_pylist()], dtype=float)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
