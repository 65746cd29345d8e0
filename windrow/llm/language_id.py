"""Language ID by a byte convolutional network.

Bytes are embedded, filters of widths 2, 3 and 4 run over fixed-length windows, each filter's largest
response goes through a softmax layer. The network is trained in numpy on the driver, on the windows
of a bounded sample of labelled documents. A document's prediction is the softmax of the mean of its
windows' outputs, weighted by their bytes, over all windows of the whole text.

For inference the filters are folded into tables over pairs of byte classes, so a batch of windows
takes two look-ups, one addition and one maximum per position instead of a matrix product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import held_out, sample_rows, slices

LENGTH, DIM, FILTERS, WIDTHS, CLASSES = 128, 8, 16, (2, 3, 4), 64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def byte_classes(texts: list[bytes]) -> np.ndarray:
    """A class from 2 to 63 for each of the most frequent bytes, ASCII letters in lower case, and 1 for all others. 0 is padding only."""
    counts = np.zeros(256, dtype=np.int64)
    for text in texts:
        counts += np.bincount(np.frombuffer(text.lower(), dtype=np.uint8), minlength=256)
    table = np.ones(256, dtype=np.uint8)
    best = [b for b in np.argsort(-counts, kind="stable")[: CLASSES - 2] if counts[b]]
    table[best] = np.arange(2, len(best) + 2)
    for upper in range(65, 91):
        table[upper] = table[upper + 32]
    return table


def windows_of(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a text's bytes in rows of LENGTH, and the number of bytes in each row."""
    data = table[np.frombuffer(text, dtype=np.uint8)]
    rows = max(1, -(-len(data) // LENGTH))
    out = np.zeros(rows * LENGTH, dtype=np.uint8)
    out[: len(data)] = data
    sizes = np.full(rows, LENGTH)
    sizes[-1] = len(data) - (rows - 1) * LENGTH
    return out.reshape(rows, LENGTH), sizes


class Network:
    def __init__(self, languages: list[str], table: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.table = languages, table
        self.p = {"e": r.normal(0, 0.5, (CLASSES, DIM)), "o": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "ob": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, kept = [], {}
        for w in WIDTHS:
            spans = np.concatenate([e[:, k : LENGTH - w + 1 + k] for k in range(w)], axis=2)
            out = spans.reshape(-1, w * DIM) @ p[f"w{w}"] + p[f"b{w}"]
            out = out.reshape(n, -1, FILTERS)
            best = out.argmax(1)
            top = np.take_along_axis(out, best[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept[w] = (spans, best, top > 0)
        h = np.concatenate(pooled, 1)
        logits = h @ p["o"] + p["ob"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"o": h.T @ prob, "ob": prob.sum(0), "e": np.zeros_like(p["e"])}
        dh = prob @ p["o"].T
        for k, w in enumerate(WIDTHS):
            spans, best, on = kept[w]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            picked = spans[np.arange(n)[:, None], best]
            g[f"w{w}"] = np.einsum("nfd,nf->df", picked, d)
            g[f"b{w}"] = d.sum(0)
            back = d[:, :, None] * p[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], best + j], back[:, :, j * DIM : (j + 1) * DIM])
        g["e"][0] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        self.p["e"][0] = 0
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            rows = x[pick].copy()
            for row in np.flatnonzero(r.random(batch) < 0.4):  # short texts occur too
                rows[row, r.integers(8, LENGTH) :] = 0
            for k, g in self.gradients(rows, y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables over the pair of classes at i and the pair at i + 2, whose sums are the filters' responses at i."""
        e, (w2, w3, w4) = self.p["e"], (self.p[f"w{w}"].reshape(w, DIM, FILTERS) for w in WIDTHS)
        at = lambda w, k: e @ w[k]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, -1)
        first = np.concatenate([pair(at(w2, 0), at(w2, 1)) + self.p["b2"], pair(at(w3, 0), at(w3, 1)) + self.p["b3"], pair(at(w4, 0), at(w4, 1)) + self.p["b4"]], 1)
        second = np.concatenate([pair(at(w3, 2), np.zeros_like(at(w3, 2))), pair(at(w4, 2), at(w4, 3))], 1)
        return np.ascontiguousarray(first), np.ascontiguousarray(second)

    def outputs(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], at_once: int = 64) -> np.ndarray:
        """The softmax layer's inputs for rows of classes."""
        out = np.empty((len(x), len(self.languages)), dtype=np.float32)
        for k in range(0, len(x), at_once):
            part = x[k : k + at_once]
            wide = np.zeros((len(part), LENGTH + 3), dtype=np.int32)
            wide[:, :LENGTH] = part
            pairs = wide[:, :-1] * CLASSES + wide[:, 1:]
            # positions past a filter's last full span see padding, as short windows do
            response = tables[0][pairs[:, :LENGTH]]
            response[:, :, FILTERS:] += tables[1][pairs[:, 2 : LENGTH + 2]]
            out[k : k + at_once] = np.maximum(response.max(1), 0) @ self.p["o"] + self.p["ob"]
        return out


def train(docs: DataFrame, max_rows: int = 2_000, windows_each: int = 12) -> Network | None:
    """A network trained on at most max_rows labelled documents that are not held out, and of each on at most windows_each evenly spread windows."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = sample_rows(known.select("doc_id", "lang"), F.struct("doc_id", "lang"), max_rows)
    rows = known.join(ids.distinct(), ["doc_id", "lang"]).select("text", "lang")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    data = text.encode()
                    if LETTER.search(text):
                        starts = range(0, len(data), LENGTH)
                        out += [(data[k : k + LENGTH], lang) for k in starts[:: -(-len(starts) // windows_each)]]
                yield pa.record_batch({"piece": pa.array([p for p, _ in out], pa.binary()), "lang": pa.array([l for _, l in out], pa.string())})

    got = rows.mapInArrow(pieces, "piece binary, lang string").toArrow().to_pandas()
    if not len(got):
        return None
    both = sorted(zip(got["lang"], map(bytes, got["piece"])))  # the same in every run
    languages = sorted({lang for lang, _ in both})
    table = byte_classes([piece for _, piece in both])
    net = Network(languages, table)
    x = np.concatenate([windows_of(piece, table)[0] for _, piece in both])
    net.train(x, np.array([languages.index(lang) for lang, _ in both]))
    return net


def predict(net: Network | None, tables: tuple[np.ndarray, np.ndarray] | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; windows of many texts go through the network together."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows, sizes, owners = [], [], []

    def settle() -> None:
        if not rows:
            return
        out, size = net.outputs(np.concatenate(rows), tables), np.concatenate(sizes)
        starts = np.cumsum([0] + [len(s) for s in sizes[:-1]])
        mean = np.add.reduceat(out * size[:, None], starts) / np.add.reduceat(size, starts)[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        for k, owner in enumerate(owners):
            names[owner], scores[owner] = net.languages[best[k]], min(1.0, float(prob[k, best[k]]))
        rows.clear(), sizes.clear(), owners.clear()

    waiting = 0
    for k, text in enumerate(texts):
        if net and text and LETTER.search(text):
            x, size = windows_of(text.encode(), net.table)
            rows.append(x), sizes.append(size), owners.append(k)
            waiting += len(x)
            if waiting > 1024:
                settle()
                waiting = 0
    settle()
    return names, scores


def identify(docs: DataFrame, max_rows: int = 2_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text, lang).

    A text that is null or has no letter is `und` with score 0, and so is every text if no row can be
    learned from. Ties go to the language that sorts first. Rows with a null doc_id are predicted and
    count as held out; repeated rows come back as often as given, and no rows of docs give no rows. Texts of
    any length are read whole. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_rows))  # of fixed size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.fold() if net else None
        for batch in batches:
            for part in slices(batch):
                names, scores = predict(net, tables, part.column("text").to_pylist())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, max_rows: int = 2_000) -> DataFrame:
    """The rows of docs, with all their columns, whose language identify names with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.fold() if net else None
        for batch in batches:
            for part in slices(batch):
                names, scores = predict(net, tables, part.column("text").to_pylist())
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
