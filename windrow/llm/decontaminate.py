"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least m - q + 1 - kq of
its q-grams with that place (of those of 8 characters at every fourth position, (m - 8) / 4 + 1 - 2k),
and the shared ones lie within k + 1 neighbouring diagonals (position in the text less position in the
item). So the shared q-grams are counted in bands of diagonals that
overlap by half, each as wide as 2 (k + 1); only bands that reach the bound are aligned, and the item
counts as found where the alignment within the band needs at most k edits. Bands over equal stretches of text,
as a repeated line makes them, are aligned once, and all others of an item together, one character of the item at a time.

Case is folded and white space counts as one space. The q-gram index of the items goes to the
executors in blocks of at most `block_chars` characters; more items than that are searched for in as
many passes. Texts are read whole and are not shuffled.

Items of fewer than Q characters have no q-gram; they are found as whole words, without edits, in passes
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import slices

Q, STRIDE, SECOND_Q = 8, 4, 4
BITS = 22
#: Characters of text aligned at once.
CELLS = 1 << 18
#: Added to diagonals, which may be negative, before they are divided into bands.
SHIFT = 1 << 40


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    """A byte for each character; equal characters have equal bytes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return (points ^ (points >> 7)).astype(np.uint8)


def q_grams(codes: np.ndarray, q: int) -> np.ndarray:
    """The q (up to 8) bytes from each position on, as one number."""
    size = max(0, len(codes) - q + 1)
    if q == 8 and size:
        return np.ndarray((size,), dtype="<u8", buffer=codes.tobytes(), strides=(1,))
    out = np.zeros(size, dtype=np.uint64)
    for k in range(q):
        out = (out << np.uint64(8)) | codes[k : k + size].astype(np.uint64)
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).view(np.int64)


def _by_id(found: tuple) -> tuple:
    return found[0] is not None, *(x or 0 for x in found)


class Grams:
    """The q-grams, at every `stride`-th place, of those items of an index for which this q is the greatest that tells."""

    def __init__(self, q: int, stride: int, items: list[int], codes: list[np.ndarray], edits: np.ndarray):
        self.q, self.items, self.edits = q, np.array(items), edits[items]
        grams = [q_grams(codes[i], q)[::stride] for i in items]
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        self.lengths = np.array([len(codes[i]) for i in items], dtype=np.int64)
        self.bound = lemma_bound(self.lengths, self.edits, q, stride)
        value, item, place = np.concatenate(grams), np.repeat(np.arange(len(items)), sizes), np.concatenate([np.arange(n) * stride for n in sizes])
        order = np.argsort(value, kind="stable")
        self.item, self.place = item[order], place[order]
        self.value, self.start, self.count = np.unique(value[order], return_index=True, return_counts=True)
        self.present = np.zeros(2**BITS, dtype=bool)
        self.present[_slots(self.value)] = True

    def candidates(self, codes: np.ndarray, at_once: int = 1 << 20) -> list[tuple[int, int]]:
        """(item, first diagonal of the band) of the bands that reach their item's bound.

        Shared q-grams are expanded into (item, band) some `at_once` at a time, in the order of the text. A
        band that no later place can add to is judged and forgotten, so what is held does not grow with the
        length of the text.
        """
        grams = q_grams(codes, self.q)
        at = np.flatnonzero(self.present[_slots(grams)])
        if not len(at):
            return []
        found = np.searchsorted(self.value, grams[at])
        found[found == len(self.value)] = 0
        hit = self.value[found] == grams[at]
        at, found = at[hit], found[hit]
        if len(at) < self.bound.min():
            return []
        n = self.count[found]
        total = np.cumsum(n)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(at_once, total[-1], at_once), side="right"), [len(at)]]))
        out: list[tuple[int, int]] = []
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for low, high in zip(cuts[:-1], cuts[1:]):
            m = n[low:high]
            which = np.repeat(self.start[found[low:high]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            item, diagonal = self.item[which], np.repeat(at[low:high], m) - self.place[which]
            width = self.edits[item] + 1
            band = (diagonal + SHIFT // width * width) // width
            new, shared = np.unique(np.concatenate([(item << 42) + band, (item << 42) + band - 1]), return_counts=True)
            if len(keys):
                every, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                keys, counts = every, np.bincount(place, weights=np.concatenate([counts, shared])).astype(np.int64)
            else:
                keys, counts = new, shared
            which = keys >> 42
            width = self.edits[which] + 1
            first = ((keys & ((1 << 42) - 1)) - SHIFT // width) * width
            over = first + 2 * width + self.lengths[which] < at[high] if high < len(at) else np.ones(len(keys), dtype=bool)
            good = over & (counts >= self.bound[which])
            out += zip(self.items[which[good]].tolist(), first[good].tolist())
            keys, counts = keys[~over], counts[~over]
        return out


def lemma_bound(length: np.ndarray, edits: np.ndarray, q: int, stride: int) -> np.ndarray:
    """How many of an item's q-grams, taken at every stride-th place, are left after so many edits; each spoils those it lies in."""
    return (length - q) // stride + 1 - edits * -(-q // stride)


class Index:
    """A block of items, each held with at most `percent` hundredths of its characters in edits.

    An item is looked for by the longest q-grams of which the lemma leaves at least one, single characters
    in the last resort; so short items have the same allowance as others.
    """

    def __init__(self, items: list[tuple[int | None, str]], percent: int):
        self.ids = [item for item, _ in items]
        self.texts = [text for _, text in items]
        codes = [_codes(text) for text in self.texts]
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        self.edits = lengths * percent // 100
        self.second = [np.unique(q_grams(c, SECOND_Q), return_counts=True) for c in codes]
        self.grams, left = [], np.ones(len(items), dtype=bool)
        for q, stride in ((Q, STRIDE), (4, 1), (2, 1), (1, 1)):
            fit = left & ((lemma_bound(lengths, self.edits, q, stride) >= 1) | (q == 1))
            if fit.any():
                self.grams.append(Grams(q, stride, np.flatnonzero(fit).tolist(), codes, self.edits))
            left &= ~fit

    def _likely(self, item: int, near: np.ndarray) -> bool:
        """Whether a stretch of text holds as many of the item's short q-grams, repeats counted, as the lemma asks for."""
        value, count = self.second[item]
        at = np.searchsorted(value, grams := q_grams(near, SECOND_Q))
        at[at == len(value)] = 0
        here = np.bincount(at[value[at] == grams], minlength=len(value))
        return np.minimum(here, count).sum() >= count.sum() - self.edits[item] * SECOND_Q

    def search(self, text: str, any_one: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, edits) of the best place of each item found in a normalized text; with any_one it ends with the first item found."""
        best: dict[int, tuple[int, int, int]] = {}
        codes, points = _codes(text), None
        bands: dict[int, list[int]] = {}
        for grams in self.grams:
            for item, diagonal in grams.candidates(codes):
                bands.setdefault(item, []).append(diagonal)
        rest = []
        for item in bands:
            start = text.find(self.texts[item])  # without edits, and the first such place: there is no better one
            if start >= 0:
                best[item] = (0, start, start + len(self.texts[item]))
                if any_one:
                    break
            elif self.edits[item]:
                rest.append(item)
        for item in rest if not (any_one and best) else ():
            k, pattern = int(self.edits[item]), self.texts[item]
            width = 2 * (k + 1)
            size = width + len(pattern)
            distinct: dict[tuple[str, int], int] = {}  # stretches of text and the first diagonal of each
            for diagonal in sorted(bands[item]):
                distinct.setdefault((text[max(0, diagonal) : max(0, diagonal + size)], min(diagonal, 0)), diagonal)
            likely = [d for d in distinct.values() if self._likely(item, codes[max(0, d) : max(0, d + size)])]
            if not likely:
                continue
            points = points if points is not None else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            own = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at_once = max(1, CELLS // size)
            for low in range(0, len(likely), at_once):
                place = min(align_many(own, points, np.array(likely[low : low + at_once], dtype=np.int64), width))
                if place[0] <= k and (item not in best or place < best[item]):
                    best[item] = place
                    if any_one:
                        break
            if any_one and best:
                break
        return sorted(((self.ids[i], s, e, d) for i, (d, s, e) in best.items()), key=_by_id)


class ShortIndex:
    """A block of items of fewer than Q characters."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids: dict[str, list[int | None]] = {}
        for item, text in items:
            self.ids.setdefault(text, []).append(item)
        self.sizes = sorted({len(text) for text in self.ids})

    def search(self, text: str, any_one: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, 0) of the first place of each item that has no letter, digit or underscore of the text beside it."""
        free = np.array([True, *(not (c == "_" or c.isalnum()) for c in text), True])  # free[p]: before p; free[p + 1]: at p
        begins, best = np.flatnonzero(free[:-1]), {}
        for size in self.sizes:
            fit = begins[begins + size <= len(text)]
            for start in fit[free[fit + size + 1]].tolist():
                part = text[start : start + size]
                if part in self.ids:
                    best.setdefault(part, start)
        return sorted(((item, at, at + len(part), 0) for part, at in best.items() for item in self.ids[part]), key=_by_id)


def align(pattern: np.ndarray, text: np.ndarray, diagonal: int, width: int) -> tuple[int, int, int]:
    """align_many of one band."""
    return align_many(pattern, text, np.array([diagonal], dtype=np.int64), width)[0]


def align_many(pattern: np.ndarray, text: np.ndarray, diagonals: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """For each band: the fewest edits of the pattern against any place of the text whose path stays within the band; that place.

    Column c of a row stands for the diagonal `diagonal` + c. Edits and the start of the path are held in
    one number, so that the smallest is also the first.
    """
    far, unit = np.int64(1) << 60, np.int64(1) << 40
    column = np.arange(width, dtype=np.int64)
    place = diagonals[:, None] + column
    row = np.where((place >= 0) & (place <= len(text)), place, far)  # no edits yet, start here
    steps = column * unit
    reach = diagonals[:, None] + np.arange(width + len(pattern))
    held = (reach >= 0) & (reach < len(text))
    near = np.full(reach.shape, -1, dtype=np.int64)
    near[held] = text[reach[held]]
    beyond = np.full((len(diagonals), 1), far)
    for i, c in enumerate(pattern):
        across = np.where(held[:, i : i + width], row + np.where(near[:, i : i + width] == c, 0, unit), far)
        skip = np.concatenate([row[:, 1:], beyond], axis=1) + unit  # the pattern's character is missing in the text
        row = np.minimum(across, skip)
        row = np.minimum(np.minimum.accumulate(row - steps, axis=1) + steps, far)  # further characters in the text
        at = place + i + 1
        row[(at < 0) | (at > len(text))] = far
    best = row.argmin(1)
    edits, start = np.divmod(row[np.arange(len(row)), best], unit)
    return list(zip(edits.tolist(), start.tolist(), (diagonals + best + len(pattern)).tolist()))


def index_blocks(items: DataFrame, percent: int, block_chars: int) -> Iterator[Index | ShortIndex]:
    """Indexes of the items in blocks, those with fewer than Q characters apart. Items with a null or blank text hold nothing to search for."""
    blocks: dict[bool, list[tuple[int | None, str]]] = {False: [], True: []}
    sizes = {False: 0, True: 0}
    made = lambda short: ShortIndex(blocks[short]) if short else Index(blocks[short], percent)
    for row in items.select("item_id", "text").filter("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalized(row["text"])
        if text:
            short = len(text) < Q
            if blocks[short] and sizes[short] + len(text) > block_chars:
                yield made(short)
                blocks[short], sizes[short] = [], 0
            blocks[short].append((row["item_id"], text))
            sizes[short] += len(text)
    for short in (False, True):
        if blocks[short]:
            yield made(short)


def find_items(docs: DataFrame, items: DataFrame, percent: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start, end and edits: the best place of each item that a document holds.

    docs: doc_id, text; items: item_id, text. An item is held with at most percent hundredths of its
    characters, rounded down, in edits; of several places the one with the fewest edits and then the
    first counts. start and end count characters of the normalized text. Items with fewer than 8
    characters are held where they occur as whole words, without edits. A repeated document row gives
    repeated rows, repeated item rows are one item, and items that share an id are searched for one by
    one. Null and empty texts hold nothing and are held by nothing; a null doc_id or item_id is kept. Other
    columns are not read. Texts of any length are searched whole.
    """
    schema = "doc_id long, item_id long, start long, end long, edits int"
    out = None
    for index in index_blocks(items, percent, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    rows = [(k, *place) for k, text in enumerate(part.column("text")) for place in shared.value.search(normalized(text.as_py()))]
                    row, item, start, end, edits = zip(*rows) if rows else ((),) * 5
                    yield pa.record_batch({
                        "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())), "item_id": pa.array(item, pa.int64()), "start": pa.array(start, pa.int64()),
                        "end": pa.array(end, pa.int64()), "edits": pa.array(edits, pa.int32()),
                    })

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that hold none of the items (as find_items says)."""
    for index in index_blocks(items, percent, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    clean = [not shared.value.search(normalized(text.as_py()), True) for text in part.column("text")]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(apply, docs.schema)
    return docs
