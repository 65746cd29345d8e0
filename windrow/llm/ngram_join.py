"""N-gram Jaccard join as a T-occurrence search with DivideSkip.

Two documents link if they share enough of the lists of an inverted index over word shingles. To
reach a Jaccard similarity t, documents with a and b shingles must meet in T = ceil(t (a + b) / (1 + t))
lists. DivideSkip splits the lists of a document with n shingles into its T - 1 longest ones and the
n - T + 1 shortest: any partner must occur in one of the short lists at least, those are merged, and
each candidate is then looked up in the long lists by binary search until T is reached or out of reach.

- The order of lists by length comes from a sketch of shingle frequencies over all documents, of fixed
  size (`SKETCH` counters), so no table of all shingles is needed. Any order gives the same links.
- The short lists, about a tenth of all postings at t = 0.9, are formed and merged by Spark's sort-merge
  shuffle; a posting carries its rank among the document's lists, and a pair is a candidate only if
  sizes and both ranks leave room for T.
- A long list is never stored: whether it holds a document is a binary search for the shingle among
  the document's sorted shingles.

Documents with equal shingle sets are one class from the start. Of a short list first only the pairs
with its hub (the class that ranks the shingle earliest, as the original does among its variants) are
probed; connected classes need no further links, and all pairs of different components that meet in
a short list are probed after that. So no link between different components is lost, and a large group
of copies costs about one probe for each copy.

As stars and components stand in for all pairs of a list, a candidate's count over the short lists is not
known when it is probed: all lists of the smaller set are probed for the larger, until T is reached or
out of reach.

Shingles are 64-bit hashes, and a class is a 64-bit sum of mixed hashes together with the set's size. Among
N different sets some N^2 / 2^65 pairs are taken for equal: none to be expected below a billion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.components import components
from windrow.llm.shared import cut_lineage, join_spread

SKETCH, RANGES = 2**22, 64
#: Of the Bloom filter that tells the documents to be probed: 16 MB.
MASK_BITS = 2**27
SLICE = 2**19
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 2**64)
U = np.uint64
#: A-Z become a-z; space and 0x09 to 0x0D separate words
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        _powers[:] = []
        for base in (MULTIPLIER, INVERSE):
            table = np.full(max(size, SLICE), base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of documents, sorted within each, and the number of them in each.

    data: the documents' bytes, one after another; bounds: where each begins, and the end.
    """
    none = np.zeros(len(bounds) - 1, dtype=np.int64)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), none
    folded = _FOLD[data]
    word = folded != 32
    if not word.any():
        return np.zeros(0, dtype=np.uint64), none
    first, last = word.copy(), word.copy()
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    powers, inverses = _power_tables(len(data))
    running = np.cumsum((folded.astype(np.uint64) + U(1)) * powers[: len(data)], dtype=np.uint64)
    hashes = running[ends] - np.where(starts > 0, running[starts - 1], U(0))
    hashes = _mixed(hashes * inverses[starts] + (ends - starts).astype(np.uint64))
    count = np.diff(np.searchsorted(starts, bounds))
    owner = np.repeat(np.arange(len(count)), count)
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * U(0xD6E8FEB86659FD93) + hashes[k : k + len(rolled)]
    whole = owner[: len(rolled)] == owner[words - 1 :] if len(rolled) else np.zeros(0, dtype=bool)
    all_owner, all_hash = [owner[: len(rolled)][whole]], [_mixed(rolled[whole])]
    offset = np.concatenate([[0], np.cumsum(count)])
    for doc in np.flatnonzero((count > 0) & (count < words)):  # the whole sequence is one shingle
        value = np.ones(1, dtype=np.uint64)
        for h in range(offset[doc], offset[doc + 1]):
            value = value * U(0xD6E8FEB86659FD93) + hashes[h : h + 1]
        all_owner.append(np.array([doc]))
        all_hash.append(_mixed(value + U(count[doc])))
    own, value = np.concatenate(all_owner), np.concatenate(all_hash)
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.bincount(own[fresh], minlength=len(count))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about SLICE bytes: first, end, bytes and bounds. A null has no bytes."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, side="right")) - 1)
        yield at, end, raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def _set_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; the same for equal sets."""
    sums = np.concatenate([[U(0)], np.cumsum(_mixed(values ^ U(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return _mixed((sums[ends] - sums[ends - sizes]) ^ sizes.astype(np.uint64)).view(np.int64)


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Counters of the shingles of all documents by the low bits of their hashes.

    Each task sends its counters compressed, in RANGES ranges. They are added up as they come, first by
    range and sending task, in as many tasks as a shuffle has, and then by range; so neither step has a
    task that takes in what all others send. The driver gets the SKETCH sums.
    """
    width = SKETCH // RANGES

    def packed(of: int, lot: int, counts: np.ndarray) -> tuple[int, int, bytes]:
        return of, lot, zlib.compress(np.minimum(counts, 2**32 - 1).astype(np.uint32).data, 1)

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.record_batch({"range": pa.array([r[0] for r in rows], pa.int32()), "lot": pa.array([r[1] for r in rows], pa.int32()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.uint32)
        for batch in batches:
            for _, _, data, bounds in _slices(batch.column("text")):
                values, _ = shingle_sets(data, bounds, words)
                np.add.at(total, (values & U(SKETCH - 1)).view(np.int64), np.uint32(1))
        lot = TaskContext.get().partitionId()
        if total.any():
            yield batch_of([packed(k, lot, total[k * width : (k + 1) * width]) for k in range(RANGES)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for of, counts in zip(batch.column("range").to_pylist(), batch.column("counts")):
                total = totals.setdefault(of, np.zeros(width, dtype=np.int64))
                total += np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.uint32)
        lot = TaskContext.get().partitionId()
        for of, total in totals.items():
            yield batch_of([packed(of, lot, total)])

    schema = "range int, lot int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("range", "lot").mapInArrow(add, schema)
    out = np.zeros(SKETCH, dtype=np.uint32)
    for of, _, counts in parts.repartition(RANGES, "range").mapInArrow(add, schema).collect():  # one row for each range
        out[of * width : (of + 1) * width] = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
    return out


def short_lists(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, key and the shingles of the short lists, shortest first, for each row of docs."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, words))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in _slices(batch.column("text")):
                values, sizes = shingle_sets(data, bounds, words)
                keys = _set_keys(values, sizes)
                own = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, sketch.value[values & U(SKETCH - 1)], own))
                starts = np.cumsum(sizes) - sizes
                rank = np.arange(len(values)) - np.repeat(starts, sizes)
                short = sizes + (-percent * sizes // 100) + 1
                short[sizes * (100 - percent) < percent] = 0  # too few shingles for a partner with another set
                chosen = values[order][rank < np.repeat(short, sizes)].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(np.minimum(short, sizes))]).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(at, end - at), "n": pa.array(sizes.astype(np.int64)), "key": pa.array(keys),
                    "short": pa.ListArray.from_arrays(pa.array(cuts), pa.array(chosen)),
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n long, key long, short array<long>")


def _unpacked(rank: str, n: str, pos: str) -> tuple:
    return F.col(rank).bitwiseAND(2**32 - 1).alias(n), F.shiftright(rank, 32).alias(pos)


def _room(percent: int):
    """Whether classes (n, pos) and (m, at) that meet in a short list leave room for T, by sizes and ranks."""
    least = F.least("n", "m")
    needed = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    return (least * 100 >= F.greatest("n", "m") * percent) & (F.col("pos") <= F.col("n") - needed) & (F.col("at") <= F.col("m") - needed)


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity: the lists of the smaller are probed for the larger, and given up when too many fail."""
    if len(a) > len(b):
        a, b = b, a
    needed = -(-percent * (len(a) + len(b)) // (100 + percent))
    found = 0
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        place = np.searchsorted(b, part)
        place[place == len(b)] = 0
        found += int((b[place] == part).sum())
        if found + len(a) - at - len(part) < needed:
            return False
    return found >= needed


def _slots(marks: np.ndarray, bits: int) -> np.ndarray:
    """Three places among `bits` (a power of two) for each mark, in a row each."""
    return np.stack([_mixed(marks + U(k * MULTIPLIER % 2**64)) & U(bits - 1) for k in range(3)])


def _id_marks(ids: pa.Array) -> np.ndarray:
    marks = _mixed(np.asarray(ids.fill_null(0)).view(np.uint64) ^ U(0x5851F42D4C957F2D))
    return np.where(np.asarray(ids.is_null()), U(1), marks)


def id_mask(wanted: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the n rows (wanted, first_id): marks of the ids, and of each id with its key, in 32 to 64 bits a row.

    It has MASK_BITS bits at most; beyond MASK_BITS / 32 rows more texts than needed are read into sets, and no others are
    left out. Its bits are set in tasks, 4 KB together.
    """
    bits = min(MASK_BITS, max(2**15, 1 << (32 * n - 1).bit_length()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _id_marks(batch.column("first_id"))
            keys = np.asarray(batch.column("wanted")).view(np.uint64)
            yield pa.record_batch({"slot": pa.array(_slots(np.concatenate([marks, _mixed(marks ^ keys)]), bits).ravel().view(np.int64))})

    slot = F.col("slot") + 1  # Spark counts bits from 1
    blocks = wanted.select("wanted", "first_id").mapInArrow(apply, "slot long").groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((bits // 2**15, 2**12), dtype=np.uint8)
    for block, held in blocks.collect():  # 4 KB each
        out[block - 1] = np.frombuffer(held, dtype=np.uint8)
    return out.ravel()


def _holds(mask: np.ndarray, marks: np.ndarray) -> np.ndarray:
    slots = _slots(marks, 8 * len(mask)).view(np.int64)
    return ((mask[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=0)


def probe(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows (a, b) of pairs whose classes reach the similarity.

    Only the texts of one document of each class at hand are read into sets again. Tasks tell them by a Bloom filter
    (`id_mask`), so neither a table of these classes nor a text is exchanged; what it lets through by chance meets no pair or
    is the same set once more.
    """
    wanted = cut_lineage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select(F.col("key").alias("wanted"), "first_id"))
    n = wanted.count()
    if not n:
        return pairs.select("a", "b").limit(0)
    mask = docs.sparkSession.sparkContext.broadcast(id_mask(wanted, n))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _id_marks(batch.column("doc_id"))
            known = _holds(mask.value, marks)
            if not known.any():
                continue
            batch, marks = batch.filter(pa.array(known)), marks[known]
            for at, end, data, bounds in _slices(batch.column("text")):
                values, sizes = shingle_sets(data, bounds, words)
                keys, ends = _set_keys(values, sizes), np.cumsum(sizes)
                hit = np.flatnonzero(_holds(mask.value, _mixed(marks[at:end] ^ keys.view(np.uint64))))
                yield pa.record_batch({"key": pa.array(keys[hit]), "shingles": pa.array([values[ends[k] - sizes[k] : ends[k]].tobytes() for k in hit], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = cut_lineage(texts.mapInArrow(sets, "key long, shingles binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            good = [reaches(np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64), percent) for k in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = held.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    two = held.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    # a hub's set is repeated for parts of its pairs rather than all pairs sent to where the set is
    both = join_spread(join_spread(pairs, one, "a", "b"), two, "b", "a", loads=pairs.groupBy("b").count())
    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long").distinct()


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text).

    n_shingles is the size of the document's set of `words`-word shingles (lower-cased A-Z; white space
    separates words); a text with fewer words is one shingle as a whole. Documents link when their sets
    have at least `percent` hundredths of their union in common; component_id is the smallest doc_id
    that links reach. A null text and one without words have no shingles and no links: component_id is
    their own doc_id. Repeated rows come back as often as given and link like copies. A null doc_id is
    never the smallest if the component has another. Other columns are not read. Sets and texts of any
    length are handled whole.
    """
    seen, known = linked_classes(docs, words, percent)
    return _named(seen, known)


def linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and key (of its set) for each row of docs; and for each key with shingles its component and the smallest doc_id reached."""
    seen = cut_lineage(short_lists(docs, words, percent))
    classes = cut_lineage(seen.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id")))

    rank = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n"))
    postings = seen.select("key", "n", F.posexplode("short").alias("pos", "token")).select("token", "key", rank.alias("rank"))
    hubs = postings.groupBy("token").agg(F.min("key").alias("k0"), F.max("key").alias("k1"), F.min_by("key", "rank").alias("other"), F.min("rank").alias("other_rank"))
    hubs = hubs.filter("k0 <> k1").select(F.col("token").alias("t"), "other", "other_rank")
    live = postings.join(hubs, F.col("token") == F.col("t")).select("token", "key", *_unpacked("rank", "n", "pos"), "other", *_unpacked("other_rank", "m", "at"))
    live = cut_lineage(live.distinct())

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = cut_lineage(live.filter((F.col("key") != F.col("other")) & _room(percent)).select(*ordered("key", "other")).distinct())
    links = cut_lineage(probe(docs, classes, stars, words, percent))

    labels = components(links)
    marked = live.join(labels, F.col("key") == F.col("node"), "left").select("token", "key", "n", "pos", F.coalesce("label", "key").alias("label"))
    marked = cut_lineage(marked)
    main = marked.groupBy("token", "label").count().groupBy(F.col("token").alias("t")).agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"))
    mixed = marked.join(main.filter("labels > 1"), F.col("token") == F.col("t")).drop("t")
    rest = mixed.filter("label <> main").select("token", "key", "n", "pos", "label", "main")
    every = mixed.select(F.col("token").alias("t"), F.col("key").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("other_label"))
    crossing = (F.col("token") == F.col("t")) & (F.col("label") != F.col("other_label")) & ((F.col("other_label") == F.col("main")) | (F.col("key") < F.col("other"))) & _room(percent)
    more = cut_lineage(rest.join(every, crossing).select(*ordered("key", "other")).distinct())
    more = probe(docs, classes, more.join(stars, ["a", "b"], "left_anti"), words, percent)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    named = labels.join(classes, labels["node"] == classes["key"]).select("label", "node", "first_id")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("reached"))
    reached = named.join(smallest, "label").select(F.col("node").alias("key"), "label", "reached")
    known = classes.join(reached, "key", "left").select("key", F.coalesce("label", "key").alias("component"), F.coalesce("reached", "first_id").alias("reached"))
    return seen, known


def _named(seen: DataFrame, known: DataFrame) -> DataFrame:
    out = join_spread(seen.select("doc_id", "n", "key"), known, "key", "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("reached")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """One row of each component of docs, with all its columns: the one with the smallest doc_id.

    Rows whose doc_id is null or shared are told apart by their text: each belongs to the component of its
    own set. Of the rows of a component with its smallest doc_id, or of one with null ids only, the row
    with the smallest text stays. A text without words links with nothing and stays; of rows with equal
    doc_id and text one stays.
    """
    seen, known = linked_classes(docs, words, percent)
    tagged = cut_lineage(_named(seen, known))
    going = tagged.filter("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    twice = tagged.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id")
    going, twice = (cut_lineage(df) for df in (going.withColumnRenamed("doc_id", "_gone"), twice.withColumnRenamed("doc_id", "_twice")))
    few = going.count() <= broadcast_rows
    staying_of = lambda rows: _without(rows, going) if few else rows.join(going, F.col("doc_id") == F.col("_gone"), "left_anti")
    if twice.isEmpty():
        return staying_of(docs)
    shared = twice.filter("_twice IS NOT NULL")
    small = F.broadcast(shared) if shared.count() <= broadcast_rows else shared
    named = docs.filter("doc_id IS NOT NULL")
    once = staying_of(named.join(small, F.col("doc_id") == F.col("_twice"), "left_anti"))
    again = named.join(small, F.col("doc_id") == F.col("_twice"), "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    again = again.dropDuplicates(["doc_id", "text"])
    keyed = cut_lineage(set_keys(again, words))
    # the first row of each set, then the first of each component; neither gathers a group in one task
    place = F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_text")
    first = keyed.filter("_n > 0").groupBy("_key").agg(F.min(place).alias("place"))
    first = first.join(known, F.col("_key") == F.col("key")).filter(F.col("place._id").eqNullSafe(F.col("reached")))
    first = first.groupBy("component").agg(F.min("place").alias("place")).select("place._id", "place._text")
    staying = cut_lineage(first.unionByName(keyed.filter("_n = 0").select("_id", "_text")))
    chosen = again.join(staying, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text").eqNullSafe(F.col("_text")), "left_semi")
    return once.unionByName(chosen)


def _without(docs: DataFrame, going: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is not in going (_gone): eight bytes for each of its rows are broadcast."""
    gone = docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(going.toArrow().column("_gone"))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("_id").fill_null(0))
            place = np.minimum(np.searchsorted(gone.value, ids), max(0, len(gone.value) - 1))
            stays = gone.value[place] != ids if len(gone.value) else np.ones(len(ids), dtype=bool)
            yield batch.drop_columns(["_id"]).filter(pc.or_(batch.column("_id").is_null(), pa.array(stays)))

    return docs.withColumn("_id", F.col("doc_id").cast("long")).mapInArrow(apply, docs.schema)


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """_id, _text, and the size _n and name _key of its set for each row of docs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in _slices(batch.column("_text")):
                values, sizes = shingle_sets(data, bounds, words)
                rows = batch.slice(at, end - at)
                yield pa.record_batch({"_id": rows.column("_id"), "_text": rows.column("_text"), "_n": pa.array(sizes.astype(np.int64)), "_key": pa.array(_set_keys(values, sizes))})

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(apply, "_id long, _text string, _n long, _key long")
