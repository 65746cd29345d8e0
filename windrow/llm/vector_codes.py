"""Product codes of vectors: small codebooks for parts of a vector, trained by Lloyd rounds with the Exponion search.

Vectors become integers, and every distance is an exact integer, so codes do not depend on how rows are
batched. A round gives each part its nearest entry. The search starts at the part's previous entry: an entry
that is as near as that one lies within twice their distance of it, in squares within four times, so only
that prefix of the previous entry's distance-sorted list of neighbours is read. Rows whose prefixes are of
like length are compared in one array.

A round is two passes without a shuffle of vectors: one writes rows with their codes as a table in the shared
folder, the other adds up the parts of each entry within its batches. Only these sums, a row for each entry
and task, are exchanged, and the codebooks (`parts` * `entries` entries) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import cut_lineage, join_spread, whole_vectors

ROWS_AT_ONCE = 8_192


class Codebook:
    """Entries by part, and for each entry all entries sorted by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # part, entry, component
        gap = ((entries[:, :, None] - entries[:, None]) ** 2).sum(-1)
        self.order = np.argsort(gap, axis=2, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, 2)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part of x (row, part, component), ties to the lower index, and its squared distance.

        start: the entry of each part from which the search starts; any gives the same result.
        """
        code, error = np.empty(start.shape, dtype=np.int64), np.empty(start.shape, dtype=np.int64)
        n = self.entries.shape[1]
        for part in range(x.shape[1]):
            rows, at = x[:, part], start[:, part].astype(np.int64)
            own = ((rows - self.entries[part][at]) ** 2).sum(1)
            # how many entries of the start's list lie within the radius; the start itself is among them
            reach = (self.gap[part][at] <= 4 * own[:, None]).sum(1)
            level = np.ceil(np.log2(reach)).astype(np.int64)  # prefixes are rounded up to a power of two
            for step in np.unique(level):
                size, members = min(1 << int(step), n), np.flatnonzero(level == step)
                for first in range(0, len(members), ROWS_AT_ONCE):
                    some = members[first : first + ROWS_AT_ONCE]
                    near = self.order[part][at[some], :size]
                    gap = ((rows[some, None] - self.entries[part][near]) ** 2).sum(-1)
                    least = gap.min(1)
                    code[some, part] = np.where(gap == least[:, None], near, n).min(1)
                    error[some, part] = least
        return code, error


def encode_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 for each vector that takes part.

    vectors: vec_id, embedding, label. A vector takes no part if it is null or empty, has a null, infinite or NaN
    component, or not as many components as most rows, or if those cannot be cut into `parts` equal parts.
    Components become floor(scale * x), 2**24 in size at most. The codebook of a part starts as that part of the
    `entries` vectors with the smallest vec_ids (all, if fewer; nulls last, equal ids by their vectors). Each
    round replaces an entry by the floor of the mean of the parts nearest to it, ties to the lower index;
    unused entries stay. code: the entries of the parts after the rounds, two hexadecimal digits each (`entries` is 256 at
    most); error: the sum of their squared distances; label_error: the errors' sum over rows of that label, nulls
    together; codebooks_sha256: of all entries' components in decimal, joined by commas. Repeated rows have
    equal codes. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    kept, dim = whole_vectors(vectors, scale, "vec_id", "label")
    label_type = vectors.schema["label"].dataType.simpleString()
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if dim is None or dim % parts:
        return spark.createDataFrame([], f"vec_id {id_type}, label {label_type}, code string, error long, label_error long, codebooks_sha256 string")
    width = dim // parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # `entries` rows
    books = [Codebook(np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy())]

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("x").flatten()).astype(np.int64).reshape(len(batch), parts, width)

    def assign(batches: Iterator[pa.RecordBatch], book, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows with code (a byte for each part) or, after the last round, with the digits and the error."""
        for batch in batches:
            x = cut(batch)
            if "code" in batch.schema.names:
                start = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(batch), parts)
            else:
                start = rough(x, book.value)
            code, error = book.value.nearest(x, start)
            packed = code.astype(np.uint8).tobytes()
            pieces = [packed[i : i + parts] for i in range(0, len(packed), parts)]
            ids = {"vec_id": batch.column("vec_id"), "label": batch.column("label")}
            if last:
                yield pa.record_batch(ids | {"code": pa.array([p.hex() for p in pieces], pa.string()), "error": pa.array(error.sum(1))})
            else:
                yield pa.record_batch(ids | {"x": batch.column("x"), "code": pa.array(pieces, pa.binary())})

    def add_up(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        """The sum and the count of each entry's parts in the task."""
        total, count = np.zeros((parts * n, width), dtype=np.int64), np.zeros(parts * n, dtype=np.int64)
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(batch), parts)
            slot = (code.astype(np.int64) + np.arange(parts) * n).ravel()
            values = cut(batch).reshape(-1, width)
            count += np.bincount(slot, minlength=parts * n)
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            total[slot[order][starts]] += np.add.reduceat(values[order], starts, axis=0)
        used = np.flatnonzero(count)
        yield pa.record_batch({"slot": pa.array(used.astype(np.int32)), "n": pa.array(count[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    rows = kept
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books[-1])
        rows = cut_lineage(rows.mapInArrow(lambda b, s=shared: assign(b, s, False), f"vec_id {id_type}, label {label_type}, x array<int>, code binary"))
        n = books[-1].entries.shape[1]
        sums = rows.mapInArrow(lambda b, n=n: add_up(b, n), "slot int, n long, total array<long>")
        sums = sums.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width))).collect()  # a row for each entry
        flat = books[-1].entries.reshape(parts * n, width).copy()
        for r in sums:
            flat[r["slot"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
        books.append(Codebook(flat.reshape(parts, n, width)))
    final = books[-1]
    digest = hashlib.sha256(",".join(map(str, final.entries.ravel().tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(final)
    coded = cut_lineage(rows.mapInArrow(lambda b: assign(b, shared, True), f"vec_id {id_type}, label {label_type}, code string, error long"))
    # a null label needs a key of its own
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("count"))
    joined = join_spread(keyed, sums.select("_label", "label_error"), "_label", "vec_id", loads=sums.select("_label", "count"))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def rough(x: np.ndarray, book: Codebook, pivots: int = 8) -> np.ndarray:
    """For rows without a previous entry: the nearest of a few entries in each part."""
    some = np.unique(np.linspace(0, book.entries.shape[1] - 1, min(pivots, book.entries.shape[1])).astype(np.int64))
    out = np.empty(x.shape[:2], dtype=np.int64)
    for part in range(x.shape[1]):
        gap = ((x[:, part, None] - book.entries[part][some][None]) ** 2).sum(-1)
        out[:, part] = some[gap.argmin(1)]
    return out
