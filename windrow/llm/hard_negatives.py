"""Hard negatives by branch and bound over ball trees.

An anchor's hard negatives for one of its positives are the rows of other labels whose inner product with the
anchor lies in a window beneath the positive's. Vectors are made integers, so all products are exact.

The top of the tree is fitted on a bounded sample and splits space into regions; every row goes down those splits.
The rows of a region are dealt into blocks of some `block_rows`, and each block builds a ball tree of its
own: nodes with a centre, a radius and the labels beneath them, stored as one binary row. |q|r around q.c bounds
all products of a node from above and from below. Nodes outside the window, without a wanted label, or strictly
beneath the k-th best found so far are pruned, for whole runs of anchors at once; equality is not
pruned, so ties are decided by exact scores and ids. The k-th best starts from the sample, whose rows are rows
of the table, so an anchor is not even sent to regions that cannot matter. Where a region or its anchors are
many, anchors are dealt in chunks, each against all blocks of the region.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.shared import cut_lineage, sample_rows, whole_vectors

NONE, LABEL_BITS = -(2**62), 62


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: as doubles where these hold all sums, else as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def label_bits(labels: np.ndarray) -> np.ndarray:
    """One bit for each label; different labels may share one, so that a node may be read in vain but never missed."""
    return np.int64(1) << (labels % LABEL_BITS)


def split(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction between two rows that lie far apart, and the median of the rows along it."""
    far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    other = x[((x - far) ** 2).sum(1).argmax()]
    return other - far, float(np.median(x @ (other - far)))


class Regions:
    """The top of the tree: splits fitted on a sample, and a centre for each leaf."""

    def __init__(self, x: np.ndarray, wanted: int):
        self.nodes: list[tuple] = []  # direction, cut, left, right; children below 0 are regions
        self.centers: list[np.ndarray] = []
        self.root = self.grow(x.astype(np.float64), wanted)
        self.center = np.rint(np.array(self.centers)).astype(np.int64)

    def grow(self, x: np.ndarray, wanted: int) -> int:
        if wanted > 1 and len(x) > 1:
            direction, cut = split(x)
            left = x @ direction < cut
            if left.any() and not left.all():
                at = len(self.nodes)
                self.nodes.append(())
                self.nodes[at] = (direction, cut, self.grow(x[left], wanted // 2), self.grow(x[~left], wanted - wanted // 2))
                return at
        self.centers.append(x.mean(0))
        return -len(self.centers)

    def find(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), dtype=np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                direction, cut, left, right = self.nodes[node]
                below = x[rows] @ direction < cut
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


class BallTree:
    """Rows in the order of a tree of balls, halved along far rows until `leaf` or fewer are left."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = 64):
        real, order = x.astype(np.float64), np.arange(len(x))
        nodes, todo = [], [(0, len(x), -1)]
        while todo:
            start, end, parent = todo.pop()
            rows = order[start:end]
            center = real[rows].mean(0)
            radius = math.sqrt(((real[rows] - center) ** 2).sum(1).max()) * (1 + 1e-9)
            at = len(nodes)
            nodes.append([start, end, 0, 0, center, radius, np.bitwise_or.reduce(label_bits(labels[rows]))])
            if parent >= 0:
                nodes[parent][2 if not nodes[parent][2] else 3] = at
            if end - start > leaf and radius > 0:
                along = real[rows] @ split(real[rows])[0]
                middle = (end - start) // 2
                order[start:end] = rows[np.argpartition(along, middle)]
                todo += [(start, start + middle, at), (start + middle, end, at)]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.span, self.child = np.array([n[:2] for n in nodes]), np.array([n[2:4] for n in nodes])
        self.center, self.radius, self.bits = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes]), np.array([n[6] for n in nodes])

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, floor: np.ndarray, top: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """anchor row, window, id and score of the k best rows of each anchor and window, highest score first, ties to the smaller id.

        floor and top: the least and the greatest score, by anchor and window. same: rows of the anchor's
        label other than itself; else rows of other labels.
        """
        windows = floor.shape[1]
        best, whose = np.full((len(q), windows, k), NONE, dtype=np.int64), np.zeros((len(q), windows, k), dtype=np.int64)
        real = q.astype(np.float64)
        length, bits = np.sqrt((real**2).sum(1)), label_bits(labels)
        exact = self.x.astype(np.int64)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            # the k-th best may have risen since the node was put aside
            upper, lower = self.bounds(node, real, length, rows)
            kth = np.maximum(floor[rows], best[rows, :, k - 1])
            alive = ((upper[:, None] >= kth) & (lower[:, None] <= top[rows])).any(1)
            alive &= (self.bits[node] & bits[rows]) != 0 if same else (self.bits[node] != bits[rows]) | self.mixed(node, labels[rows])
            rows = rows[alive]
            if not len(rows):
                continue
            left, right = self.child[node]
            if left:
                near, far = (left, right) if self.bounds(left, real, length, rows)[0].mean() >= self.bounds(right, real, length, rows)[0].mean() else (right, left)
                todo += [(far, rows), (near, rows)]
                continue
            start, end = self.span[node]
            # equal rows may fill a leaf of any size
            for at in range(start, end, 1024):
                own = slice(at, min(at + 1024, end))
                score = products(q[rows], exact[own])
                wanted = self.labels[own][None] == labels[rows, None]
                wanted = wanted & (self.ids[own][None] != ids[rows, None]) if same else ~wanted
                for w in range(windows):
                    kth = np.maximum(floor[rows, w], best[rows, w, k - 1])
                    fit = wanted & (score >= kth[:, None]) & (score <= top[rows, w, None])
                    some = np.flatnonzero(fit.any(1))
                    if len(some):
                        at_rows = rows[some]
                        scores = np.concatenate([best[at_rows, w], np.where(fit[some], score[some], NONE)], axis=1)
                        names = np.concatenate([whose[at_rows, w], np.broadcast_to(self.ids[own], (len(some), own.stop - own.start))], axis=1)
                        order = np.lexsort((names, -scores))[:, :k]
                        best[at_rows, w], whose[at_rows, w] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        row, window, place = np.nonzero(best > NONE)
        return row, window, whose[row, window, place], best[row, window, place]

    def bounds(self, node: int, real: np.ndarray, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = real[rows] @ self.center[node]
        reach = length[rows] * self.radius[node]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle + reach + slack, middle - reach - slack

    def mixed(self, node: int, labels: np.ndarray) -> np.ndarray:
        """Whether a node whose labels share the anchor's bit holds another label."""
        start, end = self.span[node]
        own = self.labels[start:end]
        return ~((own[0] == labels) & (own == own[0]).all())


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, sample: int = 8_192, block_rows: int = 8_192,
    most_regions: int = 1_024, anchors_at_once: int = 2_048,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, embedding, label (an integer). A row takes no part if any of these is null, if its vector is
    empty, has a null, infinite or NaN component or not as many components as most rows. Of rows that share a vec_id
    the one with the smallest label, then the smallest vector, counts, so repeated rows count once. Components become
    floor(scale * x); a score is the inner product with the anchor, higher first, ties to the smaller vec_id.
    Anchors are the rows for which `anchor` is true. An anchor's positives are its first `positives` other rows of its
    label; for each, the first `negatives` rows of other labels with low * positive <= 100 * negative <= high *
    positive follow, ranked from 1. Fewer, where there are fewer; a positive without negatives has no row.
    The result does not depend on sample, block_rows, most_regions and anchors_at_once. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept, dim = whole_vectors(vectors, scale, "vec_id", "label")
    if dim is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x").filter("vec_id IS NOT NULL AND label IS NOT NULL")
    kept = cut_lineage(kept)
    shared_ids = cut_lineage(kept.groupBy("vec_id").count().filter("count > 1").select("vec_id"))  # ids only are exchanged
    if not shared_ids.isEmpty():
        one = kept.join(shared_ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
        kept = cut_lineage(kept.join(shared_ids, "vec_id", "left_anti").unionByName(one))

    drawn = sample_rows(kept, F.struct("vec_id"), sample).collect()
    if not drawn:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    known = [np.array([r[c] for r in drawn], dtype=np.int64) for c in ("vec_id", "label", "x")]
    regions = Regions(known[2], max(1, min(most_regions, kept.count() // block_rows)))
    top_of_tree = spark.sparkContext.broadcast(regions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            found = top_of_tree.value.find(x.astype(np.float64))
            gap = ((x - top_of_tree.value.center[found]) ** 2).sum(1)
            bits = label_bits(batch.column("label").to_numpy())
            yield pa.record_batch({"region": pa.array(found.astype(np.int32)), "gap": pa.array(gap), "bits": pa.array(bits), "vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": batch.column("x")})

    placed = cut_lineage(kept.mapInArrow(place, "region int, gap long, bits long, vec_id long, label long, x array<int>"))
    stats = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.bit_or("bits").alias("bits")).collect()  # `most_regions` rows at most
    blocks = {r["region"]: -(-r["n"] // block_rows) for r in stats}
    known_regions = np.array(sorted(blocks))
    reach = {r["region"]: (math.sqrt(r["gap"]) * (1 + 1e-9), r["bits"]) for r in stats}
    radius, bits = np.array([reach[r][0] for r in known_regions]), np.array([reach[r][1] for r in known_regions])
    plan = spark.createDataFrame([(r, n) for r, n in blocks.items()], "region int, blocks int")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tree = BallTree(np.asarray(rows.column("vec_id")), np.asarray(rows.column("label")), matrix(rows.column("x"), dim))
        return pa.table({"region": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    dealt = placed.join(F.broadcast(plan), "region").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int"))
    trees = cut_lineage(dealt.select("region", "block", "vec_id", "label", "x").groupBy("region", "block").applyInArrow(build, "region int, block int, tree binary"))
    shared = spark.sparkContext.broadcast((known, known_regions, regions.center[known_regions], radius, bits))
    anchors = kept.filter(anchor)

    def route(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
        """Each anchor once for each region that may hold one of its rows, with its windows, their least scores raised by what the sample holds."""
        (some_ids, some_labels, some), ids_of, center, radius, region_bits = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids, labels, q = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("x"), dim)
                floor, top = windows_of(batch, same)
                score = products(q, some)
                wanted = some_labels[None] == labels[:, None]
                wanted = wanted & (some_ids[None] != ids[:, None]) if same else ~wanted
                if some.shape[0] >= k:
                    for w in range(floor.shape[1]):
                        fit = np.where(wanted & (score <= top[:, w, None]), score, NONE)
                        floor[:, w] = np.maximum(floor[:, w], np.partition(fit, len(some) - k, axis=1)[:, len(some) - k])
                real = q.astype(np.float64)
                middle, length = real @ center.T.astype(np.float64), np.sqrt((real**2).sum(1))[:, None] * radius
                slack = 1e-9 * (np.abs(middle) + length) + 1e-6
                go = (((middle + length + slack)[:, :, None] >= floor[:, None]) & ((middle - length - slack)[:, :, None] <= top[:, None])).any(2)
                if same:
                    go &= (region_bits[None] & label_bits(labels)[:, None]) != 0
                row, region = np.nonzero(go)
                out = {"region": pa.array(ids_of[region].astype(np.int32))}
                out |= {c: batch.column(c).take(pa.array(row)) for c in batch.schema.names if c not in ("floor", "top")}
                yield pa.record_batch(out | {"floor": pa.array(list(floor[row]), pa.list_(pa.int64())), "top": pa.array(list(top[row]), pa.list_(pa.int64()))})

    def windows_of(batch: pa.RecordBatch, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score wanted; windows that are missing are empty."""
        if same:
            return np.full((len(batch), 1), NONE, dtype=np.int64), np.full((len(batch), 1), 2**62, dtype=np.int64)
        floor, top = np.full((len(batch), positives), 2**62, dtype=np.int64), np.full((len(batch), positives), NONE, dtype=np.int64)
        for row, scores in enumerate(batch.column("scores").to_pylist()):
            for w, p in enumerate(scores):
                floor[row, w], top[row, w] = -(-low * p // 100), high * p // 100
        return floor, top

    def nearest(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor_id, window, vec_id and score of the best rows in each block."""
        fields = "region int, vec_id long, label long, x array<int>" + ("" if same else ", positive_ids array<long>, scores array<long>") + ", floor array<long>, top array<long>"
        routed = cut_lineage(asked.mapInArrow(lambda b: route(b, same, k), fields))
        load = routed.groupBy("region").count().collect()  # `most_regions` rows at most
        chunks = spark.createDataFrame([(r["region"], blocks[r["region"]], -(-r["count"] // anchors_at_once)) for r in load], "region int, blocks int, chunks int")
        left = routed.join(F.broadcast(chunks), "region").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("chunks").cast("long")).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "chunks")
        right = trees.join(F.broadcast(chunks), "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("region", "block", "chunk", "tree")

        def compare(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
            found = [np.zeros(0, dtype=np.int64)] * 4
            if q.num_rows and t.num_rows:
                tree: BallTree = pickle.loads(t.column("tree")[0].as_py())
                ids = np.asarray(q.column("vec_id"))
                floor, top = (np.array(q.column(c).to_pylist(), dtype=np.int64) for c in ("floor", "top"))
                row, *rest = tree.search(ids, np.asarray(q.column("label")), matrix(q.column("x"), dim), floor, top, same, k)
                found = [ids[row], *rest]
            return pa.table(dict(zip(("anchor_id", "win", "vec_id", "score"), map(pa.array, found))))

        keys = ("region", "block", "chunk")
        best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "anchor_id long, win long, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = cut_lineage(nearest(anchors, True, positives))
    listed = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # `positives` at most
    asked = anchors.join(listed, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("scores"))
    found = nearest(asked, False, negatives)
    given = first.select("anchor_id", (F.col("rank") - 1).cast("long").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["anchor_id", "win"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dim)
