"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced k-means over a bounded sample; there are some `LISTS_A_ROOT` times the square
root of the rows. Every vector is put on the posting list of its nearest centroid and, if it lies near a
border, on those of further centroids whose distance is within `closure` of the least. Centroids are
found by best-first search over a graph that joins each to its nearest neighbours, held in each worker's
memory; rows that lie near each other go through it together, so that a step is one matrix product and only centroids that were
met are held. A query reads the lists whose centroids lie within `reach` times the mean distance of the
`REFERENCE` nearest ones. reach is measured, not guessed: some of the queries are compared with every vector of the table, and
it is the ratio with which a `recall` share of their true neighbours is on a list that is read. So clustered vectors have few
lists read and scattered ones many, however small the sample is from which the centroids come.

Lists are stored in blocks of at most `block_rows` vectors, queries of a list in blocks of at most as
many, and each pair of blocks is one matrix product, so neither a crowded list nor a popular one ends
up in one task. Of equal vectors in a block only the smallest ids can be among the nearest.

The largest inner product is turned into the least distance by one more component, sqrt(M^2 - |v|^2)
for vectors with M the largest length, and 0 for queries. Scores are inner products of the original
vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.shared import cut_lineage, sample_rows

LISTS_A_ROOT, ROWS_A_CENTROID, REFERENCE = 2, 16, 16
#: Products of equal vectors in one matrix product may differ by this share of the lengths' product.
ROUNDING = 1e-12


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means over rows of equal length, with centroids of that length, so that none is near to all rows.

    A centroid gets a handicap for having more than its share of the rows and an advantage for having less.
    """
    r = np.random.default_rng(seed)
    length = max(float(np.sqrt((x**2).sum(1).max(initial=0))), 1e-300)
    centroids = x[r.choice(len(x), lists, replace=False)]
    handicap = np.zeros(lists)
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 4096] @ centroids.T - handicap).argmax(1) for at in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        far = np.sqrt((total**2).sum(1))
        filled = far > 1e-9 * length
        centroids[filled] = total[filled] * (length / far[filled, None])
        if (~filled).any():
            centroids[~filled] = x[r.choice(len(x), (~filled).sum())]
        handicap = np.where(filled, handicap + 0.02 * length**2 * np.clip(np.log(np.maximum(size, 1) / (len(x) / lists)), -1, 1), 0)
    return centroids


class CentroidGraph:
    """Centroids, each joined to its `degree` nearest ones and to a random one."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.centroids, self.square = centroids, (centroids**2).sum(1)
        n = len(centroids)
        degree = min(degree, n)
        self.near = np.empty((n, degree), dtype=np.int64)
        for at in range(0, n, 512):
            gap = self.square[None] - 2 * centroids[at : at + 512] @ centroids.T
            self.near[at : at + 512] = np.argpartition(gap, degree - 1, axis=1)[:, :degree]
        # so that far regions are joined
        self.near = np.concatenate([self.near, np.random.default_rng(1).permutation(n)[:, None]], axis=1)
        self.entries = np.linspace(0, n - 1, min(n, 16)).astype(np.int64)

    def search(self, x: np.ndarray, ratio: float, reference: int, breadth: int = 24, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of x, centroids and distances: those within `ratio` times the mean distance of the `reference` nearest centroids, and the nearest in any case.

        Best-first: the nearest centroids not yet expanded are expanded, until they are farther than that and
        than the `breadth` nearest found, for every row of a block. A block's rows share their nearest pivot, as far as they
        can; it has `cells` distances at most, and 16 rows at least.
        """
        n = len(self.centroids)
        reference, breadth = min(reference, n), min(max(breadth, reference), n)
        pivots = np.unique(np.linspace(0, n - 1, max(min(n, 16), math.isqrt(n))).astype(np.int64))
        own = (x**2).sum(1)
        far = lambda rows, nodes: np.maximum(own[rows, None] + self.square[nodes] - 2 * x[rows] @ self.centroids[nodes].T, 0)
        size = max(16, min(256, cells // n))
        few = min(4, len(pivots))
        home = np.concatenate([far(np.arange(at, min(at + 1024, len(x))), pivots).argpartition(few - 1, axis=1)[:, :few] for at in range(0, len(x), 1024)]) if len(x) else np.zeros((0, few), dtype=np.int64)
        order = np.argsort(home[:, 0], kind="stable")
        for start in range(0, len(x), size):
            rows = order[start : start + size]
            met = np.zeros(n, dtype=bool)
            ids = pivots[np.unique(home[rows])]
            met[ids] = True
            gaps, expanded = far(rows, ids), np.zeros(len(ids), dtype=bool)
            while True:
                limit = np.full(len(rows), np.inf)
                if gaps.shape[1] >= breadth:
                    nearest = np.partition(gaps, breadth - 1, axis=1)[:, :breadth]
                    limit = np.maximum(nearest[:, breadth - 1], (ratio * np.sqrt(np.partition(nearest, reference - 1, axis=1)[:, :reference]).mean(1)) ** 2)
                # of those that some row still needs, the ones nearest to a row
                need = np.flatnonzero(~expanded & (gaps <= limit[:, None]).any(0))
                if not len(need):
                    break
                take = max(16, len(need) // 2)
                if len(need) > take:
                    need = need[np.argpartition(gaps[:, need].min(0), take - 1)[:take]]
                expanded[need] = True
                new = np.unique(self.near[ids[need]])
                new = new[~met[new]]
                if len(new):
                    met[new] = True
                    ids, gaps, expanded = np.concatenate([ids, new]), np.concatenate([gaps, far(rows, new)], axis=1), np.concatenate([expanded, np.zeros(len(new), dtype=bool)])
            distance = np.sqrt(gaps)
            # the nearest one in any case
            limit = np.maximum(ratio * np.sort(np.partition(distance, reference - 1, axis=1)[:, :reference], axis=1).mean(1), distance.min(1))
            row, node = np.nonzero(distance <= limit[:, None] * (1 + 1e-12))
            yield rows[row], ids[node], distance[row, node]


def measured_reach(x: np.ndarray, asked: np.ndarray, centroids: np.ndarray, closure: float, most_copies: int, k: int, recall: float) -> float:
    """reach_of the k nearest rows of x to its rows numbered `asked`. x has the added component."""
    questions = np.concatenate([x[asked, :-1], np.zeros((len(asked), 1))], axis=1)
    score = questions @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    return reach_of(questions, [x[rows] for rows in np.argpartition(-score, k - 1, axis=1)[:, :k]], centroids, closure, most_copies, recall)


def reach_of(questions: np.ndarray, found: list[np.ndarray], centroids: np.ndarray, closure: float, most_copies: int, recall: float) -> float:
    """The ratio within which lie the nearest lists of a `recall` share of the neighbours found for each question; all with the added component."""
    far = lambda rows: np.sqrt(np.maximum((rows**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * rows @ centroids.T, 0))
    reference, copies = min(REFERENCE, len(centroids)), min(most_copies, len(centroids))
    needed = []
    for question, rows in zip(questions, found):
        if len(rows):
            distance, away = far(question[None])[0], far(rows)
            ratio = distance / max(np.partition(distance, reference - 1)[:reference].mean(), 1e-300)
            lists = np.argpartition(away, copies - 1, axis=1)[:, :copies]
            near = np.take_along_axis(away, lists, 1)
            needed.append(np.where(near <= closure * near.min(1)[:, None], ratio[lists], np.inf).min(1))
    return float(np.quantile(np.concatenate(needed), recall)) if needed else 1.0


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.94, sample: int = 20_000, most_sample: int = 400_000, closure: float = 1.02, most_copies: int = 2,
    block_rows: int = 2_048, probes: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id and score: for each query its k nearest vectors found, by largest inner product.

    vectors: vec_id, embedding; queries: the same. A vector takes no part, on either side, if it is null,
    empty or zero, has a null, infinite or NaN component, has no vec_id, or has not as many components
    as most rows. A query is not its own neighbour: rows with its vec_id are left out. Ties go to the
    smaller vec_id; of rows that share a vec_id the nearest counts. A query gets fewer than k rows only
    if there are fewer candidates. The centroids are fitted on at most `sample` rows, or ROWS_A_CENTROID for each list if that is more,
    `most_sample` in any case, the reach on `probes` queries against every row; the index holds all rows.
    `recall` is the share of true neighbours aimed at. Other columns are not read.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))

    base, asked = clean(vectors), clean(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows"), F.max(square).alias("top")).orderBy(F.desc("rows"), "dim").first()
    if sizes is None:
        return empty
    dim, rows, top = sizes["dim"], sizes["rows"], sizes["top"]
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)

    wanted = math.ceil(LISTS_A_ROOT * math.sqrt(rows))
    drawn = matrix(sample_rows(base, F.struct("vec_id", "v"), min(most_sample, max(sample, ROWS_A_CENTROID * wanted))).select("v").toArrow().column("v"), dim)
    lists = max(1, min(wanted, len(drawn) // ROWS_A_CENTROID))
    graph = CentroidGraph(balanced_centroids(lift(drawn, top), lists))
    reach = reach_of(*true_neighbours(base, asked, k, probes, dim, top), graph.centroids, closure, most_copies, recall)
    shared = spark.sparkContext.broadcast(graph)  # a row for each list

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lift(matrix(batch.column("v"), dim), top)
            for row, found, distance in shared.value.search(x, closure, 1):
                order = np.lexsort((found, distance, row))
                row, found, distance = row[order], found[order], distance[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                near = place < most_copies
                whose = pa.array(row[near])
                yield pa.record_batch({"list": pa.array(found[near].astype(np.int32)), "home": pa.array(place[near] == 0), "vec_id": batch.column("vec_id").take(whose), "v": batch.column("v").take(whose)})

    def route(batches: Iterator[pa.RecordBatch], home: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([matrix(batch.column("v"), dim), np.zeros((len(batch), 1))], axis=1)
            for row, found, _ in shared.value.search(x, reach, REFERENCE):
                here = np.unique(row)
                held = np.bincount(row, weights=home[found], minlength=len(x))
                short = here[held[here] <= k]  # too few rows: all lists, so that no candidate is missed
                keep = ~np.isin(row, short)
                row, lists_read = np.concatenate([row[keep], np.repeat(short, len(home))]), np.concatenate([found[keep], np.tile(np.arange(len(home)), len(short))])
                whose = pa.array(row)
                yield pa.record_batch({"list": pa.array(lists_read.astype(np.int32)), "query_id": batch.column("vec_id").take(whose), "q": batch.column("v").take(whose)})

    postings = cut_lineage(base.mapInArrow(assign, "list int, home boolean, vec_id long, v array<double>"))
    stats = {r["list"]: (r["n"], r["h"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).collect()}  # a row for each list
    home = np.array([stats.get(i, (0, 0))[1] for i in range(lists)])
    routed = cut_lineage(asked.mapInArrow(lambda batches: route(batches, home), "list int, query_id long, q array<double>"))
    load = {r["list"]: r["n"] for r in routed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = [(i, -(-stats[i][0] // block_rows), -(-load.get(i, 0) // block_rows)) for i in stats]
    plan = F.broadcast(spark.createDataFrame(blocks, "list int, v_blocks int, q_blocks int"))  # a row for each list

    sided = {}
    for side, df, key, value in (("v", postings, "vec_id", "v"), ("q", routed, "query_id", "q")):
        own, other = ("v", "q") if side == "v" else ("q", "v")
        df = df.select("list", F.col(key).alias("id"), F.col(value).alias("vector")).join(plan, "list")
        df = df.withColumn(f"{own}_block", F.pmod(F.xxhash64("id", F.lit(side)), F.col(f"{own}_blocks").cast("long")).cast("int"))
        df = df.withColumn(f"{other}_block", F.explode(F.when(F.col(f"{other}_blocks") > 0, F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))))
        sided[side] = df.select("list", "v_block", "q_block", "id", "vector").groupBy("list", "v_block", "q_block")

    def compare(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if q.num_rows and v.num_rows:
            ids, x = distinct_rows(np.asarray(v.column("id")), matrix(v.column("vector").combine_chunks(), dim), k + 1)
            whose, y = np.asarray(q.column("id")), matrix(q.column("vector").combine_chunks(), dim)
            far = np.sqrt((x**2).sum(1).max())
            for at in range(0, len(y), 256):
                part = y[at : at + 256]
                score = part @ x.T
                score[whose[at : at + 256, None] == ids[None]] = -np.inf
                last = -np.partition(-score, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(part), -np.inf)
                # with what equals the last within rounding; the exact order is made of exact scores below
                row, col = np.nonzero(np.isfinite(score) & (score >= (last - ROUNDING * far * np.sqrt((part**2).sum(1)))[:, None]))
                out["query_id"].append(whose[at + row])
                out["vec_id"].append(ids[col])
                out["score"].append((part[row] * x[col]).sum(1))
        return pa.table({name: pa.array(np.concatenate(parts) if parts else [], pa.float64() if name == "score" else pa.int64()) for name, parts in out.items()})

    pairs = sided["q"].cogroup(sided["v"]).applyInArrow(compare, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def true_neighbours(base: DataFrame, asked: DataFrame, k: int, probes: int, dim: int, top: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """At most `probes` of the queries and the k nearest rows of the whole table to each, all with the added component.

    A batch keeps the k best of its rows for each probe, so k rows for each probe and batch are exchanged and k for each reach the driver.
    """
    spark = base.sparkSession
    few = sample_rows(asked, F.struct("vec_id", "v"), probes).toArrow()
    if not len(few):
        return np.zeros((0, dim + 1)), []
    ids, questions = few.column("vec_id").to_numpy(), matrix(few.column("v"), dim)
    shared = spark.sparkContext.broadcast((ids, questions))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asks = shared.value
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                score = asks @ matrix(part.column("v"), dim).T
                score[names[:, None] == part.column("vec_id").to_numpy()[None]] = -np.inf
                count = min(k, len(part))
                row = np.argpartition(-score, count - 1, axis=1)[:, :count].ravel()
                probe = np.repeat(np.arange(len(names)), count)
                found = np.isfinite(value := score[probe, row])
                yield pa.record_batch({"probe": pa.array(probe[found].astype(np.int32)), "score": pa.array(value[found]), "vec_id": part.column("vec_id").take(pa.array(row[found])), "v": part.column("v").take(pa.array(row[found]))})

    nearest = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    kept = base.mapInArrow(best, "probe int, score double, vec_id long, v array<double>").withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("probe", "v").toArrow()
    rows, probe = lift(matrix(kept.column("v"), dim), top), kept.column("probe").to_numpy()
    return np.concatenate([questions, np.zeros((len(questions), 1))], axis=1), [rows[probe == i] for i in range(len(questions))]


def distinct_rows(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows without repeated ones, and of equal vectors those with the `most` smallest ids."""
    mark = (x * np.random.default_rng(4).normal(size=x.shape[1])).sum(1)  # equal for equal vectors
    order = np.lexsort((ids, mark))
    ids, x = ids[order], x[order]
    same = np.zeros(len(ids), dtype=bool)
    same[1:] = (x[1:] == x[:-1]).all(1)
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = ~same[1:] | (ids[1:] != ids[:-1])
    ids, x, same = ids[fresh], x[fresh], same[fresh]
    starts = np.flatnonzero(~same)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    keep = place < most
    return ids[keep], x[keep]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes all of them equally long."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]], axis=1)
