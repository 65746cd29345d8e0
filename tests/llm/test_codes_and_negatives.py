"""Vector codes and hard negatives against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, x string, region int, code int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, 1) for i, v, label in rows], SCHEMA).repartition(3)


def clustered(n, dim, seed, scale=0.4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(7, dim))
    return [[float(x) for x in np.float32(centers[i % 7] * 0.3 + r.normal(size=dim) * scale * 0.2)] for i in range(n)]


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def codes_of(rows, parts, entries, rounds):
    rows = [(i, whole(v), label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    piece = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    books = [[piece(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    pick = lambda v, p: min(range(len(books[p])), key=lambda e: (far(piece(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [pick(v, p) for _, v, _ in rows]
            book = []
            for e in range(len(books[p])):
                mine = [piece(v, p) for (_, v, _), o in zip(rows, own) if o == e]
                book.append([sum(c) // len(mine) for c in zip(*mine)] if mine else books[p][e])
            new.append(book)
        books = new
    out = [(i, "".join(f"{pick(v, p):02x}" for p in range(parts)), sum(far(piece(v, p), books[p][pick(v, p)]) for p in range(parts)), label) for i, v, label in rows]
    total = {}
    for _, _, error, label in out:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in out), key=str)


@pytest.mark.parametrize("n, entries, rounds", [(300, 16, 2), (5, 16, 3), (120, 7, 0)])
def test_codes(spark, n, entries, rounds):
    rows = [(i, v, None if i % 11 == 0 else i % 3) for i, v in enumerate(clustered(n, 8, n))]
    rows += [(3, rows[3][1], 1), (None, rows[1][1], 1), (n + 1, None, 1), (n + 2, [1.0, None] * 4, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [float("inf")] * 8, 1), (n + 5, [], 1)]
    rows += [(-5 - i, rows[0][1], 2) for i in range(40)]  # equal vectors, so equal entries and ties
    out = vector_codes.encode_vectors(frame(spark, rows), parts=4, entries=entries, rounds=rounds).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out), key=str) == codes_of(rows, 4, entries, rounds)


def test_codes_of_empty_and_odd_tables(spark):
    empty = frame(spark, [])
    assert vector_codes.encode_vectors(empty).count() == 0
    assert vector_codes.encode_vectors(frame(spark, [(1, [1.0] * 6, 1)]), parts=4).count() == 0
    # a vector of another length takes no part
    assert [r.vec_id for r in vector_codes.encode_vectors(frame(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 8, 1), (3, [1.0] * 4, 1)]), parts=4).orderBy("vec_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(empty, entries=300)


def test_any_start_gives_the_nearest_entry():
    r = np.random.default_rng(3)
    book = vector_codes.Codebook(r.integers(-5, 5, size=(2, 23, 3)))
    x = r.integers(-6, 6, size=(400, 2, 3))
    gap = ((x[:, :, None] - book.entries[None]) ** 2).sum(-1)
    for start in (0, 7, 22):
        code, error = book.nearest(x, np.full((400, 2), start))
        assert (code == gap.argmin(2)).all() and (error == gap.min(2)).all()


def test_a_near_start_reads_few_entries():
    """Clustered parts and the entry found before: the radius holds a small part of the entries."""
    r = np.random.default_rng(4)
    entries = r.integers(-1000, 1000, size=(1, 64, 4))
    book = vector_codes.Codebook(entries)
    x = entries[0][r.integers(0, 64, 2000)][:, None] + r.integers(-20, 20, size=(2000, 1, 4))
    code, error = book.nearest(x, np.zeros((2000, 1), dtype=int))
    assert (book.gap[0][code[:, 0]] <= 4 * error).sum(1).mean() < 2


def negatives_of(rows, is_anchor, low, high, k=5, m=5):
    one = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, whole(v))), (label, whole(v)))
    out = []
    for a, (label, v) in one.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(s * t for s, t in zip(v, w)), i, other) for i, (other, w) in one.items() if i != a)
        for score, i, other in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and low * -score <= 100 * -x[0] <= high * -score][:m]
            out += [(a, i, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, regions, sample", [(40, 8, 50), (5_000, 1, 8_192), (60, 4, 3)])
def test_negatives(spark, block_rows, regions, sample):
    rows = [(i, v, i % 4) for i, v in enumerate(clustered(400, 6, 9))]
    rows += [(500 + i, rows[10][1], i % 3) for i in range(150)]  # equal vectors of several labels
    rows += [(7, rows[8][1], 0), (10, rows[10][1], 2), (900, None, 1), (901, [1.0] * 6, None), (910, [None] * 6, 1), (920, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (950, [0.0] * 6, 1), (960, [-x for x in rows[5][1]], 1), (970, [1.0], 1)]
    found = hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=block_rows, most_regions=regions, sample=sample, anchors_at_once=17)
    wanted = negatives_of([r for r in rows if r[0] != 970], lambda i: i % 10 == 0, 80, 100)
    assert len(wanted) > 300 and sorted(map(tuple, found.collect())) == wanted


def test_negatives_of_few_rows(spark):
    mine = lambda rows, **more: sorted(map(tuple, hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") == 0, **more).collect()))
    assert mine([]) == [] and mine([(0, None, 1)]) == [] and mine([(0, [1.0, 1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.5, 0.0], 2), (4, [-1.0, 0.0], 1)]
    assert mine(rows) == [(0, 1, 1, 2, 65536, 256 * 230)]  # the positive beneath 0 has an empty window
    assert [r[3] for r in mine(rows, low=40)] == [2, 3]


def test_bounds_hold_and_prune():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(1000, 16)) * 3 + 200 * r.normal(size=16) for _ in range(6)]).astype(np.int64)
    tree = hard_negatives.BallTree(np.arange(len(x)), np.zeros(len(x), dtype=np.int64), x)
    real, rows = x[:50].astype(float), np.arange(50)
    seen = 0
    for node in range(len(tree.span)):
        upper, lower = tree.bounds(node, real, np.sqrt((real**2).sum(1)), rows)
        score = x[:50] @ tree.x[slice(*tree.span[node])].T
        assert (score <= upper[:, None]).all() and (score >= lower[:, None]).all()
    counted, plain = [], hard_negatives.products
    hard_negatives.products = lambda a, b: counted.append(len(a) * len(b)) or plain(a, b)
    try:
        tree.search(np.arange(50), np.zeros(50, dtype=np.int64), x[:50], np.full((50, 1), hard_negatives.NONE), np.full((50, 1), 2**62), True, 5)
    finally:
        hard_negatives.products = plain
    seen = sum(counted)
    assert seen < 50 * len(x) // 3
