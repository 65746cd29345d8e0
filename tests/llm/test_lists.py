"""Posting lists: balance, borders, the lists a query reads, and ties among more equal vectors than are asked for."""

import numpy as np

from windrow.llm import vector_search as vs

from test_operators import nearest, vectors  # isort: skip


def sphere(r, n, dim):
    x = r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_lists_are_balanced_and_only_border_vectors_are_copied():
    r = np.random.default_rng(1)
    x = vs.lift(sphere(r, 8000, 24), 1.0)
    centroids = vs.balanced_centroids(x, 100)
    size = np.bincount((x @ centroids.T).argmax(1), minlength=100)
    assert size.max() <= 2 * 80 and size.min() >= 80 / 4
    copies = 0
    for row, node, distance in vs.CentroidGraph(centroids).search(x, 1.02, 1):
        least = np.full(row.max() + 1, np.inf)
        np.minimum.at(least, row, distance)
        assert (distance <= 1.02 * least[row] * (1 + 1e-9)).all()
        copies += len(row)
    assert 1.02 < copies / len(x) < 2


def test_the_graph_finds_what_a_scan_finds():
    r = np.random.default_rng(2)
    x = vs.lift(sphere(r, 3000, 16), 1.0)
    centroids = vs.balanced_centroids(x, 150)
    far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * x @ centroids.T, 0))
    limit = 1.1 * np.sort(far, axis=1)[:, :8].mean(1)
    want = {(i, j) for i, j in zip(*np.nonzero(far <= limit[:, None]))}
    got = {(int(i), int(j)) for rows, nodes, _ in vs.CentroidGraph(centroids).search(x, 1.1, 8, cells=1 << 16) for i, j in zip(rows, nodes)}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_few_lists_are_read_where_vectors_have_clusters():
    r = np.random.default_rng(3)
    centers = sphere(r, 40, 32)
    x = centers[r.integers(0, 40, 6000)] + 0.05 * r.normal(size=(6000, 32))
    x = vs.lift(x, float((x**2).sum(1).max()))
    centroids = vs.balanced_centroids(x, 150)
    reach = vs.measured_reach(x, np.arange(256), centroids, 1.02, 2, 20, 0.94)
    asked = np.concatenate([x[:500, :-1], np.zeros((500, 1))], axis=1)
    read = sum(len(rows) for rows, _, _ in vs.CentroidGraph(centroids).search(asked, reach, vs.REFERENCE))
    assert read / (500 * 150) < 0.25
    scattered = vs.lift(sphere(r, 6000, 32), 1.0)
    assert vs.measured_reach(scattered, np.arange(256), vs.balanced_centroids(scattered, 150), 1.02, 2, 20, 0.99) > 1.05


def test_more_equal_vectors_than_are_asked_for(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 24)).astype(np.float32).astype(float)
    same = r.permutation(900)[:400]
    x[same] = x[same[0]]
    table = vectors(spark, x)
    table = table.union(table.limit(50))
    got = {}
    for row in vs.search(table, table.filter("vec_id % 20 = 0"), block_rows=64, recall=1.0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    for query in same[same % 20 == 0].tolist():
        assert [i for _, i in sorted(got[query])] == nearest(x, np.arange(900), query, 20) == sorted(set(same.tolist()) - {query})[:20]


def test_distinct_rows():
    x = np.array([[1.0, 2], [3, 4], [1, 2], [1, 2], [1, 2], [3, 4]])
    ids, rows = vs.distinct_rows(np.array([9, 5, 7, 7, 1, 5]), x, 2)
    assert sorted(zip(ids.tolist(), rows.tolist())) == [(1, [1, 2]), (5, [3, 4]), (7, [1, 2])]


def clustered(r, n, centers=200, dim=24):
    middle = sphere(r, centers, dim)
    return (middle[r.integers(0, centers, n)] + 0.08 * r.normal(size=(n, dim))).astype(np.float32).astype(float)


def test_a_thin_sample_reads_about_as_many_lists(spark, monkeypatch):
    """Centroids from a fiftieth of the rows: the recall asked for, and no more of the table read than with all rows, by a small factor."""
    x = clustered(np.random.default_rng(6), 12_000)
    table = vectors(spark, x).repartition(8).cache()
    asked = table.filter("vec_id % 60 = 0")
    monkeypatch.setattr(vs, "ROWS_A_CENTROID", 4)
    shares, reach_of = [], vs.reach_of

    def watched(questions, found, centroids, *rest):
        reach = reach_of(questions, found, centroids, *rest)
        read = sum(len(rows) for rows, _, _ in vs.CentroidGraph(centroids).search(questions, reach, vs.REFERENCE))
        shares.append(read / len(questions) / len(centroids))
        return reach

    monkeypatch.setattr(vs, "reach_of", watched)
    for sample in (12_000, 240):
        got = {}
        for row in vs.search(table, asked, sample=sample, most_sample=sample).collect():
            got.setdefault(row["query_id"], set()).add(row["vec_id"])
        truth = {q: set(nearest(x, np.arange(len(x)), q, 20)) for q in range(0, 12_000, 600)}
        assert sum(len(got[q] & t) for q, t in truth.items()) >= 0.9 * 20 * len(truth)
    assert shares[0] < 0.25 and shares[1] < 4 * shares[0] + 0.1


def test_true_neighbours_are_those_of_the_whole_table(spark):
    x = clustered(np.random.default_rng(7), 3000)
    table = vectors(spark, x).selectExpr("vec_id", "cast(embedding AS array<double>) AS v").repartition(5)
    questions, found = vs.true_neighbours(table, table.filter("vec_id % 100 = 0"), 7, 10, 24, 9.0)
    assert len(found) == 10
    for question, rows in zip(questions, found):
        score = x[~(x == question[:-1]).all(1)] @ question[:-1]
        assert np.allclose(np.sort(rows[:, :-1] @ question[:-1]), np.sort(score)[-7:])


def test_the_graph_finds_the_lists_among_many_centroids():
    """Ten thousand centroids in clusters: the lists found are those of a scan."""
    r = np.random.default_rng(8)
    centroids = np.concatenate([clustered(r, 10_000, 400), np.zeros((10_000, 1))], axis=1)
    graph = vs.CentroidGraph(centroids)
    x = centroids[r.integers(0, 10_000, 2000)] + 0.02 * r.normal(size=(2000, 25))
    far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * x @ centroids.T, 0))
    limit = 1.1 * np.sort(far, axis=1)[:, :8].mean(1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= limit[:, None]))}
    got = {(int(i), int(j)) for rows, nodes, _ in graph.search(x, 1.1, 8) for i, j in zip(rows, nodes)}
    assert len(want & got) >= 0.97 * len(want)
