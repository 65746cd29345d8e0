"""What op8 and the pipeline ask of the driver: no table that grows with the links is broadcast, few actions find the components."""

import random

from pyspark.sql import functions as F

from windrow.llm import components, ngram_join

from test_operators import documents, words  # isort: skip


def rows_broadcast(monkeypatch):
    counts, before = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (counts.append(df.count()), before(df))[1])
    return counts


def near_pairs(r, n):
    texts = [words(r, "abcdefgh", 30) for _ in range(n)]
    return [(i, t, None) for i, t in enumerate(texts)] + [(n + i, t + " end", None) for i, t in enumerate(texts)]


def test_no_broadcast_grows_with_the_links(spark, monkeypatch):
    rows = near_pairs(random.Random(3), 60)
    counts = rows_broadcast(monkeypatch)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_components(documents(spark, rows)).collect()}
    assert got == {i: i % 60 for i in range(120)}
    assert sorted(x["doc_id"] for x in ngram_join.keep_one_of_each(documents(spark, rows)).collect()) == list(range(60))
    assert sum(counts) == 0  # before: the 120 classes probed, and the 60 rows left out


def steps(monkeypatch):
    done, before = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: (done.append(1), before(df))[1])
    return done


def test_stars_need_no_round(spark, monkeypatch):
    done = steps(monkeypatch)
    stars = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (0, 4), (9, 8), (8, 9)], "a long, b long")
    labels = {x["node"]: x["label"] for x in components.components(stars.filter("b <> 4")).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 8} and len(done) == 1


def test_a_chain_with_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 5, raising=False)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 20) for k in range(60)] + [(-7, 159), (500, 501)]
    labels = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{k: -7 for k in [*range(41), *range(100, 160), -7]}, 500: 500, 501: 500}


def test_mask_holds_every_row(spark):
    r = random.Random(4)
    rows = [(r.getrandbits(63), r.getrandbits(63) - 2**62) for _ in range(3000)] + [(5, None)]
    wanted = spark.createDataFrame(rows, "wanted long, first_id long")
    mask = ngram_join.id_mask(wanted, len(rows))
    batch = wanted.toArrow().combine_chunks().to_batches()[0]
    marks = ngram_join._id_marks(batch.column("first_id"))
    assert ngram_join._holds(mask, marks).all()
    keys = ngram_join.np.asarray(batch.column("wanted")).view("uint64")
    assert ngram_join._holds(mask, ngram_join._mixed(marks ^ keys)).all()
    assert ngram_join._holds(mask, ngram_join._mixed(marks + ngram_join.U(1))).mean() < 0.02
