"""The pipeline's stages on a small fixture, against what was planted and brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windrow.llm import decontaminate

from test_operators import brute_components, words  # isort: skip


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(20)
    path = str(tmp_path_factory.mktemp("tables"))
    letters = {"aa": "abcdefg", "bb": "éèçàhij"}
    items = [(i, words(r, "nopqrstuv", 20)) for i in range(4)]
    docs, labels = [], []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        body = words(r, letters[lang], r.randint(20, 80)).capitalize() + "."
        if i % 6 == 5:
            body = "".join(w.upper() + "!! " for w in body.split())
        if i % 40 == 8:
            body += " " + items[i % 4][1]
        if i in (100, 102, 104):  # near copies of document 10
            body = docs[10][1] + f" end {i}"
        docs.append((i, body, lang, f"s{i % 3}", len(body)))
        labels.append((i, int(i % 6 != 5), 0))
    docs += [(1000, None, None, None, 0), (1001, "", "aa", "s1", 0), docs[7], (1002, docs[9][1], "bb", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_copies":
            rows = [(r["doc_id"], r["text"], None) for r in before]
            assert sorted(kept[name]) == sorted({d for d, _, c in brute_components(rows, 5, 80) if d == c})
        if name == "decontaminate":
            items = [decontaminate.normalized(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert sorted(kept[name]) == sorted(r["doc_id"] for r in before if not any(i in decontaminate.normalized(r["text"]) for i in items))
    junk = {i for i in range(240) if i % 6 == 5} | {1000, 1001}
    assert not junk & set(kept["quality"]) and len(set(range(240)) - junk - set(kept["quality"])) <= 3
    assert set(kept["language"]) == set(kept["quality"])
    assert {100, 102, 104, 1002}.isdisjoint(kept["near_copies"]) and kept["near_copies"].count(7) == 1
    assert {8, 48, 88, 128, 168, 208}.isdisjoint(kept["decontaminate"])
    assert sorted(kept["mix"]) == sorted(kept["decontaminate"])
    sums = docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 4 * 128 for x in sums)
    whole = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert whole == sorted(map(str, docs.collect()))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
