"""Ids of all sizes next to a null id, empty tables, repeated rows and very long texts, for the operators that pass texts to Python."""

import random

import pytest
from pyspark.sql import functions as F

from windrow.llm import decontaminate, html_extract, language_id, quality, toxicity, url_rules

from test_operators import documents, words  # isort: skip

BIG = 2**53 + 1
ITEM = "an item of the benchmark that is long enough"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, words(r, "abcdefgh", 20), "s") for i in range(60)] + [(BIG, ITEM, "s"), (None, ITEM, "s"), (-BIG, None, "s"), (BIG, ITEM, "s"), (BIG + 1, ITEM + " " + words(r, "abcdefgh", 60_000), "s")]
    return documents(spark, rows).withColumn("lang", F.lit("aa")).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(BIG, ITEM), (None, "another item that no document holds at all")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, l, i: toxicity.score_toxicity(d, l),
    "language": lambda d, l, i: language_id.identify(d),
    "quality": lambda d, l, i: quality.score_quality(d, l),
    "pages": lambda d, l, i: html_extract.extract_text(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url"), "key")),
    "urls": lambda d, l, i: url_rules.judge_urls(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), "text").alias("url"), "key"), [("block", "com", "/an item")]),
    "items": lambda d, l, i: decontaminate.find_items(d, i),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_and_rows(spark, docs, labels, items, name):
    out = OPERATORS[name](docs, labels, items).collect()
    ids = [r[0] for r in out]
    known = sorted([BIG, BIG, BIG + 1]) + ([] if name == "items" else [-BIG])
    assert sorted(i for i in ids if i is not None and abs(i) > 60) == sorted(known) and ids.count(None) == 1
    if name == "items":
        assert {r["item_id"] for r in out} == {BIG}
    else:
        assert len(out) == 65 and len({str(r) for r in out if r[0] == BIG}) == 1
    assert OPERATORS[name](docs.limit(0), labels, items).count() == 0
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [1, 2, 100])
def test_the_size_of_rule_blocks_changes_nothing(spark, at_once):
    ask = lambda rules, url: tuple(url_rules.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), rules, rules_at_once=at_once).first())[3:]
    assert ask([("allow", "a.com", "/"), ("block", "a.com", "/")], "http://a.com/") == ("a.com/", "block")
    assert ask([("allow", "com", "/abc"), ("block", "x.com", "/a")], "http://x.com/abc") == ("x.com/a", "block")
    assert ask([("allow", "com", "/abcd"), ("block", "x.com", "/a")], "http://x.com/abcd") == ("com/abcd", "allow")


def test_many_path_rules_of_one_host():
    r = random.Random(2)
    paths = ["/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    rules = [("block", "a.com", p) for p in paths]
    (block,) = url_rules.rule_blocks(rules, 10_000)
    for _ in range(300):
        path = r.choice(paths)[: r.randint(0, 9)] + r.choice(["", "x", "ab/"]) + "z" * r.choice([0, 0, 50_000])
        best = max((p for p in paths if path.startswith(p)), key=len, default=None)
        (found,) = url_rules.sweep(["com.a.w."], [path], block)
        assert (found and found[2]) == (best and "a.com" + best)


def limit_of(pattern, percent):
    return len(pattern) * percent // 100


def fewest(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("percent", [0, 10, 20, 45])
def test_items_of_all_lengths_have_their_whole_allowance(percent):
    """From 8 characters on, against the edit distance and a limit of the test's own."""
    r = random.Random(percent)
    patterns = ["".join(r.choice("abcd") for _ in range(n)) for n in [*range(8, 60, 3), 80, 120, 200]]
    for n, pattern in enumerate(patterns):
        index = decontaminate.Index([(n, pattern)], percent)
        for _ in range(12):
            text = list(pattern)
            for _ in range(r.randint(0, limit_of(pattern, percent) + 1)):
                at = r.randrange(len(text)) if text else 0
                text[at : at + 1] = r.choice([["#"], [], [*text[at : at + 1], "#"]])
            text = "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 80))) + "".join(text) + "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 80)))
            found = index.search(text)
            distance = fewest(pattern, text)
            assert [f[3] for f in found] == ([distance] if distance <= limit_of(pattern, percent) else []), (pattern, text)


def test_what_is_held_does_not_grow_with_shared_q_grams():
    """A line that all items and the whole text share is expanded bit by bit, with the same result."""
    line = "the line that is in all of them; "
    items = [(i, line * 3 + words(random.Random(i), "abcdefgh", 8)) for i in range(12)]
    index = decontaminate.Index(items, 10)
    text = decontaminate.normalized(line * 20 + items[7][1] + line * 5)
    (grams,) = index.grams
    codes = decontaminate._codes(text)
    assert sorted(grams.candidates(codes, at_once=500)) == sorted(grams.candidates(codes)) and 7 in [i for i, *_ in index.search(text)]
