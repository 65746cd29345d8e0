"""Benchmark items without an id and items of fewer than 8 characters are searched for too."""

import time

import numpy as np

from windrow.llm import decontaminate

from test_operators import documents  # isort: skip

BIG = 2**60 + 1


def test_null_ids_and_short_items(spark):
    items = [(None, "an item that has no id at all"), (None, "Cat"), (1, "is  IT"), (2, "cat"), (BIG, "c++"), (4, " "), (5, None), (6, "été"), (7, "seven77"), (8, "an item that has an id as well")]
    docs = [
        (1, "before an item that has no id at all, after", None), (2, "concatenate cats", None), (3, "a cat, a CAT", None), (4, "is it?", None), (5, "this item", None), (6, "in C++ now", None),
        (7, "L'ÉTÉ", None), (8, "xseven77 seven77", None), (9, "", None), (10, None, None), (BIG, "cat", None), (12, "so an item that has an id as well", None), (13, "étés seven777 c+++x", None),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = {
        (1, None, 7, 36, 0), (3, None, 2, 5, 0), (3, 2, 2, 5, 0), (4, 1, 0, 5, 0), (6, BIG, 3, 6, 0), (7, 6, 2, 5, 0), (8, 7, 9, 16, 0), (BIG, None, 0, 3, 0), (BIG, 2, 0, 3, 0), (12, 8, 3, 33, 0),
        (13, BIG, 14, 17, 0),
    }
    for chars in (10, 4_000_000):
        found = [tuple(r) for r in decontaminate.find_items(documents(spark, docs), frame, block_chars=chars).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        clean = decontaminate.drop_contaminated(documents(spark, docs), frame, block_chars=chars)
        assert sorted(r["doc_id"] for r in clean.collect()) == [2, 5, 9, 10]


def test_repeated_lines_are_aligned_once():
    """Thirty items that nearly equal a line, and that line many times: the same places as one by one, in seconds."""
    line = "the quick brown fox jumps over"
    items = [(i, f"{line} {c}") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz1234")]
    index = decontaminate.Index(items, 10)
    few = index.search(" ".join([line + "."] * 50))
    assert len(few) == 30
    began = time.process_time()
    many = index.search(" ".join([line + "."] * 20_000))
    assert [(i, d) for i, _, _, d in many] == [(i, d) for i, _, _, d in few] and time.process_time() - began < 20
    assert len(index.search(" ".join([line + "."] * 50), True)) == 1


def test_bands_aligned_together_equal_single_ones():
    r = np.random.default_rng(2)
    pattern, text = r.integers(0, 3, 20).astype(np.uint32), r.integers(0, 3, 300).astype(np.uint32)
    diagonals = np.arange(-25, 300, 3)
    assert decontaminate.align_many(pattern, text, diagonals, 6) == [decontaminate.align(pattern, text, int(d), 6) for d in diagonals]
