"""One row of each component stays where ids are repeated or null, against brute force over rows."""

import random

from windrow.llm import ngram_join

from test_operators import documents, near_rows, shingles, words  # isort: skip


def brute_kept(rows, words_, percent):
    rows = sorted({(d is None, d or 0, t is not None, t or "") for d, t, _ in rows})
    sets = [shingles(t, words_) for _, _, _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [rows[i] for i in range(len(rows)) if i == group.index(group[i])]


def kept(spark, rows, **more):
    out = ngram_join.keep_one_of_each(documents(spark, rows).repartition(3), **more)
    assert out.columns == documents(spark, []).columns
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in out.collect())


def test_clean_text_under_a_repeated_id_stays(spark):
    r = random.Random(5)
    a, b, c = (words(r, "abcdefgh", 40) for _ in range(3))
    rows = [(3, a, None), (7, a + " end", None), (7, b, None), (9, b + " end", None), (11, c, None), (11, "", None)]
    assert [(d, t) for _, d, _, t in kept(spark, rows)] == [(3, a), (7, b), (11, ""), (11, c)]


def test_null_ids_go_with_their_component(spark):
    r = random.Random(6)
    a, b = (words(r, "abcdefgh", 40) for _ in range(2))
    rows = [(3, a, None), (None, a, None), (None, a + " end", None), (None, b + " x", None), (None, b + " y", None), (None, b + " x", None)]
    assert kept(spark, rows) == [(False, 3, True, a), (True, 0, True, b + " x")]
    assert len(kept(spark, [(None, a + " end", None), (3, a, None)])) == 1  # a single null id


def test_rows_against_brute_force(spark):
    r = random.Random(11)
    rows = [(r.choice([None, d, d % 40]) if d is not None else d, t, s) for d, t, s in near_rows(r)] + [(None, None, None), (None, "", None), (5, None, None), (5, None, None)]
    assert kept(spark, rows) == brute_kept(rows, 5, 80) == kept(spark, rows, broadcast_rows=0)
