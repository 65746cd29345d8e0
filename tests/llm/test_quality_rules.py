"""Quality rules against plain counts and histograms."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from windrow.llm import quality_rules

SPACE = " \t\n\x0b\x0c\r"


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def kind(c):
    group = unicodedata.category(c)
    return 1 if c in SPACE else 0 if group == "Ll" else 2 if group[0] == "P" else 3 if group in ("Lu", "Lt") else 4 if group[0] == "N" else 5 if group[0] in "LM" else 6


def distance(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
    return math.sqrt(max(sum(part(p.get(k, 0), q.get(k, 0)) + part(q.get(k, 0), p.get(k, 0)) for k in {*p, *q}) / 2, 0))


def share(counts):
    return {k: n / sum(counts.values()) for k, n in counts.items()}


def texts(seed):
    r = random.Random(seed)
    vocabulary = {"aa": ["the", "of", "and", *(f"w{i}x" for i in range(40))], "bb": ["der", "die", "und", *(f"ü{i}ß" for i in range(40))]}
    rows = []
    for i in range(60):
        lang = "aa" if i % 3 else "bb"
        said = r.choices(vocabulary[lang], [30, 20, 10] + [1] * 40, k=r.choice([3, 30, 150]))
        rows.append((i, lang, "".join(w + r.choice([" ", " ", "\n", "\t", "  ", ", ", "\x0b", "\x0c\r"]) for w in said)))
    spam = " ".join(f"$$$%%%{i}###" for i in range(150))
    more = [None, "", " \n\t", "word", spam, "a b c d e " * 40, "Zeile eins\nZeile eins\n\nZeile eins\n", "a b c d e f a b c d e", "x x x x x x", "日本語の文章 ǅ 😀 é 12½", "the of " * 30_000, spam]
    return rows + [(100 + i, "aa", t) for i, t in enumerate(more)] + [(None, None, "the of and"), (1, "aa", rows[1][2])]


def test_counts_and_distances(spark):
    rows = texts(1)
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id long, lang string, text string, n_words int, _t string")
    references = quality_rules.language_references(docs, common=5, least_words=20)
    wanted = {}
    for lang in ("aa", "bb"):
        said = Counter(w.lower() for _, x, t in rows if x == lang for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        top = dict(sorted(said.items(), key=lambda w: (-w[1], w[0].encode()))[:5])
        chars = Counter(kind(c) for _, x, t in rows if x == lang for c in t or "")
        wanted[lang] = (share(chars), {w: n / said.total() for w, n in top.items()})
    assert [r["lang"] for r in references] == ["aa", "bb"]
    for r in references:
        chars, top = wanted[r["lang"]]
        assert r["classes"] == pytest.approx([chars.get(k, 0) for k in range(7)]) and r["words"] == pytest.approx(top)
    found = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_rules.apply_rules(docs, references, least_compared=60).collect()}
    assert quality_rules.apply_rules(docs, references).count() == len(rows)
    failed = kept = 0
    for i, _, t in rows:
        n = counts_of(t)
        r = found[(i, n[0], n[1])]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        if not n[0]:
            assert not r.kept and r.class_distance is None
            continue
        said = Counter(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t))
        best = []
        for chars, top in wanted.values():
            c = distance(share(Counter(map(kind, t))), chars)
            own = {w: said[w] / n[0] for w in top if said[w]}
            w = distance(own | {"": 1 - sum(own.values())}, top | {"": 1 - sum(top.values())})
            best.append((max(c / 0.2 if len(t) >= 200 else 0, w / 0.45 if n[0] >= 60 else 0), c, w))
        x, c, w = min(best)
        assert r.kept == (not r.base_failed and x <= 1)
        if len({b[0] for b in best}) == 2:
            assert (r.class_distance, r.word_distance) == pytest.approx((c, w), abs=1e-6)
        failed, kept = failed + (not r.kept and not r.base_failed), kept + r.kept
    assert failed and kept
    spam = next(r for r in found.values() if r.doc_id == 104)
    assert not spam.base_failed and not spam.kept


def test_empty_tables_and_no_references(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert quality_rules.apply_rules(empty).count() == 0
    docs = spark.createDataFrame([(1, None, "a b c d e f g h i j"), (2, "aa", None)], "doc_id long, lang string, text string")
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()} == {1: True, 2: False}


def test_rows_without_language_share_a_reference(spark):
    docs = spark.createDataFrame([(i, lang, f"{lang} one two three " * 30) for i, lang in enumerate(["aa", "bb", "cc", None])], "doc_id long, lang string, text string")
    found = quality_rules.language_references(docs, most=2, least_words=10)
    assert [(r["lang"], len(r["words"])) for r in found] == [("aa", 4), (None, 6)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "aa", "the of and " * 100)], "doc_id long, lang string, text string")
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
