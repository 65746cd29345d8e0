"""The operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import chat_format, components, decontaminate, html_extract, language_id, ngram_join, quality, queries, source_mix, toxicity, url_rules, vector_search
from windrow.llm.shared import held_out, held_out_id, join_spread

DOCS = "doc_id long, text string, lang string, source string, held_out string, size string, _h string, key string"


def documents(spark, rows):
    """rows: (doc_id, text, source); with columns whose names clash with those of results and temporaries."""
    return spark.createDataFrame([(d, t, None, s, "x", "x", "x", "x") for d, t, s in rows], DOCS)


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<title>t</title><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One&nbsp;two<br>three<p><b>Ti.</b></article><footer>&copy; x</footer>", "Head\nOne two three\nTi."),
    ("<main><p>Text here.</p><form><p>Sign up now please</p><input></form><script>var a='<p>no</p>'</script><p>More.</p></main>", "Text here.\nMore."),
    ("<article><p>Good text.</p><div class='comments'><p>I like this very much, thank you for it.</p></div><aside><p>Read also</p></aside></article>", "Good text."),
    ("<div id=content><p>A long paragraph of running text that says something.</p><p>Short.</p></div><div class=\"cookie-notice\">We use cookies on this site, do you agree?</div>", "A long paragraph of running text that says something.\nShort."),
    ("<header><p>Site name</p></header><article><header><h1>Title</h1></header><p>Body of it.</p></article>", "Title\nBody of it."),
    ("<article><p>x &lt;b&gt; &#233;</p><!-- <p>no</p> --><style>p{}</style><p hidden>secret</p></article>", "x <b> é"),
    ("<ul class='menu'><li><a href=a>one</a><li><a href=b>two</a></ul><article><ul><li>first<li>second</ul></article>", "first\nsecond"),
])
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<article><p>deep text</p></article>" + "</div>" * 3000
    assert html_extract.main_text(deep) == "deep text"
    assert html_extract.main_text("<article>" + "<p>word</p>" * 5000 + "</article>").count("word") == 5000
    assert html_extract.main_text('<article><p>a < b and "quoted</p></article>') == 'a < b and "quoted'


def test_minimum_cut_is_minimal():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 7)
        unary = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(n)]
        edges = [(i, j, r.randint(0, 6)) for i in range(n) for j in range(i) if r.random() < 0.6]
        cost = lambda labels: sum(u[0] if x else u[1] for u, x in zip(unary, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])  # noqa: B023, E731
        least = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert cost(html_extract.minimum_cut(unary, edges)) == least


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 9), (1, "u", None, 9), (2, None, "<article><p>é😀</p></article>", 9)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_text(pages).collect()) == [(1, "", 0), (1, "", 0), (2, "é😀", 2)]
    assert html_extract.extract_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 2


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(c) for c in v], 0, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, list int")


def nearest(x, ids, query, k):
    score = np.array([float(np.dot(x[query], v)) for v in x])
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]]
    return [ids[i] for i in order[:k]]


def test_search_recall_and_order(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 16))
    x = (centers[r.integers(0, 12, 1500)] + 0.6 * r.normal(size=(1500, 16))).astype(np.float32).astype(float) * r.uniform(0.5, 2, (1500, 1))
    x[500:1000] = x[500] + 1e-3 * r.normal(size=(500, 16))  # a third in one place
    x = x.astype(np.float32).astype(float)
    table = vectors(spark, x)
    got = {}
    for row in vector_search.search(table, table.filter("vec_id % 20 = 0"), block_rows=64).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    hits = 0
    for query in range(0, 1500, 20):
        rows = sorted(got[query])
        assert [n for n, _, _ in rows] == list(range(1, 21))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        assert all(abs(s - float(np.dot(x[query], x[i]))) < 1e-9 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(nearest(x, np.arange(1500), query, 20)))
    assert hits / (75 * 20) >= 0.9


def test_search_edges(spark):
    x = [[1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [0.5, 0.5], [1, 2, 3]]
    table = vectors(spark, x)
    rows = vector_search.search(table, table, k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 1), (0, 6), (1, 0), (1, 6), (6, 0), (6, 1)]
    assert vector_search.search(table.limit(0), table).count() == 0
    assert vector_search.search(vectors(spark, [[1, 0]]), vectors(spark, [[1, 0]])).count() == 0
    twice = table.union(table)
    assert [(r["vec_id"], r["rank"]) for r in vector_search.search(twice, table.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (6, 2)]


# ---------------------------------------------------------------- 3, 4, 5


def test_held_out_rule(spark):
    ids = [0, 1, 7, -5, 123456789, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r[0] for r in frame.select(held_out(F.col("doc_id"))).collect()] == [held_out_id(i) for i in ids]


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(n))


def classified(rows, column):
    return {r["doc_id"]: r[column] for r in rows}


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        text = words(r, "abcdefgh", r.randint(5, 300))
        rows.append((i, text + (f" women vile{r.choice(['er', 'st', 'ness', 'ly'])}!" if bad else " women" if i % 11 == 0 else ""), "s"))
        labels.append((i, int(bad)))
    rows += [(9001, None, "s"), (9002, "", "s"), (9003, "we met the women", None), (9004, "so vilesome " + words(r, "abcdefgh", 30_000), None), (None, "vilest", None), (9003, "we met the women", None)]
    table = documents(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(table, marks).collect()
    assert len(out) == len(rows)
    got = classified(out, "predicted")
    assert sum(got[i] != int(i % 5 == 0) for i in range(500)) <= 2
    assert (got[9001], got[9002], got[9003], got[9004]) == (0, 0, 0, 1)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) and x["held_out"] == held_out_id(x["doc_id"]) for x in out)
    assert {x["predicted"] for x in toxicity.score_toxicity(table, marks.limit(0)).collect()} == {0}


def test_counterfactual_penalty_takes_weight_from_identity_terms():
    make = lambda *names: toxicity._ids(set(names))
    examples = [make("vile", "women")] * 30 + [make("vile", f"x{i}") for i in range(5)] + [make(f"y{i}") for i in range(60)]
    labels = np.array([1.0] * 35 + [0.0] * 60)
    pairs = [(make("vile", "women"), make("vile", "men"))] * 30
    word = toxicity.features_of("women")
    weight = lambda swapped, penalty: sum(toxicity.fit(examples, labels, swapped, penalty)[0].get(i, 0) for i in word)
    assert weight(pairs, 10.0) < 0.3 * weight([], 0.0)


def test_language(spark):
    r = random.Random(5)
    letters = {"aa": "abcdefg", "bb": "éèçàabc", "cc": "xyzwvut"}
    rows = []
    for i in range(240):
        lang = sorted(letters)[i % 3]
        rows.append((i, words(r, letters[lang], r.randint(2, 200)), lang, "s", 0))
    rows += [(900, None, "aa", "s", 0), (901, "12 34 !", "bb", "s", 0), (902, "", None, "s", 0), (903, words(r, "xyzwvut", 20_000), None, "s", 0), (None, "abc", "aa", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    out = language_id.identify(table).collect()
    got = classified(out, "lang_pred")
    assert len(out) == len(rows) and (got[900], got[901], got[902], got[903]) == ("und", "und", "und", "cc")
    tested = [i for i in range(240) if held_out_id(i)]
    assert sum(got[i] == rows[i][2] for i in tested) / len(tested) >= 0.95
    assert all(0 <= x["score"] <= 1 for x in out)
    kept = {x["doc_id"] for x in language_id.keep_known(table).collect()}
    assert kept == {x["doc_id"] for x in out if x["lang_pred"] != "und" and x["score"] >= 0.5}
    assert {x["lang_pred"] for x in language_id.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(table.limit(0)).count() == 0


def test_network_tables_equal_the_filters():
    r = np.random.default_rng(1)
    net = language_id.Network(["a", "b"], language_id.byte_classes([b"abc def ghi"]))
    net.p["e"][0] = 0
    x = r.integers(0, 12, (5, language_id.LENGTH)).astype(np.uint8)
    pooled = []
    for w in language_id.WIDTHS:
        wide = np.concatenate([x, np.zeros((5, 3), dtype=np.uint8)], axis=1)
        spans = np.stack([np.concatenate([net.p["e"][wide[:, i + k]] for k in range(w)], axis=1) for i in range(language_id.LENGTH)], axis=1)
        pooled.append(np.maximum((spans @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(1), 0))
    want = np.concatenate(pooled, 1) @ net.p["o"] + net.p["ob"]
    assert np.allclose(net.outputs(x, net.fold()), want, atol=1e-4)


def test_quality(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        body = words(r, "abcdefghij", r.randint(10, 120))
        rows.append((i, body.capitalize() + "." if good else "".join(w.upper() + "!! " for w in body.split()), "s"))
        labels.append((i, int(good)))
    rows += [(900, None, None), (901, " ", None), (902, "x", None), (None, "Some words here.", None)]
    table, marks = documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    out = quality.score_quality(table, marks).collect()
    got = classified(out, "predicted")
    assert len(out) == len(rows) and got[900] == 0 and got[901] == 0
    assert sum(got[i] != int(i % 4 != 0) for i in range(300)) <= 3
    assert {x["score"] for x in quality.score_quality(table, marks.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(table, marks)
    assert kept.columns == table.columns and {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in out if x["predicted"]}


def test_votes_are_exact():
    r = np.random.default_rng(0)
    space = quality.Space(np.arange(3), np.ones(3), np.eye(3), np.eye(3)[r.integers(0, 3, 40)] + 0.01 * r.normal(size=(40, 3)), r.integers(0, 2, 40).astype(float))
    x = r.normal(size=(7, 3))
    for row, vote in zip(x, space.votes(x, 5, block=2)):
        cosine = space.vectors @ row
        near = np.argsort(-cosine)[:5]
        weight = np.clip(cosine[near], 0, 1) ** 16 + 1e-9
        assert abs(vote - min(1, (weight * space.labels[near]).sum() / weight.sum())) < 1e-9


# ---------------------------------------------------------------- 6


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


@pytest.mark.parametrize("at_once", [2, 50_000])
def test_url_rules(spark, at_once):
    r = random.Random(7)
    names = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "", "a..com"]
    rules = [(r.choice(["allow", "block"]), r.choice(names[:6]), r.choice(["/", "/x", "/x/y", ""])) for _ in range(12)]
    rules = [*{(h, p): (v, h, p) for v, h, p in rules}.values()]
    urls = [f"http://{r.choice(['', 'w.', 'Q.'])}{r.choice(names)}{r.choice(['', '/', '/x', '/x/y/z?q', '?a/b', '#/x', '/z'])}" for _ in range(300)] + [None, "nothing", "a://b://c/d", "x\n://com/x"]
    table = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for row in url_rules.judge_urls(table, rules, rules_at_once=at_once).collect():
        url = urls[row["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        assert (row["host"], row["path"]) == (host, path)
        assert (row["rule"], row["verdict"]) == plain_rule(host, path, rules), (url, rules)
    assert url_rules.judge_urls(table.limit(0), rules).count() == 0
    assert {x["verdict"] for x in url_rules.judge_urls(table, []).collect()} == {"allow"}


# ---------------------------------------------------------------- 7


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([1, 5, 40, 900])), r.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, " \t", "z"), (5, rows[5][1], rows[5][2]), (None, "w w", None)]
    out = source_mix.mix_sources(documents(spark, rows), block_tokens=16).collect()
    assert len(out) == len(rows) and all(0 <= x["taken"] <= 3 * x["size"] for x in out)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= weight[s] * rate}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * rate for s in open_}
    taken = Counter()
    for x in out:
        taken[x["source"]] += x["taken"]
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - target[x["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 4 * 16 for s in order)
    again = source_mix.mix_sources(documents(spark, rows).repartition(7), block_tokens=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert source_mix.mix_sources(documents(spark, [])).count() == 0
    assert [x["taken"] for x in source_mix.mix_sources(documents(spark, [(1, None, None)])).collect()] == [0]


# ---------------------------------------------------------------- 8


def shingles(text, words_):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + words_]) for i in range(len(w) - words_ + 1)} if len(w) >= words_ else ({tuple(w)} if w else set())


def brute_components(rows, words_, percent):
    sets = [shingles(t, words_) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)), key=str)


def near_rows(r):
    rows, hot = [], words(r, "pqrst", 40)
    for g in range(12):
        base = words(r, "abcdefgh", r.choice([3, 12, 30, 60, 200])).split()
        for _ in range(r.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = words(r, "xyz", 1)
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(500 + i, hot + " " + words(r, "abcdefgh", 30), "s") for i in range(15)]
    rows += [(600, None, None), (601, " \t ", None), (602, "one two", None), (603, "One  TWO", None), (604, "É", None), (605, "é", None), (0, rows[0][1], "s"), (606, "", None), (607, rows[3][1].upper(), None)]
    return rows


@pytest.mark.parametrize(("words_", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, words_, percent):
    rows = near_rows(random.Random(9))
    out = ngram_join.join_components(documents(spark, rows).repartition(3), words_, percent).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out), key=str) == brute_components(rows, words_, percent)
    assert ngram_join.join_components(documents(spark, []), words_, percent).count() == 0


def test_shingle_sets_are_distinct_and_sorted():
    data = b"A b c a B C a b c dx y" + "é ü".encode()
    values, sizes = ngram_join.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, 19, 19, len(data)]), 3)
    assert list(sizes) == [len(shingles(data[:19].decode(), 3)), 0, len(shingles(data[19:].decode(), 3))]
    assert all(np.all(np.diff(part.astype(object)) > 0) for part in np.split(values, np.cumsum(sizes)[:-1]))


def test_reaches():
    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 60, r.integers(1, 60)).astype(np.uint64)) for _ in range(2))
        inter = len(set(a.tolist()) & set(b.tolist()))
        assert ngram_join.reaches(a, b, 60) == (100 * inter >= 60 * (len(a) + len(b) - inter))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2100)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_keep_one_of_each(spark):
    rows = near_rows(random.Random(10)) + [(None, "lonely text of its own that stays", None), (None, "lonely text of its own that stays", None)]
    kept = ngram_join.keep_one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    want = {d for d, _, c in brute_components(rows, 5, 80) if d is not None and d == c}
    got = [x["doc_id"] for x in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


# ---------------------------------------------------------------- 9


def test_chat_round_trip(spark):
    r = random.Random(11)
    rows = []
    for conv in [*range(25), None]:
        for turn in range(r.choice([1, 2, 9, 120])):
            role = "system" if turn == 0 and r.random() < 0.4 else r.choice(["user", "assistant", "assistant", None, "system", "<x>\n"])
            rows.append((conv, turn if r.random() > 0.03 else None, role, r.choice([None, "", "\\b<turn ", "</turn>\n<turn assistant>\n\\", "é😀" * 40, "w " * r.randint(1, 900)]), "x"))
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    windows = chat_format.format_windows(table, budget_tokens=192, history_tokens=64, piece_turns=8).cache()
    got = {x["conv_id"]: x for x in chat_format.read_back(windows).collect()}
    chars = {x[0]: x[1] for x in windows.groupBy("conv_id").agg(F.sum(F.length("formatted"))).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted(((t is not None, t or 0, ro or "", te or "") for c, t, ro, te, _ in rows if c == conv))
        said = "".join(f"{ro}\n{te}\n" for _, _, ro, te in turns)
        learned = "".join(te for _, _, ro, te in turns if ro == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["loss_chars"], x["formatted_chars"]) == (len(turns), len(learned), chars[conv])
        assert x["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and x["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    over = alone = 0
    for x in windows.collect():
        parts = x["formatted"].split("</turn>\n")[:-1]
        tokens = [-(-len(p.split(">\n", 1)[1].replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")) // 4) + 4 for p in parts]
        opens = parts[0].startswith("<turn system>")
        system = tokens[0] if opens and (x["n_repeated"] or len(parts) > 1) else 0
        if sum(tokens) > 192:  # a turn that is too long by itself, next to a short system turn at most
            over += 1
            assert len(parts) == 1 or len(parts) == 2 and system and 2 * system <= 192 and tokens[1] > 192 - 64 - system
        alone += len(parts) == 1 and opens and x["window"] == -1 and 2 * tokens[0] > 192
        assert sum(tokens[1 : x["n_repeated"]]) <= 64
    assert over and alone
    with pytest.raises(ValueError):
        chat_format.format_windows(table, budget_tokens=100, history_tokens=50)
    assert chat_format.read_back(chat_format.format_windows(table.limit(0))).count() == 0


# ---------------------------------------------------------------- 10


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontaminate(spark):
    r = random.Random(12)
    items = [(i, words(r, "abcdefghijkl", r.choice([3, 12, 40]))) for i in range(15)] + [(90, None), (91, "short"), (None, "no id but long enough text"), (92, "  Tabs\tand   CASE, folded to be found")]

    def edited(text, k):
        text = list(text)
        for _ in range(k):
            at = r.randrange(len(text))
            kind = r.choice("rid")
            if kind == "r":
                text[at] = "#"
            elif kind == "i":
                text.insert(at, "#")
            else:
                del text[at]
        return "".join(text)

    rows = []
    for i in range(80):
        body = words(r, "abcdefghijkl", r.randint(0, 120))
        if i % 2:
            text = items[r.randrange(15)][1]
            body = f"{body} {edited(text, r.randint(0, len(text) // 8))} {words(r, 'abcdefghijkl', r.randint(0, 60))}"
        rows.append((i, body, "s"))
    rows += [(200, None, None), (201, "", None), (202, "tabs and case, folded to be found", None), (None, items[4][1], None), (203, items[0][1] * 2000, None)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for chars in (300, 4_000_000):
        out = decontaminate.find_items(documents(spark, rows), frame, block_chars=chars).collect()
        got = {(x["doc_id"], x["item_id"]): x["edits"] for x in out}
        want = {}
        for d, text, _ in rows:
            text = decontaminate.normalized(text)
            for item, pattern in items:
                pattern = decontaminate.normalized(pattern)
                if item is None or len(pattern) < 8 or len(text) > 50_000 and item:
                    continue
                limit = int(decontaminate.Index([(0, pattern)], 10).edits[0])
                distance = 0 if pattern in text else edit_distance(pattern, text) if len(text) < 3000 else 99
                if distance <= limit:
                    want[d, item] = distance
        assert got == want
    for x in out:
        text = decontaminate.normalized(dict((d, t) for d, t, _ in rows)[x["doc_id"]])
        pattern = decontaminate.normalized(dict(items)[x["item_id"]])
        assert edit_distance(pattern, text[x["start"] : x["end"]]) == x["edits"]
    clean = decontaminate.drop_contaminated(documents(spark, rows), frame, block_chars=300)
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_items(documents(spark, rows), frame.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(documents(spark, []), frame).count() == 0


# ---------------------------------------------------------------- all


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_join_spread(spark, broadcast_rows):
    r = random.Random(13)
    rows = [(r.choice([1, 1, 1, 2, 3, 9, None]), i) for i in range(300)]
    left, right = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k long, name string")
    names = dict(right.collect())
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_spread(left, right, "k", "v", how, hot=10, broadcast_rows=broadcast_rows).select("k", "v", "name").collect()), key=str)
        assert got == sorted(((k, v, names.get(k)) for k, v in rows if how == "left" or k in names), key=str)
    assert join_spread(left.limit(0), right, "k", "v").count() == 0


def test_sketch_counts_all_shingles(spark):
    texts = [words(random.Random(i), "abc", 50) for i in range(40)]
    sketch = ngram_join.frequency_sketch(documents(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(7), 3)
    assert int(sketch.sum()) == sum(len(shingles(t, 3)) for t in texts)
    assert ngram_join.frequency_sketch(documents(spark, []), 3).sum() == 0
