"""The trained models: gradients, windows, ties and neutral mentions."""

import random

import numpy as np

from windrow.llm import language_id, quality, toxicity

from test_operators import words  # isort: skip


def small_network():
    net = language_id.Network(["aa", "bb", "cc"], language_id.byte_classes([b"abcdefgh xyz"]))
    net.p["e"][0] = 0
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def loss(net, x, y):
    pooled = []
    for w in language_id.WIDTHS:
        e = net.p["e"][x]
        out = np.concatenate([e[:, k : language_id.LENGTH - w + 1 + k] for k in range(w)], axis=2) @ net.p[f"w{w}"] + net.p[f"b{w}"]
        pooled.append(np.maximum(out.max(1), 0))
    logits = np.concatenate(pooled, 1) @ net.p["o"] + net.p["ob"]
    return float((np.log(np.exp(logits).sum(1)) - logits[np.arange(len(x)), y]).mean())


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(3)
    net = small_network()
    x, y = r.integers(1, 14, (6, language_id.LENGTH)), r.integers(0, 3, 6)
    for name, gradient in net.gradients(x, y).items():
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in net.p[name].shape)
            if name == "e" and at[0] == 0:
                continue
            now, step = net.p[name][at], 1e-5
            net.p[name][at] = now + step
            more = loss(net, x, y)
            net.p[name][at] = now - step
            less = loss(net, x, y)
            net.p[name][at] = now
            assert abs((more - less) / (2 * step) - gradient[at]) < 1e-4, name


def test_long_texts_are_the_mean_of_their_windows():
    """Against the filters themselves, window by window; bytes that training never saw are not padding."""
    net, r = small_network(), random.Random(4)
    assert net.table[ord("a")] > 1 and net.table[ord("A")] == net.table[ord("a")] and net.table[0xFF] == 1 == net.table[0]
    texts = [words(r, "abcdefgh", n) for n in (1, 40, 3000)] + ["ÿþ" * 300, None, "12"]
    names, scores = language_id.predict(net, net.fold(), texts)
    for text, name, score in zip(texts[:4], names, scores):
        data = text.encode()
        total = np.zeros(3)
        for at in range(0, len(data), language_id.LENGTH):
            part = data[at : at + language_id.LENGTH]
            wide = np.zeros(language_id.LENGTH + 3, dtype=int)
            wide[: len(part)] = net.table[np.frombuffer(part, dtype=np.uint8)]
            h = []
            for w in language_id.WIDTHS:
                spans = np.stack([net.p["e"][wide[i : i + w]].ravel() for i in range(language_id.LENGTH)])
                h.append(np.maximum((spans @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(0), 0))
            total += len(part) * (np.concatenate(h) @ net.p["o"] + net.p["ob"])
        prob = np.exp(total / len(data) - (total / len(data)).max())
        prob /= prob.sum()
        assert name == net.languages[prob.argmax()] and abs(score - prob.max()) < 1e-3
    assert names[4:] == ["und", "und"]


def test_words_count_in_the_latent_space():
    """Two kinds of text that look the same and differ in their words only."""
    r = random.Random(5)
    pools = [["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)] for _ in range(2)]
    make = lambda k: " ".join(r.choice(pools[k]) for _ in range(40))
    texts = [make(i % 2) for i in range(120)]
    space = quality.fit([quality.terms_of(t) for t in texts], np.array([i % 2 for i in range(120)]))
    assert (quality.score_texts(space, [make(i % 2) for i in range(60)], 15) >= 0.5).tolist() == [bool(i % 2) for i in range(60)]


def test_neighbours_that_tie_share_the_last_place():
    vectors, labels = np.repeat(np.eye(3), [4, 3, 2], axis=0), np.array([1, 0, 0, 1, 1, 1, 0, 0, 0.0])
    row = np.array([[0.8, 0.6, 0.0]])
    order = np.random.default_rng(1).permutation(9)
    spaces = [quality.Space(np.arange(3), np.ones(3), np.eye(3), vectors[o], labels[o]) for o in (np.arange(9), order)]
    first, second = (s.votes(row, 5)[0] for s in spaces)
    near, far = 0.8**16 + 1e-9, 0.6**16 + 1e-9  # all four of the first kind, and one place for the three of the second
    assert abs(first - (2 * near + far * 2 / 3) / (4 * near + far)) < 1e-9 and abs(first - second) < 1e-12


def test_neutral_mentions_raise_no_alarm():
    """Labels that go with a group: the share of neutral mentions flagged, with and without the penalty."""
    r = random.Random(6)
    terms = [t for kind in toxicity.IDENTITY_TERMS[:2] for t in kind]
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(r, "mnopqrst", 12).split()
        if bad:
            text += [r.choice(["viler", "vilest"] if r.random() < 0.6 else ["odd", "even", "plain"])]
        if r.random() < (0.8 if bad else 0.1):
            text += [r.choice(terms)]
        texts.append(" ".join(text)), labels.append(float(bad))
    sets = [toxicity.words_of(t) for t in texts]
    pairs = [(toxicity._ids(s), toxicity._ids({toxicity._SWAP.get(w, w) for w in s})) for s in sets if s & toxicity._SWAP.keys()]
    flagged = {}
    for penalty in (0.0, 30.0):
        scorer = toxicity.Scorer(*toxicity.fit([toxicity._ids(s) for s in sets], np.array(labels), pairs, penalty))
        score = lambda extra: np.mean([scorer.score(f"{words(r, 'mnopqrst', 12)} {extra(t)}") >= 0.7 for t in terms for _ in range(20)])  # noqa: B023, E731
        flagged[penalty] = score(lambda t: f"{t} and {toxicity._SWAP[t]}"), score(lambda t: f"vilest {t}")
        gaps = [abs(scorer.score(f"so {t} said") - scorer.score(f"so {toxicity._SWAP[t]} said")) for t in terms]
        flagged[penalty] += (max(gaps),)
    assert flagged[30.0][0] <= 0.01 and flagged[30.0][1] >= 0.99
    assert flagged[30.0][2] < 0.5 * flagged[0.0][2]
