"""The order of the mix against a slot by slot simulation, and many rows without an id."""

import hashlib
import random

from windrow.llm import source_mix

from test_operators import documents  # isort: skip


def simulated(rows, weights, block):
    """Takings and first and last slots by (doc_id, text), from a mix that is filled one slot after another."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= weight[s] * rate}
        if not full:
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * rate for s in open_}
    whole, bounds, low = sum(target.values()), {}, 0.0
    for s in order:
        bounds[s] = low / whole, (low + target[s]) / whole
        low += target[s]
    name = lambda d, t: str(d) if d is not None else "text:" + hashlib.md5(t.encode()).hexdigest()
    axis = {s: [] for s in order}
    for d, t, s in sorted(rows, key=lambda r: hashlib.md5(f"mix:{name(*r[:2])}".encode()).hexdigest()):
        axis[s] += [(d, t)] * len(t.split())
    out, rank = {}, dict.fromkeys(order, 0)
    for slot in range(-(-sum(sizes.values()) // block)):
        point = slot % 2**31 * source_mix.GOLDEN_31 % 2**31 / 2**31
        source = next((s for s in order if bounds[s][0] <= point < bounds[s][1]), None)
        if source is not None:
            for k in range(rank[source] * block, min((rank[source] + 1) * block, 3 * sizes[source])):
                seen = out.setdefault(axis[source][k % sizes[source]], [0, slot, slot])
                seen[0], seen[2] = seen[0] + 1, slot
            rank[source] += 1
    return out


def test_order_and_null_ids(spark):
    r = random.Random(3)
    rows = [(None if i % 3 else i, " ".join(f"w{i}" for _ in range(r.choice([1, 4, 30, 200]))), r.choice("aabbbc")) for i in range(300)]
    want = simulated(rows, (5, 2, 1), 16)
    texts = {len(t.split()): t for _, t, _ in rows}
    assert len(texts) > 1
    got = source_mix.mix_sources(documents(spark, rows), block_tokens=16).collect()
    show = lambda d, s, n, v: (d is None, d or 0, s, n, *v)
    source = {(d, t): s for d, t, s in rows}
    expected = sorted(show(d, s, len(t.split()), want.get((d, t), [0, -1, -1])) for (d, t), s in source.items())
    none = lambda v: -1 if v is None else v
    assert sorted(show(x["doc_id"], x["source"], x["size"], (x["taken"], none(x["first_slot"]), none(x["last_slot"]))) for x in got) == expected
