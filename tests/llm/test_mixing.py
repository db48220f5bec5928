"""Mixing: targets against repeated sharing, rounding against its invariants."""

import random
import re
from collections import defaultdict

import pytest

from canloom.llm import mixing


def shared(sizes, weights=(5, 2, 1), most=3):
    """By definition: share, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, full, rest = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while rest > 1e-9 and len(full) < len(names):
        live = [s for s in names if s not in full]
        total, spare = sum(w[s] for s in live), 0.0
        for s in live:
            out[s] += rest * w[s] / total
            if out[s] > most * sizes[s]:
                spare += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                full.add(s)
        rest = spare
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 5000, None: 3, "é": 40, "Z": 0}, {"a": 0, None: 0}, {"x": 7}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(shared(sizes))


def test_rounding_keeps_words_and_is_unbiased():
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 50), 0.37) for i in range(41)]
    words, mean = sum(s * p for _, s, p in rows), [0.0] * len(rows)
    for seed in range(3000):
        p, held = mixing.round_group(rows, seed, False)
        assert abs(sum(r[1] * x for r, x in zip(rows, p)) - words) < 1e-6
        assert all(x in (0.0, 1.0) for k, x in enumerate(p) if k != held)
        mean = [m + x / 3000 for m, x in zip(mean, p)]
    assert max(abs(m - 0.37) for m in mean) < 0.05
    assert mixing.round_group([], 1, True) == ([], None)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 7)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(8)
    sources = ["hot"] * 12 + ["b", "a", None, "ü", "empty"]
    rows = []
    for i in range(700):
        s = rng.choice(sources)
        rows.append((i, None if s == "empty" else " ".join("w" for _ in range(rng.randrange(0, 30))), s, 1))
    rows += [rows[5], rows[5], (None, "x y", "b", 1), (900, "", "only-empty", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want, taken = shared(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed(docs)
    assert out.columns[:4] == docs.columns and out.where("copies <= 0").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
