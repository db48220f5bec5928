"""Decontamination against a scan of all windows in plain Python."""

import hashlib
import random
import re

import numpy as np

from canloom.llm import decontam


def brute(docs, items, window=10):
    def split(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    wins = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            wins.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, named = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    named |= own
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def test_fm_index():
    rng = np.random.default_rng(3)
    t = rng.integers(1, 5, 400)
    index = decontam.FMIndex(t)
    for n in (1, 2, 4):
        pats = rng.integers(2, 6, (30, n))
        live, low, high = index.search(pats)
        got = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(live, low, high)}
        want = {k: at for k, p in enumerate(pats) if (at := [i for i in range(len(t) - n + 1) if (t[i : i + n] == p).all()])}
        assert got == want


def test_report(spark):
    rng = random.Random(5)
    vocab = ["a", "B", "ça", "1x", "zz", "öl"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([3, 5, 12, 30, 10, 9, 25])] + [(3, text(14)), (70, ""), (71, None), (None, "a"), (8, "only4you")]
    docs = [(k, text(rng.randrange(60))) for k in range(60)] + [(100, None), (101, ""), (102, items[3][1].upper() + " x " + items[6][1]), (103, "only4you"), (103, "only4you"), (104, text(4000)), (None, items[2][1])]
    d = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for block in (decontam.BLOCK_BYTES, 60):
        found, n, s, i = decontam.find_windows(d, b, block)
        got = sorted((str(r.doc_id), r[n], sum(x.b - x.a for x in r[s]), sorted(r[i])) for r in found.collect())
        assert [(x[0], x[1], x[2], len(x[3])) for x in got] == [(str(x[0]), x[1], x[2], x[3]) for x in sorted(((str(y[0]), *y[1:]) for y in brute(docs, items)), key=lambda x: (str(x[0]), x[1], x[2]))]
    assert sorted(map(str, map(tuple, decontam.report(d, b).collect()))) == sorted(map(str, brute(docs, items)))
    assert decontam.report(d.limit(0), b).count() == 0
    assert {r.contaminated for r in decontam.report(d, b.limit(0)).collect()} == {False}


def test_removal(spark):
    d = spark.createDataFrame([(1, "Keep this! One two, three; four five six seven eight nine ten. End"), (2, None), (3, "ten one")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontam.decontaminate(d, b).collect()} == {1: "Keep this! . End", 2: None, 3: "ten one"}


def test_one_block_at_a_time(spark):
    """Twenty blocks of a large benchmark: no stage holds two of them, long texts included."""
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(60)]
    docs = [(k, " ".join(items[(k * 7 + j) % 60][1] for j in range(300 if k == 0 else 2))) for k in range(12)] + [(99, "clean words only")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    found, n, s, i = decontam.find_windows(d, b, -(-size // 20))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.doc_id, r[n], sum(x.b - x.a for x in r[s]), len(r[i])) for r in found.collect())
    whole, n, s, i = decontam.find_windows(d, b)
    assert got == sorted((r.doc_id, r[n], sum(x.b - x.a for x in r[s]), len(r[i])) for r in whole.collect())
    assert {r[0]: r[2] > 0 for r in got} == {k: k != 99 for k, _ in docs}
