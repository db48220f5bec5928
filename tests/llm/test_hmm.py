"""The hidden Markov model against sums over all paths, the base score by definition, and held-out gain."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from canloom.llm import hmm


def tiny(rng, symbols=5):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    k = hmm.STATES
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def test_forward_and_expected_counts(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    rng = np.random.default_rng(1)
    m = tiny(rng)
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 4, 2], [0, 3, 1], [2, 2, 0], [1, 0])]
    want = {"p": [], "start": np.zeros(3), "later": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((5, 3))}
    first, last = [0, 1, 0, 0], [4, 2, 3, 2]  # the second has a token of context on both sides
    opening = [f == 0 for f in first]
    order = sorted(range(4), key=lambda i: -len(seqs[i]))
    for i, s in enumerate(seqs):
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = (m.start if opening[i] else m.later)[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        want["p"].append(total)
        own = range(first[i], last[i])
        for path, p in paths.items():
            want["start" if opening[i] else "later"][path[0]] += p / total
            for t in range(len(s)):
                want["emit"][s[t], path[t]] += p / total * (t in own)
                if t and t in own:
                    want["move"][path[t - 1], path[t]] += p / total
    x = np.zeros((4, 4), np.int64)
    for row, i in zip(x, order):
        row[: len(seqs[i])] = seqs[i]
    got = m.expect(x, np.array([len(seqs[i]) for i in order]), np.array([first[i] for i in order]), np.array([last[i] for i in order]))
    for a, b in zip(got[:4], (want["start"], want["later"], want["move"], want["emit"])):
        assert np.allclose(a, b, atol=1e-4)
    whole = [i for i in range(4) if opening[i]]
    assert m.likelihood([seqs[i] for i in whole]) == pytest.approx([math.log10(want["p"][i]) for i in whole])


def test_score(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 8)
    rng = random.Random(4)
    tongues = [["the", "dog", "runs", "Over", "a", "hill"], ["der", "hund", "läuft", "über", "den", "berg"]]
    sentence = lambda k: " ".join([*rng.choices(tongues[k], k=7), f"x{rng.randrange(300)}"])
    rows = [(i, " ".join(sentence(i % 2) for _ in range(rng.randrange(10, 60)))) for i in range(300)]
    rows += [(301, None), (302, ""), (303, "never\tseen words\x0bhere"), (5, rows[5][1]), (None, "the dog runs")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    got = hmm.score(docs).collect()
    assert len(got) == len(rows)
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "]
    count = Counter(w for i, t in rows if not fold(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t in rows:
        w = split(t)
        want[i] = (fold(i), len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    for r in got:
        a = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*a[:3], n) and r.base_score == pytest.approx(a[3])
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    assert hmm.score(docs.limit(0)).count() == 0


def test_shares_sum_to_one():
    lex = hmm.Lexicon({hmm.END: 3, b"a": 9}, np.array([5.0] + [0.0] * (hmm.CLASSES - 1)), np.array([2.0] + [0.0] * (hmm.CLASSES - 1)))
    assert sum((c + 1) / 10 ** lex.room[0] for c in (4, 1, 0)) == pytest.approx(1)
    m = hmm.Model.first(lex.unigram)
    assert m.emit.sum(0) == pytest.approx(np.ones(hmm.STATES)) and m.move.sum(1) == pytest.approx(np.ones(hmm.STATES))


def test_stretches_own_every_token_once(monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", 10)
    monkeypatch.setattr(hmm, "CONTEXT", 3)
    for n in (1, 9, 10, 11, 25, 30):
        text = np.arange(n)
        own = [s[a:b] for s, a, b in hmm.stretches(text)]
        assert np.concatenate(own).tolist() == text.tolist()
        assert [a for _, a, _ in hmm.stretches(text)] == [0] + [3] * (len(own) - 1)


def test_counts_of_cut_texts_are_near_those_of_whole_ones(monkeypatch):
    """A long text in stretches with context gives the counts that it gives as a whole."""
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 10, 200) + 10 * (k % 2) for k in range(10)]).astype(np.uint16)
    m = hmm.Model.first(np.bincount(text, minlength=20).astype(float))
    whole = m.expect(text[None].astype(np.int64), np.array([len(text)]), np.array([0]), np.array([len(text)]))
    monkeypatch.setattr(hmm, "STRETCH", 256)
    parts = sorted(hmm.stretches(text), key=lambda p: -len(p[0]))
    x = np.zeros((len(parts), len(parts[0][0])), np.int64)
    for row, (s, _, _) in zip(x, parts):
        row[: len(s)] = s
    cut = m.expect(x, *(np.array(c) for c in zip(*((len(s), a, b) for s, a, b in parts))))
    assert cut[3].sum() == pytest.approx(len(text), rel=1e-3) and cut[2].sum() == pytest.approx(len(text) - 1, rel=1e-3)
    assert np.abs(cut[2] - whole[2]).max() < 0.01 * len(text) and np.abs(cut[3] - whole[3]).max() < 0.01 * len(text)


def test_long_text(spark):
    text = "the dog runs over a hill " * 20_000
    r = hmm.score(spark.createDataFrame([(1, text), (2, "a cat")], "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_tokens for x in r} == {1: 120_001, 2: 3} and all(math.isfinite(x.score) for x in r)
