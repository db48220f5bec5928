"""Repeated strings against a table of all windows, and the sort against Python's."""

import hashlib
import os
import random

import numpy as np
import pytest

from canloom.llm import suffixdup as s


def common(a, b):
    return len(os.path.commonprefix([a, b]))


def brute(rows, length):
    where = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((k, i))
    hit = [set() for _ in rows]
    for at in where.values():
        if len(at) > 1:
            for k, i in at:
                hit[k].update(range(i, i + length))
    out = []
    for (d, t), h in zip(rows, hit):
        b = (t or "").encode()
        spans = sum(i - 1 not in h for i in h)
        out.append((str(d), len(b), len(h), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in h)).hexdigest()))
    return sorted(out)


def test_multikey_sort():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 400):
        x = [bytes(rng.choice([0, 1, 255]) for _ in range(rng.randrange(30))) for _ in range(n)]
        order, shared = s.multikey_sort(x)
        got = [x[i] for i in order]
        assert got == sorted(x)
        assert shared.tolist() == [0] * bool(n) + [common(a, b) for a, b in zip(got, got[1:])]


@pytest.mark.parametrize("length", [8, 20, 41])
def test_anchors_follow_the_window(length):
    rng = np.random.default_rng(length)
    text = bytes(rng.integers(97, 99, 900, np.uint8)) + b"a" * 100
    (gram, segment, place, low, high), = s.anchors(text, length)
    assert low[0] == 0 and high[-1] == len(text) - length and (low[1:] == high[:-1] + 1).all()
    offset = {}
    for p, a, b in zip(place, low, high):
        for i in range(a, b + 1):
            assert i <= p <= i + length - length // 3
            assert offset.setdefault(text[i : i + length], p - i) == p - i


def texts(rng, alphabet, n):
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(10, 200))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pool)
            i = rng.randrange(len(p))
            parts.append(rng.choice([p, p[i:], p[:i], "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))]))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("length,alphabet,hot", [(20, "ab", 10**9), (32, "abcdefghij é", 10**9), (41, "xyz\U0001f600", 10**9), (32, "abcdefghij é", 3)])
def test_report(spark, monkeypatch, length, alphabet, hot):
    monkeypatch.setattr(s, "HOT_KINDS", hot)
    monkeypatch.setattr(s, "CHUNK", 300)
    monkeypatch.setattr(s, "LEAD", 8)
    rng = random.Random(length)
    rows = list(enumerate(texts(rng, alphabet, 60))) + [(500, None), (501, ""), (502, "a" * 900), (503, "short")]
    rows += [rows[3], (None, rows[4][1]), (None, "q" * 10 + rows[5][1]), (600, rows[7][1])]
    docs = spark.createDataFrame([(d, t, "t") for d, t in rows], "doc_id long, text string, text_hash string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.report(docs, length).collect())
    assert got == brute(rows, length)
    assert sum(x[2] for x in got) > 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.report(docs).count() == 0
    one = s.report(spark.createDataFrame([(1, "x" * 1000), (2, "y")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in one} == {(1, 1000), (2, 0)}
