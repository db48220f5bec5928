"""Vector codes: nearest entries against all distances, the whole fit against plain loops."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from canloom.llm import vectorcode
from canloom.llm.vectorcode import Codebook

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_tries_no_more_than_the_annulus_and_loses_nothing(kind):
    rng = np.random.default_rng(2)
    for spread in (3, 50, 4000):
        entries = rng.integers(-spread, spread, (16, 8)).astype(kind)
        entries[5] = entries[9]  # a tie of entries: the lower index
        entries[7] = -entries[3]  # a tie of norms
        parts = np.concatenate([rng.integers(-spread, spread, (400, 8)).astype(kind), entries, np.zeros((1, 8), kind)])
        book = Codebook(entries)
        got, distance = book.nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert got.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
        assert book.evaluated <= 16 * len(parts)
    apart = np.array([[10 ** (k // 4) * (k % 4 + 1)] * 2 for k in range(16)], kind)
    book = Codebook(apart)
    book.nearest(np.repeat(apart, 50, 0) + np.array(1, kind))
    assert book.evaluated < 0.3 * 16 * 16 * 50  # norms far apart leave few entries in an annulus


def by_loops(rows):
    """code, error and label_error of each kept row, and the codebooks, by the definition."""
    kept = [(v, x, label) for v, x, label in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fits = [r for r in kept if r[1] and len(r[1]) % 8 == 0]
    width = len(fits[0][1]) if fits else 0
    fits = [(v, [math.floor(4096 * c) for c in x], label) for v, x, label in fits if len(x) == width]
    w = width // 8
    cut = [[x[p * w : (p + 1) * w] for p in range(8)] for _, x, _ in fits]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min((apart(part, c), e) for e, c in enumerate(book))
    for _ in range(6):
        for p in range(8):
            of = defaultdict(list)
            for c in cut:
                of[best(c[p], books[p])[1]].append(c[p])
            for e, parts in of.items():
                books[p][e] = [sum(v) // len(parts) for v in zip(*parts)]
    out, label_error = [], defaultdict(int)
    for (v, _, label), c in zip(fits, cut):
        found = [best(c[p], books[p]) for p in range(8)]
        out.append((v, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        label_error[label] += out[-1][3]
    return [(*r, label_error[r[1]]) for r in out], hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def rows_of(rng, n, dim=16, centres=3):
    middle = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(centres)]
    return [(i * 3, [float(np.float32(c + rng.gauss(0, 0.05))) for c in rng.choice(middle)], rng.choice([None, 1, 2])) for i in range(n)]


def held(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcode.compress(df).collect()]
    want, sha = by_loops(rows)
    assert all(r[5] == sha for r in got if r[2] is not None)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((r[:5] for r in got if r[2] is not None), key=key) == sorted(want, key=key)
    return [r for r in got if r[2] is None]


def test_against_loops(spark):
    rng = random.Random(11)
    rows = rows_of(rng, 150)
    rows += [rows[3], rows[3], (None, rows[4][1], None), (7, [0.0] * 16, 2), (8, [-0.0001] * 16, 2)]  # repeated rows, ties, a null id
    rows += [(1, None, 1), (2, [0.1] * 15 + [None], 1), (4, [math.nan] + [0.1] * 15, 1), (5, [0.1] * 15 + [-math.inf], None)]
    assert held(spark, rows) == []
    other = held(spark, [*rows, (10_000, [0.5] * 8, 1), (10_001, [], 1), (10_002, [0.5] * 9, None)])
    assert {(r[0], r[3]) for r in other} == {(10_000, None), (10_001, None), (10_002, None)}


def test_few_rows_and_large_components(spark):
    rng = random.Random(4)
    assert held(spark, rows_of(rng, 5)) == []
    assert held(spark, []) == [] and held(spark, [(1, None, 1), (2, [math.inf] * 8, 1)]) == []
    rows = rows_of(rng, 40, dim=8)
    rows += [(1000 + i, [float(np.float32(rng.choice([-1, 1]) * 40_000.5)) for _ in range(8)], 3) for i in range(4)]
    assert held(spark, rows) == []  # beyond PLAIN: unbounded integers
    huge = [*rows, (5000, [3e38] * 8, 9), (5001, [-3e38] * 8, 9)]
    got = {r.vec_id: r for r in vectorcode.compress(spark.createDataFrame([(*r, "") for r in huge], SCHEMA)).collect()}
    assert len(got) == len(huge) and got[5000].label_error == max(got[5000].error, got[5001].error)


def test_one_vector_as_a_third_of_all_rows(spark):
    rng = random.Random(9)
    rows = rows_of(rng, 200)
    assert held(spark, rows + [(1000 + i, rows[0][1], 1) for i in range(100)]) == []
