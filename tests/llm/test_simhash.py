"""SimHash against bit counts and all pairs in plain Python."""

import random
import re
import time

import numpy as np
import pytest
import xxhash

from canloom.llm import components, simhash
from canloom.llm.components import Forest


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if (a[1] ^ rows[j][1]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(rows))]


def test_fingerprint():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " ".join(rng.choice(["Ab", "çÀ", "x y", "q\tQ", "\x1c", "zz"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == brute_print(t)
    assert simhash.fingerprint(b" \n\t") == 0


@pytest.mark.parametrize("segments", [5, 6, 4])
def test_links_are_complete(segments):
    rng = np.random.default_rng(segments)
    table = simhash.PivotTable(segments, 3)
    fp = rng.integers(0, 1 << 64, 400, np.uint64)
    for _ in range(5):  # balls of near prints
        fp = np.concatenate((fp, fp[:120] ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))))
    fp = np.unique(fp)
    node = np.arange(len(fp))
    import pyarrow as pa

    rows = list(simhash._candidates(table, 3)(iter([pa.RecordBatch.from_arrays([pa.array(node), pa.array(fp.view(np.int64))], ["node", "fp"])])))
    key, n, f = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(3))
    order = np.argsort(key, kind="stable")
    cuts = [0, len(key) // 3, len(key)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[order][a:b]) for x in (key, n, f)], ["key", "node", "fp"]) for a, b in zip(cuts, cuts[1:])]
    forest = components.Forest()
    for b in simhash._bucket_links(table, 3)(iter(batches)):
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(u, v)
    assert [forest.root(int(x)) for x in node] == brute_components([(int(i), int(x)) for i, x in zip(node, fp)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (200, 200)] + [(500, x) for x in range(600, 640)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 95: 90, 100: 90, 500: 500, **{x: 500 for x in range(600, 640)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_form(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(300)) for _ in range(12)]
    texts = []
    for b in base:
        w = b.split()
        texts += [b, b.upper()]
        for _ in range(3):
            v = list(w)
            v[rng.randrange(300)] = "other"
            texts.append(" ".join(v))
    texts += [None, "", "  \n", "one", "one two"]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)] + [(1000, texts[0])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    extra = docs.selectExpr("doc_id", "text", "fp", "1 as n", "2 as rows", "3 as component_id").unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "text", "fp", "1 as n", "2 as rows", "3 as component_id"))
    one = simhash.one_of_each(extra).collect()
    assert sum(r.doc_id is None for r in one) == 1
    kept = sorted(r.doc_id for r in one if r.doc_id is not None)
    assert kept == sorted({c for _, _, c in want})
    some = docs.selectExpr("cast(null as long) doc_id", "text").union(docs.where("doc_id = 993").select("doc_id", "text"))
    assert {r.component_id for r in simhash.near_duplicates(some).where("fingerprint <> '0000000000000000'").collect()} >= {None, 993}


def test_large_bucket():
    """Twenty thousand distinct fingerprints that agree in 26 bits, with planted neighbours: the links of all pairs, in seconds."""
    rng = np.random.default_rng(9)
    fp = np.unique(rng.integers(0, 1 << 38, 20_000, np.uint64))
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(38, 3, False).astype(np.uint64)) for _ in range(2000)], np.uint64)
    fp = np.unique(np.concatenate((fp, fp[:2000] ^ flips)))
    table = simhash.PivotTable()
    began = time.time()
    forest = Forest()
    for a, b in simhash.bucket_links(np.arange(len(fp)), fp, table):
        forest.join(a, b)
    assert time.time() - began < 10
    whole = Forest()
    for a in range(len(fp)):
        for b in np.flatnonzero(np.bitwise_count(fp ^ fp[a]) <= 3):
            whole.join(a, int(b))
    assert [forest.root(i) for i in range(len(fp))] == [whole.root(i) for i in range(len(fp))]
