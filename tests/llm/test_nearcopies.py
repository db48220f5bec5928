"""Near copies: planted texts at 0.8 to 0.95, chains and look-alikes, against all pairs by exact Jaccard."""

import numpy as np
import random

from canloom.llm import nearcopies as n
from canloom.llm.simhash import PivotTable, majority
from canloom.llm.components import Forest


def test_planted_copies(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(900)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    common = text(60)
    docs = []
    for i in range(60):
        base = text(150)
        docs.append(base)
        for changed in (1, 2, 3):  # up to 5 of 146 shingles a change: 0.81 to 0.95
            copy = list(base)
            for at in rng.sample(range(0, 150, 10), changed):
                copy[at] = "new"
            docs.append(copy)
    chain = text(150)
    for i in range(8):  # neighbours are similar, the ends aren't
        docs.append(list(chain))
        chain[10 * i + 5] = "link"
        chain[10 * i + 60 + 3 * (i % 2)] = "more"
    docs += [common + text(25) for _ in range(30)]  # alike below 0.8
    docs += [[], [], ["one"], ["ONE"]]
    texts = [" ".join(d) for d in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    forest, pairs = Forest(), 0
    for i in range(len(sets)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if common_ >= 0.8 * (len(sets[i]) + len(sets[j]) - common_):
                forest.join(i, j)
                pairs += common_ < len(sets[i])
    assert pairs > 150
    want = {i for i in range(len(sets)) if forest.root(i) == i}
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in n.one_of_each(d).collect()} == want
    assert n.one_of_each(d.limit(0)).count() == 0


def test_links_settle_a_bucket():
    import numpy as np

    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 9, 18, 500, 27, 505)]
    fp = [int(np.uint64(majority(s)).view(np.int64)) for s in sets]
    out = n.links(list(range(6)), list(range(6)), fp, sets)
    forest = Forest()
    for u, v in out:
        forest.join(u, v)
    assert [forest.root(i) for i in range(6)] == [0, 0, 0, 3, 0, 3] and len(out) == 4


def test_stage_takes_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(9)
    base = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(150)]
    copies = [base, [*base[:40], "x", *base[41:]], [*base[:40], "x", *base[41:110], "y", *base[111:]], base[::-1]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(copies)], "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()} == {0, 3}


def test_fingerprints_of_similar_sets_are_near():
    """The discard by pivots and bits loses no similar pair, small sets and ties included."""
    rng = np.random.default_rng(3)
    pivots, worst = PivotTable(), 0
    for _ in range(4000):
        size = int(rng.integers(4, 60))
        common = rng.integers(0, 1 << 64, size, np.uint64)
        left = int(size / 0.8 - size)
        cut = int(rng.integers(0, left + 1))
        a, b = (np.concatenate((common, rng.integers(0, 1 << 64, k, np.uint64))) for k in (cut, left - cut))
        fa, fb = (np.array([majority(x)], np.uint64) for x in (a, b))
        worst = max(worst, int(np.bitwise_count(fa ^ fb)[0]))
        assert n.near(pivots.whole_distances(fa), pivots.whole_distances(fb), fa, fb)[0]
    assert worst < n.WIDE
    other = rng.integers(0, 1 << 64, (2, 4000), np.uint64)
    assert n.near(pivots.whole_distances(other[0]), pivots.whole_distances(other[1]), *other).mean() < 0.25


def test_the_pivots_propose(spark, monkeypatch):
    """Copies whose fingerprints are near are found by the pivots without any block; pairs that aren't similar are not."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    texts = []
    for _ in range(20):
        base = [word() for _ in range(2000)]
        texts += [base, [*base[:-1], "end"]]
    a, b = (np.array([majority(n.shingles(" ".join(t).encode()))], np.uint64) for t in texts[:2])
    assert np.bitwise_count(a ^ b)[0] <= 3

    def nothing(batches):
        for batch in batches:
            yield batch.slice(0, 0).select([0, 1, 1]).rename_columns(["key", "node", "leader"])

    monkeypatch.setattr(n, "_blocks", nothing)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in n.one_of_each(docs).collect()} == set(range(0, 40, 2))
