"""Toxicity: the decoder against all paths of the lattice, and held-out accuracy with disguised words."""

import itertools
import random
import zlib

import numpy as np

from canloom.llm import quality, toxicity

BAD = ["idiot", "moron", "stupid", "clown"]


def model_of(texts):
    key, n = np.unique(quality.codes(texts, 3)[0], return_counts=True)
    return quality.KneserNey(key, n, 3)


def test_viterbi_is_the_best_path():
    r = toxicity.Restorer(model_of(["the idiot said that a stupid clown is a moron and the rest"] * 5))
    for word in ["1d10t", "m0r0n", "s.t-u+p1d", "clllown", "$tup!d", "x9y"]:
        best = None
        for path in itertools.product(*r.lattice(word)):
            text, v, a, b = "".join(x for x, _ in path), -sum(c for _, c in path), 0, r.symbol(" ")
            for c in text + " ":
                v += float(r.cube[a, b, r.symbol(c)])
                a, b = b, r.symbol(c)
            best = max(best or (v, text), (v, text))
        assert r.decode(word) == best[1]
    assert r.restore("Idi0t!!!") == "idiot" and r.restore("iiiidiot") == "idiot" and r.restore("1234") == ""
    assert r.restore("plain,") == "plain"
    assert "idiot" in {r.restore(w) for w in toxicity.words_of("an i d i o t here")}


def test_held_out(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    hide = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: " ".join(w), lambda w: w.upper() + "###", lambda w: w.replace("s", "$")]
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 1
        w = [rng.choice(vocab) for _ in range(60)]
        if bad:
            for b in rng.sample(BAD, 2):
                w[rng.randrange(60)] = rng.choice(hide)(b)
        docs.append((i, " ".join(w), "x", 0.5))
        labels.append((i, int(bad)))
    docs += [(9000, None, None, None), (9001, "", "x", 1.0), (9001, "", "x", 1.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxicity double")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.report(d, y).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 1) for r in held) >= 0.97 * len(held)
    kept = toxicity.clean(d, y)
    assert kept.columns == d.columns and {9000, 9001} <= {r.doc_id for r in kept.collect()}
    assert max(r.score for r in toxicity.report(d, y.limit(0)).collect()) < 1e-9
    assert toxicity.report(d.limit(0), y).count() == 0


def test_share_is_the_same_at_every_size(spark, monkeypatch):
    """Labels that texts tell little about: the mean score is the share of label 1, also where one label is sampled."""
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(8)) + (" idiot" if i % 10 == 1 and i % 30 != 1 or i % 10 == 2 else ""), int(i % 10 == 1)) for i in range(1000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    means = []
    for most in (4000, 60):
        monkeypatch.setattr(toxicity, "SAMPLE", most)
        means.append(np.mean([r.score for r in toxicity.report(d, d.select("doc_id", "toxic")).collect()]))
    assert all(0.06 < m < 0.15 for m in means), means


def test_named_disguises():
    r = toxicity.Restorer(model_of(["hello you idiot said that a stupid clown well is a moron and an ass or ass or ass is bad in the rest of it"] * 5))
    read = lambda text: {x for w in toxicity.words_of(text) for x in r.readings(w)}
    for text, word in [
        ("hello:idiot", "idiot"), ("you/idiot", "idiot"), ("well...moron", "moron"), ("hello/you/1d10t", "idiot"),
        ("i d ! o t", "idiot"), ("$ t u p i d", "stupid"), ("b a d", "bad"), ("i   d...i  -  o t!", "idiot"), ("a$$", "ass"),
        ("the-" * 40 + "m0r0n", "moron"),
    ]:
        assert word in read(text), (text, read(text))
    assert "stupid" in read("s.t-u+p1d") and "idiot" in read("Idi0t!!!")
    assert len(r.decode("ab-" * 5000)) >= 10000  # in time linear to the length
    toxicity.words_of("_ " * 5000 + "x " * 5000 + "_" * 5000)


def test_long_disguised_token_and_text():
    """Whole tokens and whole texts are read: what is far behind the first hundred characters counts."""
    r = toxicity.Restorer(None)
    token = "x" * 300 + "-idiot"
    assert "idiot" in {w for w in r.readings(token)} or any(w.endswith("idiot") for w in r.readings(token))
    words = toxicity.words_of("fine words " * 50_000 + "idiot")
    assert words == {"fine", "words", "idiot"}


def test_plain_words_are_read_together():
    """Features of many words at once are those of each, and plain words go through no decoder."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcXYZ") for _ in range(rng.randrange(1, toxicity.SHORT + 1))) for _ in range(500)] + ["aaa", "ab", "baaa", "aabaa", "x" * toxicity.SHORT]
    made, odd = toxicity.plain_features(words)
    long = lambda w: [zlib.crc32(x.encode()) % toxicity.SPACE for x in [w, *(f"{w[:n]}*" for n in (4, 5, 6, 7) if len(w) > n)]] if len(w) > 2 else []
    for w, row, o in zip(words, made.tolist(), odd.tolist()):
        assert [x for x in row if x >= 0] == long(w.lower()) == toxicity.features(w.lower())
        assert o == any(w.lower()[i] * 3 == w.lower()[i : i + 3] for i in range(len(w)))
    assert toxicity.features("Ünïcödé") == long("Ünïcödé")
    assert toxicity.Restorer(None).readings("Plain,") == {"plain"} == toxicity.Restorer(None).readings("PLAIN")


def test_features_are_few_files_at_any_number_of_partitions(spark, monkeypatch):
    """Each file that an executor writes starts a process that counts as large as the executor: a bounded table has few of them."""
    rng = random.Random(14)
    docs = [(i, " ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(8)) + " 1d10t" * (i % 7 == 1), int(i % 7 == 1)) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    run = lambda: sorted((r.doc_id, r.score) for r in toxicity.report(d, d.select("doc_id", "toxic")).collect())
    plain, files, kept = run(), {}, toxicity.materialize

    def counted(df, what, **more):
        out = kept(df, what, **more)
        files[what] = len(out.inputFiles())
        return out

    monkeypatch.setattr(toxicity, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert run() == plain
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 1 <= files["features"] <= 2 * spark.sparkContext.defaultParallelism
