"""The pipeline on planted documents: what must go goes, what is clean stays."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(14)
    docs, labels = [], []
    for i in range(400):
        t = text(80)
        bad = i % 4 == 3
        if bad:
            t += rng.choice([" idiot here", " 1d10t here"])
        labels.append((i, 1, int(bad)))
        docs.append([i, t, "en", f"s{i % 3}", len(t)])
    docs[0][1] += f" {item} tail"
    docs[1][1] += " mail me@host.org now"
    docs[200][1] = docs[4][1]
    docs += [[500, None, None, None, None], [501, "", "en", "s0", 0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = spark.createDataFrame([tuple(x) for x in docs], schema)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = out.columns
        out = stage(spark, out, str(tmp_path))
        if name != "mix":
            assert out.columns == before and out.schema == spark.read.parquet(f"{tmp_path}/documents.parquet").schema
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in out.collect()})
    toxic, near, cut, red, mix = seen
    assert sum(i % 4 == 3 for i in toxic if i < 400) <= 2 and sum(i % 4 != 3 for i in toxic if i < 400) >= 298
    assert set(toxic) - set(near) == {200, 501}  # one of two copies, one of two texts without words
    assert item not in cut[0].text and cut[0].text.endswith(" tail") and set(cut) == set(near)
    assert red[1].text.endswith("mail [EMAIL] now") and red[1].n_chars == len(red[1].text) and set(red) == set(cut)
    assert all(r.copies >= 1 and r.copies <= 3 for r in mix.values()) and set(mix) <= set(red)
    ran = {r.doc_id: (r.text, r.copies) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {i: (r.text, r.copies) for i, r in mix.items()}


def test_clashing_columns_repeated_rows_nulls_and_empty_tables(spark, tmp_path):
    """Extra columns by names that stages use keep their values; repeated rows don't multiply; empty tables run through."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity int, pii_spans string, size int, node int, component int"
    rows = [(i, text(60), "en", f"s{i % 2}", 1, i, f"p{i}", 2 * i, 3 * i, 4 * i) for i in range(60)]
    rows += [rows[7], rows[7], (None, text(30), None, None, None, 1, None, 2, 3, 4), (70, text(20_000), "en", "s1", 1, 70, "p70", 140, 210, 280)]
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}-{name}")
            after = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            assert after.columns[: len(docs.columns)] == docs.columns
            docs = after
        got = docs.collect()
        if n:
            assert got == []
            continue
        assert all(r.toxicity == r.doc_id and r.size == 2 * r.doc_id and r.pii_spans == f"p{r.doc_id}" for r in got if r.doc_id is not None)
        # nothing is toxic or alike but the repeated rows, of which one stays
        kept = spark.read.parquet(f"{tmp_path}/0-personal_data").select("doc_id").collect()
        assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, {r[0] for r in rows}))
