"""Token counts against the library called on each text."""

import public_tokenizers
from tokenizers import Tokenizer

from canloom.llm import tokens
from canloom.llm.common import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a b  c", "a b  c", "<|endoftext|> x", "naïve café 12345 \n\n y", "z " * 5000, "\U0001f600   \t"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_and_cache(spark):
    rows = list(enumerate(TEXTS)) + [(2, "a b  c"), (None, "q")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, content string")
    cache = fresh_path(spark, "test-cache")
    want = sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, expected([t for _, t in rows])))
    for _ in range(2):
        got = tokens.count_tokens(docs, PATH, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(docs, PATH, fresh_path(spark, "test-cache")).collect() == []
