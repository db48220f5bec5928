"""Token counts by a digest cache.

Content is named by the digest of its UTF-8 bytes and the tokenizer by the digest of its file. Digests are counted and
joined with the cache, and two bit maps of bounded size tell a second reading of the texts what is missing: a text that no
other row may share is encoded where it is read, and never shuffled. Of content that may repeat, the rows are joined
with the one row that stands for it (by digest and row mark, so that copies are dealt out and no content is a hot key),
and that one is encoded. New counts are appended to the cache.

* Normalisation: null counts as the empty text. Nothing else may change, as the counts are to be exact.
* A full map only sends more rows the longer way, or encodes a cached text again: counts stored twice are the same, and
  read once. The cache is partitioned by tokenizer, and may be read and appended to by many jobs.
* Repeated rows, ties and empty tables need no rule of their own: each input row gets one output row. Very long texts are
  encoded whole, ``BATCH_BYTES`` of texts together. Other columns of docs aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.llm.common import materialize, member, membership, small_batches, steps

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"
#: Characters of the texts that are encoded together.
BATCH_BYTES = 1 << 20


def tokenizer_version(path: str) -> tuple[str, str]:
    """(digest, file content) of a tokenizer file; the file is a few MB."""
    body = Path(path).read_text(encoding="utf-8")
    return hashlib.sha256(body.encode()).hexdigest(), body


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """(content, n_tokens) stored for this tokenizer, or None where there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(body: str, need=None, shared=None):
    """Rows (content, place, text) to counts; with maps, of those whose place is needed (all, without that map) and not shared."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(body)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        seen: set[bytes] = set()
        for batch in batches:
            if shared is not None:
                place = batch.column(1).to_numpy(zero_copy_only=False)
                own = ~member(shared.value, place)
                batch = batch.filter(pa.array(own if need is None else own & member(need.value, place)))
            keep = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            batch = batch.take(pa.array(keep, pa.int64()))
            texts, counts = batch.column(2).to_pylist(), []
            for a, b in steps(texts, BATCH_BYTES):
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return encode


def _in_map(known):
    """Rows (content, place, ...) whose place the map may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(member(known.value, batch.column(1).to_numpy(zero_copy_only=False))))

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    version, body = tokenizer_version(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))
    mark = F.xxhash64("doc_id", "content").alias("mark")
    keys = materialize(docs.select("doc_id", content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    kinds = keys.select("content", mark).groupBy("content").agg(F.min("mark").alias("mark"), F.count("*").alias("n"))
    need, place = None, F.xxhash64("content").alias("place")
    if (stored := read_cache(spark, cache_path, version)) is not None:
        kinds = materialize(kinds.join(stored.select("content"), "content", "left_anti"), "missing", narrow=True)
        need = spark.sparkContext.broadcast(membership(kinds.select(place), "place"))
    twice = materialize(kinds.where("n > 1").select("content", place, "mark"), "repeated", narrow=True)
    shared = spark.sparkContext.broadcast(membership(twice, "place"))
    rows = docs.select("doc_id", content.alias("content"), text.alias("text")).select("content", F.xxhash64("content").alias("place"), "text", mark)
    schema = "content binary, n_tokens long"
    texts, cores = rows.select("content", "place", "text"), spark.sparkContext.defaultParallelism
    if len(keys.inputFiles()) < cores:  # one file for each partition of the reading: too few to keep all cores busy
        texts = texts.repartition(cores)
    alone = texts.mapInArrow(_encoder(body, need, shared), schema)
    copies = rows.mapInArrow(_in_map(shared), "content binary, place long, text string, mark long")
    # a text that only seems shared stands for itself
    chosen = kinds.select("content", place, "mark").mapInArrow(_in_map(shared), "content binary, place long, mark long").select("content", "mark")
    one = copies.join(chosen.hint("merge"), ["content", "mark"]).select("content", "place", "text").mapInArrow(_encoder(body), schema)
    fresh = alone.unionByName(one).select("content", "n_tokens", F.lit(version).alias("tokenizer"))
    fresh.write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = materialize(read_cache(spark, cache_path, version), "counts")  # two plain sides: Spark can split a hot content
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
