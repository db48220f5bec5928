"""What the corpus operators share: shared storage, row identity, words and bounded text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Rows an Arrow batch has at most, so that batches of long texts fit a small Python worker.
BATCH_ROWS = 1000

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; one of our own only in one process (tests) where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="canloom-"))
    return f"file://{_OWN_DIR[0]}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/canloom/{what}-{uuid.uuid4().hex}"


#: Folders written since each ``scratch`` began.
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, what: str, result: bool = False, narrow: bool = False) -> DataFrame:
    """Cut the lineage: written once to shared storage, so a lost executor costs no more than its tasks.

    Inside ``scratch``, what isn't its result is deleted at its end. Tables of a few numbers a row, or of a bounded
    number of rows (``narrow``), are written by two waves of tasks, so that they aren't a great many small files."""
    path = fresh_path(df.sparkSession, what)
    if narrow:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    if len(_SCOPES) > result:
        _SCOPES[-1 - result].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is materialized meanwhile, at the end or on failure, but for results. What is computed from it must be
    written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, so that extra columns of the input never clash with ours."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def fold(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of a membership map, at most (32 MB); a fuller map lets more rows through, and never loses one.
MAP_BITS = 28


def membership(keys: DataFrame, column: str) -> np.ndarray:
    """A bit map of the longs in keys[column], 16 bits a key up to the bound; read it by ``member``."""
    n = keys.count()
    bits = min(MAP_BITS, max(16, (16 * n).bit_length()))
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    word = F.shiftright(place, 6).alias("word")
    marks = keys.select(word, F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("mark"))
    table = marks.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return out


def member(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for longs that the map surely lacks."""
    place = keys.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
