"""Benchmark decontamination by an FM-index for each training shard.

A shard is a bounded run of documents. Its words are mapped to the ids that the benchmark's words have; runs
of other words can hold no window and become one separator, so the index covers exactly the stretches that
could match. The index is a wavelet matrix over the Burrows-Wheeler transform with every eighth suffix
position kept. All windows of one length are searched backwards at once, occurrences are located by walking
to a kept position, and the spans of a document are merged.

* Windows: 10 consecutive words of an item; an item of fewer, but not none, is one window.
* Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null texts have none.
* Benchmark rows without an item_id are ignored; rows that repeat an item_id are windows of one item.
* The benchmark is taken in blocks of ``BLOCK_BYTES`` of text; each block passes over all documents, so what a
  task holds is bounded however large the benchmark is. Documents are never shuffled.
* A very long text is one shard by itself, so memory grows with the longest text. An empty benchmark hits nothing, an empty
  table gives no rows, repeated rows get equal results, and columns of docs that clash with ours keep their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import fresh_name, materialize, small_batches, steps, utf8

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 8

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Word bytes stand for themselves, A-Z for a-z, all others for a space.
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By doubling; t ends with a value that is smaller than all others and occurs once."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, k = len(t), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-k] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, min(2 * k, n - 1)


class FMIndex:
    """Counts and locates patterns of symbols 2.. in a sequence of symbols 1.. (1 parts the stretches)."""

    def __init__(self, t: np.ndarray):
        t = np.append(t, 0)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.n, top = len(t), int(t.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=top + 1))))
        self.top, self.bits = top, max(1, top.bit_length())
        self.ones, self.zeros, level = [], [], bwt
        for k in range(self.bits - 1, -1, -1):
            bit = (level >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.bwt = bwt
        self.kept = np.where(sa % SAMPLE == 0, sa, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``at`` places of the transform."""
        low, high = np.zeros_like(at), at
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            bit = (symbol >> k) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, row behind the last) of the patterns that occur."""
        live = np.flatnonzero((patterns <= self.top).all(axis=1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low, high = self.before[symbol] + self.rank(symbol, low), self.before[symbol] + self.rank(symbol, high)
            live, low, high = (x[high > low] for x in (live, low, high))
            if not len(live):
                break
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        place, walked, rows = np.full(len(rows), -1, np.int64), 0, rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            found = self.kept[rows[todo]]
            there = found >= 0
            place[todo[there]] = found[there] + walked
            todo = todo[~there]
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.before[symbol] + self.rank(symbol, rows[todo])
            walked += 1
        return place


class Phrases:
    """The distinct windows of a block of items, by length, as word ids."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 2) for x in words(text.encode())]
            for a in range(max(1, len(w) - window + 1)) if w else ():
                found.setdefault(min(len(w), window), {}).setdefault(tuple(w[a : a + window]), set()).add(number[item])
        self.by_length = {}
        for n, of in found.items():
            owners = [sorted(x) for x in of.values()]
            self.by_length[n] = (np.array(list(of), np.int64), np.concatenate([[0], np.cumsum([len(x) for x in owners])]), np.array([y for x in owners for y in x], np.int64))
        self.least = min(found, default=0)

    def match(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int]], list[str]]]]:
        """Word counts, and (row, merged word spans, items) of the rows in which a window occurs."""
        get = self.ids.get
        parts = [np.array([get(w, 1) for w in words(t)], np.int64) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        if not self.least or not counts.sum():
            return counts, []
        ids = np.concatenate([x for p in parts for x in (p, [1])]).astype(np.int64)
        row = np.repeat(np.arange(len(parts)), counts + 1)
        base = np.concatenate(([0], np.cumsum(counts + 1)))
        known = np.concatenate(([0], (ids > 1).astype(np.int8), [0]))
        edge = np.diff(known)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= self.least
        first, last = first[long], last[long]
        if not len(first):
            return counts, []
        # each stretch with the separator behind it; where its symbols stood in ids
        length = last - first + 1
        start = np.cumsum(length) - length
        where = np.arange(length.sum()) - np.repeat(start - first, length)
        index = FMIndex(ids[where])
        begin, end, pair = [], [], []
        for n, (patterns, at, owner) in self.by_length.items():
            live, low, high = index.search(patterns)
            times = high - low
            if not len(live):
                continue
            rows = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            place = where[index.locate(rows)]
            begin.append(place)
            end.append(place + n)
            which = np.repeat(live, times)
            owners = at[which + 1] - at[which]
            flat = np.repeat(at[which] - (np.cumsum(owners) - owners), owners) + np.arange(owners.sum())
            pair.append(np.unique(np.repeat(row[place], owners) * len(self.items) + owner[flat]))
        if not begin:
            return counts, []
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, np.concatenate(begin), 1)
        np.add.at(cover, np.concatenate(end), -1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))
        spans: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            spans.setdefault(int(row[a]), []).append((int(a - base[row[a]]), int(b - base[row[a]])))
        named: dict[int, list[str]] = {}
        for x in np.unique(np.concatenate(pair)):
            named.setdefault(int(x // len(self.items)), []).append(self.items[x % len(self.items)])
        return counts, [(r, s, named[r]) for r, s in spans.items()]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the stretches from the first to the last word of each span."""
    found, out, done = [m.span() for m in _WORD.finditer(text.translate(_TABLE))], [], 0
    for a, b in spans:
        out.append(text[done : found[a][0]])
        done = found[b - 1][1]
    return b"".join([*out, text[done:]])


def _searcher(phrases, text: str, words_col: str, spans_col: str, items_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = phrases.value
        for batch in batches:
            texts = utf8(batch.column(text))
            spans = [[(s["a"], s["b"]) for s in x] for x in batch.column(spans_col).to_pylist()]
            items = batch.column(items_col).to_pylist()
            counts = []
            for a, b in steps(texts, SHARD_BYTES):
                n, found = block.match(texts[a:b])
                counts.append(n)
                for r, s, i in found:
                    spans[a + r] = _merge(spans[a + r] + s)
                    items[a + r] = sorted({*items[a + r], *i})
            made = {
                words_col: pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                spans_col: pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                items_col: pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(k)) for k, n in enumerate(batch.schema.names)], batch.schema.names)

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, whose names are returned: word count, merged word spans, items found."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    n, s, i = (fresh_name(docs, x) for x in ("n_words", "spans", "items"))
    out = docs.withColumns({n: F.lit(0).cast("long"), s: F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), i: F.expr("cast(array() as array<string>)")})
    for k in range(blocks):
        if k:  # what the last block found is written, so that a task, its workers and the driver hold one block at a time
            out = materialize(out, "windows")
            phrases.unpersist()
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = spark.sparkContext.broadcast(Phrases([(r.item, r.text) for r in own.toLocalIterator()]))
        out = out.mapInArrow(_searcher(phrases, "text", n, s, i), out.schema)
    return out, n, s, i


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs as they were, with every benchmark span cut out of the texts (null stays null)."""
    found, n, s, i = find_windows(docs, benchmark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, texts = batch.schema.names.index("text"), batch.column("text").to_pylist()
            for r, spans in enumerate(batch.column(s).to_pylist()):
                if spans:
                    texts[r] = without(texts[r].encode(), [(x["a"], x["b"]) for x in spans]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == k else batch.column(j) for j in range(batch.num_columns)], batch.schema.names)

    return found.mapInArrow(cut, found.schema).drop(n, s, i)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of what was found, one row per document."""
    found, n, s, i = find_windows(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(s, F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    return found.select(
        "doc_id",
        F.col(n).alias("n_words"),
        hit.alias("n_hit"),
        F.size(i).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(i), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
