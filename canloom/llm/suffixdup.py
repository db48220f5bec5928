"""Removal of long repeated byte strings by range-partitioned suffix sorting.

Which suffixes are sorted. Every window of ``LENGTH`` bytes has an anchor: the place in it whose next bytes, a third
of LENGTH, have the smallest hash. The anchor depends on the window's bytes alone, so two equal windows have equal
anchors at equal places, and only suffixes that start at anchors need to meet: one in over a hundred. An anchor's segment is
the stretch of all windows that it is the anchor of.

1. Anchors (hash of the gram, hash of the whole segment, place) are counted. A segment that occurs twice is repeated
   as a whole; an anchor whose gram occurs once isn't repeated at all. Counts are aggregated before the shuffle, so
   copies are no hot keys.
2. What is left, one segment for each distinct content of a gram, goes as bytes to buckets: sampled splitters range-
   partition the suffixes by their leading bytes. A bucket sorts the suffixes by multikey quicksort over 8-byte tokens
   and keeps the lengths that neighbours share; texts to the left of the anchors are sorted likewise. A window is
   repeated if another suffix shares enough on both sides. Suffixes of one gram share their leading bytes and lie in
   one bucket, and the last suffixes of a bucket's batch are carried over to the next, so none is parted.
3. Windows found repeated are merged into spans for each document.

* Step 1 compares 128 bits of two independent polynomial hashes; step 2 compares bytes, but for grams with over
  ``HOT_KINDS`` distinct segments, whose windows are counted by 128-bit hashes so that no task holds them all.
* Very long texts are taken in chunks of ``CHUNK`` window starts. An empty table gives no rows; other columns aren't looked at.
* Matches never cross texts; null counts as empty. A repeated row repeats all of its windows. Rows are told apart by
  doc_id (which may be null) and a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize, member, membership, scratch, small_batches, utf8

LENGTH = 400
#: Window starts that are looked at together; longer texts are taken in turns.
CHUNK = 1 << 20
#: Leading bytes that buckets are split by.
LEAD = 32
#: Suffixes that are sorted together at least; a bucket has many such batches.
BATCH = 2048
#: Grams with more distinct segments than this are too many for one task; see ``_window_hashes``.
HOT_KINDS = 20_000
PLACE_BITS = 22
assert CHUNK + LENGTH < 1 << PLACE_BITS


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


_VALUES = [_odd(11, 256), _odd(12, 256)]
_BASES = [int(_odd(21, 1)[0]), int(_odd(22, 1)[0])]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    held = _POWERS.get((which, inverse))
    if held is None or len(held) < n:
        base = np.uint64((_INVERSES if inverse else _BASES)[which])
        held = np.ones(max(n, 1 << 14), np.uint64)
        held[1:] = base
        held = _POWERS[which, inverse] = np.multiply.accumulate(held)
    return held[:n]


class Hashes:
    """Polynomial hashes modulo 2**64 of any stretch of a byte string."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[which][data] * _powers(which, False, len(data)), out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = (self.sums[last] - self.sums[first]) * _powers(self.which, True, len(self.sums))[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int = LENGTH) -> list[tuple[np.ndarray, ...]]:
    """(gram hash, segment hash, anchor, first window, last window) of a text, in chunks of window starts."""
    gram, out = length // 3, []
    for start in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(len(text) - start, CHUNK + length - 1), start)
        one = Hashes(data, 0)
        first = np.arange(len(data) - gram + 1)
        hashed = one.of(first, first + gram)
        ranked = (hashed & ~np.uint64((1 << PLACE_BITS) - 1)) | first.astype(np.uint64)
        at = (_window_minimum(ranked, length - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        low = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        high = np.concatenate((low[1:] - 1, [len(at) - 1]))
        place = at[low]
        two = Hashes(data, 1)
        segment = two.of(low, high + length) + (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out.append((hashed[place], segment, place + start, low + start, high + start))
    return out


def text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


_ROW = "doc_id long, text_hash long"


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "segment", "doc_id", "text_hash", "place", "low", "high"]
        for batch in batches:
            held, size = [], 0
            ids = batch.column(0).to_pylist()
            for d, t in zip(ids, utf8(batch.column(1))):
                if len(t) < length:
                    continue
                h = text_hash(t)
                for x in anchors(t, length):
                    held.append((d, h, x))
                    size += len(x[0])
                if size > 1 << 18:
                    yield _packed(held, names)
                    held, size = [], 0
            if held:
                yield _packed(held, names)

    return run


def _packed(held: list, names: list[str]) -> pa.RecordBatch:
    n = [len(x[0]) for _, _, x in held]
    cols = [np.concatenate([x[k] for _, _, x in held]) for k in range(5)]
    docs = pa.array([d for d, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), n)))
    hashes = np.repeat(np.array([h for _, h, _ in held], np.int64), n)
    return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), docs, pa.array(hashes), *(pa.array(c.astype(np.int64)) for c in cols[2:])], names)


def _segments(length: int):
    """(doc_id, text_hash, text, wanted anchors) to rows of segments as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, h, t, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                for w in wanted:
                    place, low, high = w["place"], w["low"], w["high"]
                    rows.append((t[place : place + LEAD], d, h, place, low, high, w["whole"], w["hot"], t[low:place], t[place : high + length]))
            if rows:
                kinds = [pa.binary(), *[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lead", "doc_id", "text_hash", "place", "low", "high", "whole", "hot", "before", "after"])

    return run


def multikey_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the bytes that each shares with the one before it (0 for the first).

    Multikey quicksort on tokens of 8 bytes: runs that are equal so far are parted by the next token; a run of one
    string is done. All runs of a depth are parted at once.
    """
    n = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    width = max(1, -(-int(size.max(initial=0)) // 8))
    table = np.zeros((n, width * 8), np.uint8)
    for i, s in enumerate(strings):
        table[i, : len(s)] = np.frombuffer(s, np.uint8)
    tokens = table.view(">u8").astype(np.uint64)
    order, run = np.arange(n), np.zeros(n, np.int64)
    shared = np.zeros(n, np.int64)
    live = np.arange(n)  # places whose run has more than one string
    for depth in range(width):
        if len(live) < 2:
            break
        own = order[live]
        key = tokens[own, depth]
        by = np.lexsort((np.minimum(size[own], 8 * depth + 8), key, run[live]))
        own, key = own[by], key[by]
        order[live] = own
        r = run[live]  # unchanged: a run's places are its own
        left = np.minimum(size[own], 8 * depth + 8)
        same_run = np.concatenate(([False], r[1:] == r[:-1]))
        differ = np.concatenate(([True], (key[1:] != key[:-1]) | (left[1:] != left[:-1])))
        new = same_run & differ
        if new.any():
            at = np.flatnonzero(new)
            x = key[at] ^ key[at - 1]
            alike = np.full(len(at), 8, np.int64)
            for byte in range(8):  # the first byte from the left that differs
                alike[(alike == 8) & ((x >> np.uint64(56 - 8 * byte)) & np.uint64(255) != 0)] = byte
            shared[live[at]] = np.minimum(8 * depth + alike, np.minimum(left[at], left[at - 1]))
        starts = ~same_run | differ
        label = live[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        run[live] = label
        begin = np.flatnonzero(starts)
        count = np.diff(np.append(begin, len(live)))
        done = np.repeat((count == 1) | (np.maximum.reduceat(size[own], begin) <= 8 * depth + 8), count)
        ended = np.repeat(count > 1, count) & done & ~starts
        shared[live[ended]] = size[order[live[ended]]]
        live = live[~done]
    return order, shared


def repeated(before: list[bytes], after: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each segment, ranges (lowest, highest) of o such that the window from o bytes before the anchor is another's.

    ``before`` ends at the anchor, ``after`` starts there; both are as long as the segment's own windows need.
    """
    n = len(before)
    order_b, shared_b = multikey_sort([b[::-1] for b in before])
    order_a, shared_a = multikey_sort(after)
    longest = np.array([len(b) for b in before], np.int64)
    least = length - np.array([len(a) for a in after], np.int64)
    # what is shared changes with o only at these values
    end = int(longest.max(initial=-1)) + 1
    stops = np.unique(np.concatenate((shared_b + 1, length - shared_a, least, longest + 1, [end])))
    stops = stops[(stops >= max(0, int(least.min(initial=end)))) & (stops <= end)]
    group_b, group_a = np.empty(n, np.int64), np.empty(n, np.int64)
    hit = np.zeros((len(stops) + 1, n), bool)
    for k, o in enumerate(stops.tolist()):
        own = np.flatnonzero((least <= o) & (o <= longest))
        if len(own) < 2:
            continue
        group_b[order_b] = np.cumsum(shared_b < o)
        group_a[order_a] = np.cumsum(shared_a < length - o)
        back, count = np.unique(group_b[own] * (n + 1) + group_a[own], return_inverse=True, return_counts=True)[1:]
        hit[k, own] = count[back] > 1
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    edge = np.diff(np.concatenate((np.zeros((1, n), np.int8), hit.astype(np.int8))), axis=0).T
    rows, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    for i, a, b in zip(rows.tolist(), stops[first].tolist(), stops[last].tolist()):
        found[i].append((a, b - 1))
    return found


def _bucket(length: int):
    """Rows sorted by lead: start ranges of the windows that other rows of equal lead repeat."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for r, ranges in zip(rows, repeated([x[8] for x in rows], [x[9] for x in rows], length)):
            if not r[6]:  # a segment that is repeated as a whole is known already
                out += [(r[1], r[2], r[3] - b, r[3] - a) for a, b in ranges]
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_hash", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(group) >= BATCH and row[0] != group[-1][0]:
                    yield settle(group)
                    group = []
                group.append(row)
        if len(group) > 1:
            yield settle(group)

    return run


def _window_hashes(length: int):
    """Segments to a 128-bit hash of each of their windows: for grams that are too hot for a bucket, whose windows are
    then counted instead of sorted. (A segment that is repeated as a whole comes once, and is known already.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                _, doc_id, text_hash_, place, low, high, _, _, before, after = row
                data = before + after
                digests = b"".join(hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(high - low + 1))
                n = high - low + 1
                pair = np.frombuffer(digests, "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, text_hash_)), pa.array(np.arange(low, high + 1))], ["one", "two", "doc_id", "text_hash", "start"]
                )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, low, high): ranges of window starts in docs(doc_id, text) that are repeated somewhere."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    found = materialize(rows.mapInArrow(_anchor_rows(length), f"gram long, segment long, {_ROW}, place long, low long, high long"), "anchors")
    one = F.struct("doc_id", "text_hash", "place", "low", "high")
    distinct = materialize(found.groupBy("gram", "segment").agg(F.count("*").alias("n"), F.min(one).alias("one")), "segments")
    # grams with more than one segment, one of which isn't repeated as a whole, are compared by bytes
    open_ = materialize(distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1"), "open")
    # joins are by shuffle at every size, as both sides grow with the corpus
    wanted = distinct.join(open_.select("gram", (F.col("kinds") > HOT_KINDS).alias("hot")).hint("merge"), "gram").select("one.*", (F.col("n") > 1).alias("whole"), "hot")
    listed = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "low", "high", "whole", "hot")).alias("wanted"))
    listed = materialize(listed, "wanted")
    own = _named(rows, membership(listed, "text_hash")).join(listed.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}).hint("merge"), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))
    segments = own.select("doc_id", "text_hash", "text", "wanted").mapInArrow(_segments(length), f"lead binary, {_ROW}, place long, low long, high long, whole boolean, hot boolean, before binary, after binary")
    hot = None
    if open_.where(F.col("kinds") > HOT_KINDS).limit(1).count():
        segments = materialize(segments, "suffixes")
        hashed = materialize(segments.where("hot").mapInArrow(_window_hashes(length), f"one long, two long, {_ROW}, start long"), "windows")
        twice = hashed.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
        hot = hashed.join(twice.hint("merge"), ["one", "two"]).select("doc_id", "text_hash", F.col("start").alias("low"), F.col("start").alias("high"))
    # rows that repeat a document brought its segments more than once
    sorted_ = segments.where("not hot").repartitionByRange("lead").sortWithinPartitions("lead", "text_hash", "doc_id", "place")
    part = sorted_.mapInArrow(_bucket(length), f"{_ROW}, low long, high long")
    part = part if hot is None else part.unionByName(hot)
    whole = found.join(distinct.where("n > 1").select("gram", "segment").hint("merge"), ["gram", "segment"]).select("doc_id", "text_hash", "low", "high")
    return whole.unionByName(part)


def _named(rows: DataFrame, known: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows with their hash: those that the map may hold, or the others."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([text_hash(t) for t in utf8(batch.column(1))], np.int64)
            own = pa.array(np.flatnonzero(member(sent.value, hashes) == inside))
            if len(own):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(hashes).take(own), batch.column(1).take(own)], ["doc_id", "text_hash", "text"])

    return rows.mapInArrow(run, f"{_ROW}, text string")


def removal_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, spans): the byte spans to remove of each text that has any, merged and in order."""
    low_high = repeated_windows(docs, length).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merged([(r["low"], r["high"] + length) for r in x])] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "text_hash", "spans"])

    return low_high.mapInArrow(merge, f"{_ROW}, spans array<struct<a:bigint,b:bigint>>")


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text and spans (null for none) of every row; only texts that may have spans are shuffled."""
    with scratch(docs.sparkSession):
        spans = materialize(removal_spans(docs, length), "spans", result=True).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    known, rows = membership(spans, "h"), docs.select("doc_id", "text")
    some = _named(rows, known).join(spans.hint("merge"), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "spans")
    none = _named(rows, known, False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return some.unionByName(none)


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:a])
        done = b
    return b"".join([*out, text[done:]])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, s in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                spans = [(x["a"], x["b"]) for x in s or ()]
                rows.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(t, spans)).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
