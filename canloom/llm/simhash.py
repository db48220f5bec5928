"""SimHash near-duplicates by pivot distance tables.

Reference fingerprints (pivots) come as pairs r and r^M, where M covers one of ``SEGMENTS`` runs of bits. A
table holds the Hamming distance of every distinct fingerprint to each pivot. As
d(x, r^M) - d(x, r) = |M| - 2 d_M(x, r), the table gives the distances inside each segment, for several r
enough to tell segments apart. Two fingerprints at ``RADIUS`` or fewer bits agree in SEGMENTS - RADIUS
segments, so their coordinates there are equal: candidates are found by equal coordinates of a choice of
segments and by the cell of one whole-word pivot distance (cells overlap by RADIUS, so no pair is parted).
Among candidates, a pair whose coordinates differ by more than RADIUS anywhere is discarded by the triangle
inequality, and survivors are verified by the exact distance.

* Equal fingerprints are one node, so exact copies cost nothing. A node is the smallest doc_id that has it.
* A candidate bucket yields a spanning forest of its links and never its pairs; a large one is parted by further bits.
* Texts without words (null, empty, blanks) have fingerprint zero and link like any other.
* Very long texts: words and shingles of one text are held at a time, and their bits counted ``CHUNK`` at a time. An empty
  table gives an empty result; other columns of docs aren't looked at.
* Rows whose doc_id is null have a fingerprint, take part as the largest id, and get a null component_id if
  nothing with an id is in reach. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize, small_batches, utf8
from canloom.llm.components import Forest, components

RADIUS = 3
SEGMENTS = 5
SHINGLE = 3
#: Pivots for each segment, besides the four that are compared over the whole word.
PIVOTS = 12
CELL = 8
#: Buckets of more fingerprints are parted before their members are compared.
LARGE = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Fingerprints that only rows without a doc_id have are nodes from here on; ids of documents are smaller.
NO_ID = 1 << 62


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits that are set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lower() folds A-Z alone, split() parts at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        return int(hashes[0])
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    return majority(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class PivotTable:
    """Distances to the pivots, whole and by segment."""

    def __init__(self, segments: int = SEGMENTS, radius: int = RADIUS, pivots: int = PIVOTS, seed: int = 7):
        rng = np.random.default_rng(seed)
        cut = np.linspace(0, 64, segments + 1).astype(int)
        self.masks = np.array([sum(1 << b for b in range(a, e)) for a, e in zip(cut, cut[1:])], np.uint64)
        self.widths = np.diff(cut)
        self.base = rng.integers(0, 1 << 64, (segments, pivots), np.uint64)
        # inside a segment, one pivot for each bit but the last tells all values of a parity apart; parity the rest
        for s, (a, e) in enumerate(zip(cut, cut[1:])):
            unit = [np.uint64((int(self.base[s, 0]) ^ (1 << b)) & (2**64 - 1)) for b in range(a, e)]
            row = [self.base[s, 0], *unit]
            self.base[s, : min(pivots, len(row))] = row[:pivots]
        self.whole = rng.integers(0, 1 << 64, 4, np.uint64)
        self.choices = list(combinations(range(segments), segments - radius))

    def coordinates(self, fp: np.ndarray, segment: int) -> np.ndarray:
        """Distances inside the segment, from the distances to each pivot and to its mirror."""
        base = self.base[segment]
        near = np.bitwise_count(fp[:, None] ^ base).astype(np.int64)
        far = np.bitwise_count(fp[:, None] ^ base ^ self.masks[segment]).astype(np.int64)
        return (near - far + int(self.widths[segment])) // 2

    def signature(self, fp: np.ndarray, segment: int) -> np.ndarray:
        """The segment's coordinates as one number."""
        key = np.zeros(len(fp), np.uint64)
        for c in self.coordinates(fp, segment).T:
            key = key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
            key ^= key >> np.uint64(29)
        return key

    def whole_distances(self, fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[:, None] ^ self.whole).astype(np.int16)


def _candidates(table: PivotTable, radius: int):
    """Rows (key, node, fp), one for each choice of segments and each cell that a fingerprint lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            signs = [table.signature(fp, s) for s in range(len(table.masks))]
            d = table.whole_distances(fp)[:, 0].astype(np.int64)
            low, high = d // CELL, (d + radius) // CELL
            for k, choice in enumerate(table.choices):
                key = np.full(len(fp), k + 1, np.uint64)
                for s in choice:
                    key = (key ^ signs[s]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                for cell, own in ((low, np.ones(len(fp), bool)), (high, high > low)):
                    at = (key[own] + cell[own].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                    yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(node[own]), pa.array(fp[own].view(np.int64))], ["key", "node", "fp"])

    return run


def links(node: np.ndarray, fp: np.ndarray, table: PivotTable, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at ``radius`` or fewer bits, by the pivot filter and the exact distance."""
    whole = table.whole_distances(fp)
    order = np.argsort(whole[:, 0], kind="stable")
    node, fp, whole = node[order], fp[order], whole[order]
    left, out = np.arange(len(fp)), []
    while len(left):
        heap, left = [left[0]], left[1:]
        while heap and len(left):
            x = heap.pop()
            first = whole[left, 0]
            a, b = np.searchsorted(first, whole[x, 0] - radius), np.searchsorted(first, whole[x, 0] + radius, "right")
            at = np.arange(a, b)
            at = at[np.abs(whole[left[at]] - whole[x]).max(axis=1, initial=0) <= radius]
            at = at[np.bitwise_count(fp[left[at]] ^ fp[x]) <= radius]
            if len(at):
                out += [(int(node[x]), int(y)) for y in node[left[at]]]
                heap += left[at].tolist()
                left = np.delete(left, at)
    return out


def bucket_links(node: np.ndarray, fp: np.ndarray, table: PivotTable, radius: int = RADIUS) -> list[tuple[int, int]]:
    """``links``; a large bucket is parted first. Where its bits differ at all they are cut into radius + 1 runs, and two
    fingerprints in reach agree in one of them: each run parts the bucket anew, so work doesn't grow with its square."""
    free = np.bitwise_or.reduce(fp ^ fp[0])
    places = np.flatnonzero((free >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    if len(fp) <= LARGE or len(places) <= radius:
        return links(node, fp, table, radius)
    out = []
    for run in np.array_split(places, radius + 1):
        own = fp & np.bitwise_or.reduce(np.uint64(1) << run.astype(np.uint64))
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.diff(own[order])) + 1
        for part in np.split(order, cut):
            if len(part) > 1:
                # at the end of what parting can do, all that is left agrees but for a few bits
                out += links(node[part], fp[part], table, radius) if len(part) == len(fp) else bucket_links(node[part], fp[part], table, radius)
    return out


def _bucket_links(table: PivotTable, radius: int):
    """Rows sorted by key: the forest of each bucket. Holds one bucket of distinct fingerprints at a time."""

    def forests(key: np.ndarray, node: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
        cut = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        pairs = first[last - first == 2]
        pairs = pairs[np.abs(table.whole_distances(fp[pairs]) - table.whole_distances(fp[pairs + 1])).max(axis=1, initial=0) <= radius]
        for x in pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius]:
            forest.join(int(node[x]), int(node[x + 1]))
        for a, b in zip(first[last - first > 2], last[last - first > 2]):
            for x, y in bucket_links(node[a:b], fp[a:b], table, radius):
                forest.join(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest = [np.empty(0, np.int64)] * 3, Forest()
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new)]
            done = int(np.searchsorted(held[0], held[0][-1]))
            if done:
                forests(held[0][:done], held[1][:done], held[2][:done].view(np.uint64), forest)
                held = [x[done:] for x in held]
        if len(held[0]):
            forests(held[0], held[1], held[2].view(np.uint64), forest)
        u = [x for x in forest.up if forest.root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([forest.root(x) for x in u], pa.int64())], ["u", "v"])

    return run


def fingerprint_links(nodes: DataFrame, table: PivotTable, radius: int) -> DataFrame:
    """(u, v): pairs that join all of nodes(node, fp) within reach of each other by links of ``radius`` or fewer bits."""
    keyed = nodes.select("node", "fp").mapInArrow(_candidates(table, radius), "key long, node long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(table, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs(doc_id, text)."""
    table = PivotTable(segments, radius)
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(NO_ID))).alias("node"))
    found = components(fingerprint_links(nodes, table, radius))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id; of rows that repeat it, any one.

    Rows without a doc_id can't be told apart, and stay. The join is by shuffle at every size, as what is kept grows with
    the corpus.
    """
    kept = materialize(near_duplicates(docs).where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    out = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if kept.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of texts at a similarity of 0.8 or more: see ``nearcopies``."""
    from canloom.llm import nearcopies

    return nearcopies.one_of_each(docs)
