"""SimHash near-dedup at a stated similarity: texts whose sets of five words have a Jaccard similarity of 0.8 or more.

First the steps of ``simhash`` as they are, over fingerprints of the sets: candidates by the table of distances to pivots, the
discard by coordinates, the exact distance of ``RADIUS`` bits; what they link is verified by the sets themselves. The same steps
at a wider radius find the rest: at 0.8 fingerprints differ in 10 of 64 bits (in ``WIDE`` or more with a chance below 10**-7), where cells of pivot distances propose next to
all pairs; so blocks propose them: a set's ``BANDS`` keys are each made of ``ROWS`` minima, and two sets at similarity s
share one with 1 - (1 - s**ROWS)**BANDS: all but 7 in 10**10 at 0.8. Each set is compared with the first member of its
blocks that leads most of them. Blocks whose members are not one component after this are settled as a whole, by those
members that ``SHARED`` such blocks hold (similar sets share fewer with a chance of 3 in 10**6 at 0.8): a search over
fingerprints, then sets, compares each pair of members that no link joins yet. So a group of near copies costs a star,
and only what looks alike and isn't is compared pair by pair, in memory. Sets are made from the texts when they are
needed, five bytes a shingle, and go to their leaders in groups of ``FOLLOWERS``, so that a hot leader is many groups.

* Equal sets are one node (the 64-bit hash of the set), so exact copies cost nothing.
* Texts of fewer than ``SHINGLE`` words are one shingle; texts without words (null, empty, blanks) are equal.
* Very long texts have as many shingles as words; minima are taken ``CHUNK`` shingles at a time. Repeated rows share a
  node; an empty table gives an empty result; other columns of docs aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize, member, membership, scratch, small_batches, utf8
from canloom.llm.components import Forest, components
from canloom.llm.simhash import RADIUS, PivotTable, fingerprint_links, majority

SHINGLE = 5
#: Bits that fingerprints of similar sets may differ in.
WIDE = 28
ROWS, BANDS = 4, 40
#: Blocks of several components that an unlinked similar pair shares.
SHARED = 4
#: Bytes kept of a shingle's hash, and sets that are compared with one leader in a task.
KEPT, FOLLOWERS = 5, 1000
#: Shingles whose permuted values are held at once.
CHUNK = 512

_RNG = np.random.default_rng(11)
_MASK = _RNG.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32)
_FACTOR = _RNG.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) | np.uint32(1)


def shingles(text: bytes) -> np.ndarray:
    """XXH64 (seed 42) of the distinct runs of SHINGLE words, sorted; words as in ``simhash.fingerprint``."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - SHINGLE] + 1)).tolist()
    return np.unique(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set, as signed longs."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    low = np.full(ROWS * BANDS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), CHUNK):
        np.minimum(low, ((short[at : at + CHUNK] ^ _MASK) * _FACTOR).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in low.reshape(BANDS, ROWS).T:
        key = (key ^ c) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def similar(shared, a, b):
    """Whether sets of a and b members, ``shared`` of them common, are at 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def packed(own: np.ndarray) -> bytes:
    """The first KEPT bytes of each hash, in order: two texts of 1,000 shingles agree by chance in one with 10**-6."""
    high = np.unique(own >> np.uint64(8 * (8 - KEPT)))
    return high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT)
    return out.view("<u8").ravel()


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def node_of(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return signed(xxh64_intdigest(own.tobytes(), 42))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to node and, for the first row of a node in this partition, its band keys and fingerprint."""
    seen: set[int] = set()
    for batch in batches:
        nodes, keys, ends, there, prints = [], [], [0], [], []
        for t in utf8(batch.column(1)):
            own = shingles(t)
            nodes.append(node_of(own))
            there.append(nodes[-1] not in seen)
            if there[-1]:
                seen.add(nodes[-1])
                keys.append(band_keys(own))
            prints.append(signed(majority(own)) if there[-1] else None)
            ends.append(len(keys) * BANDS)
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([not x for x in there], pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), lists, pa.array(prints, pa.int64())], ["doc_id", "node", "keys", "fp"])


def _sets(wanted):
    """Texts to (node, fp, own) of the nodes that the map may hold, once in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            made = [shingles(t) for t in utf8(batch.column(0))]
            nodes = np.array([node_of(x) for x in made], np.int64)
            out = []
            for n, x, own in zip(nodes.tolist(), made, member(wanted.value, nodes).tolist()):
                if own and n not in seen:
                    seen.add(n)
                    out.append((n, signed(majority(x)), packed(x)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["node", "fp", "own"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) sorted: (key, node, leader) of blocks of several nodes, the first of which leads."""
    last = waiting = leader = None
    for batch in batches:
        rows = []
        for key, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != last:
                last = key
                waiting = leader = node
                continue
            if node == leader:
                continue
            if waiting is not None:
                rows.append((key, leader, leader))
                waiting = None
            rows.append((key, node, leader))
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "node", "leader"])


def similar(shared, a, b):
    """Whether sets of a and b members, ``shared`` of them common, are at 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def near(table: np.ndarray, other: np.ndarray, fp: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether fingerprints may be of similar sets: by the largest coordinate difference, then by the bits that differ."""
    keep = np.abs(table - other).max(axis=-1) <= WIDE
    return keep & (np.bitwise_count(fp ^ of) <= WIDE)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, part, node, fp, own) sorted, a leader's own row before its followers: links of leaders and followers."""
    pivots = PivotTable()
    name, of, fp, table = None, None, None, None
    for batch in batches:
        out = []
        for leader, part, _, node, f, own in zip(*(c.to_pylist() for c in batch.columns)):
            f = np.array([f], np.int64).view(np.uint64)
            if node == leader:
                name, of, fp, table = (leader, part), unpacked(own), f, pivots.whole_distances(f)
            elif (leader, part) == name and near(table, pivots.whole_distances(f), fp, f)[0]:
                x = unpacked(own)
                if similar(min(len(x), len(of)), len(x), len(of)) and similar(len(np.intersect1d(x, of, True)), len(x), len(of)):
                    out.append((leader, node))
        cols = list(zip(*out)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, own, other): the pairs whose sets are similar."""
    for batch in batches:
        pairs = []
        for u, v, own, other in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = unpacked(own), unpacked(other)
            if similar(min(len(x), len(y)), len(x), len(y)) and similar(len(np.intersect1d(x, y, True)), len(x), len(y)):
                pairs.append((u, v))
        cols = list(zip(*pairs)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])


def links(node: list[int], component: list[int], fp: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that join what components of the given nodes touch."""
    size, out = np.array([len(s) for s in sets]), []
    fp = np.array(fp, np.int64).view(np.uint64)
    table = PivotTable().whole_distances(fp)
    left: dict[int, list[int]] = {}
    for i, c in enumerate(component):
        left.setdefault(c, []).append(i)
    while len(left) > 1:
        heap = left.pop(next(iter(left)))
        while heap and left:
            x = heap.pop()
            at = np.array([i for own in left.values() for i in own])
            at = at[similar(np.minimum(size[at], size[x]), size[at], size[x]) & near(table[at], table[x], fp[at], fp[x])]
            if not len(at):
                continue
            line = np.concatenate([sets[i] for i in at])
            place = np.minimum(np.searchsorted(sets[x], line), size[x] - 1)
            shared = np.add.reduceat((sets[x][place] == line).astype(np.int64), np.cumsum(size[at]) - size[at])
            for y in at[similar(shared, size[at], size[x])].tolist():
                if component[y] in left:
                    out.append((node[x], node[y]))
                    heap += left.pop(component[y])
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, component, fp, own) sorted by key: links of each block. Holds one block at a time."""
    forest = Forest()
    name, held = None, ([], [], [], [])

    def settle() -> None:
        for u, v in links(*held):
            forest.join(u, v)

    for batch in batches:
        for key, node, component, fp, own in zip(*(c.to_pylist() for c in batch.columns)):
            if key != name:
                settle()
                name, held = key, ([], [], [], [])
            for part, x in zip(held, (node, component, fp, unpacked(own))):
                part.append(x)
    settle()
    u = [x for x in forest.up if forest.root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([forest.root(x) for x in u], pa.int64())], ["u", "v"])


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component of every row of docs(doc_id, text); a component is named by one of its nodes."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_named, "doc_id long, node long, keys array<long>, fp long"), "bands")
    # what fingerprints tell: pairs within RADIUS bits, by the pivots
    prints = rows.where("keys is not null").select("node", "fp").distinct()
    close = materialize(fingerprint_links(prints, PivotTable(), RADIUS).distinct(), "close", narrow=True)
    # a node's keys come once from each partition that has it; its row repeats in a block and is dropped there
    keyed = rows.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    blocks = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_blocks, "key long, node long, leader long")
    blocks = materialize(blocks, "blocks", narrow=True)
    pairs = blocks.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    best = materialize(pairs.groupBy("node").agg(F.max(F.struct("n", (-F.col("leader")).alias("less"), "leader")).alias("m")).select("node", "m.leader"), "stars", narrow=True)
    every = blocks.select("node").unionByName(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = spark.sparkContext.broadcast(membership(every, "node"))
    sets = docs.select("text").mapInArrow(_sets(wanted), "node long, fp long, own binary")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    groups = F.ceil(F.count("*") / FOLLOWERS).cast("long").alias("parts")
    leaders = best.groupBy("leader").agg(groups)
    # a leader's row for each of its groups, and each follower in one
    own = leaders.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("follows"))
    following = best.join(leaders, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(1).alias("follows"))
    dealt = own.unionByName(following).join(sets, "node").select("leader", "part", "follows", "node", "fp", "own")
    dealt = dealt.repartition("leader", "part").sortWithinPartitions("leader", "part", "follows")
    side = lambda c, own: sets.select(F.col("node").alias(c), F.col("own").alias(own))
    told = close.join(side("u", "own"), "u").join(side("v", "other"), "v").select("u", "v", "own", "other").mapInArrow(_agreed, "u long, v long")
    edges = materialize(dealt.mapInArrow(_verified, "u long, v long").unionByName(told), "links", narrow=True)
    found = components(edges)
    named = materialize(blocks.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "named", narrow=True)
    left = named
    for _ in range(2):  # what the first sieve takes out may leave blocks of one component
        several = left.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        left = left.join(several, "key")
        left = materialize(left.join(left.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("node"), "node").select("key", "node", "component"), "open", narrow=True)
    # of blocks with equal members one is enough
    alike = left.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    one = alike.where("least < most").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    whole = left.join(one, "key").join(sets, "node").select("key", "node", "component", "fp", "own")
    more = whole.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_settled, "u long, v long")
    found = components(edges.unionByName(materialize(more, "more", narrow=True)))
    return rows.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id; of rows that repeat it, any one.

    Rows without a doc_id can't be told apart, and stay. The join is by shuffle at every size, as what is kept grows with
    the corpus.
    """
    with scratch(docs.sparkSession):
        named = materialize(near_copies(docs), "components", result=True)
    least = named.groupBy("component").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    kept = materialize(least.select("doc_id").distinct(), "kept")
    out = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    if named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))
