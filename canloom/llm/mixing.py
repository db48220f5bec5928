"""Mixing sources to target weights by pivotal dependent rounding.

Sources by code point, null last, weigh 5, 2, 1 in turn and share all words; no target exceeds ``MOST`` times its
source's words, and the excess is shared again by weight. A document is to be taken target / source words times:
the whole part for sure, the fraction by rounding. Fractions are settled from the largest document to the smallest: a
document is paired with the pool of all smaller ones, and words move between the two at random, without bias, until the
document is integral (or the pool is). So a source's taken words stay equal to its target until one fraction is left, a
small document's, which is rounded by itself.

Rounding runs as a reduction tree: leaves of about ``LEAF`` documents (by a hash of doc_id and text, so that a hot source
has many), whose one residual each meets ``FAN`` - 1 others a level higher. Random numbers come from the seed and
the doc_ids, and leaves don't depend on partitions: reruns agree.

* size is the number of words ``[^\\x20\\x09-\\x0D]+``; null has none, and texts without words are taken 0 times. Of a
  very long text only its number of words and its hash leave the scan.
* Repeated rows are documents of their own; where a row repeats more than ``LEAF`` times, its copies are dealt to leaves
  by their place in the input. An empty table, or one without words, gives targets of 0.
* Sources may be many: they are ranked by range partitions, and the level at which targets meet is found by sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canloom.llm.common import fresh_name, materialize, small_batches

WEIGHTS = (5, 2, 1)
MOST = 3
LEAF, FAN = 2000, 64
#: Source tables up to so many rows are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 50_000
TINY = 1e-9


def ranked(by: DataFrame) -> DataFrame:
    """Distinct sources with a column more, their place (from 0) by code point, null last."""
    order = F.col("source").asc_nulls_last()
    parts = materialize(by.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect())  # one row for each partition
    first, at = {}, 0
    for part, n in sizes:
        first[part], at = at, at + n
    if not first:
        return parts.withColumn("place", F.lit(0).cast("long")).drop("part")
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in first.items() for x in pair)), F.col("part").cast("long"))
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset).drop("part")


def targets(sized: DataFrame) -> DataFrame:
    """source, n_docs, source_size and target of each source of sized(source, size)."""
    by = sized.groupBy("source").agg(F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int") + 1).cast("double")
    out = ranked(by).withColumn("weight", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    out = materialize(out.select("source", "n_docs", "source_size", "weight", "cap"), "weights", narrow=True)
    # words for each weight: raised until no source more is full
    level, full = 0.0, -1
    while True:
        below = F.col("cap") <= F.col("weight") * level
        r = out.agg(F.sum("cap").alias("cap"), F.sum(F.when(below, F.col("cap"))).alias("held"), F.sum(F.when(~below, F.col("weight"))).alias("open"), F.count(F.when(below, 1)).alias("full")).first()
        if r.full == full or not r.open:
            break
        level, full = ((r.cap or 0.0) / MOST - (r.held or 0.0)) / r.open, r.full
    return out.select("source", "n_docs", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _uniform(seed: int, a: object, b: object) -> float:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{seed}|{a}|{b}".encode()) / 2.0**64


def round_group(rows: list[tuple[object, int, float]], seed: int, last: bool) -> tuple[list[float], int | None]:
    """Fractions of rows (doc_id, size, fraction), largest sizes first, after all trades; the place of the one left fractional."""
    p = [x[2] if TINY < x[2] < 1 - TINY else float(x[2] > 0.5) for x in rows]
    own = [j for j in range(len(rows)) if 0 < p[j] < 1]
    # sums over the pool, the rows behind: sizes, and sizes times the fractions that they came with
    sizes, words = [0.0] * (len(own) + 1), [0.0] * (len(own) + 1)
    for k in range(len(own) - 1, -1, -1):
        sizes[k] = sizes[k + 1] + rows[own[k]][1]
        words[k] = words[k + 1] + rows[own[k]][1] * p[own[k]]
    # trades change all fractions of a pool alike: what came as f is now scale * f + shift
    scale, shift, held = 1.0, 0.0, None
    for k, j in enumerate(own):
        size = rows[j][1]
        f = min(1.0, max(0.0, scale * p[j] + shift))
        if f <= TINY or f >= 1 - TINY:
            p[j] = float(f > 0.5)
            continue
        if held is not None:  # a larger one has settled this pool already
            p[j] = float(f > 0.5)
            continue
        there = scale * words[k + 1] + shift * sizes[k + 1]
        room = sizes[k + 1] - there
        up, down = min((1 - f) * size, there), min(f * size, room)
        if up <= TINY and down <= TINY:
            p[j], held = f, j
            continue
        rises = _uniform(seed, rows[j][0], k) * (up + down) < down
        f += (up if rises else -down) / size
        if rises:
            scale, shift = scale * (1 - up / there), shift * (1 - up / there)
        else:
            give = down / room
            scale, shift = scale * (1 - give), shift * (1 - give) + give
        if f <= TINY or f >= 1 - TINY:
            p[j] = float(f > 0.5)
        else:
            p[j], held = f, j
    if held is not None and last:
        p[held] = float(_uniform(seed, rows[held][0], "last") < p[held])
        held = None
    return p, held


def _rounder(seed: int, last: bool):
    """Rows (source, leaf, doc_id, size, p, rest) sorted by leaf: p decided or, with left = true, still fractional."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            p, held = round_group([(x[2], x[3], x[4]) for x in group], seed, last)
            cols = list(zip(*group))
            cols[4] = p
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, schema)), pa.array([k == held for k in range(len(p))])], [*schema.names, "left"])

        group: list[tuple] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:2] != group[0][:2]:
                    yield from done(group)
                    group = []
                group.append(row)
        if group:
            yield from done(group)

    return run


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = materialize(docs.select("doc_id", "source", words.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("mark")), "sizes")
    goal = materialize(targets(sized), "targets", narrow=True)
    n, most = goal.agg(F.count("*"), F.max("n_docs")).first()
    small = F.broadcast(goal) if n <= BROADCAST_ROWS else goal
    joined = sized.withColumnRenamed("source", "own").join(small, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    many = sized.groupBy("mark").count().where(F.col("count") > LEAF).select("mark")
    if many.limit(1).count():
        hot = materialize(many.withColumn("again", F.lit(True)), "repeated")
        place = F.xxhash64("mark", F.monotonically_increasing_id())
        spread = sized.withColumn("place", place).join(hot.hint("merge"), "mark", "left")
        sized = materialize(spread.withColumn("mark", F.when(F.col("again"), F.col("place")).otherwise(F.col("mark"))).select("doc_id", "source", "size", "mark"), "sizes")
        joined = sized.withColumnRenamed("source", "own").join(small, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    leaf = F.pmod(F.col("mark"), F.greatest(F.ceil(F.col("n_docs") / LEAF), F.lit(1)))
    rows = joined.select("source", leaf.cast("long").alias("leaf"), "doc_id", "size", (copies - F.floor(copies)).alias("p"), F.floor(copies).cast("long").alias("whole"), "source_size", "target")
    leaves, decided = max(1, -(-(most or 0) // LEAF)), []
    while True:
        last = leaves <= 1
        dealt = rows.repartition("source", "leaf").sortWithinPartitions("source", "leaf", F.desc("size"), "doc_id", "p")
        rounded = materialize(dealt.mapInArrow(_rounder(seed, last), rows.schema.simpleString()[7:-1].replace(":", " ") + ", left boolean"), "rounded", narrow=True)
        decided.append(rounded.where("not left"))
        if last:
            break
        rows = rounded.where("left").drop("left").withColumn("leaf", F.expr(f"leaf div {FAN}"))
        leaves = -(-leaves // FAN)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    total = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", total.alias("copies"), (total * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken (renamed if docs has them).

    Rows are told apart by doc_id; rows that repeat one share its number of copies (the largest).
    """
    plan = mix(docs, seed).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target", "copies", "taken")))
    names = {c: fresh_name(docs, c) for c in plan.columns[1:]}
    key = fresh_name(docs, "mixed_id")
    plan = plan.where("copies > 0").withColumnsRenamed({"doc_id": key, **names})
    # by shuffle at every size, as the plan grows with the corpus
    return docs.join(plan.hint("merge"), docs["doc_id"].eqNullSafe(plan[key])).drop(key)
