"""A measurement folder as one MDF file: signal groups, raw groups, then the statistics.

Two passes. Tasks deflate the records of each group in stretches of the log and leave them as blocks; only their sizes come to
the driver. With these, the addresses of all blocks are a running sum, and tasks put each block in its place.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.functions.shared import new_folder
from canloom.functions.tables import local
from canloom.operators import sink
from canloom.sources import mdf

_DTYPES = {"f64": "<f8", **{f"{s}{n}": f"<{s}{n // 8}" for s in "ui" for n in (8, 16, 32, 64)}}
#: Frames of a log that lie in one stretch: a block has at most as many records.
STRETCH = 1 << 17
BLOCKS = "number int, stretch long, n long, raw long, block binary"


def _block(number: int, stretch: int, group: mdf.Group) -> pa.Table:
    records = mdf.records(group)
    columns = [pa.array([number], pa.int32()), *(pa.array([x], pa.int64()) for x in (stretch, len(records), records.nbytes)), pa.array([mdf.deflated(records)], pa.binary())]
    return pa.table(columns, ["number", "stretch", "n", "raw", "block"])


def _in_stretches(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return rows.withColumn("stretch", F.expr(f"seq div {STRETCH}")).groupBy(*keys, "stretch").applyInArrow(run, BLOCKS)


def _signals(spark: SparkSession, folder: str, groups: list[dict], first: int) -> tuple[list[mdf.Group], DataFrame]:
    """Groups of signals without their samples, and the blocks of their records; the groups are numbered from ``first``."""
    meta: dict[int, list] = {}
    for r in spark.read.parquet(f"{folder}/channels").orderBy("position").collect():
        meta.setdefault(r.group_ordinal, []).append(r)
    bare, kinds = [], {}
    for i, g in enumerate(groups):
        own = meta.get(g["group_ordinal"], [])
        kinds[g["channel"], g["group_ordinal"]] = first + i, [(m.position, _DTYPES[m.dtype]) for m in own]
        about = [(m, m.scale != 1 or m.offset != 0) for m in own]
        bare.append(mdf.Group(g["group_name"], np.empty(0), [mdf.Channel(m.signal, np.empty(0, _DTYPES[m.dtype]), m.unit, m.scale, m.offset, dict(m.choices or {}) if m.kind == "enum" else {}, m.unit if scaled else "") for m, scaled in about]))

    def run(table: pa.Table) -> pa.Table:
        number, own = kinds[table.column("channel")[0].as_py(), table.column("group_ordinal")[0].as_py()]
        table = table.sort_by([("ordinal", "ascending"), ("seq", "ascending")])
        ordinal, ts, bits, value = (table.column(c).to_numpy() for c in ("ordinal", "ts", "bits", "value"))
        channels, times = [], np.empty(0)
        for position, kind in own:
            at = slice(*np.searchsorted(ordinal, [position, position + 1]))
            times = ts[at]
            x = value[at].astype(kind) if kind == "<f8" else bits[at].view("<u8" if kind[1] == "u" else "<i8").astype(kind)
            channels.append(mdf.Channel("", x))
        return _block(number, table.column("stretch")[0].as_py(), mdf.Group("", times, channels))

    samples = spark.read.parquet(f"{folder}/samples").select("channel", "group_ordinal", "ordinal", "seq", "ts", "bits", "value")
    return bare, _in_stretches(samples, ["channel", "group_ordinal"], run)


def _raw(spark: SparkSession, folder: str, names: list[str], first: int) -> tuple[list[mdf.Group], DataFrame]:
    rows = spark.read.parquet(f"{folder}/raw").select("channel", "seq", "ts", "id", "dlc", "data", "is_extended", "is_fd")
    width = dict(rows.groupBy("channel").agg(F.max(F.length("data"))).collect())
    numbers = {int(name.removeprefix("Raw::CAN")): first + i for i, name in enumerate(names)}

    def group(name: str, ts: np.ndarray, numbers: list[np.ndarray], data: np.ndarray) -> mdf.Group:
        arb, dlc, extended, fd = (x.astype(k) for x, k in zip(numbers, ("<u4", "u1", "u1", "u1")))
        return mdf.Group(name, ts, [mdf.Channel("ID", arb), mdf.Channel("DLC", dlc), mdf.Channel("Data", data), mdf.Channel("IsExtended", extended), mdf.Channel("IsFD", fd)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        col = lambda c: table.column(c).to_numpy()
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return _block(numbers[col("channel")[0]], int(col("stretch")[0]), group("", col("ts"), [col(c) for c in ("id", "dlc", "is_extended", "is_fd")], data))

    bare = [group(name, np.empty(0), [np.empty(0, "<u4")] * 4, np.empty((0, width[c]), np.uint8)) for name, c in zip(names, numbers)]
    return bare, _in_stretches(rows, ["channel"], run)


def _statistics(spark: SparkSession, folder: str, first: int) -> tuple[list[mdf.Group], DataFrame]:
    rows = spark.read.parquet(f"{folder}/stats").select("channel", "item_ordinal", "item", F.col("k").cast("long").alias("seq"), "t", "value")
    items = rows.select("channel", "item_ordinal", "item").distinct().orderBy("channel", "item_ordinal").collect()
    numbers = {(r.channel, r.item_ordinal): first + i for i, r in enumerate(items)}
    kind = lambda item: "<f8" if item.endswith("Rate") else "<i4"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        channel, ordinal, item, stretch = (table.column(c)[0].as_py() for c in ("channel", "item_ordinal", "item", "stretch"))
        return _block(numbers[channel, ordinal], stretch, mdf.Group("", table.column("t").to_numpy(), [mdf.Channel("", table.column("value").to_numpy().astype("<f8" if item.endswith("Rate") else "<i4"))]))

    bare = [mdf.Group("1s", np.empty(0), [mdf.Channel(r.item, np.empty(0, kind(r.item)))]) for r in items]
    return bare, _in_stretches(rows, ["channel", "item_ordinal"], run)


def _write(spark: SparkSession, folder: str, path: str) -> None:
    manifest = sink.read_manifest(spark, folder)
    bare: list[mdf.Group] = []
    parts: list[DataFrame] = []
    for there, make in (
        (manifest["groups"], lambda: _signals(spark, folder, manifest["groups"], len(bare))),
        (manifest["raw_groups"], lambda: _raw(spark, folder, manifest["raw_groups"], len(bare))),
        (manifest["stats_groups"], lambda: _statistics(spark, folder, len(bare))),
    ):
        if there:
            groups, blocks = make()
            bare += groups
            parts.append(blocks)
    held = new_folder(spark, "mdf")
    try:
        rows = []
        if parts:
            reduce(DataFrame.unionByName, parts).write.parquet(held)
            blocks = spark.read.parquet(held)
            rows = blocks.select("number", "stretch", "n", "raw", F.length("block").alias("size")).orderBy("number", "stretch").collect()
        end, placed = _addresses(manifest["start_ns"], bare, rows, path)
        if rows:
            written = blocks.join(F.broadcast(local(spark, placed, "number int, stretch long, at long")), ["number", "stretch"]).select("at", "block").mapInArrow(_putter(path), "n long").agg(F.sum("n")).first()[0]
            if written != sum(r.size for r in rows) or os.path.getsize(path) != end:
                raise OSError(f"{written} bytes of records were written, and the file has {os.path.getsize(path)} of {end}")
    finally:
        sink.Folder(spark, held).delete()


def _addresses(start_ns: int, bare: list[mdf.Group], rows: list, path: str) -> tuple[int, list[tuple[int, int, int]]]:
    """Write all but records, whose blocks follow; the file's end and the place of each block.

    How long the first part is doesn't depend on the addresses in it, so it is laid out once without them.
    """
    own: dict[int, list] = {i: [] for i in range(len(bare))}
    for r in rows:
        own[r.number].append(r)

    def lay(stream: io.BufferedIOBase, at: dict[tuple[int, int], int]) -> int:
        groups = ((g, sum(r.n for r in own[i]), lambda f, i=i: mdf.listed(f, [(at.get((i, r.stretch), 0), r.raw) for r in own[i]])) for i, g in enumerate(bare))
        mdf.write_blocks(stream, start_ns, groups)
        return stream.seek(0, os.SEEK_END)

    end, at = lay(io.BytesIO(), {}), {}
    for r in rows:
        at[r.number, r.stretch] = end
        end += r.size
    with open(path, "w+b") as stream:
        lay(stream, at)
        stream.truncate(end)
    return end, [(*k, v) for k, v in at.items()]


def _putter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts blocks at their places; a task that runs again writes the same bytes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as stream:
            for batch in batches:
                for at, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    stream.seek(at)
                    stream.write(block.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.as_buffer()) for x in batch.column(1))], pa.int64())], ["n"])

    return run


def write_mdf(spark: SparkSession, folder: str, out: str) -> None:
    """Write the file beside its place and move it there; a failure leaves what was there and nothing else.

    ``out`` is a path that the driver and all executors see.
    """
    made, at = [], os.path.dirname(os.path.abspath(out))
    while not os.path.exists(at):
        made.append(at)
        at = os.path.dirname(at)
    part = f"{out}.part-{uuid.uuid4().hex[:8]}"
    try:
        os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
        _write(spark, folder, os.path.abspath(part))
        os.replace(part, out)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        for d in made:
            if os.path.isdir(d) and not os.listdir(d):
                os.rmdir(d)
        raise
