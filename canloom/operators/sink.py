"""The measurement sink: a folder of Parquet tables with what a measurement file says about its groups.

    samples/      group_ordinal, group_name, channel, signal, seq, ts, bits, value; partitioned by channel
    raw/          frames of unbound channels, data padded to the channel's longest
    stats/        the ten items of each of 16 channels
    channels/     one row for each signal: unit, storage type, kind, place
    conversions/  value tables
    summary/      the accounting of each channel
    manifest.json start time, groups in order, versions

A fleet of logs has one such folder (``FleetMeasurement``), whose tables carry the column log, with the tables logs and groups
in place of the manifest: neither plans nor files multiply with the number of logs.

All is written to a folder beside the target and moved into place at the end. If anything fails, that folder and parent
folders made for it go, and a measurement that was there stays as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.functions import timegrid
from canloom.model import Catalog
from canloom.operators import decode, stats
from canloom.operators import frames as fr
from canloom.sources import dbc

MANIFEST = "manifest.json"
FORMAT = 1


class Folder:
    """A path on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def missing_parents(self) -> list[Any]:
        out, at = [], self.path.getParent()
        while at is not None and not self.fs.exists(at):
            out.append(at)
            at = at.getParent()
        return out

    def move(self, to: Folder) -> None:
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"can't move {self.path} to {to.path}")

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def write_text(self, text: str) -> None:
        out = self.fs.create(self.path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_head(self, n: int) -> bytes:
        """The first n bytes, or all if there are fewer."""
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def read_text(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def replacing(spark: SparkSession, out: str, write: Callable[[str], Any]) -> Any:
    """Call write(folder) and put what it wrote at ``out``: all of it, or nothing is changed."""
    out = out.rstrip("/")
    mark = uuid.uuid4().hex[:8]
    target, staged, old = (Folder(spark, p) for p in (out, f"{out}.part-{mark}", f"{out}.old-{mark}"))
    made = target.missing_parents()
    try:
        result = write(f"{out}.part-{mark}")
        if target.exists():
            target.move(old)
        try:
            staged.move(target)
        except BaseException:
            if old.exists():
                old.move(target)
            raise
        old.delete()
        return result
    except BaseException:
        staged.delete()
        for folder in made:  # innermost first; only empty ones go
            if target.fs.exists(folder) and not target.fs.listStatus(folder):
                target.fs.delete(folder, False)
        raise


def channel_rows(catalogs: list[Catalog], groups: list[dict]) -> list[tuple]:
    by = {c.path: c for c in catalogs}
    out = []
    for g in groups:
        for i, s in enumerate(by[g["dbc"]].messages[g["arb_norm"]].signals):
            out.append((g["group_ordinal"], g["group_name"], g["channel"], s.name, i, s.unit, s.ref_dtype, s.spark_type.simpleString(), s.kind, s.scale, s.offset, s.choices or None))
    return out


CHANNEL_COLUMNS = "group_ordinal int, group_name string, channel int, signal string, position int, unit string, dtype string, spark_type string, kind string, scale double, offset double, choices map<bigint,string>"


class Measurement:
    """The tables of one measurement in the making: frames are labelled, their series written, and all else follows.

    Frames are read three times: for the series, for the samples, for the statistics (raw frames are a fourth)."""

    def __init__(self, folder: str, frames: DataFrame, bindings: DataFrame, catalogs: list[Catalog]):
        self.spark, self.folder, self.frames, self.bindings, self.catalogs = frames.sparkSession, folder, frames, bindings, catalogs
        self.messages, self.plan = dbc.messages_table(self.spark, catalogs), decode.plan_table(self.spark, catalogs)
        self.labelled = fr.labelled(frames, bindings, self.messages)
        muxed = any(m.selector for c in catalogs for m in c.messages.values())
        found = fr.series(decode.routed_frames(self.labelled, self.plan) if muxed else self.labelled)
        self.series = self._written(found.coalesce(1), "_series")
        named = fr.group_names(fr.series_groups(self.series))
        self.groups = [
            {"group_ordinal": i, "group_name": r.group_name, "channel": r.channel, "arb_norm": r.arb_norm, "message_name": r.message_name, "dbc": r.dbc, "n_frames": r.n_frames, "first_ts": r.first_ts, "last_ts": r.last_ts, "on_grid": r.on_grid}
            for i, r in enumerate(named.orderBy("channel", "series_order").collect())  # one row for each channel and message
        ]
        self.raw_channels: list[dict] = []

    def _put(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self._put(df, name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def samples(self) -> None:
        own = local(self.spark, [(g["group_ordinal"], g["group_name"], g["channel"], g["arb_norm"], g["on_grid"]) for g in self.groups], "group_ordinal int, group_name string, channel int, arb_norm long, on_grid boolean")
        decoded = decode.long(self.labelled, self.plan, routed=True).join(fr.small(own), ["channel", "arb_norm"])
        ts = F.when(F.col("on_grid"), timegrid.on_grid(F.col("ts"))).otherwise(F.col("ts"))
        self._put(decoded.select("group_ordinal", "group_name", "channel", F.col("signal_name").alias("signal"), "ordinal", "seq", ts.alias("ts"), "bits", F.col("phys").alias("value"), "active"), "samples", "channel")

    def describe(self) -> None:
        self._put(local(self.spark, channel_rows(self.catalogs, self.groups), CHANNEL_COLUMNS), "channels")
        self._put(decode.conversions(dbc.signals_table(self.spark, self.catalogs)), "conversions")

    def exported(self) -> DataFrame:
        return fr.exported_series(self.series, self.bindings, self.messages)

    def raw(self) -> None:
        exported = self.exported().where("exported")
        facts = exported.groupBy("channel").agg(F.max("longest").alias("width"), (F.max("off") <= timegrid.TOLERANCE_MS).alias("on_grid"), F.min_by("first_ts", "first_seq").alias("first_ts"), F.max_by("last_ts", "last_seq").alias("last_ts"))
        self.raw_channels = [r.asDict() for r in facts.orderBy("channel").collect()]
        marks = local(self.spark, [(r["channel"], r["width"], r["on_grid"]) for r in self.raw_channels], "channel int, width int, on_grid boolean")
        own = self.labelled.join(fr.small(exported.select("channel", "arb_norm").distinct()), ["channel", "arb_norm"], "left_semi").join(F.broadcast(marks.select("channel", "on_grid")), "channel")
        on = own.withColumn("ts", F.when(F.col("on_grid"), timegrid.on_grid(F.col("ts"))).otherwise(F.col("ts"))).withColumn("exported", F.lit(True))
        self._put(fr.raw_groups(on, marks.select("channel", "width")), "raw", "channel")

    def summary(self, raw: bool) -> None:
        sizes = local(self.spark, [(c.path, m.arb_norm, len(m.signals)) for c in self.catalogs for m in c.messages.values()], "dbc string, arb_norm long, n_signals long")
        self._put(fr.series_summary(self.series, self.bindings, sizes, self.exported() if raw else None).coalesce(1), "summary")

    def statistics(self, global_end: float) -> None:
        self._put(stats.items(stats.bus_statistics(self.frames, global_end)).coalesce(1), "stats")

    def manifest(self, start_ns: int, statistics: bool) -> None:
        about = {"format": FORMAT, "start_ns": start_ns, "master": "t", "groups": self.groups, "raw_groups": [f"Raw::CAN{r['channel']}" for r in self.raw_channels], "stats_groups": 160 if statistics else 0}
        Folder(self.spark, f"{self.folder}/{MANIFEST}").write_text(json.dumps(about, ensure_ascii=False, indent=1))
        Folder(self.spark, f"{self.folder}/_series").delete()


class FleetMeasurement:
    """The tables of the measurements of many logs in the making, in one plan each: frames(log, ...), logs(log, file, start_ns, max_obj_ns).

    What ``Measurement`` gathers about a log on the driver, its groups, stays a table here."""

    def __init__(self, folder: str, frames: DataFrame, logs: DataFrame, bindings: DataFrame, catalogs: list[Catalog]):
        self.spark, self.folder, self.frames, self.logs, self.bindings, self.catalogs = frames.sparkSession, folder, frames, logs, bindings, catalogs
        self.messages, self.plan = dbc.messages_table(self.spark, catalogs), decode.plan_table(self.spark, catalogs)
        self.labelled = fr.labelled(frames, bindings, self.messages)
        muxed = any(m.selector for c in catalogs for m in c.messages.values())
        self.series = self._written(fr.series(decode.routed_frames(self.labelled, self.plan) if muxed else self.labelled, "log"), "_series")
        named = fr.group_names(fr.series_groups(self.series, "log"), "log")
        ordinal = (F.row_number().over(Window.partitionBy("log").orderBy("channel", "series_order")) - 1).alias("group_ordinal")
        self.groups = self._written(named.select("log", ordinal, "group_name", "channel", "arb_norm", "message_name", "dbc", "n_frames", "first_ts", "last_ts", "on_grid"), "groups")

    def _put(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self._put(df, name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def samples(self) -> None:
        own = self.groups.select("log", "group_ordinal", "group_name", "channel", "arb_norm", "on_grid")
        decoded = decode.long(self.labelled, self.plan, "log", routed=True).join(fr.small(own), ["log", "channel", "arb_norm"])
        ts = F.when(F.col("on_grid"), timegrid.on_grid(F.col("ts"))).otherwise(F.col("ts"))
        self._put(decoded.select("log", "group_ordinal", "group_name", "channel", F.col("signal_name").alias("signal"), "ordinal", "seq", ts.alias("ts"), "bits", F.col("phys").alias("value"), "active"), "samples", "channel")

    def describe(self) -> None:
        rows = [(c.path, m.arb_norm, s.name, i, s.unit, s.ref_dtype, s.spark_type.simpleString(), s.kind, s.scale, s.offset, s.choices or None) for c in self.catalogs for m in c.messages.values() for i, s in enumerate(m.signals)]
        signals = local(self.spark, rows, "dbc string, arb_norm long, " + CHANNEL_COLUMNS.split("channel int, ", 1)[1])
        own = self.groups.select("log", "group_ordinal", "group_name", "channel", "dbc", "arb_norm").join(fr.small(signals), ["dbc", "arb_norm"])
        self._put(own.drop("dbc", "arb_norm"), "channels")
        self._put(decode.conversions(dbc.signals_table(self.spark, self.catalogs)), "conversions")

    def summary(self) -> None:
        sizes = local(self.spark, [(c.path, m.arb_norm, len(m.signals)) for c in self.catalogs for m in c.messages.values()], "dbc string, arb_norm long, n_signals long")
        self._put(fr.series_summary(self.series, self.bindings, sizes, logs=self.logs), "summary")

    def statistics(self) -> None:
        ends = self.logs.select(F.col("log").alias("file"), timegrid.to_seconds(F.col("max_obj_ns")).alias("global_end"))
        made = stats.fleet_statistics(self.frames.drop("file").withColumnRenamed("log", "file"), ends).withColumnRenamed("file", "log")
        self._put(made, "stats")


def together(spark: SparkSession, work: list[Callable[[], None]]) -> None:
    """Independent jobs over the same frames; threads keep the caller's job tags."""
    with ThreadPoolExecutor(len(work)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]:
            done.result()


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(Folder(spark, f"{folder}/{MANIFEST}").read_text())


#: Signals of a group of raw frames: name, column of ``raw``, storage.
RAW_SIGNALS = (("ID", "id", "u32"), ("DLC", "dlc", "u8"), ("Data", "data", "bytes"), ("IsExtended", "is_extended", "u8"), ("IsFD", "is_fd", "u8"))


def _raw_groups(spark: SparkSession, folder: str) -> DataFrame | None:
    """group_ordinal and group_name of raw groups, which follow those of signals."""
    m = read_manifest(spark, folder)
    rows = [(len(m["groups"]) + i, name) for i, name in enumerate(m["raw_groups"])]
    return local(spark, rows, "group_ordinal int, group_name string") if rows else None


#: Frame numbers that are counted together: what numbers the samples of a signal is split by it.
BLOCK = 1 << 20


def placed(samples: DataFrame, keys: list[str]) -> DataFrame:
    """seq as the place within the series (``keys``), from 0. Blocks of a series are numbered by themselves, and begin behind
    the ones before them, so that a long series isn't sorted by one task."""
    own = samples.withColumn("_block", F.floor(F.col("seq") / BLOCK))
    by = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy(*keys, "_block").count().select(*keys, "_block", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("seq")) - 1
    return own.join(before, [*keys, "_block"]).withColumn("seq", F.col("_before") + place).select(*samples.columns)


def read_samples(spark: SparkSession, folder: str, places: bool = False) -> DataFrame:
    """Samples as the cross-checks take them, raw frames among them; bytes are text, as hex digits. seq is the number of the
    frame in the log, or the place in the group (``places``), which is what files know."""
    kinds = fr.small(spark.read.parquet(f"{folder}/channels").select("group_ordinal", "signal", "dtype"))
    own = spark.read.parquet(f"{folder}/samples").join(kinds, ["group_ordinal", "signal"])
    out = own.select("group_ordinal", "group_name", "signal", "seq", "ts", "value", F.lit(None).cast("string").alias("text"), "dtype")
    groups = _raw_groups(spark, folder)
    if groups is not None:
        raw = spark.read.parquet(f"{folder}/raw").join(F.broadcast(groups), "group_name")
        each = F.array(*(F.struct(F.lit(n).alias("signal"), (F.lit(None).cast("double") if k == "bytes" else F.col(c).cast("double")).alias("value"), (F.hex(c) if k == "bytes" else F.lit(None)).cast("string").alias("text"), F.lit(k).alias("dtype")) for n, c, k in RAW_SIGNALS))
        out = out.unionByName(raw.select("group_ordinal", "group_name", "seq", "ts", F.inline(each)))
    return placed(out, ["group_ordinal", "signal"]) if places else out


#: Parts the number of a log from a name within it.
PART = "\x1e"


def of_log(df: DataFrame) -> DataFrame:
    """A fleet's table as one measurement's: groups and signals of each log have names and numbers of their own, so that what
    compares two measurements compares each log of two fleets by itself."""
    within = lambda c: F.concat(F.col("log").cast("string"), F.lit(PART), c).alias(c)
    number = (F.shiftleft(F.col("log").cast("long"), 32) + F.col("group_ordinal")).alias("group_ordinal")
    return df.select(number, within("group_name"), within("signal"), *(c for c in df.columns if c not in ("log", "group_ordinal", "group_name", "signal")))


def read_fleet_samples(spark: SparkSession, folder: str) -> DataFrame:
    """``read_samples`` of a fleet, with the column log."""
    dtypes = fr.small(spark.read.parquet(f"{folder}/channels").select("log", "group_ordinal", "signal", "dtype"))
    own = spark.read.parquet(f"{folder}/samples").join(dtypes, ["log", "group_ordinal", "signal"])
    return own.select("log", "group_ordinal", "group_name", "signal", "seq", "ts", "value", F.lit(None).cast("string").alias("text"), "dtype")


def read_fleet_metadata(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.read.parquet(f"{folder}/channels")
    return own.select("log", "group_ordinal", "group_name", "signal", "position", "unit", "dtype", F.to_json(F.struct("kind", "scale", "offset", "choices")).alias("conversion"))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.read.parquet(f"{folder}/channels")
    out = own.select("group_ordinal", "group_name", "signal", "position", "unit", "dtype", F.to_json(F.struct("kind", "scale", "offset", "choices")).alias("conversion"))
    groups = _raw_groups(spark, folder)
    if groups is None:
        return out
    each = F.array(*(F.struct(F.lit(n).alias("signal"), F.lit(i).alias("position"), F.lit("").alias("unit"), F.lit(k).alias("dtype"), F.lit("").alias("conversion")) for i, (n, _, k) in enumerate(RAW_SIGNALS)))
    return out.unionByName(groups.select("group_ordinal", "group_name", F.inline(each)))


def read_group(spark: SparkSession, folder: str, group_name: str) -> DataFrame:
    """One group as a wide table: seq, ts and a column for each signal in its place."""
    names = [r.signal for r in spark.read.parquet(f"{folder}/channels").where(F.col("group_name") == group_name).orderBy("position").collect()]
    own = spark.read.parquet(f"{folder}/samples").where(F.col("group_name") == group_name)
    return own.groupBy("seq", "ts").pivot("signal", names).agg(F.first("value"))
