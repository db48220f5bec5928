"""An archive of bus logs that takes in what is new: decoded signals, and a report of each day's measurement.

    python -m jobs.bus_archive --source /in/events.parquet --out /archive --config jobs/bus_archive.json

Events come as Parquet files in a folder that grows. Each run starts a stream over the files that no run has taken yet
(``availableNow``, the checkpoint knows them), and ends when they are done. A day is one measurement. Of a batch,

* its frames go to ``frames``, and the signals that the catalogs decode from them to ``samples``, by day and batch;
* the days that it touches are reported anew from all of their frames: ``statistics``, ``groups`` and ``summary``, by day;
* a row of ``runs`` says what it read and wrote.

Each write replaces the partitions it is for, and a batch that is begun again after a failure has its number and files
again, so that a rerun leaves the same tables. Late events only touch their own days, however late they are: nothing is
dropped by a watermark. A checkpoint belongs to its archive, and lies in it if no other place is given.

Null times have no day and are left out (``runs`` has their number); an unknown type of event is a frame that no catalog
knows, and one without a user has no channel: both are in ``frames`` alone. A day's report reads six narrow columns of the
day's frames; its size is that of the grid, 80 series of a point a second.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.operators import decode, fleet
from canloom.operators import frames as fr
from canloom.plans import frame_view
from canloom.sources import dbc
from jobs.common import LOG, read_config, session, write

DAY_US = 86_400_000_000
TABLES = ("frames", "samples", "statistics", "groups", "summary")


def _catalogs(config: dict) -> list[dbc.Catalog]:
    return [dbc.parse(text, path) for path, text in sorted(config["catalogs"].items())]


def _bindings(spark: SparkSession, config: dict) -> DataFrame:
    return local(spark, [(int(c), path) for c, path in sorted(config["bindings"].items(), key=lambda x: int(x[0]))], "channel int, dbc string")


def day_frames(events: DataFrame) -> DataFrame:
    """Frames of events with the day (UTC) whose measurement they are in."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int")).cast("string")
    frames = frame_view.of_events(events.where("ts is not null"), F.pmod(us, F.lit(DAY_US)), day.alias("day"))
    return frames.select("day", *(c for c in frames.columns if c not in ("day", "file")))


def report(spark: SparkSession, out: str, days: DataFrame, config: dict) -> dict[str, int]:
    """Write the reports of days(day) from all of their frames."""
    frames = spark.read.parquet(f"{out}/frames").join(F.broadcast(days), "day", "left_semi").withColumnRenamed("day", "file")
    ends = frames.groupBy("file").agg(F.max("abs_ns").alias("max_obj_ns"), F.lit(None).cast("string").alias("error"))
    made = fleet.measured(frames, ends, _bindings(spark, config), _catalogs(config))
    groups = made.groups.join(made.durations, "file")
    tables = {"statistics": made.statistics, "groups": groups, "summary": made.summary}
    # a day's report is bounded by its grid: one file
    return {name: write(t.withColumnRenamed("file", "day").repartition("day"), f"{out}/{name}", ["day"]) for name, t in tables.items()}


def take(events: DataFrame, batch: int, out: str, config: dict) -> dict[str, int]:
    """One batch of the stream into the archive; the rows written to each table."""
    spark = events.sparkSession
    number = F.lit(batch).alias("batch")
    seen = Observation()
    marked = events.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col("ts").isNull()).alias("undated"))
    written = {"frames": write(day_frames(marked).select("*", number), f"{out}/frames", ["day", "batch"])}
    got = {"batch": batch, **seen.get}
    if written["frames"]:
        # back from the archive: the batch's files aren't read twice, and samples are of what was kept
        frames = spark.read.parquet(f"{out}/frames").where(F.col("batch") == batch)
        catalogs = _catalogs(config)
        classified = fr.classify(frames, _bindings(spark, config), dbc.messages_table(spark, catalogs))
        samples = decode.long(classified, decode.plan_table(spark, catalogs), "day", "batch", routed=True).where("active")
        written["samples"] = write(samples.select("day", "batch", "channel", "message_name", "signal_name", "seq", "ts", "phys"), f"{out}/samples", ["day", "batch"])
        written |= report(spark, out, frames.select("day").distinct(), config)
    told = {**got, **{t: written.get(t, 0) for t in TABLES}}
    write(local(spark, [tuple(told.values())], ", ".join(f"{c} long" for c in told)), f"{out}/runs", ["batch"])
    LOG.info("batch done: %s", told)
    return told


def as_pattern(path: str) -> str:
    """path as a pattern of one name, by which a stream takes a table that is one file as well as a folder of files."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return path if set(name) & set("*?[]{}") else f"{parent}/{{{name}}}" if parent else f"{{{name}}}"


def run(spark: SparkSession, source: str, out: str, config: dict, checkpoint: str | None = None) -> list[dict]:
    """Take in what is new at source; what each batch of this run read and wrote."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(config["files_per_batch"])).parquet(as_pattern(source))
    wanted = stream.select("event_id", "ts", "user_id", "event_type", "value", "props")
    done: list[dict] = []
    query = wanted.writeStream.foreachBatch(lambda events, batch: done.append(take(events, batch, out, config))).option("checkpointLocation", checkpoint or f"{out}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("took %s from %s", done or "nothing", source)
    return done


def whole(spark: SparkSession, out: str) -> DataFrame:
    """The archive as one table: day, kind (sample, count, rate, group or summary), channel, name, place and value."""
    read = lambda name: spark.read.parquet(f"{out}/{name}").withColumn("day", F.col("day").cast("string"))
    row = lambda kind, name, place, value: ["day", F.lit(kind).alias("kind"), "channel", F.expr(name).alias("name"), F.expr(place).cast("long").alias("place"), F.expr(value).cast("double").alias("value")]
    statistics, groups, summary = read("statistics"), read("groups"), read("summary")
    parts = [
        read("samples").select(*row("sample", "concat(message_name, '.', signal_name)", "seq", "phys")),
        statistics.select(*row("count", "class", "k", "count")),
        statistics.select(*row("rate", "class", "k", "rate")),
        groups.select(*row("group", "message_name", "series_order", "n_frames")),
        summary.select(*row("summary", "'decoded'", "signal_count", "decoded_frames")),
        summary.select(*row("summary", "'unknown'", "unknown_ids", "unknown_frames")),
    ]
    out_ = parts[0]
    for more in parts[1:]:
        out_ = out_.unionByName(more)
    return out_


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "out", "config"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--checkpoint")
    args = p.parse_args()
    spark = session("bus_archive")
    try:
        run(spark, args.source, args.out, read_config(spark, args.config), args.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
