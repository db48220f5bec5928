"""Bus statistics: cumulative counts and rates of each second, for 16 channels and five frame classes.

Counting by bounds is arithmetic: a time tells its bucket, buckets are aggregated, and a running sum over the dense grid
gives what lies below each bound. Frames are read once, and only bucket counts are shuffled, for one log or a fleet of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canloom.functions import timegrid
from canloom.functions.tables import local
from canloom.model import STAT_CHANNELS
from canloom.operators.frames import frame_class

#: Frame classes with the names of their count and their rate.
ITEMS = {"Std": ("StdData", "StdDataRate"), "Ext": ("ExtData", "ExtDataRate"), "StdRemote": ("StdRemote", "StdRemoteRate"), "ExtRemote": ("ExtRemote", "ExtRemoteRate"), "Err": ("ErrorFrames", "ErrorFrameRate")}


def points(global_end: float) -> int:
    """N, the index of the last grid point; 0 means that nothing was measured."""
    return max(0, -int(-global_end // 1))


def axis(spark: SparkSession, global_end: float) -> DataFrame:
    """k and t: 0, the count bounds, and the end of the measurement, all on the millisecond grid if they lie on it."""
    n = points(global_end)
    rows = spark.range(n + 1 if n else 0).select(F.col("id").cast("int").alias("k"))
    t = F.when(F.col("k") == n, F.lit(float(global_end))).otherwise(timegrid.count_bound(F.col("k")))
    # of all points, only the end can be off the grid
    off = abs(global_end * 1000.0 - np.rint(global_end * 1000.0)) > timegrid.TOLERANCE_MS
    return rows.select("k", (t if off else timegrid.on_grid(t)).alias("t"))


def class_counts(frames: DataFrame) -> DataFrame:
    """Frames of the statistics' channels by channel and class."""
    return _marked(frames).groupBy("channel", "class").agg(F.count("*").alias("n_frames"))


def _marked(frames: DataFrame, *keys: str) -> DataFrame:
    own = frames.where((F.col("channel") >= 0) & (F.col("channel") < STAT_CHANNELS))
    return own.select(*keys, "channel", "ts", frame_class(F.col("is_extended"), F.col("is_remote"), F.col("is_error")).alias("class"))


def bus_statistics(frames: DataFrame, global_end: float) -> DataFrame:
    """channel, class, k, t, count, rate at every grid point of one measurement."""
    one = local(frames.sparkSession, [("", float(global_end))], "file string, global_end double")
    return fleet_statistics(frames.withColumn("file", F.lit("")), one).drop("file")


def fleet_statistics(frames: DataFrame, ends: DataFrame) -> DataFrame:
    """file, channel, class, k, t, count, rate at every grid point of each measurement of ends(file, global_end).

    count is the number of frames before the bound of k. rate is the number in the k-th rate window by its length, 0 at
    k = 0, and repeated at the last point. One plan for any number of measurements: frames become bucket counts where they
    are read, and meet the empty grid of their file by a union; a measurement that ended at 0 has no points. The end of a
    file comes from its row, null and negative ends count as 0; files without a row have no statistics.
    """
    # frames fall into bucket counts where they are read, by the times as they are (_u) and by the millisecond grid (_g):
    # which of both holds for a channel shows when all of its deviations are known
    marked = _marked(frames, "file")
    on_grid = timegrid.on_grid(F.col("ts"))
    places = [f(x).alias(f"{n}_{v}") for n, f in (("c", timegrid.count_bucket), ("r", timegrid.rate_bucket)) for v, x in (("u", F.col("ts")), ("g", on_grid))]
    names = ["c_u", "c_g", "r_u", "r_g"]
    counted = marked.select("file", "channel", "class", *places, timegrid.deviation(F.col("ts")).alias("off")).groupBy("file", "channel", "class", *names).agg(F.count("*").alias("n"), F.max("off").alias("off"))
    hit = lambda name: F.struct(F.col(name).alias("k"), *(F.when(F.lit(x == name), F.col("n")).otherwise(0).alias(x) for x in names))
    hits = counted.select("file", "channel", "class", "off", F.inline(F.array(*map(hit, names))))
    spans = ends.select("file", F.col("global_end").cast("double").alias("end"), F.ceil("global_end").cast("int").alias("last")).where("last > 0")
    series = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(STAT_CHANNELS - 1))).alias("channel")).select("*", F.explode(F.array(*map(F.lit, ITEMS))).alias("class"))
    empty = series.select("file", "channel", "class", "end", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k"))
    # the partitioning by channels serves the sums as well as all windows
    together = empty.unionByName(hits, allowMissingColumns=True).repartition("file", "channel")
    dense = together.groupBy("file", "channel", "class", "k").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), *(F.max(c).alias(c) for c in ("off", "end", "last")))
    aligned = F.max("off").over(Window.partitionBy("file", "channel")) <= timegrid.TOLERANCE_MS
    dense = dense.withColumn("aligned", aligned).select("*", *(F.when(F.col("aligned"), F.col(f"{n}_g")).otherwise(F.col(f"{n}_u")).alias(n) for n in ("c", "r")))
    w = Window.partitionBy("file", "channel", "class").orderBy("k")
    k, last = F.col("k"), F.col("k") == F.col("last")
    length = timegrid.bound(k) - timegrid.bound(k - 1)
    rate = F.when((k >= 1) & ~last, F.col("r").cast("double") / length).otherwise(F.lit(0.0))
    t = F.when(last, F.col("end")).otherwise(timegrid.count_bound(k))
    # of all points, only the end can be off the grid
    on = timegrid.deviation(F.col("end")) <= timegrid.TOLERANCE_MS
    out = dense.withColumn("count", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("_rate", rate).withColumn("t", F.when(on, timegrid.on_grid(t)).otherwise(t))
    return out.withColumn("rate", F.when(last, F.coalesce(F.lag("_rate").over(w), F.lit(0.0))).otherwise(F.col("_rate"))).where("last is not null").select("file", "channel", "class", "k", "t", "count", "rate")


def items(statistics: DataFrame, *keys: str) -> DataFrame:
    """Statistics as exported: channel, item_ordinal, item, k, t, value; channel by channel, ten items each. ``keys`` are kept."""
    order = [name for pair in ITEMS.values() for name in pair]
    named = F.create_map(*(x for c, (a, b) in ITEMS.items() for x in (F.lit(c), F.struct(F.lit(a).alias("count"), F.lit(b).alias("rate")))))
    names = named[F.col("class")]
    both = F.array(F.struct(names["count"].alias("item"), F.col("count").cast("double").alias("value")), F.struct(names["rate"].alias("item"), F.col("rate").alias("value")))
    rows = statistics.select(*keys, "channel", "k", "t", F.explode(both).alias("x"))
    return rows.select(*keys, "channel", (F.array_position(F.array(*map(F.lit, order)), F.col("x.item")) - 1).cast("int").alias("item_ordinal"), F.col("x.item").alias("item"), "k", "t", F.col("x.value").alias("value"))


def min_send_distance(frames: DataFrame) -> DataFrame:
    """Shortest time between two frames of an id on a channel (an item beyond the ten)."""
    w = Window.partitionBy("channel", "arb_id", "is_extended").orderBy("ts", "seq")
    return frames.withColumn("_gap", F.col("ts") - F.lag("ts").over(w)).groupBy("channel", "arb_id", "is_extended").agg(F.min("_gap").alias("min_distance"), F.count("*").alias("n_frames"))
