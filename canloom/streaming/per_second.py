"""Counts of each second as logs arrive: a stream of frames to one row for each channel, class and second.

Input is a stream of frames with an event time: e.g. the Parquet frames that conversions leave, by the file source. The
watermark bounds the state; a second is final once the watermark has passed it. Rates and the last point need a log's
end, and stay with the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.functions.timegrid import count_bucket
from canloom.operators.frames import frame_class


def with_event_time(frames: DataFrame, start: str = "start_ns") -> DataFrame:
    """event_time of frames that carry their log's start."""
    return frames.withColumn("event_time", F.timestamp_micros(F.floor((F.col(start) - F.pmod(F.col(start), F.lit(1_000_000_000)) + F.col("abs_ns")) / 1000).cast("long")))


def second_counts(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """file, channel, class, second (start of the window) and n_frames; frames later than ``delay`` are dropped."""
    kind = frame_class(F.col("is_extended"), F.col("is_remote"), F.col("is_error"))
    own = frames.withWatermark("event_time", delay).withColumn("class", kind)
    counts = own.groupBy("file", "channel", "class", F.window("event_time", "1 second")).agg(F.count("*").alias("n_frames"))
    return counts.select("file", "channel", "class", F.col("window.start").alias("second"), "n_frames")


def bucket_counts(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """file, channel, class, k and n_frames by the count buckets of the batch statistics (their running sum over k is the
    count at each bound)."""
    kind = frame_class(F.col("is_extended"), F.col("is_remote"), F.col("is_error"))
    own = frames.withWatermark("event_time", delay).withColumn("class", kind).withColumn("k", count_bucket(F.col("ts")))
    return own.groupBy("file", "channel", "class", "k", F.window("event_time", "1 minute")).agg(F.count("*").alias("n_frames")).select("file", "channel", "class", "k", "n_frames")
