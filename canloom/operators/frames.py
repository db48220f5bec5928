"""Frames and catalogs: classification, accounting, raw export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canloom.functions.bits import normalize_id, padded
from canloom.functions.timegrid import TOLERANCE_MS, deviation

#: Catalog tables are broadcast if the plan bounds them by so many bytes, or else if they have at most so many rows;
#: beyond, Spark plans the join by its own sizes.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 200_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is known to be small: by the plan's size, else its rows are counted first."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) <= BROADCAST_BYTES or df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def classify(frames: DataFrame, bindings: DataFrame, messages: DataFrame) -> DataFrame:
    """Frames of bound channels with their catalog, message and whether it matches.

    bindings(channel, dbc); messages as in model.MESSAGES. A frame is valid if its normalized id is in the catalog of its
    channel and it is no shorter than the message; longer is fine. Unbound channels have no rows.
    """
    bound = small(bindings.where("dbc is not null").select("channel", "dbc"))
    known = small(messages.select(F.col("dbc").alias("_dbc"), F.col("arb_norm").alias("_norm"), "message_name", "node", "frame_length"))
    keyed = frames.withColumn("arb_norm", normalize_id(F.col("arb_id"), F.col("is_extended"))).join(bound, "channel")
    joined = keyed.join(known, (F.col("dbc") == F.col("_dbc")) & (F.col("arb_norm") == F.col("_norm")), "left").drop("_dbc", "_norm")
    found = F.col("message_name").isNotNull()
    return joined.withColumn("found", found).withColumn("valid", found & (F.col("data_len") >= F.col("frame_length")))


def labelled(frames: DataFrame, bindings: DataFrame, messages: DataFrame) -> DataFrame:
    """All frames, those of unbound channels too, with catalog, message and validity as ``classify`` gives them."""
    own = bindings.where("dbc is not null").select("channel", "dbc")
    unbound = frames.join(small(own.select("channel")), "channel", "left_anti").withColumn("arb_norm", normalize_id(F.col("arb_id"), F.col("is_extended")))
    return classify(frames, bindings, messages).unionByName(unbound.withColumn("found", F.lit(False)).withColumn("valid", F.lit(False)), allowMissingColumns=True)


def series(labelled: DataFrame, *keys: str) -> DataFrame:
    """What a conversion must know of its frames before it decodes them: for each channel, id and validity the number,
    the first and last, the largest deviation from the millisecond grid, and the longest payload. A few rows for each id.

    Of a fleet of logs, here and in what follows from series: with a key, for each log by itself."""
    return labelled.groupBy(*keys, "channel", "dbc", "arb_norm", "arb_id", "message_name", "valid").agg(
        F.count("*").alias("n_frames"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.max(deviation(F.col("ts"))).alias("off"),
        F.max("data_len").alias("longest"),
    )


def series_groups(found: DataFrame, *keys: str) -> DataFrame:
    """``buckets`` from series, with the catalog and whether all times of the group lie on the millisecond grid."""
    by = found.where("valid").groupBy(*keys, "channel", "arb_norm", "message_name", "dbc").agg(
        F.sum("n_frames").alias("n_frames"),
        F.min("first_seq").alias("first_seq"),
        F.min_by("arb_id", "first_seq").alias("first_arb_id"),
        F.min_by("first_ts", "first_seq").alias("first_ts"),
        F.max_by("last_ts", "last_seq").alias("last_ts"),
        (F.max("off") <= TOLERANCE_MS).alias("on_grid"),
    )
    return by.withColumn("series_order", F.row_number().over(Window.partitionBy(*keys, "channel").orderBy("first_seq")))


def exported_series(found: DataFrame, bindings: DataFrame, messages: DataFrame) -> DataFrame:
    """Series of unbound channels with a mark whether they are exported raw, as ``raw_frames`` has it for frames."""
    own = found.join(small(bindings.where("dbc is null").select("channel")), "channel", "left_semi")
    if not bindings.where("dbc is not null").limit(1).count():
        return own.withColumn("exported", F.lit(True))
    ids = small(known_ids(bindings, messages).withColumn("_known", F.lit(True)))
    return own.join(ids, "arb_norm", "left").withColumn("exported", F.coalesce("_known", F.lit(False))).drop("_known")


def series_summary(found: DataFrame, bindings: DataFrame, signal_counts: DataFrame, raw: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """``ingest_summary`` from series; ``raw`` are exported_series. Of a fleet, for each of logs(log) and channel."""
    keys = [] if logs is None else ["log"]
    by = [*keys, "channel"]
    total = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("n_frames"))), F.lit(0)).alias(n)
    ids = lambda c, n: F.countDistinct(F.when(c, F.col("arb_id"))).alias(n)
    valid = F.col("valid")
    counts = found.where("dbc is not null").groupBy(*by).agg(total(valid, "decoded_frames"), total(~valid, "unknown_frames"), ids(~valid, "unknown_ids"))
    emitted = found.where("valid").select(*by, "dbc", "arb_norm").distinct().join(small(signal_counts), ["dbc", "arb_norm"]).groupBy(*by).agg(F.sum("n_signals").alias("signal_count"))
    own = raw if raw is not None else found.where("false").withColumn("exported", F.lit(True))
    lost = own.groupBy(*by).agg(total(F.col("exported"), "raw_frames"), total(~F.col("exported"), "_lost"), ids(~F.col("exported"), "_ids"))
    rows = bindings.select("channel", F.col("dbc").isNotNull().alias("bound"))
    if logs is not None:  # a few channels for each log
        rows = logs.select("log").crossJoin(small(rows))
    rows = rows.join(counts, by, "left").join(emitted, by, "left").join(lost, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = rows.select(*by, "bound", zero("decoded_frames").alias("decoded_frames"), zero("signal_count").alias("signal_count"), (zero("unknown_frames") + zero("_lost")).alias("unknown_frames"), (zero("unknown_ids") + zero("_ids")).alias("unknown_ids"), zero("raw_frames").alias("raw_frames"))
    return out.withColumn("warning", F.when(F.col("bound") & (F.col("signal_count") == 0), "NO_FRAMES").when(~F.col("bound") & (F.col("unknown_frames") > 0) & (F.col("raw_frames") == 0), "NO_MATCH"))


def frame_class(is_extended: Column, is_remote: Column, is_error: Column) -> Column:
    """The one class of a frame: Err before remote before plain."""
    return (
        F.when(is_error, "Err")
        .when(is_extended & is_remote, "ExtRemote")
        .when(is_remote, "StdRemote")
        .when(is_extended, "Ext")
        .otherwise("Std")
    )


def channel_counts(classified: DataFrame, *keys: str) -> DataFrame:
    """total, unknown and distinct unknown raw ids of each channel; frames are known as of column valid.

    Of a fleet of logs in one frame, here and below: with the key ``file``, for each log by itself."""
    unknown = ~F.col("valid")
    return classified.groupBy(*keys, "channel").agg(
        F.count("*").alias("total_frames"),
        F.count_if(unknown).alias("unknown_frames"),
        F.countDistinct(F.when(unknown, F.col("arb_id"))).alias("unknown_ids"),
    )


def buckets(classified: DataFrame, *keys: str) -> DataFrame:
    """Groups of valid frames by channel and message: count, first raw id and place, order of first appearance."""
    by = classified.where("valid").groupBy(*keys, "channel", "arb_norm", "message_name").agg(
        F.count("*").alias("n_frames"),
        F.min("seq").alias("first_seq"),
        F.min_by("arb_id", "seq").alias("first_arb_id"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
    )
    return by.withColumn("series_order", F.row_number().over(Window.partitionBy(*keys, "channel").orderBy("first_seq")))


def group_names(by: DataFrame, *keys: str) -> DataFrame:
    """Names of exported groups: the message, or CAN<channel>::message from the second that has it on."""
    nth = F.row_number().over(Window.partitionBy(*keys, "message_name").orderBy("channel", "series_order"))
    return by.withColumn("group_name", F.when(nth == 1, F.col("message_name")).otherwise(F.concat(F.lit("CAN"), F.col("channel").cast("string"), F.lit("::"), F.col("message_name"))))


def duration(by: DataFrame, *keys: str) -> DataFrame:
    """One row: last minus first sample over all groups, 0 if there are none (with keys, a log without groups has no row)."""
    return by.groupBy(*keys).agg(F.coalesce(F.max("last_ts") - F.min("first_ts"), F.lit(0.0)).alias("duration_seconds"))


def known_ids(bindings: DataFrame, messages: DataFrame) -> DataFrame:
    """Normalized ids that any bound catalog knows."""
    bound = bindings.where("dbc is not null").select("dbc").distinct()
    return messages.join(small(bound), "dbc", "left_semi").select("arb_norm").distinct()


def raw_frames(frames: DataFrame, bindings: DataFrame, messages: DataFrame) -> DataFrame:
    """Frames of unbound channels with a mark whether they are exported: known to a bound catalog, or none is bound."""
    unbound = small(bindings.where("dbc is null").select("channel"))
    own = frames.join(unbound, "channel", "left_semi").withColumn("arb_norm", normalize_id(F.col("arb_id"), F.col("is_extended")))
    if not bindings.where("dbc is not null").limit(1).count():
        return own.withColumn("exported", F.lit(True))
    ids = small(known_ids(bindings, messages).withColumn("_known", F.lit(True)))
    return own.join(ids, "arb_norm", "left").withColumn("exported", F.coalesce("_known", F.lit(False))).drop("_known")


def raw_groups(raw: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """Exported raw frames as their groups hold them: data padded with zeros to the channel's longest (widths(channel, width),
    or looked for)."""
    own = raw.where("exported")
    longest = small(own.groupBy("channel").agg(F.max(F.length("data")).alias("width")) if widths is None else widths)
    return own.join(longest, "channel").select(
        F.concat(F.lit("Raw::CAN"), F.col("channel").cast("string")).alias("group_name"),
        "channel",
        "seq",
        "ts",
        F.col("arb_id").alias("id"),
        F.length("data").cast("int").alias("dlc"),
        padded(F.col("data"), F.col("width")).alias("data"),
        F.col("is_extended").cast("int").alias("is_extended"),
        F.col("is_fd").cast("int").alias("is_fd"),
    )


def ingest_summary(bindings: DataFrame, classified: DataFrame, signal_counts: DataFrame, raw: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row for each channel of the bindings; of a fleet, for each of files(file) and channel.

    signal_counts(dbc, arb_norm, n_signals). decoded + unknown frames of bound channels, or raw frames of unbound ones if
    ``raw`` (of raw_frames) is given, with a warning code where nothing matches.
    """
    keys = [] if files is None else ["file"]
    by = [*keys, "channel"]
    counts = channel_counts(classified, *keys)
    emitted = classified.where("valid").select(*by, "dbc", "arb_norm").distinct().join(small(signal_counts), ["dbc", "arb_norm"]).groupBy(*by).agg(F.sum("n_signals").alias("signal_count"))
    own = bindings.select("channel", F.col("dbc").isNotNull().alias("bound"))
    if files is not None:  # a few channels for each file
        own = files.select("file").crossJoin(small(own))
    rows = own.join(counts, by, "left").join(emitted, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = rows.select(*by, "bound", (zero("total_frames") - zero("unknown_frames")).alias("decoded_frames"), zero("signal_count").alias("signal_count"), zero("unknown_frames").alias("unknown_frames"), zero("unknown_ids").alias("unknown_ids"))
    none = F.when(F.col("bound") & (F.col("signal_count") == 0), F.lit("NO_FRAMES"))
    if raw is None:
        return out.withColumn("raw_frames", F.lit(0).cast("long")).withColumn("warning", none)
    own = raw.groupBy(*by).agg(F.count_if("exported").alias("raw_frames"), F.count_if(~F.col("exported")).alias("_lost"), F.countDistinct(F.when(~F.col("exported"), F.col("arb_id"))).alias("_ids"))
    out = out.join(own, by, "left")
    out = out.withColumn("raw_frames", zero("raw_frames")).withColumn("unknown_frames", F.col("unknown_frames") + zero("_lost")).withColumn("unknown_ids", F.col("unknown_ids") + zero("_ids"))
    lost = F.when(~F.col("bound") & (F.col("unknown_frames") > 0) & (F.col("raw_frames") == 0), F.lit("NO_MATCH"))
    return out.drop("_lost", "_ids").withColumn("warning", F.coalesce(none, lost))
