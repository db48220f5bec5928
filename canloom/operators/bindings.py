"""Which catalog decodes which channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suggestions(catalogs: DataFrame, mapping: DataFrame) -> DataFrame:
    """channel, dbc from catalogs(stem, dbc, load_order) and mapping(stem, channel); of several, the last loaded."""
    return catalogs.join(mapping, "stem").groupBy("channel").agg(F.max_by("dbc", "load_order").alias("dbc"))


def state(in_log: Column, binding: Column) -> Column:
    return F.when(~in_log, "NO_DATA").when(binding.isNotNull(), "BOUND").otherwise("NOT_EXPORTED")


def decide(channels: DataFrame, auto: DataFrame, previous: DataFrame, catalogs: DataFrame) -> DataFrame:
    """channel, binding, state for the channels of the log and of the suggestions, in order.

    channels(channel), auto(channel, dbc), previous(channel, dbc; null: unbound by choice), catalogs(dbc) loaded. A
    choice of no catalog stands; a choice that is loaded stands; else a suggestion that is loaded; else nothing.
    """
    loaded = catalogs.select("dbc").distinct()
    auto = auto.join(loaded, "dbc", "left_semi").select("channel", F.col("dbc").alias("_auto"), F.lit(True).alias("_suggested")).unionByName(
        auto.join(loaded, "dbc", "left_anti").select("channel", F.lit(None).cast("string").alias("_auto"), F.lit(True).alias("_suggested"))
    )
    chosen = previous.join(loaded.withColumn("_valid", F.lit(True)), "dbc", "left").select("channel", F.col("dbc").alias("_chosen"), F.coalesce("_valid", F.lit(False)).alias("_valid"), F.lit(True).alias("_stated"))
    log = channels.select("channel").distinct().withColumn("_in_log", F.lit(True))
    rows = log.join(auto, "channel", "full_outer").join(chosen, "channel", "left")
    binding = F.when(F.col("_stated") & F.col("_chosen").isNull(), F.lit(None).cast("string")).when(F.col("_valid"), F.col("_chosen")).otherwise(F.col("_auto"))
    out = rows.select("channel", binding.alias("binding"), F.coalesce("_in_log", F.lit(False)).alias("_in_log"))
    return out.select("channel", "binding", state(F.col("_in_log"), F.col("binding")).alias("state")).orderBy("channel")
