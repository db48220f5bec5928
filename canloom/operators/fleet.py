"""Many logs in one plan: what a conversion reports of a log, for each log of a fleet.

A log that can't be read is a row with its error, and takes no part in the rest. All tables carry the column ``file``; the
end of a log is a joined column of it, so that no number of a single log passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.functions import timegrid
from canloom.functions.tables import local
from canloom.model import Catalog
from canloom.operators import frames as fr
from canloom.operators import stats
from canloom.sources import blf, dbc


@dataclass(frozen=True)
class Fleet:
    """Tables of a fleet: logs (with errors), groups, durations, a summary for each channel of the bindings, statistics."""

    logs: DataFrame
    groups: DataFrame
    durations: DataFrame
    summary: DataFrame
    statistics: DataFrame


def signal_counts(spark: SparkSession, catalogs: list[Catalog]) -> DataFrame:
    return local(spark, [(c.path, m.arb_norm, len(m.signals)) for c in catalogs for m in c.messages.values()], "dbc string, arb_norm long, n_signals long")


def measured(frames: DataFrame, logs: DataFrame, bindings: DataFrame, catalogs: list[Catalog]) -> Fleet:
    """The fleet of frames(file, ...) and logs(file, max_obj_ns, error)."""
    spark = frames.sparkSession
    whole = logs.where("error is null")
    own = frames.join(whole.select("file"), "file", "left_semi")
    classified = fr.classify(own, bindings, dbc.messages_table(spark, catalogs))
    groups = fr.group_names(fr.buckets(classified, "file"), "file")
    ends = whole.select("file", timegrid.to_seconds(F.col("max_obj_ns")).alias("global_end"))
    return Fleet(logs, groups, fr.duration(groups, "file"), fr.ingest_summary(bindings, classified, signal_counts(spark, catalogs), files=whole), stats.fleet_statistics(own, ends))


def read(spark: SparkSession, paths: str | list[str], bindings: DataFrame, catalogs: list[Catalog]) -> Fleet:
    """The fleet of the logs at paths."""
    return measured(blf.frames(spark, paths, on_error="skip"), blf.file_info(spark, paths, on_error="row"), bindings, catalogs)
