"""Many files: what to convert and where to, how a batch went."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mapping_lines(lines: DataFrame) -> DataFrame:
    """new_name, channel of lines(line) of the form old——new——CANn; other lines are skipped."""
    line = F.trim("line")
    parts = F.split(line, "——")
    number = F.substring(F.trim(F.try_element_at(parts, F.lit(3))), 4, 1000).try_cast("int")
    return lines.where(~line.startswith("#")).select(F.trim(F.try_element_at(parts, F.lit(2))).alias("new_name"), number.alias("channel")).where("channel is not null")


def candidates(entries: DataFrame) -> DataFrame:
    """Files to convert from entries(entry, path, size): the path of a log with the dropped entry, file or folder, that gave it.

    A log counts once, whatever the case of its name; the folder that holds it wins over the file itself. A file's output
    stands beside it, a folder's in the mirrored tree <folder>_t. In order of display name and output.
    """
    logs = entries.where(F.lower("path").like("%.blf"))
    once = Window.partitionBy(F.lower("path")).orderBy(F.lower("entry"), "path", "size")
    own = logs.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    loose = F.col("entry") == F.col("path")
    rest = F.expr("substring(path, length(entry) + 2)")
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    display = F.when(loose, F.regexp_replace("path", "^.*/", "")).otherwise(rest)
    output = F.when(loose, F.concat(stem(F.col("path")), F.lit("_t.mdf"))).otherwise(F.concat("entry", F.lit("_t/"), stem(rest), F.lit("_t.mdf")))
    return own.select("path", (~loose).alias("in_folder"), "size", display.alias("display"), output.alias("output")).orderBy(F.lower("display"), "output")


def not_existing(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose output isn't among existing(output)."""
    return found.join(existing, "output", "left_anti")


def outcome_counts(done: DataFrame, skipped: DataFrame) -> DataFrame:
    """status, n_files and the total of keys, of done(o_orderkey, error) and skipped(o_orderkey)."""
    status = done.select("o_orderkey", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")).unionByName(skipped.select("o_orderkey", F.lit("skipped").alias("status")))
    return status.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("o_orderkey").alias("total"))


def channel_union(files: list[DataFrame]) -> DataFrame:
    """Channels of any of the files' frames, in order."""
    return reduce(DataFrame.unionByName, [f.select("channel").distinct() for f in files]).distinct().orderBy("channel")
