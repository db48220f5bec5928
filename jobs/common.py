"""What the jobs' command lines share. Files are read by Spark, so that paths may be of any store."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("jobs")


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write(df: DataFrame, path: str, partitions: list[str], dynamic: bool = True) -> int:
    """Write df by its partition columns and tell how many rows there were, counted on the way.

    Of partitions that are written before, those that df has are replaced (``dynamic``), or all."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*partitions)
    out.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)
    LOG.info("wrote %d rows to %s", seen.get["n"], path)
    return seen.get["n"]
