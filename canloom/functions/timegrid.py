"""Time axes: the millisecond grid test and the second bounds of bus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds by which times may miss the grid (200 ns).
TOLERANCE_MS = 2e-4


def to_seconds(ns: Column) -> Column:
    return ns.cast("double") * F.lit(1e-9)


def on_grid(ts: Column) -> Column:
    return F.rint(ts * 1000.0) * 1e6 * 1e-9


def deviation(ts: Column) -> Column:
    return F.abs(ts * 1000.0 - F.rint(ts * 1000.0))


def align(frames: DataFrame, keys: list[str], ts: str = "ts", out: str = "ts") -> DataFrame:
    """Times of a series (``keys``) rounded to the millisecond grid if all of them lie on it, else unchanged.

    One aggregate decides for each series; its rows are few, so frames aren't sorted or shuffled for it.
    """
    worst = frames.groupBy(*keys).agg(F.max(deviation(F.col(ts))).alias("_worst"))
    same = [frames[k].eqNullSafe(worst[k]) for k in keys]
    joined = frames.join(worst, on=same, how="left")
    for k in keys:
        joined = joined.drop(worst[k])
    return joined.withColumn(out, F.when(F.col("_worst") <= TOLERANCE_MS, on_grid(F.col(ts))).otherwise(F.col(ts))).drop("_worst")


def count_bucket(ts: Column) -> Column:
    """The smallest k with ts < C[k], where C[0] = 0, C[1] = 1.1 + 0.009, C[k] = k + 0.009."""
    f = F.floor(ts)
    return (
        F.when(ts < 0, F.lit(0))
        .when(ts < F.lit(1.1) + F.lit(0.009), F.lit(1))
        .when((f >= 2) & (ts < f.cast("double") + F.lit(0.009)), f)
        .otherwise(F.greatest(f + 1, F.lit(2)))
        .cast("int")
    )


def rate_bucket(ts: Column) -> Column:
    """The rate window of a time: up to 1.1 - 0.001, then whole seconds."""
    return F.when(ts < F.lit(1.1) - F.lit(0.001), F.lit(1)).otherwise(F.greatest(F.floor(ts) + 1, F.lit(2))).cast("int")


def bound(k: Column) -> Column:
    """R[k]: 0, 1.1, 2, 3, ..."""
    return F.when(k == 0, F.lit(0.0)).when(k == 1, F.lit(1.1)).otherwise(k.cast("double"))


def count_bound(k: Column) -> Column:
    return F.when(k == 0, F.lit(0.0)).otherwise(bound(k) + F.lit(0.009))
