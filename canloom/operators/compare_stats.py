"""Statistics of two measurements, folders or files: counts of groups, their order, the time axis, and all points.

A file has its statistics as groups of one name, told apart by their place: ten a channel in our order, or in another
tool's, whose ``layout`` says how many it has for a channel, and where ours are among them. Tables are
(ordinal, item, k, t, value) with the place of the group and of the point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canloom.functions.tables import local
from canloom.operators import compare
from canloom.operators.frames import small
from canloom.operators.stats import ITEMS, items

#: Our items of a channel, in order.
ORDER = [name for pair in ITEMS.values() for name in pair]
#: (items of a channel, place of each of ours among them): as we write them.
OWN_LAYOUT = (len(ORDER), {name: i for i, name in enumerate(ORDER)})
Layout = tuple[int, dict[str, int]]
FOUND = "label string, kind string, detail string"
#: What decides: the axis. A hole, and the rest, is reported.
DECIDES = ("axis",)


def of_file(samples: DataFrame) -> DataFrame:
    """The statistics among the samples of a file; groups are numbered in order."""
    own = samples.where(F.col("group_name") == compare.STATS_GROUP)
    numbers = own.select("group_ordinal").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("group_ordinal")) - 1)  # some hundred groups
    return own.join(small(numbers), "group_ordinal").select("ordinal", F.col("signal").alias("item"), F.col("seq").cast("int").alias("k"), F.col("ts").alias("t"), "value")


def of_folder(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.read.parquet(f"{folder}/stats")
    return own.select((F.col("channel") * len(ORDER) + F.col("item_ordinal")).alias("ordinal"), "item", "k", "t", "value")


def of_fleet(spark: SparkSession, folder: str) -> DataFrame:
    """``of_folder`` of a fleet, with the column log."""
    own = items(spark.read.parquet(f"{folder}/stats"), "log")
    return own.select("log", (F.col("channel") * len(ORDER) + F.col("item_ordinal")).alias("ordinal"), "item", "k", "t", "value")


def differences(ours: DataFrame, theirs: DataFrame, layout: Layout = OWN_LAYOUT) -> DataFrame:
    """label, kind and detail of what differs.

    * groups: one side has no statistics, ours aren't whole channels, or theirs have fewer channels; nothing else is looked at
    * order: a channel of ours whose items aren't in our order
    * axis: the first group's times differ; hole: they do as they may where the other tool leaves out a gap (``axis_contract``)
    * length, points: an item of a channel has another number of points, or values that differ (by more than 1e-9)
    """
    block, offsets = layout
    compare.check_layout(block, offsets, ORDER)
    spark = ours.sparkSession
    n_a, n_b = (x.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0] for x in (ours, theirs))
    channels = n_a // len(ORDER)
    if not n_a and not n_b:
        return local(spark, [], FOUND)
    if not n_a or not n_b or n_a % len(ORDER) or n_b < channels * block:
        return local(spark, [("1s", "groups", f"{n_a} {n_b}")], FOUND)
    # our items with their places in both, a small table
    places = local(spark, [(c, i, name, c * len(ORDER) + i, c * block + offsets[name]) for c in range(channels) for i, name in enumerate(ORDER)], "channel int, i int, name string, here int, there int")
    label = F.concat(F.lit("CAN"), F.col("channel").cast("string"), F.lit("."), F.col("name"))
    named = ours.select("ordinal", "item").distinct().join(F.broadcast(places), F.col("ordinal") == F.col("here"))
    order = named.where("item <> name").select(label.alias("label"), F.lit("order").alias("kind"), F.col("item").alias("detail"))
    first = lambda x, at: x.where(F.col("ordinal") == at).select("k", "t")
    contract = compare.axis_contract(first(ours, 0), first(theirs, offsets[ORDER[0]]))
    axis = contract.where("verdict <> 'equal'").select(F.lit("1s").alias("label"), F.when(F.col("verdict") == "hole", "hole").otherwise("axis").alias("kind"), _said().alias("detail"))
    here = ours.join(F.broadcast(places), F.col("ordinal") == F.col("here")).select("there", "k", F.col("value").alias("a"), F.lit(1).alias("in_a"))
    other = theirs.select(F.col("ordinal").alias("there"), "k", F.col("value").alias("b"), F.lit(1).alias("in_b"))
    both = here.join(other, ["there", "k"], "full_outer")
    met = _points(both, "there").join(F.broadcast(places), "there")
    points = met.where("n_a <> n_b or n_bad > 0").select(label.alias("label"), *_point_rows())
    return order.unionByName(axis).unionByName(points)


def fleet_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``differences`` of two fleets in our layout, each log by itself: log, label, kind, detail. Tables carry the column log."""
    n = len(ORDER)
    last = lambda x, c: x.groupBy("log").agg((F.max("ordinal") + 1).alias(c))
    sizes = last(ours, "n_a").join(last(theirs, "n_b"), "log", "full_outer").select("log", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    whole = (F.col("n_a") > 0) & (F.col("n_a") % n == 0) & (F.col("n_b") >= F.col("n_a"))
    groups = sizes.where(~whole).select("log", F.lit("1s").alias("label"), F.lit("groups").alias("kind"), F.concat_ws(" ", F.col("n_a").cast("string"), F.col("n_b").cast("string")).alias("detail"))
    right = small(sizes.where(whole).select("log", "n_a"))
    ours, theirs = (x.join(right, "log").where(F.col("ordinal") < F.col("n_a")) for x in (ours, theirs))
    name = lambda o: F.element_at(F.array(*map(F.lit, ORDER)), (o % n + 1).cast("int"))
    label = F.concat(F.lit("CAN"), F.floor(F.col("ordinal") / n).cast("string"), F.lit("."), name(F.col("ordinal")))
    order = ours.select("log", "ordinal", "item").distinct().where(F.col("item") != name(F.col("ordinal"))).select("log", label.alias("label"), F.lit("order").alias("kind"), F.col("item").alias("detail"))
    first = lambda x: x.where("ordinal = 0").select("log", "k", "t")
    contract = compare.axis_contract(first(ours), first(theirs), "log")
    axis = contract.where("verdict <> 'equal'").select("log", F.lit("1s").alias("label"), F.when(F.col("verdict") == "hole", "hole").otherwise("axis").alias("kind"), _said().alias("detail"))
    both = ours.select("log", "ordinal", "k", F.col("value").alias("a"), F.lit(1).alias("in_a")).join(theirs.select("log", "ordinal", "k", F.col("value").alias("b"), F.lit(1).alias("in_b")), ["log", "ordinal", "k"], "full_outer")
    met = _points(both, "log", "ordinal").where("n_a <> n_b or n_bad > 0")
    return groups.unionByName(order).unionByName(axis).unionByName(met.select("log", label.alias("label"), *_point_rows()))


def _said() -> Column:
    """What an axis contract found, as text."""
    return F.concat_ws(" ", F.col("n_ours").cast("string"), F.col("n_theirs").cast("string"), F.concat(F.lit("prefix "), F.col("prefix").cast("string")), F.when(~F.coalesce("same_end", F.lit(False)), "other end"), F.when(F.col("bad_steps") > 0, F.concat(F.col("bad_steps").cast("string"), F.lit(" bad steps"))))


def _points(both: DataFrame, *keys: str) -> DataFrame:
    """Points of each side and points that differ, of both(a, b, in_a, in_b)."""
    bad = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.coalesce(compare.close(F.col("a"), F.col("b"), 1e-9, 0.0), F.lit(False))
    return both.groupBy(*keys).agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(bad).alias("n_bad"))


def _point_rows() -> list[Column]:
    other = F.col("n_a") != F.col("n_b")
    return [F.when(other, "length").otherwise("points").alias("kind"), F.when(other, F.concat_ws(" ", F.col("n_a").cast("string"), F.col("n_b").cast("string"))).otherwise(F.col("n_bad").cast("string")).alias("detail")]
