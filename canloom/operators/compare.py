"""Cross-checks of two measurements: every difference is a row.

A measurement is a table of samples (group_ordinal, group_name, signal, seq, ts, value double, text string, dtype
string) with its channels' metadata (group_ordinal, group_name, signal, position, unit, dtype, conversion). Differences
have a dimension (header, structure, values, stats), a severity (hard or note), a label and a detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canloom.functions.bits import clean_text
from canloom.operators.frames import small

DIMENSIONS = ("header", "structure", "values", "stats")
STATS_GROUP = "1s"
#: Steps of a statistics axis, and how far a step may be off (1 ns).
FIRST_STEP, SECOND_STEP, STEP, STEP_TOLERANCE = 1.109, 0.9, 1.0, 1e-9


def check_dimensions(dims: set[str]) -> None:
    if bad := set(dims) - set(DIMENSIONS):
        raise ValueError(f"no such dimension: {sorted(bad)} (there are {list(DIMENSIONS)})")


def check_layout(block: int, offsets: dict[str, int], items: list[str]) -> None:
    """The place of each statistics item in another tool's block of items for a channel."""
    if missing := set(items) - set(offsets):
        raise ValueError(f"items without a place: {sorted(missing)}")
    for item, at in offsets.items():
        if not 0 <= at < block:
            raise ValueError(f"place of {item} outside of the block: {at}")


def close(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Within atol + rtol * |b|, or both NaN."""
    nan = F.isnan(a) & F.isnan(b)
    return nan | (~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))))


def identical(a: DataFrame, b: DataFrame, atol: float = 1e-12) -> DataFrame:
    """Samples that differ, by group ordinal, signal and place: kind is missing, extra, dtype, time, text or value."""
    keys = ["group_ordinal", "signal", "seq"]
    pick = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("ts", "value", "text", "dtype")), F.lit(True).alias(f"{p}_there"))
    both = pick(a, "a").join(pick(b, "b"), keys, "full_outer")
    c = F.col
    kind = (
        F.when(c("b_there").isNull(), "missing")
        .when(c("a_there").isNull(), "extra")
        .when(~c("a_dtype").eqNullSafe(c("b_dtype")), "dtype")
        .when(~c("a_ts").eqNullSafe(c("b_ts")), "time")
        .when(~clean_text(c("a_text")).eqNullSafe(clean_text(c("b_text"))), "text")
        .when(c("a_value").isNull() & c("b_value").isNull(), F.lit(None))
        .when(~F.coalesce(close(c("a_value"), c("b_value"), atol, 0.0), F.lit(False)), "value")
    )
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "a_value", "b_value")


def signal_sets(samples_meta: DataFrame) -> DataFrame:
    """group_ordinal, group_name, signal_set: the signals of each group, which tell what group of another file it is."""
    return samples_meta.groupBy("group_ordinal", "group_name").agg(F.array_join(F.sort_array(F.collect_set("signal")), "\x1f").alias("signal_set"))


def numbered_sets(samples_meta: DataFrame) -> DataFrame:
    """``signal_sets`` with nth: of several groups with one set, their order."""
    nth = F.row_number().over(Window.partitionBy("signal_set").orderBy("group_ordinal", "group_name"))
    return signal_sets(samples_meta).withColumn("nth", nth)


def paired_groups(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of two measurements matched by their sets of signals and the place among those of one set; names don't count.

    (pair, group_name), and for each side (group_ordinal, pair): a group is known by a number from there on, so that the
    list of its signals stays out of what its samples are joined by. Groups without a counterpart have a number of their own.
    """
    sa, sb = (numbered_sets(x.select("group_ordinal", "group_name", "signal").distinct()).select("signal_set", "nth", F.col("group_ordinal").alias(f"o_{p}"), F.col("group_name").alias(f"name_{p}")) for x, p in ((a, "a"), (b, "b")))
    number = F.coalesce(F.col("o_a"), -1 - F.col("o_b"))
    both = sa.join(sb, ["signal_set", "nth"], "full_outer").select(number.alias("pair"), "o_a", "o_b", F.coalesce("name_a", "name_b").alias("group_name"))
    side = lambda o: small(both.where(F.col(o).isNotNull()).select(F.col(o).alias("group_ordinal"), "pair"))
    return small(both.select("pair", "group_name")), side("o_a"), side("o_b")


def missing_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups of one measurement that the other has no counterpart of: side (a or b), group_name, n_signals.

    Counterparts have equal signal sets; of several groups with one set, each needs its own.
    """
    sa, sb = (numbered_sets(x.where(F.col("group_name") != STATS_GROUP)) for x in (a, b))
    n = F.size(F.split("signal_set", "\x1f")).cast("long").alias("n_signals")
    only = lambda x, y, side: x.join(y, ["signal_set", "nth"], "left_anti").select(F.lit(side).alias("side"), "group_name", n)
    return only(sa, sb, "a").unionByName(only(sb, sa, "b"))


def renamed_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """name_a, name_b of matched groups whose names differ; two tools name groups differently, so this is no value difference."""
    sa, sb = (numbered_sets(x).select("signal_set", "nth", F.col("group_name").alias(f"name_{p}")) for x, p in ((a, "a"), (b, "b")))
    return sa.join(sb, ["signal_set", "nth"]).where("name_a <> name_b").select("name_a", "name_b")


def within_tolerance(a: DataFrame, b: DataFrame, atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """Signals of groups matched by signal set alone that differ: lengths, times, and values beyond tolerance.

    One row for each signal with group_name (a's where there is one), n_a, n_b, bad_times, bad_values and the largest difference.
    """
    names, of_a, of_b = paired_groups(a, b)
    keys = ["pair", "signal", "seq"]
    pick = lambda df, own, p: df.join(own, "group_ordinal").select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("ts", "value", "text")), F.lit(1).alias(f"{p}_there"))
    both = pick(a, of_a, "a").join(pick(b, of_b, "b"), keys, "full_outer")
    c = F.col
    there = c("a_there").isNotNull() & c("b_there").isNotNull()
    text = c("a_text").isNotNull() | c("b_text").isNotNull()
    bad = F.when(text, ~clean_text(c("a_text")).eqNullSafe(clean_text(c("b_text")))).otherwise(~F.coalesce(close(c("a_value"), c("b_value"), atol, rtol), F.lit(False)))
    by = both.groupBy("pair", "signal").agg(
        F.count("a_there").alias("n_a"),
        F.count("b_there").alias("n_b"),
        F.count_if(there & ~c("a_ts").eqNullSafe(c("b_ts"))).alias("bad_times"),
        F.count_if(there & bad).alias("bad_values"),
        F.max(F.when(there & ~F.isnan("a_value") & ~F.isnan("b_value"), F.abs(c("a_value") - c("b_value")))).alias("max_diff"),
    )
    return by.where("n_a <> n_b or bad_times > 0 or bad_values > 0").join(names, "pair").select("group_name", "signal", "n_a", "n_b", "bad_times", "bad_values", "max_diff")


def metadata(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metadata fields that differ for signals of matched groups: group_name (a's), signal, field, a, b."""
    fields = ["unit", "dtype", "conversion", "position"]
    names, of_a, of_b = paired_groups(a, b)
    tall = lambda df, own, p: df.join(own, "group_ordinal").select("pair", "signal", F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))))).alias("field", p))
    return tall(a, of_a, "a").join(tall(b, of_b, "b"), ["pair", "signal", "field"]).where("a <> b").join(names, "pair").select("group_name", "signal", "field", "a", "b")


def header(a: dict[str, str], b: dict[str, str]) -> list[tuple[str, str | None, str | None]]:
    return [(f, a.get(f), b.get(f)) for f in sorted({*a, *b}) if a.get(f) != b.get(f)]


def axis_steps(axis: DataFrame) -> DataFrame:
    """Each step of an axis(series, k, t) with whether it is as it must be: ok, order, first, second, inner or last."""
    w = Window.partitionBy("series").orderBy("k")
    steps = axis.withColumn("step", F.col("t") - F.lag("t").over(w)).withColumn("_n", F.max("k").over(Window.partitionBy("series"))).where("k >= 1")
    off = lambda want: F.abs(F.col("step") - F.lit(want)) > STEP_TOLERANCE
    k, n = F.col("k"), F.col("_n")
    verdict = (
        F.when(F.col("step") <= 0, "order")
        .when((k == 1) & (n > 1) & off(FIRST_STEP), "first")
        .when((k == 2) & (n > 2) & off(SECOND_STEP), "second")
        .when((k > 2) & (k < n) & off(STEP), "inner")
        .when((k == n) & (F.col("step") > STEP + STEP_TOLERANCE) & (n > 1), "last")
        .otherwise("ok")
    )
    return steps.select("series", "k", "step", verdict.alias("verdict"))


def axis_contract(ours: DataFrame, theirs: DataFrame, *keys: str) -> DataFrame:
    """One row (for each of ``keys``): n_ours, n_theirs, the common prefix, whether the ends agree, bad steps of ours, and the verdict.

    Axes of one length must agree at every point (equal); otherwise a prefix of 2 points, the end, and our own steps must
    be right (hole), else broken. axis tables have k and t.
    """
    both = ours.select(*keys, "k", F.col("t").alias("a")).join(theirs.select(*keys, "k", F.col("t").alias("b")), [*keys, "k"], "full_outer")
    differs = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.abs(F.col("a") - F.col("b")) > STEP_TOLERANCE)
    facts = both.groupBy(*keys).agg(
        F.count("a").alias("n_ours"),
        F.count("b").alias("n_theirs"),
        F.min(F.when(differs, F.col("k"))).alias("_first"),
        F.max_by("a", F.when(F.col("a").isNotNull(), F.col("k"))).alias("_end_a"),
        F.max_by("b", F.when(F.col("b").isNotNull(), F.col("k"))).alias("_end_b"),
        F.min_by("a", F.when(F.col("a").isNotNull(), F.col("k"))).alias("_start"),
    )
    steps = axis_steps(ours.withColumn("series", F.struct(*keys) if keys else F.lit(0)))
    wrong = F.count_if(F.col("verdict") != "ok").alias("bad_steps")
    if keys:
        bad = steps.groupBy("series").agg(wrong).select(*(F.col(f"series.{x}").alias(x) for x in keys), "bad_steps")
        out = facts.join(bad, list(keys), "left").withColumn("bad_steps", F.coalesce("bad_steps", F.lit(0).cast("long")))
    else:
        out = facts.crossJoin(F.broadcast(steps.agg(wrong)))  # one row by one row
    prefix = F.coalesce(F.col("_first").cast("long"), F.least("n_ours", "n_theirs"))
    ends = F.abs(F.col("_end_a") - F.col("_end_b")) <= STEP_TOLERANCE
    right = (prefix >= 2) & ends & (F.col("_start") == 0) & (F.col("bad_steps") == 0)
    verdict = F.when((F.col("n_ours") == F.col("n_theirs")) & F.col("_first").isNull(), "equal").when((F.col("n_ours") != F.col("n_theirs")) & right, "hole").otherwise("broken")
    return out.select(*keys, "n_ours", "n_theirs", prefix.alias("prefix"), ends.alias("same_end"), "bad_steps", verdict.alias("verdict"))


def stats_by_layout(ours: DataFrame, theirs: DataFrame, block: int, offsets: dict[str, int], tolerance: float = 1e-9) -> DataFrame:
    """channel, item, n_bad: ours(channel, item, k, value) against theirs(ordinal, k, value), whose groups are blocks of
    ``block`` items a channel, an item at its offset."""
    places = F.create_map(*(x for i, o in sorted(offsets.items()) for x in (F.lit(i), F.lit(o))))
    keyed = ours.withColumn("ordinal", F.col("channel") * block + F.element_at(places, F.col("item")))
    both = keyed.join(theirs.select("ordinal", "k", F.col("value").alias("other")), ["ordinal", "k"], "full_outer").where("channel is not null")
    bad = F.col("other").isNull() | (F.abs(F.col("value") - F.col("other")) > tolerance)
    return both.groupBy("channel", "item").agg(F.count_if(bad).alias("n_bad")).where("n_bad > 0")


def nearest(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """For each sample of b(series, seq, ts) the nearest of a(series, seq, ts) within the tolerance, of equals the first.

    A range join by cells: a time meets those of its own and the two neighbouring cells of the tolerance's width.
    """
    cell = lambda t: F.floor(t / F.lit(tolerance)).cast("long")
    left = a.select("series", F.col("seq").alias("a_seq"), F.col("ts").alias("a_ts"), F.explode(F.sequence(cell(F.col("ts")) - 1, cell(F.col("ts")) + 1)).alias("_cell"))
    right = b.select("series", F.col("seq").alias("b_seq"), F.col("ts").alias("b_ts"), cell(F.col("ts")).alias("_cell"))
    gap = F.abs(F.col("a_ts") - F.col("b_ts"))
    met = right.join(left, ["series", "_cell"]).where(gap <= tolerance)
    return met.groupBy("series", "b_seq", "b_ts").agg(F.min(F.struct(gap.alias("gap"), "a_seq", "a_ts")).alias("m")).select("series", "b_seq", "b_ts", "m.a_seq", "m.a_ts", "m.gap")


def with_severity(differences: DataFrame, known: Column) -> DataFrame:
    """Differences that are known and explained are notes; the others are hard."""
    return differences.withColumn("severity", F.when(known, "note").otherwise("hard"))


def gate(differences: DataFrame, dims: tuple[str, ...] = ("values", "stats")) -> DataFrame:
    """Hard differences of the dimensions that decide."""
    return differences.where((F.col("severity") == "hard") & F.col("dimension").isin(*dims))


def profile(samples: DataFrame) -> DataFrame:
    """n, first and last time and value of each signal."""
    return samples.groupBy("group_name", "signal").agg(
        F.count("*").alias("n"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"), F.min_by("value", "seq").alias("first_value"), F.max_by("value", "seq").alias("last_value")
    )
