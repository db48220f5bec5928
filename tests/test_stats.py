"""Bus statistics against their definition, and stated vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.operators import compare, stats

FRAMES = "seq long, channel int, ts double, is_extended boolean, is_remote boolean, is_error boolean, arb_id long"


def run(spark, times, end, channel=3, kinds=None):
    rows = [(i, channel, t, *(kinds[i] if kinds else (False, False, False)), 1) for i, t in enumerate(times)]
    return {(r.channel, r["class"], r.k): r for r in stats.bus_statistics(local(spark, rows, FRAMES), end).collect()}


def brute(times, end):
    if times and max(abs(t * 1000 - round(t * 1000)) for t in times) <= 2e-4:
        times = [float(round(t * 1000)) * 1e6 * 1e-9 for t in times]
    n = math.ceil(end)
    r = [0.0, 1.1, *map(float, range(2, n + 1))][: max(2, n + 1)]
    c = [0.0] + [x + 0.009 for x in r[1:]]
    rb = [0.0, 1.1 - 0.001, *map(float, range(2, n))]
    counts = [sum(t < x for t in times) for x in c[: n + 1]]
    rates = [0.0] * (n + 1)
    for k in range(1, n):
        rates[k] = (sum(t < rb[k] for t in times) - sum(t < rb[k - 1] for t in times)) / (r[k] - r[k - 1])
    rates[n] = rates[n - 1]
    return counts, rates


def test_stated_vectors(spark):
    got = run(spark, [0.5, 1.0, 1.5, 2.5, 3.5], 3.5)
    assert [got[3, "Std", k]["count"] for k in range(5)] == [0, 2, 3, 4, 5]
    assert [got[3, "Std", k].rate for k in range(5)] == [0, 2 / 1.1, 1 / (2.0 - 1.1), 1, 1]
    got = run(spark, [1.109, 1.109, 2.009, 3.009, 3.009], 3.009)
    assert [got[3, "Std", k]["count"] for k in range(5)] == [0, 0, 2, 3, 5]


def test_empty_channels_and_axis(spark):
    axis = [r.t for r in stats.axis(spark, 599.999).orderBy("k").collect()]
    assert len(axis) == 601 and axis[1] == 1.109 and axis[2] == 2.0090000000000003 and axis[-1] == 599.999
    off = [r.t for r in stats.axis(spark, 254.426397562).orderBy("k").collect()]
    assert len(off) == 256 and off[-1] == 254.426397562
    got = run(spark, [], 2.0)
    assert len(got) == 16 * 5 * 3 and all(r["count"] == 0 and r.rate == 0 for r in got.values())
    assert run(spark, [0.0], 0.0) == {}
    one = run(spark, [0.2], 0.5)
    assert [one[3, "Std", k]["count"] for k in (0, 1)] == [0, 1] and one[3, "Std", 1].rate == 0


def test_classes_and_channels(spark):
    kinds = [(False, False, False), (True, False, False), (False, True, False), (False, True, False), (True, True, True), (False, False, True)]
    got = run(spark, [0.5] * 6, 1.5, kinds=kinds)
    assert [got[3, c, 2]["count"] for c in stats.ITEMS] == [1, 1, 2, 0, 2]
    assert run(spark, [0.5], 1.5, channel=16)[0, "Std", 2]["count"] == 0


@pytest.mark.parametrize("grid", [True, False])
def test_random_times(spark, grid):
    rng = random.Random(grid)
    times = [rng.uniform(0, 30) for _ in range(500)]
    times = [round(t, 3) for t in times] if grid else times
    end = max(times) + 0.4
    got, (counts, rates) = run(spark, times, end), brute(times, end)
    assert [got[3, "Std", k]["count"] for k in range(len(counts))] == counts
    assert [got[3, "Std", k].rate for k in range(len(rates))] == pytest.approx(rates)


def test_items_and_contract(spark):
    table = stats.bus_statistics(local(spark, [(0, 1, 0.5, False, False, False, 1)], FRAMES), 5.5)
    items = stats.items(table)
    assert items.select("channel", "item").distinct().count() == 160
    assert items.where("channel = 1 and item_ordinal = 0 and k = 6").first().value == 1.0
    axis = stats.axis(spark, 5.5)
    assert compare.axis_contract(axis, axis).first().verdict == "equal"
    bent = axis.withColumn("t", F.when(F.col("k") == 3, F.col("t") + 0.1).otherwise(F.col("t")))
    assert compare.axis_contract(bent, axis).first().verdict == "broken"
    assert compare.axis_contract(axis, axis.where("k <> 4").withColumn("k", F.when(F.col("k") > 4, F.col("k") - 1).otherwise(F.col("k")))).first().verdict == "hole"
    with pytest.raises(ValueError):
        compare.check_layout(22, {"StdData": 30}, ["StdData"])
    with pytest.raises(ValueError):
        compare.check_layout(22, {}, ["StdData"])
