"""Many logs converted in one plan: what each log's own conversion gives, and differences of two fleets."""

import pickle
import shutil

from pyspark.sql import functions as F

from canloom.operators import convert, sink
from canloom.sources import blf, dbc, resolver
from tests import blf_factory as f
from tests.test_convert import ABC, rich

CATALOG = dbc.parse(ABC, "ABC.dbc")
BOUND = {1: CATALOG, 2: CATALOG, 7: CATALOG}


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_a_fleet_is_its_logs(spark, tmp_path):
    """All tables of each log, as ``convert`` writes them; a log that can't be read is a row, and jobs don't multiply with logs."""
    for n in range(3):
        rich(tmp_path / f"l{n}.blf", start=(2026, 7, 3, 22, 10, 0, 0, 250 + n))
    (tmp_path / "bad.blf").write_bytes(b"x" * 200)
    found = resolver.resolve([tmp_path])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fleet", "fleet")
    done = {r.log: r for r in convert.run_fleet(spark, found, BOUND, str(tmp_path / "fleet")).collect()}
    assert [bool(done[i].error) for i in range(4)] == [True, False, False, False]
    few = len(tracker.getJobIdsForGroup("fleet"))
    spark.sparkContext.setJobGroup("more", "more")
    convert.run_fleet(spark, found * 5, BOUND, str(tmp_path / "more"))
    assert len(tracker.getJobIdsForGroup("more")) <= few + 3
    spark.sparkContext.setJobGroup("rest", "rest")
    samples, summary = sink.read_fleet_samples(spark, str(tmp_path / "fleet")), spark.read.parquet(f"{tmp_path}/fleet/summary")
    own = lambda df, i: df.where(F.col("log") == i)
    for i, c in enumerate(found[1:], 1):
        one = str(tmp_path / f"one{i}")
        r = convert.convert(spark, str(c.blf), BOUND, one)
        assert done[i].start_ns == sink.read_manifest(spark, one)["start_ns"]
        columns = ["group_ordinal", "group_name", "signal", "seq", "ts", "value", "dtype"]
        assert rows(own(samples, i), *columns) == rows(sink.read_samples(spark, one), *columns)
        columns = list(r.summaries[0])
        assert rows(own(summary, i), *columns) == rows(spark.read.parquet(f"{one}/summary"), *columns)
        columns = ["ordinal", "item", "k", "t", "value"]
        assert rows(own(convert.compare_stats.of_fleet(spark, str(tmp_path / "fleet")), i), *columns) == rows(convert.compare_stats.of_folder(spark, one), *columns)
        columns = ["group_ordinal", "group_name", "signal", "position", "unit", "dtype", "conversion"]
        assert rows(own(sink.read_fleet_metadata(spark, str(tmp_path / "fleet")), i), *columns) == rows(sink.read_metadata(spark, one), *columns)
    assert {r["log"] for r in samples.select("log").distinct().collect()} == {1, 2, 3}
    assert not list((tmp_path / "fleet").glob("_frames*"))


def test_differences_of_fleets(spark, tmp_path):
    """Each dimension's difference is found in the log that has it, and in no other."""
    for n in range(4):
        rich(tmp_path / f"l{n}.blf")
    found, a, b = resolver.resolve([tmp_path]), str(tmp_path / "a"), str(tmp_path / "b")
    convert.run_fleet(spark, found, BOUND, a)
    shutil.copytree(a, b)
    both = lambda: [convert.fleet_differences(spark, a, b, exact=e) for e in (True, False)]
    assert [d.count() for d in both()] == [0, 0]

    def change(table, column, value):
        out = spark.read.parquet(f"{a}/{table}").withColumn(column, value)
        out.write.mode("overwrite").parquet(f"{b}/{table}")
        spark.catalog.refreshByPath(b)

    log, x = F.col("log"), F.col("value")
    change("samples", "value", F.when((log == 1) & (F.col("signal") == "Speed") & (F.col("seq") == 1), x + 1).otherwise(x))
    change("stats", "rate", F.when((log == 2) & (F.col("k") == 2), F.col("rate") + 1).otherwise(F.col("rate")))
    change("channels", "unit", F.when((log == 3) & (F.col("signal") == "Speed"), "mph").otherwise(F.col("unit")))
    change("logs", "start_ns", F.when(log == 0, 1).otherwise(F.col("start_ns")))
    for d in both():
        assert {(r.log, r.dimension) for r in d.collect()} == {(0, "header"), (1, "values"), (2, "stats"), (3, "structure")}
        assert all("\x1e" not in r.label + r.detail for r in d.collect())


def test_small_logs_share_tasks(spark, tmp_path):
    """Logs and ranges beyond some for each core are read together, and no task is sent the list of all."""
    data = b"".join(f.can(i % 5, 100 + i % 7, bytes([i % 256] * 8), 1000 * i) for i in range(300))
    for n in range(120):
        f.write(tmp_path / f"s{n:03d}.blf", f.container(data[:3000]), f.container(data[3000:7001]), f.container(data[7001:]))
    parts = blf.split(spark, str(tmp_path), 50)
    assert sum(map(len, parts.ranges.values())) == 360
    df = blf.frames(spark, str(tmp_path), parts=parts)
    assert df.rdd.getNumPartitions() <= blf.WAVES * spark.sparkContext.defaultParallelism * 1.5
    got = df.groupBy("file").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.countDistinct("seq").alias("d")).collect()
    assert len(got) == 120 and {(r.n, r.last, r.d) for r in got} == {(300, 299, 300)}
    reader = blf.BlfReader({"path": str(tmp_path), "ranges": blf.packed(parts.ranges), "tasks": "16"})
    assert len(pickle.dumps(reader)) < 2000 and sum(len(p.pieces) for p in reader.partitions()) == 360
