"""The jobs: growing input, reruns, failures on the way, rows of every state, command lines."""

import datetime
import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from canloom.plans import job_queries
from jobs import bus_archive, text_payloads
from jobs.common import read_config, write

EVENTS = "/root/testdata/sf0.001/events.parquet"
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
ARCHIVE, PAYLOADS = job_queries.config(bus_archive), job_queries.config(text_payloads)


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.fixture(scope="module")
def parts(spark):
    """The events in three parts: later days do not only come later."""
    e = spark.read.parquet(EVENTS)
    e = e.where(F.col("ts") < e.agg(F.min("ts")).first()[0] + datetime.timedelta(days=3))
    odd = e.limit(1).select(*(F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns))
    odd = odd.unionByName(e.limit(1).withColumn("user_id", F.lit(None).cast("long")).withColumn("event_type", F.lit("new")).withColumn("event_id", F.lit(9_000_001)))
    split = F.when(F.col("event_id") % 10 < 6, 0).when(F.col("event_id") % 10 < 9, 1).otherwise(2)
    return [e.where(split == 0), e.where(split == 1).unionByName(odd), e.where(split == 2)]


def test_archive_takes_only_what_is_new(spark, parts, tmp_path, caplog):
    source, out, at_once = (str(tmp_path / n) for n in ("in", "out", "once"))
    parts[0].coalesce(1).write.mode("append").parquet(source)
    first = bus_archive.run(spark, source, out, ARCHIVE)
    assert [r["read"] for r in first] == [parts[0].count()]
    for part in parts[1:]:
        part.coalesce(1).write.mode("append").parquet(source)
    with caplog.at_level(logging.INFO, logger="jobs"):
        second = bus_archive.run(spark, source, out, ARCHIVE)
    assert sum(r["read"] for r in second) == parts[1].count() + parts[2].count() and sum(r["undated"] for r in second) == 1
    assert f"from {source}" in caplog.text and f"rows to {out}/statistics" in caplog.text
    before = rows(bus_archive.whole(spark, out))
    assert bus_archive.run(spark, source, out, ARCHIVE) == [] and rows(bus_archive.whole(spark, out)) == before
    bus_archive.run(spark, source, at_once, ARCHIVE | {"files_per_batch": 1})
    assert rows(bus_archive.whole(spark, at_once)) == before
    assert [r.batch for r in spark.read.parquet(f"{out}/runs").orderBy("batch").collect()] == [0, 1]
    assert spark.read.parquet(f"{out}/frames").where("channel is null").count() == 1


def test_archive_goes_on_after_a_failure(spark, parts, tmp_path, monkeypatch):
    source, out, at_once = (str(tmp_path / n) for n in ("in", "out", "once"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    settings = ARCHIVE | {"files_per_batch": 2}

    def failing(name):
        def broken(df, path, *rest):
            if path.endswith(name) and spark.read.parquet(f"{out}/frames").where("batch = 1").limit(1).count():
                raise RuntimeError("lost")
            return write(df, path, *rest)

        return broken

    for name in ("samples", "groups", "runs"):
        with monkeypatch.context() as m:
            m.setattr(bus_archive, "write", failing(name))
            with pytest.raises(Exception, match="lost"):
                bus_archive.run(spark, source, out, settings)
    assert [r["batch"] for r in bus_archive.run(spark, source, out, settings)] == [1]
    bus_archive.run(spark, source, at_once, ARCHIVE)
    assert rows(bus_archive.whole(spark, out)) == rows(bus_archive.whole(spark, at_once))


def texts(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, channel string")


def test_payloads_give_back_the_texts(spark, tmp_path):
    long = "é€😀" * 40_000
    data = [(0, None, "en", "a", ""), (1, "", "de", None, ""), (2, "x" * 64, "fr", "a", ""), (3, "x" * 65 + "\0\0", "en", None, ""), (None, "no id", "en", "a", "clash"), (14, "repeated", "de", "a", ""), (14, "repeated", "de", "a", ""), (5, "unknown", "xx", "a", ""), (6, "null", None, "a", ""), (-7, long, "en", "a", "")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts(spark, data).repartition(3).write.parquet(source)
    text_payloads.run(spark, source, out, PAYLOADS)
    got = spark.read.parquet(f"{out}/payloads").collect()
    said, longest = {}, {}
    for r in got:
        longest[r.channel] = max(longest.get(r.channel, 0), r.dlc)
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.part)):
        said[r.doc_id] = said.get(r.doc_id, b"") + bytes(r.data)[: r.dlc]
        assert len(r.data) == longest[r.channel] and r.group_name == f"Raw::CAN{r.channel}"
    assert said == {2: b"x" * 64, 3: b"x" * 65, None: b"no id", 14: b"repeated" * 2, -7: long.encode()}
    listed = {r.doc_id: r for r in spark.read.parquet(f"{out}/texts").collect()}
    assert len(listed) == 9 and [listed[k].exported for k in (0, 1, 2, 5, 6)] == [False, False, True, False, False]
    assert listed[-7].n_frames == -(-len(long.encode()) // 64) and listed[-7].channel == 5 and listed[5].id == PAYLOADS["other"]
    before = rows(text_payloads.whole(spark, out))
    text_payloads.run(spark, source, out, PAYLOADS)
    assert rows(text_payloads.whole(spark, out)) == before


def test_a_rerun_replaces_all(spark, tmp_path):
    source, less, out = (str(tmp_path / n) for n in ("in", "less", "out"))
    spark.read.parquet(DOCUMENTS).write.parquet(source)
    spark.read.parquet(DOCUMENTS).where("doc_id % 12 < 3").write.parquet(less)
    text_payloads.run(spark, source, out, PAYLOADS)
    assert spark.read.parquet(f"{out}/texts").select("channel").distinct().count() == 12
    text_payloads.run(spark, less, out, PAYLOADS)
    assert spark.read.parquet(f"{out}/texts").select("channel").distinct().count() == 3
    texts(spark, []).write.parquet(f"{source}0")
    text_payloads.run(spark, f"{source}0", f"{out}0", PAYLOADS)
    assert text_payloads.whole(spark, f"{out}0").count() == 0


def test_settings_stay_as_they_were(spark, tmp_path):
    before = spark.sql("SET").collect()
    text_payloads.run(spark, DOCUMENTS, str(tmp_path / "out"), PAYLOADS)
    assert spark.sql("SET").collect() == before
    assert bus_archive.as_pattern("s3a://b/in/events.parquet/") == "s3a://b/in/{events.parquet}" and bus_archive.as_pattern("/in/*.parquet") == "/in/*.parquet"


@pytest.mark.parametrize("job, source", [("bus_archive", EVENTS), ("text_payloads", DOCUMENTS)])
def test_command_lines(spark, tmp_path, job, source):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = str(tmp_path / "out")
    line = [sys.executable, "-m", f"jobs.{job}", "--source", source, "--out", out, "--config", f"{root}/jobs/{job}.json"]
    done = subprocess.run(line, cwd=root, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.sql.session.timeZone=UTC pyspark-shell"}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert f"from {source}" in done.stderr and "wrote" in done.stderr
    module = {"bus_archive": bus_archive, "text_payloads": text_payloads}[job]
    assert module.whole(spark, out).limit(1).count() == 1
    assert read_config(spark, f"{root}/jobs/{job}.json") == json.load(open(f"{root}/jobs/{job}.json"))


def test_days_are_utc(spark):
    moment = datetime.datetime(2024, 2, 29, 23, 59, 59, 999_999)
    e = spark.createDataFrame([(1, moment, 3, "click", 1.5, '{"k": 2}')], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    r = bus_archive.day_frames(e).first()
    assert r.day == "2024-02-29" and r.abs_ns == (86_399_999_999 // 4320) * 1000 and r.channel == 3
