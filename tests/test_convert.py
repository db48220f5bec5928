"""Logs to measurements end to end, failures without residue, batches, cross-checks, resolution and the stream."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from canloom.operators import convert, decode, fleet, sink, stats
from canloom.operators import frames as fr
from canloom.sources import blf, dbc, resolver
from canloom.sources.resolver import Cancelled
from canloom.streaming import per_second
from tests import blf_factory as f

ABC = """
BO_ 100 ABC: 2 ECU
 SG_ Speed : 0|16@1+ (0.01,0) [0|0] "km/h" X
BO_ 300 MUX: 3 ECU
 SG_ Mode M : 0|8@1+ (1,0) [0|0] "" X
 SG_ A m0 : 8|8@1+ (0.5,0) [0|0] "" X
 SG_ B m1 : 8|8@1- (1,0) [0|0] "" X
"""
SEC = 10**9


def rich(path, start=f.START):
    payload = b"".join(
        [
            f.can(1, 100, b"\xe8\x03", 0), f.can(1, 100, b"\x88\x13", SEC), f.can(1, 999, b"\x01", 2 * SEC), f.can(1, 100, b"\x01", 2 * SEC),
            f.can(1, 300, b"\x00\x08\x00", 2 * SEC), f.can(1, 300, b"\x01\xff\x00", 2 * SEC), f.can(1, 300, b"\x02\xff\x00", 2 * SEC),
            f.can(2, 100, b"\x10\x00", SEC // 2), f.can(4, 100, b"\xee\xff", SEC), f.fd(4, 0x777, b"x" * 12, SEC), f.obj(11, b"end", 4 * SEC + 500_000_000),
        ]
    )
    return f.write(path, f.container(payload[:100]), f.container(payload[100:]), start=start)


@pytest.fixture(scope="module")
def catalog(tmp_path_factory):
    path = tmp_path_factory.mktemp("dbc") / "ABC.dbc"
    path.write_text(ABC)
    return dbc.load(str(path))


def test_convert(spark, tmp_path, catalog):
    src, out = rich(tmp_path / "a.blf"), str(tmp_path / "deep" / "er" / "a_t.mdf")
    seen = []
    r = convert.convert(spark, src, {1: catalog, 2: catalog, 4: None, 7: catalog}, out, lambda s, p: seen.append(p), raw_export=True)
    assert seen == sorted(seen) and seen[-1] == 100
    by = {s["channel"]: s for s in r.summaries}
    assert (by[1]["decoded_frames"], by[1]["unknown_frames"], by[1]["unknown_ids"], by[1]["signal_count"]) == (4, 3, 3, 4)
    assert by[2]["decoded_frames"] == 1 and by[7]["warning"] == "NO_FRAMES" and by[4]["raw_frames"] == 1 and by[4]["unknown_frames"] == 1
    assert [(g["group_name"], g["channel"], g["n_frames"]) for g in r.groups] == [("ABC", 1, 2), ("MUX", 1, 2), ("CAN2::ABC", 2, 1)]
    assert r.duration_seconds == pytest.approx(2.0)
    speed = sink.read_group(spark, out, "ABC").orderBy("seq").collect()
    assert [(x.ts, x.Speed) for x in speed] == [(0.25, 10.0), (1.25, 50.0)]
    mux = sink.read_group(spark, out, "MUX").orderBy("seq").collect()
    assert (mux[0].Mode, mux[0].A, mux[0].B) == (0, 4.0, 0) and mux[1].B == -1 and mux[1].A != mux[1].A
    raw = spark.read.parquet(f"{out}/raw").collect()
    assert [(x.id, bytes(x.data), x.channel) for x in raw] == [(100, b"\xee\xff", 4)]
    st = spark.read.parquet(f"{out}/stats")
    assert st.count() == 16 * 10 * 6 and st.where("channel = 1 and item = 'StdData' and k = 5").first().value == 7
    assert st.agg(F.max("t")).first()[0] == 4.75
    m = sink.read_manifest(spark, out)
    assert m["raw_groups"] == ["Raw::CAN4"] and m["start_ns"] == 1784714400250 * 10**6
    assert not list(Path(out).glob("_frames*")) and [p.name for p in Path(out).parent.iterdir()] == ["a_t.mdf"]


def test_unbound_only_and_no_binding(spark, tmp_path):
    src = rich(tmp_path / "a.blf")
    with pytest.raises(ValueError):
        convert.convert(spark, src, {}, str(tmp_path / "o"))
    r = convert.convert(spark, src, {1: None}, str(tmp_path / "o"))
    assert r.groups == [] and r.duration_seconds == 0.0
    assert spark.read.parquet(f"{tmp_path}/o/stats").select("channel", "item").distinct().count() == 160


def test_no_residue(spark, tmp_path, catalog):
    src, bad = rich(tmp_path / "a.blf"), tmp_path / "b.blf"
    bad.write_bytes(b"not a blf at all" * 8)
    with pytest.raises(Exception, match="file format"):
        convert.convert(spark, str(bad), {1: catalog}, str(tmp_path / "x" / "y" / "b"))
    assert not (tmp_path / "x").exists()
    out = tmp_path / "kept"
    convert.convert(spark, src, {1: catalog}, str(out))
    before = (out / "manifest.json").read_text()
    with pytest.raises(Exception, match="file format"):
        convert.convert(spark, str(bad), {1: catalog}, str(out))
    calls = []
    with pytest.raises(Cancelled):
        convert.convert(spark, src, {1: catalog}, str(out), cancel_cb=lambda: calls.append(1) or len(calls) > 1)
    assert (out / "manifest.json").read_text() == before
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.blf", "b.blf", "kept"]


def test_cancel_while_jobs_run(spark, tmp_path, catalog, monkeypatch):
    """A job that would go on for a minute is interrupted; nothing is left."""
    src, told = rich(tmp_path / "a.blf"), []

    def long_job(self):
        told.append(time.perf_counter())
        self.spark.range(8).repartition(4).mapInPandas(lambda it: [time.sleep(60) or x for x in it], "id long").count()

    monkeypatch.setattr(convert.sink.Measurement, "samples", long_job)
    with pytest.raises(Cancelled):
        convert.convert(spark, src, {1: catalog}, str(tmp_path / "out" / "m"), cancel_cb=lambda: bool(told) and time.perf_counter() > told[0] + 1)
    assert time.perf_counter() - told[0] < 20 and [p.name for p in tmp_path.iterdir()] == ["a.blf"]


def test_a_stage_is_told_when_it_begins(spark, tmp_path, catalog):
    """90, 92 and 95 come while the tables they are about aren't there yet."""
    src, seen = rich(tmp_path / "a.blf"), {}

    def say(stage, percent):
        seen.setdefault((stage, percent), {p.name for d in tmp_path.glob("m.part-*") for p in d.iterdir()})

    convert.convert(spark, src, {1: catalog}, str(tmp_path / "m"), say)
    assert [p for _, p in seen] == sorted(p for _, p in seen)
    assert "samples" in seen["statistics", 90] and "stats" not in seen["statistics", 90]
    assert "stats" in seen["metadata", 92] and "summary" not in seen["metadata", 92]
    assert "summary" in seen["write", 95] and "manifest.json" not in seen["write", 95]


def test_series_agree_with_frames(spark, tmp_path, catalog):
    """What a conversion derives from series is what the operators over frames give."""
    src = rich(tmp_path / "a.blf")
    frames = blf.frames(spark, src)
    for bound in ({1: catalog, 2: catalog, 4: None, 7: catalog}, {1: None, 4: None}, {4: catalog}):
        catalogs = [catalog] if any(bound.values()) else []
        bindings, messages = convert.bindings_table(spark, bound), dbc.messages_table(spark, catalogs)
        plan = decode.plan_table(spark, catalogs)
        classified = decode.routed_frames(fr.classify(frames, bindings, messages), plan)
        found = fr.series(decode.routed_frames(fr.labelled(frames, bindings, messages), plan))
        sizes = fleet.signal_counts(spark, catalogs)
        rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
        assert rows(fr.series_groups(found).drop("dbc", "on_grid")) == rows(fr.buckets(classified))
        raw, exported = fr.raw_frames(frames, bindings, messages), fr.exported_series(found, bindings, messages)
        for r, e in ((None, None), (raw, exported)):
            assert rows(fr.series_summary(found, bindings, sizes, e)) == rows(fr.ingest_summary(bindings, classified, sizes, r))


def test_batch_and_cross_check(spark, tmp_path, catalog):
    for n in ("one", "two"):
        rich(tmp_path / f"{n}.blf")
    (tmp_path / "bad.BLF").write_bytes(b"x" * 200)
    found = resolver.resolve([tmp_path])
    assert [c.display for c in found] == ["bad.BLF", "one.blf", "two.blf"]
    steps = []
    r = convert.run_batch(spark, found, {1: catalog, 2: catalog}, progress_cb=lambda s, p: steps.append(p))
    assert [o.ok for o in r.outcomes] == [False, True, True] and len(r.failures) == 1 and not r.all_succeeded
    assert steps == sorted(steps)
    a, b = (str(c.output) for c in found[1:])
    assert convert.differences(spark, a, b).count() == 0
    assert convert.differences(spark, a, b, exact=False).count() == 0
    other = str(tmp_path / "other")
    rich(tmp_path / "c.blf", start=(2026, 7, 3, 22, 10, 0, 0, 251))
    convert.convert(spark, str(tmp_path / "c.blf"), {1: catalog}, other)
    dims = {x.dimension for x in convert.differences(spark, a, other).collect()}
    assert dims == {"header", "structure", "values", "stats"}
    with pytest.raises(ValueError):
        convert.differences(spark, a, b, dims={"nothing"})
    todo, skipped = convert.to_convert(found, overwrite=False)
    assert [c.display for c in todo] == ["bad.BLF"] and len(skipped) == 2
    with pytest.raises(convert.BatchCancelled) as e:
        calls = []
        convert.run_batch(spark, found, {1: catalog}, cancel_cb=lambda: calls.append(1) or len(calls) > 2)
    assert [o.ok for o in e.value.outcomes] in ([], [False])  # what had ended by then


def test_resolve(tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for n in ("d/b.blf", "d/sub/a.BLF", "d/note.txt", "loose.blf"):
        (tmp_path / n).write_bytes(b"1234")
    (tmp_path / "alias.blf").symlink_to(tmp_path / "d/b.blf")
    got = resolver.resolve([tmp_path / "d/b.blf", tmp_path / "loose.blf", tmp_path / "d", tmp_path / "gone", tmp_path / "alias.blf"])
    rel = [(c.display, str(c.output.relative_to(tmp_path)), c.size) for c in got]
    assert rel == [("b.blf", "d_t/b_t.mdf", 4), ("loose.blf", "loose_t.mdf", 4), ("sub/a.BLF", "d_t/sub/a_t.mdf", 4)]
    assert resolver.resolve([tmp_path / "d/note.txt"]) == []
    with pytest.raises(Cancelled):
        resolver.resolve([tmp_path], cancel_cb=lambda: True)


def test_stream_equals_batch(spark, tmp_path):
    src = rich(tmp_path / "a.blf")
    start = blf.file_info(spark, src).first().start_ns
    frames = blf.frames(spark, src).withColumn("start_ns", F.lit(start))
    frames.write.parquet(f"{tmp_path}/frames")
    live = per_second.with_event_time(spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/frames"))
    q = per_second.bucket_counts(live).writeStream.format("memory").queryName("live_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.channel, r["class"], r.k): r.n_frames for r in spark.sql("select channel, class, k, sum(n_frames) n_frames from live_counts group by all").collect()}
    end = blf.file_info(spark, src).first().max_obj_ns * 1e-9
    batch = {(r.channel, r["class"], r.k): r["count"] for r in stats.bus_statistics(blf.frames(spark, src), end).collect()}
    assert all(batch[c, x, k] - batch[c, x, k - 1] == n for (c, x, k), n in got.items()) and sum(got.values()) == 10
