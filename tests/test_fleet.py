"""A fleet of logs in one plan against single runs."""

import pytest
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.operators import fleet, stats
from canloom.operators import frames as fr
from canloom.sources import blf, dbc
from tests import blf_factory as f

CATALOG = """
BO_ 5 ABC: 8 E
 SG_ S : 0|8@1+ (1,0) [0|0] "" X
BO_ 6 DEF: 2 E
 SG_ T : 0|8@1+ (1,0) [0|0] "" X
 SG_ U : 8|8@1+ (1,0) [0|0] "" X
"""


def made(folder, n):
    """n logs of lengths of their own, off and on the millisecond grid; one without frames, and one that is broken."""
    for i in range(n):
        step = 137_000_000 + 1_000_000 * i + (123_457 if i % 3 == 0 else 0)
        objects = [f.can((j + i) % 3, 5 + j % 3, bytes([j % 256] * (8 - j % 4)), j * step) for j in range(10 + 7 * i)]
        f.write(folder / f"log{i:03d}.blf", f.container(b"".join(objects[: len(objects) // 2])), f.container(b"".join(objects[len(objects) // 2 :])))
    f.write(folder / "none.blf", f.container(f.obj(65, b"note", 0)))
    (folder / "bad.blf").write_bytes(f.log(f.container(f.can(0, 5, b"x" * 8, 1000)))[:-9] + b"junk")
    (folder / "empty.blf").write_bytes(b"")


def rows(df, *drop):
    return sorted(map(str, df.drop("file", *drop).collect()))


def test_many_logs_equal_single_runs(spark, tmp_path):
    made(tmp_path, 3)
    catalog = dbc.parse(CATALOG, "c.dbc")
    bound = local(spark, [(0, "c.dbc"), (1, "c.dbc"), (2, None), (4, "c.dbc")], "channel int, dbc string")
    got = fleet.read(spark, str(tmp_path), bound, [catalog])
    logs = {r.file.rpartition("/")[2]: r for r in got.logs.collect()}
    assert len(logs) == 6 and {n for n, r in logs.items() if r.error} == {"bad.blf", "empty.blf"}
    assert got.summary.count() == 4 * 4 and got.statistics.where("file like '%none.blf'").count() == 80 * 2
    for name in [f"log{i:03d}.blf" for i in range(3)] + ["none.blf"]:
        path = str(tmp_path / name)
        frames, end = blf.frames(spark, path), logs[name].max_obj_ns * 1e-9
        classified = fr.classify(frames, bound, dbc.messages_table(spark, [catalog]))
        groups = fr.group_names(fr.buckets(classified))
        mine = lambda df, path=path: df.where(F.col("file") == path)
        assert rows(mine(got.statistics)) == rows(stats.bus_statistics(frames, end))
        assert rows(mine(got.groups)) == rows(groups)
        assert rows(mine(got.summary)) == rows(fr.ingest_summary(bound, classified, fleet.signal_counts(spark, [catalog])))
        assert [r.duration_seconds for r in mine(got.durations).collect()] == ([] if name == "none.blf" else [fr.duration(groups).first()[0]])


def test_on_error(spark, tmp_path):
    made(tmp_path, 1)
    with pytest.raises(Exception, match="PythonException|LogError|unexpected file format"):
        blf.file_info(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="onError"):
        blf.frames(spark, str(tmp_path), on_error="row").collect()
    remote = blf._remote(spark, [str(tmp_path)], {"mode": "file_info", "onError": "row"})
    assert sorted(r.file.rpartition("/")[2] for r in remote.where("error is not null").collect()) == ["bad.blf"]  # Spark leaves empty files out
