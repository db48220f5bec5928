"""The log source against the walk that states the format, and hand-made logs."""

import io
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canloom.sources import blf, blf_layout, blf_read
from tests import blf_factory as f


def rows_of(data, part):
    c, tail, latest = blf_read.parse(data, part)
    binary, words = blf_read.payloads(data, c)
    out = [
        blf_read.Frame(int(ch), int(ns), int(i), bool(x), bool(d), int(n), b, bool(r), bool(e))
        for ch, ns, i, x, d, n, b, r, e in zip(c.channel, c.abs_ns, c.arb_id, c.is_extended, c.is_fd, c.dlc, binary.to_pylist(), c.is_remote, c.is_error)
    ]
    for frame, w in zip(out, words.to_pylist()):
        assert b"".join(struct.pack("<q", x) for x in w)[: len(frame.data)] == frame.data
    return out, tail, latest


def same(data, part=250_000_000):
    try:
        want = blf_read.walk(data, part)
    except (ValueError, struct.error) as e:
        with pytest.raises(type(e)):
            blf_read.parse(data, part)
        return None
    assert rows_of(data, part) == want
    return want


payload = st.binary(max_size=8)
makers = st.one_of(
    st.builds(f.can, st.integers(0, 20), st.integers(0, 0x7FF), payload, st.integers(0, 10**10), st.booleans(), st.booleans(), kind=st.sampled_from([1, 86]), version=st.sampled_from([1, 2]), flags=st.sampled_from([1, 2, 3])),
    st.builds(f.can, st.integers(0, 3), st.just(5), payload, dlc=st.integers(0, 255)),
    st.builds(f.error, st.integers(0, 20), st.integers(0, 0x7FF), payload, st.integers(0, 10**9)),
    st.builds(f.fd, st.integers(0, 3), st.just(7), st.sampled_from([b"", b"x" * 12, b"LOBJ" * 16]), code=st.integers(0, 20)),
    st.builds(f.fd64, st.integers(0, 3), st.just(9), st.sampled_from([b"", b"y" * 8, b"z" * 48]), code=st.just(15), valid=st.integers(0, 255), ext_off=st.sampled_from([0, 50, 80, 255])),
    st.builds(f.obj, st.sampled_from([11, 65]), st.binary(max_size=30), st.integers(0, 10**11), version=st.sampled_from([1, 2])),
    st.builds(f.obj, st.just(1), st.binary(max_size=30), version=st.just(3)),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(makers, max_size=11), st.binary(max_size=11))
def test_parse_is_walk(objects, junk):
    same(b"".join(objects) + junk)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=60), st.just(b"LOBJ")), max_size=8))
def test_garbage(parts):
    same(b"".join(parts))


def test_gap_and_cut():
    a, b = f.can(0, 1, b"ab"), f.can(1, 2, b"cd")
    assert len(same(a + b"\x00" * 3 + b)[0]) == 2
    assert same(a + b[:-5])[1] == b[:-5]
    with pytest.raises(blf_layout.LogError):
        blf_read.walk(a + b"\x01" * 20, 0)
    assert same(f.can(0, 1, b"x", size=40)[:40])[1] != b""


def two_channels(path):
    first = f.can(1, 100, b"\xe8\x03", 0) + f.can(1, 100, b"\x88\x13", 10**9) + f.can(2, 100, b"\xaa\xbb", 5)
    second = f.can(1, 999, b"\x01", 2 * 10**9) + f.can(2, 0x456, b"\xcc\xdd", 6) + f.obj(11, b"mark", 3 * 10**9)
    whole = first + second
    return f.write(path, f.container(whole[:70]), f.container(whole[70:], blf_layout.STORED), f.container(b"skipped", 7))


def test_source(spark, tmp_path):
    path = two_channels(tmp_path / "a.BLF")
    rows = blf.frames(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.channel, r.arb_id, bytes(r.data), r.seq) for r in rows] == [(1, 100, b"\xe8\x03", 0), (1, 100, b"\x88\x13", 1), (2, 100, b"\xaa\xbb", 2), (1, 999, b"\x01", 3), (2, 0x456, b"\xcc\xdd", 4)]
    assert rows[1].abs_ns == 1_250_000_000 and rows[1].ts == float(1_250_000_000) * 1e-9
    assert blf.list_channels(spark, path) == [1, 2]
    info = blf.file_info(spark, path).first()
    assert info.max_obj_ns == 3_250_000_000 and info.ms_part_ns == 250_000_000 and info.n_containers == 2
    assert blf.read_start_time(path) == info.start_ns * 1e-9
    assert blf.frames(spark, path, [2]).count() == 2
    assert blf.frames(spark, path).where("channel = 1").count() == 3
    assert blf.frames(spark, path).where("channel in (2, 7)").count() == 2


def test_broken_files(spark, tmp_path):
    two_channels(tmp_path / "a.blf")
    (tmp_path / "b.blf").write_bytes(b"not a blf at all" * 8)
    with pytest.raises(Exception, match="unexpected file format"):
        blf.frames(spark, str(tmp_path)).count()
    assert blf.frames(spark, str(tmp_path), on_error="skip").count() == 5
    with pytest.raises(blf_layout.LogError):
        list(blf_read.batches(io.BytesIO(f.log(b"JUNK" * 8)), "x"))


def test_systemtime():
    assert blf_layout.systemtime_ns((2026, 7, 3, 22, 10, 0, 0, 250)) == 1784714400250 * 10**6
    assert blf_layout.systemtime_ns((0,) * 8) == 0 and np.int64(0) == 0


def test_chain_table_is_the_chain():
    rng = random.Random(6)
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(0, 8)):
            kind = rng.randrange(6)
            if kind == 0:
                parts.append(f.can(rng.randrange(4), 1, b"LOBJ" + b"x" * 4))
            elif kind == 1:
                parts.append(b"\0" * rng.randrange(0, 7))
            elif kind == 2:
                parts.append(f.can(1, 2, b"1", size=rng.choice([0, 3, 4, 17, 40, 5000])))
            else:
                parts.append(f.can(rng.randrange(4), 3, b"abc", version=rng.choice([1, 2])))
        data = b"".join(parts)
        data = data[: len(data) - rng.randrange(0, 30)] if rng.random() < 0.5 else data
        table, rest, why = blf_read.chain_table(data)
        objects, at, end = blf_read.chain(data)
        assert ([tuple(x) for x in table.tolist()], rest, why) == (objects, at, end)


def test_remote_paths(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    f.write(tmp_path / "sub" / "a.BLF", f.container(f.can(1, 5, b"ab", rel=7) + f.can(3, 6, b"c", rel=9)))
    own = blf.frames(spark, str(tmp_path)).drop("file").collect()
    away = blf._remote(spark, [str(tmp_path)], {}).drop("file").collect()
    assert own == away and len(own) == 2
    assert [r.channel for r in blf._remote(spark, [str(tmp_path)], {"mode": "channels"}).collect()] == [1, 3]


def in_parts(whole, each=1):
    """Rows of a log read in ranges of ``each`` bytes, and whether the split knows its end."""
    ranges = {"x": blf_read.index(io.BytesIO(whole), each)}
    surveys = []

    def ask(asked):
        surveys.append(asked)
        return {("x", r.first): blf_read.survey(io.BytesIO(whole), r) for r in asked["x"]}

    parts = blf.unpacked(blf.packed(blf.settled(ranges, ask).ranges))
    found = blf.settled(ranges, ask)
    assert parts == found.ranges
    rows = []
    for r in parts["x"]:
        rows += taken(whole, r)
    return rows, found, surveys


def taken(whole, r=None):
    """Rows in order; the error that ends them is the last."""
    rows = []
    try:
        for batch, _ in blf_read.batches(io.BytesIO(whole), "x", r):
            rows += batch.to_pylist()
    except (ValueError, struct.error) as e:
        rows.append(type(e))
    return rows


def containers_of(data, cuts):
    at = sorted({0, len(data), *(c % (len(data) + 1) for c in cuts)})
    return [data[a:b] for a, b in zip(at, at[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(makers, max_size=11), st.lists(st.integers(0, 2000), max_size=8), st.integers(1, 400), st.sampled_from([b"", b"", b"\x01" * 20]))
def test_ranges_are_the_log(objects, cuts, each, junk):
    """Objects cut anywhere, also over several containers, in ranges of any size; with objects that aren't containers between."""
    parts = containers_of(b"".join(objects) + junk, cuts)
    log = f.log(*(f.container(x, blf_layout.STORED) for x in parts[:1]), f.obj(65, b"outer"), *(f.container(x) for x in parts[1:]))
    want = taken(log)
    rows, found, _ = in_parts(log, each)
    assert rows == want
    if not (want and isinstance(want[-1], type)):
        start, latest, n = blf_read.extent(io.BytesIO(log))
        assert found.latest["x"] == latest and found.channels["x"] == blf_read.channels(io.BytesIO(log)) == {r["channel"] for r in want}


def test_a_seam_at_every_byte():
    """Two seams a byte apart, at all places of a chain of all kinds of objects."""
    data = f.can(1, 5, b"LOBJabcd", 7) + f.fd(2, 6, b"LOBJ" * 16, 8) + f.error(3, 7, b"ab", 9) + f.can(4, 8, b"x" * 8, 10)
    want = None
    for at in range(len(data)):
        log = f.log(f.container(data[:at]), f.container(data[at : at + 1]), f.container(data[at + 1 :]))
        rows, _, _ = in_parts(log)
        own = [{k: v for k, v in r.items() if k != "container"} for r in rows]
        want = want or own
        assert rows == taken(log) and own == want and len(rows) == 4


def test_wrong_guesses_are_found():
    """Payloads that look like objects mislead a guess; the survey is then made again, and most often it isn't needed."""
    false = f.can(9, 9, b"")[:16] + b"\x00" * 48
    data = b"".join(f.fd(i % 3, 7, false, i) for i in range(60))
    logs = [f.log(*(f.container(x) for x in containers_of(data, range(17, len(data), step)))) for step in (150, 1000)]
    rounds = [in_parts(log)[2] for log in logs]
    assert all(in_parts(log)[0] == taken(log) for log in logs) and max(map(len, rounds)) > 2
    plain = b"".join(f.can(i % 3, 7, b"abc", i) for i in range(500))
    log = f.log(*(f.container(x) for x in containers_of(plain, range(17, len(plain), 900))))
    rows, _, surveys = in_parts(log)
    assert rows == taken(log) and len(surveys) == 2  # one for each of two calls


def test_split_source(spark, tmp_path):
    data = b"".join(f.can(i % 5, 100 + i % 7, bytes([i % 256] * 8), 1000 * i) for i in range(4000)) + f.obj(65, b"later", 10**10)
    path = f.write(tmp_path / "long.blf", *(f.container(x) for x in containers_of(data, range(999, len(data), 1000))))
    small = two_channels(tmp_path / "small.blf")
    parts = blf.split(spark, str(tmp_path), 4000)
    assert len(parts.ranges[path]) > 5 and small not in parts.ranges and parts.latest == {path: 10_250_000_000}
    df = blf.frames(spark, str(tmp_path), parts=parts)
    assert df.rdd.getNumPartitions() == len(parts.ranges[path]) + 1
    order = ["file", "seq"]
    whole = blf.frames(spark, str(tmp_path), parts=blf.Split())
    assert df.orderBy(order).collect() == whole.orderBy(order).collect()
    assert df.where("channel = 3").count() == 800 and blf.frames(spark, path, [3], parts=parts).count() == 800
    assert blf.list_channels(spark, str(tmp_path)) == [0, 1, 2, 3, 4]


def test_split_of_a_broken_log(spark, tmp_path):
    """The fault is raised where it is, and what comes before it is kept by ``skip``, as by one reader."""
    data = [b"".join(f.can(i % 5, 7, b"ab", i) for i in range(j, j + 50)) for j in range(0, 1000, 50)]
    boxes = [f.container(x) for x in data]
    boxes[12] = boxes[12][:40] + bytes(len(boxes[12]) - 40)
    path = f.write(tmp_path / "a.blf", *boxes)
    parts = blf.split(spark, path, 600)
    assert parts.ranges[path][-1].first <= 12 and not parts.latest
    with pytest.raises(Exception, match="container of"):
        blf.frames(spark, path, parts=parts).count()
    assert blf.frames(spark, path, on_error="skip", parts=parts).count() == 600
    assert blf.frames(spark, path, on_error="skip", parts=blf.Split()).count() == 600
