"""MDF files: round trips, and a converted log."""

import io
import struct
import zlib

import numpy as np
import pytest

from canloom import cli
from canloom.operators import compare_stats, convert, export, sink, verify
from canloom.sources import dbc, mdf
from tests.test_convert import ABC, rich


def test_round_trip():
    t = np.array([0.0, 0.5, 1.109])
    groups = [
        mdf.Group("A", t, [mdf.Channel("x", np.array([1, 2, 300], "<u2"), "V"), mdf.Channel("y", np.array([-1, 2, 3], "i1"), choices={0: "off", 1: "ön"}, scale=0.1, offset=-50.0, default_unit="degC"), mdf.Channel("z", np.array([0.5, np.nan, 2]), "m")]),
        mdf.Group("Raw::CAN4", t[:2], [mdf.Channel("Data", np.arange(16, dtype=np.uint8).reshape(2, 8))]),
        mdf.Group("empty", t[:0], [mdf.Channel("u", np.empty(0, "<u8"))]),
    ]
    f = io.BytesIO()
    mdf.write(f, 1784714400250 * 10**6, groups)
    data = f.getvalue()
    assert data[:16] == b"MDF     4.10    " and struct.unpack_from("<H", data, 28)[0] == 410
    assert data[64:68] == b"##HD" and struct.unpack_from("<Q", data, 64 + 8)[0] == 104
    start, got = mdf.read(data)
    assert start == 1784714400250 * 10**6 and [g.name for g in got] == ["A", "Raw::CAN4", "empty"]
    for g, h in zip(groups, got):
        assert (g.times == h.times).all()
        for c, d in zip(g.channels, h.channels):
            assert (c.name, c.unit, c.choices) == (d.name, d.unit, d.choices) and np.array_equal(c.samples, d.samples, equal_nan=c.samples.dtype.kind == "f") and c.samples.dtype == d.samples.dtype
    y = got[0].channels[1]
    assert (y.scale, y.offset, y.default_unit) == (0.1, -50.0, "degC")
    with pytest.raises(ValueError):
        mdf.read(b"junk" * 40)


def test_blocks_are_linked_and_aligned():
    f = io.BytesIO()
    mdf.write(f, 0, [mdf.Group(str(i), np.zeros(i), [mdf.Channel("c", np.zeros(i, "u1"))]) for i in range(5)])
    data = f.getvalue()
    at, n = 64, 0
    sizes = {"HD": 104, "CG": 104, "CN": 160, "DG": 64}
    while at < len(data):
        kind, links, body = mdf._read_block(data, at)
        size = struct.unpack_from("<Q", data, at + 8)[0]
        assert data[at : at + 2] == b"##" and size == sizes.get(kind, size) and all(x % 8 == 0 and x < len(data) for x in links)
        at += size + -size % 8
        n += 1
    assert at == len(data) and n > 20


def test_export(spark, tmp_path, monkeypatch):
    src = rich(tmp_path / "a.blf")
    c = dbc.parse(ABC, str(tmp_path / "ABC.dbc"))
    folder = str(tmp_path / "m")
    convert.convert(spark, src, {1: c, 2: c, 4: None}, folder, raw_export=True)
    out = tmp_path / "x" / "a_t.mdf"
    export.write_mdf(spark, folder, str(out))
    start, groups = mdf.read(out.read_bytes())
    assert start == 1784714400250 * 10**6 and len(groups) == 3 + 1 + 160
    by = {g.name: g for g in groups[:4]}
    assert list(by["ABC"].channels[0].samples) == [10.0, 50.0] and list(by["ABC"].times) == [0.25, 1.25] and by["ABC"].channels[0].unit == "km/h"
    mux = {x.name: x.samples for x in by["MUX"].channels}
    assert mux["Mode"].dtype == np.uint8 and mux["B"].tolist() == [0, -1] and mux["B"].dtype == np.int8 and np.isnan(mux["A"][1])
    assert by["Raw::CAN4"].channels[2].samples.tolist() == [[0xEE, 0xFF]]
    assert [g.channels[0].name for g in groups[4:14]][:2] == ["StdData", "StdDataRate"] and len(groups[4].times) == 6
    before = out.read_bytes()
    monkeypatch.setattr(export, "STRETCH", 1)  # a block for each record, also of groups of signals
    export.write_mdf(spark, folder, str(tmp_path / "parts.mdf"))
    data = (tmp_path / "parts.mdf").read_bytes()
    assert data.count(b"##DL") > 160 > before.count(b"##DL")
    for a, b in zip(groups, mdf.read(data)[1], strict=True):
        assert a.name == b.name and a.times.tolist() == b.times.tolist() and len(a.channels) == len(b.channels)
        assert all(x.name == y.name and x.samples.tobytes() == y.samples.tobytes() for x, y in zip(a.channels, b.channels))
    with pytest.raises(Exception):
        export.write_mdf(spark, str(tmp_path / "gone"), str(out))
    with pytest.raises(Exception):
        export.write_mdf(spark, str(tmp_path / "gone"), str(tmp_path / "y" / "z" / "b.mdf"))
    assert out.read_bytes() == before and not (tmp_path / "y").exists()


def test_compressed_and_listed_records(monkeypatch):
    monkeypatch.setattr(mdf, "DEFLATED", 1000)
    t = np.arange(700) * 0.01
    g = mdf.Group("big", t, [mdf.Channel("x", np.arange(700, dtype="<i4")), mdf.Channel("y", np.sin(t))])
    plain, packed = io.BytesIO(), io.BytesIO()
    mdf.write(plain, 5, [g], compress=False)
    mdf.write(packed, 5, [g, g])
    kinds = {mdf._read_block(packed.getvalue(), i)[0] for i in range(0, len(packed.getvalue()) - 24, 8) if packed.getvalue()[i : i + 2] == b"##"}
    assert {"HL", "DL", "DZ"} <= kinds and len(packed.getvalue()) < 2 * len(plain.getvalue())
    for data in (plain.getvalue(), packed.getvalue()):
        for h in mdf.read(data)[1]:
            assert (h.times == t).all() and (h.channels[0].samples == np.arange(700)).all() and (h.channels[1].samples == np.sin(t)).all()


def test_transposed_block():
    raw = bytes(range(100)) + b"rest"
    packed = zlib.compress(np.frombuffer(raw[:100], np.uint8).reshape(10, 10).T.tobytes() + raw[100:])
    f = io.BytesIO(bytes(8))
    f.seek(8)
    at = mdf._File(f).block("DZ", [], struct.pack("<2sBBIQQ", b"DT", 1, 0, 10, len(raw), len(packed)) + packed)
    assert mdf._read_records(f.getvalue(), at) == raw


def test_samples_of_any_width_and_order():
    raw = np.frombuffer(struct.pack("<HB", 0b1010_1100_1111_0101, 0xF0) * 3, np.uint8).reshape(3, 3)
    assert mdf._samples(raw, 0, 0, 2, 10).tolist() == [(0b1010_1100_1111_0101 >> 2) & 1023] * 3
    assert mdf._samples(raw, 2, 2, 4, 4).tolist() == [-1] * 3
    assert mdf._samples(raw, 1, 0, 0, 16).tolist() == [int.from_bytes(raw[0, :2].tobytes(), "big")] * 3
    assert mdf._samples(raw, 3, 0, 0, 24).tolist() == [int.from_bytes(raw[0].tobytes(), "big", signed=True)] * 3


def test_compare_with_a_file_of_another_tool(spark, tmp_path):
    src = rich(tmp_path / "a.blf")
    c = dbc.parse(ABC, str(tmp_path / "ABC.dbc"))
    folder, own = str(tmp_path / "m"), tmp_path / "own.mdf"
    convert.convert(spark, src, {1: c, 2: c}, folder)
    export.write_mdf(spark, folder, str(own))
    start, groups = mdf.read(own.read_bytes())
    for g in groups:
        if g.name != "1s":  # statistics have groups of one name in every tool's file
            g.name = f"CAN::{g.name}"
    for name, change in (("same", 0.0), ("other", 1.0)):
        groups[0].channels[0].samples = groups[0].channels[0].samples + change
        with open(tmp_path / f"{name}.mdf", "wb") as f:
            mdf.write(f, start, groups)
    same = convert.differences(spark, str(own), str(tmp_path / "same.mdf"), exact=False).collect()
    assert {(r.dimension, r.detail.split("CAN")[0]) for r in same} == {("structure", "is named ")}
    assert convert.differences(spark, folder, str(own), exact=False).where("dimension = 'values'").collect() == []
    other = convert.differences(spark, str(own), str(tmp_path / "other.mdf"), exact=False).where("dimension = 'values'").collect()
    assert len(other) == 1 and other[0].label.endswith(groups[0].channels[0].name)


def test_folder_and_file_have_the_same_samples(spark, tmp_path, monkeypatch):
    src = rich(tmp_path / "a.blf")
    c = dbc.parse(ABC, str(tmp_path / "ABC.dbc"))
    folder, own = str(tmp_path / "m"), str(tmp_path / "own.mdf")
    convert.convert(spark, src, {1: c, 2: c, 4: None}, folder, raw_export=True)
    export.write_mdf(spark, folder, own)
    monkeypatch.setattr(sink, "BLOCK", 3)  # series of several blocks
    for exact in (True, False):
        assert convert.differences(spark, folder, own, exact=exact).collect() == []
        assert convert.differences(spark, own, folder, exact=exact).collect() == []
    assert verify.passes(spark, folder, own) and verify.passes(spark, own, folder)
    start, groups = mdf.read(open(own, "rb").read())
    raw = next(g for g in groups if g.name == "Raw::CAN4")

    def changed(name, change):
        """Another file, in which one thing differs."""
        _, g = mdf.read(open(own, "rb").read())
        begin = change({x.name: x for x in g if x.name != "1s"}, [x for x in g if x.name == "1s"], g) or start
        with open(tmp_path / name, "wb") as f:
            mdf.write(f, begin, g)
        return str(tmp_path / name)

    def flip(named, stats, g):
        named["Raw::CAN4"].channels[2].samples = 255 - raw.channels[2].samples

    for a in (folder, own):
        found = convert.differences(spark, a, changed("bytes.mdf", flip), exact=False).collect()
        assert [(r.dimension, r.label) for r in found] == [("values", "Raw::CAN4.Data")]

    def late(named, stats, g):
        first = next(iter(named.values()))
        first.times = first.times + 0.001

    found = convert.differences(spark, folder, changed("late.mdf", late), exact=False).collect()
    assert found and {r.dimension for r in found} == {"values"} and all(r.detail.split()[2] != "0" for r in found)
    assert [r.dimension for r in convert.differences(spark, own, changed("start.mdf", lambda *_: start + 1)).collect()] == ["header"]


def test_statistics_of_files_decide(spark, tmp_path):
    src = rich(tmp_path / "a.blf")
    c = dbc.parse(ABC, str(tmp_path / "ABC.dbc"))
    folder, own = str(tmp_path / "m"), str(tmp_path / "own.mdf")
    convert.convert(spark, src, {1: c}, folder)
    export.write_mdf(spark, folder, own)

    def changed(name, change):
        start, groups = mdf.read(open(own, "rb").read())
        signals, ones = [g for g in groups if g.name != "1s"], [g for g in groups if g.name == "1s"]
        with open(tmp_path / name, "wb") as f:
            mdf.write(f, start, signals + (change(ones) or ones))
        return str(tmp_path / name)

    def every(f):
        def change(ones):
            for g in ones:
                f(g)

        return change

    def shift(g):
        g.times = g.times + 1e-3

    def more(g):
        g.channels[0].samples = g.channels[0].samples + 1

    def hole(g):
        keep = np.arange(len(g.times)) != 3
        g.times, g.channels[0].samples = g.times[keep], g.channels[0].samples[keep]

    def kinds(path, **more):
        return {r.detail.split(" ")[0] for r in convert.differences(spark, folder, path, dims={"stats"}, **more).collect()}

    for a in (folder, own):
        assert convert.differences(spark, a, own, dims={"stats"}).count() == 0
        found = convert.differences(spark, a, changed("more.mdf", every(more)), dims={"stats"}).collect()
        assert len(found) == 160 and {r.detail.split(" ")[0] for r in found} == {"points"}
    cases = {"shift": (every(shift), {"axis"}, False), "more": (every(more), {"points"}, True), "hole": (every(hole), {"hole", "length"}, True), "few": (lambda ones: ones[:150], {"groups"}, True)}
    for name, (change, want, good) in cases.items():
        path = changed(f"{name}.mdf", change)
        assert kinds(path) == want and verify.passes(spark, folder, path) == good, name
    swapped = changed("order.mdf", lambda ones: [ones[1], ones[0], *ones[2:]])
    assert {r.detail.split(" ")[0] for r in convert.differences(spark, swapped, own, dims={"stats"}).collect()} >= {"order"}
    # another tool's blocks: 12 items a channel, ours from the third on, backwards
    offsets = {n: 11 - i for i, n in enumerate(compare_stats.ORDER)}

    def blocks(ones):
        pad = mdf.Group("1s", ones[0].times, [mdf.Channel("Other", ones[0].channels[0].samples)])
        return [g for ch in range(16) for g in (pad, pad, *reversed(ones[10 * ch : 10 * ch + 10]))]

    theirs = changed("blocks.mdf", blocks)
    assert kinds(theirs, layout=(12, offsets)) == set() and kinds(theirs) == {"points"}
    assert verify.passes(spark, own, theirs, (12, offsets))
    with pytest.raises(ValueError, match="without a place"):
        kinds(theirs, layout=(12, {"StdData": 0}))
    assert cli.main(["compare", folder, changed("more.mdf", every(more)), "--dims", "stats"]) == 1
