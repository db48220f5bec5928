"""Bit algebra against big integers, and decoding against stated vectors."""

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canloom.functions import bits
from canloom.functions.tables import local
from canloom.model import SignalDef
from canloom.operators import decode
from canloom.operators import frames as fr
from canloom.sources import dbc


def scalar_bits(data, s):
    """By definition, on Python integers."""
    data = data.ljust(128, b"\x00")
    if s.byte_order == "little":
        v = int.from_bytes(data, "little") >> s.start_bit & ((1 << min(s.length, 64)) - 1)
    else:
        total = 8 * len(data)
        v = int.from_bytes(data, "big") >> (total - s.position - s.length) & ((1 << s.length) - 1) & ((1 << 64) - 1)
    n = min(s.length, 64)
    return v - (1 << n) if s.is_signed and v >> (n - 1) else v


def words_of(data):
    data = data.ljust(max(8, -(-len(data) // 8) * 8), b"\x00")
    return [x[0] for x in struct.iter_unpack("<q", data)]


def samples(spark, text, payloads, arb=1):
    c = dbc.parse(text, "c")
    frames = local(spark, [(i, 0, arb, False, len(p), i / 10, words_of(p)) for i, p in enumerate(payloads)], "seq long, channel int, arb_id long, is_extended boolean, data_len int, ts double, words array<bigint>")
    known = fr.classify(frames, local(spark, [(0, "c")], "channel int, dbc string"), dbc.messages_table(spark, [c]))
    plan = decode.plan_table(spark, [c])
    long = decode.long(known, plan)
    return c.messages[arb], known, plan, {(r.seq, r.signal_name): r for r in long.where("routed_ok").collect()}, {r.seq: r for r in decode.wide(known, c.messages[arb]).collect()}


def test_random_signals(spark):
    rng = random.Random(7)
    lines, defs = [], []
    for i in range(60):
        n, order, sign = rng.choice([1, 3, 8, 12, 16, 31, 32, 33, 63, 64, 200]), rng.choice("01"), rng.choice("+-")
        if order == "1":
            start = rng.randrange(0, 512 - n)
        else:
            stream = rng.randrange(0, 512 - n)
            start = 8 * (stream // 8) + 7 - stream % 8
        lines.append(f' SG_ S{i} : {start}|{n}@{order}{sign} (1,0) [0|0] "" X')
        defs.append(SignalDef(f"S{i}", start, n, is_signed=sign == "-", byte_order="little" if order == "1" else "big"))
    payloads = [bytes(rng.randrange(256) for _ in range(64)) for _ in range(25)] + [b"\xff" * 64, bytes(64)]
    _, _, _, long, wide = samples(spark, "BO_ 1 M: 64 E\n" + "\n".join(lines) + "\n", payloads)
    for i, p in enumerate(payloads):
        for s in defs:
            want = scalar_bits(p, s)
            assert int(long[i, s.name].raw) == want == int(wide[i][s.name]), (s, p)
            assert long[i, s.name].phys == float(want)


def test_stated_vectors(spark):
    _, _, _, long, wide = samples(spark, 'BO_ 1 ABC: 3 E\n SG_ Speed : 0|16@1+ (0.01,0) [0|0] "" X\n SG_ Temp : 16|8@1+ (1,-40) [0|0] "" X\n', [b"\xe8\x03\x50"])
    assert wide[0].Speed == 10.0 and wide[0].Temp == 40.0 and long[0, "Temp"].phys == 40.0
    big = 'BO_ 1 D: 64 E\n SG_ P : 7|512@0+ (1,0) [0|0] "" X\n'
    assert int(samples(spark, big, [b"\xff" * 56 + b"\xab" * 8])[3][0, "P"].raw) == 0xABABABABABABABAB
    little = 'BO_ 1 D: 64 E\n SG_ P : 0|512@1+ (1,0) [0|0] "" X\n'
    assert int(samples(spark, little, [b"\xab" * 8 + b"\xff" * 56])[4][0].P) == 0xABABABABABABABAB
    assert samples(spark, 'BO_ 1 D: 8 E\n SG_ P : 7|64@0- (1,0) [0|0] "" X\n', [b"\xff" * 8])[4][0].P == -1


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.integers(0, 2**32 - 1), st.sampled_from([0, 1, 0x7F800000, 0xFF800000, 0x7FC00001, 0x80000000, 0x007FFFFF, 0x00800000])), st.one_of(st.integers(0, 2**64 - 1), st.sampled_from([1, 0x7FF0000000000000, 0x7FF8000000000001, 0x000FFFFFFFFFFFFF, 2**63])))
def test_float_bits(spark, a, b):
    want = struct.unpack("<f", struct.pack("<I", a))[0], struct.unpack("<d", struct.pack("<Q", b))[0]
    signed = b - (1 << 64) if b >> 63 else b
    got = spark.range(1).select(bits.float32_value(F.lit(a).cast("long")), bits.float64_value(F.lit(signed).cast("long"))).first()
    for x, y in zip(got, want):
        assert (math.isnan(x) and math.isnan(y)) or (x == y and math.copysign(1, x) == math.copysign(1, y))


def test_float_signals(spark):
    text = 'BO_ 1 F: 12 E\n SG_ A : 0|32@1- (2,1) [0|0] "" X\n SG_ B : 39|64@0- (1,0) [0|0] "" X\nSIG_VALTYPE_ 1 A : 1;\nSIG_VALTYPE_ 1 B : 2;\n'
    _, _, _, long, wide = samples(spark, text, [struct.pack("<f", 1.5) + struct.pack(">d", -2.25)])
    assert (wide[0].A, wide[0].B) == (4.0, -2.25) == (long[0, "A"].phys, long[0, "B"].phys)


def test_physical_is_exact_beyond_2_53(spark):
    rows = [((1 << 63) - 3, 7.0, 5.0), (2**53 + 1, 1.0, 0.0), (3, 0.1, -50.0), (-(2**60) - 1, 3.0, -1.0)]
    df = local(spark, rows, "r long, s double, o double")
    got = [x[0] for x in df.select(bits.physical(df.r, df.s, df.o)).collect()]
    assert got == [float(((1 << 63) - 3) * 7 + 5), float(2**53 + 1), 3 * 0.1 + -50.0, float((-(2**60) - 1) * 3 - 1)]


MUX = 'BO_ 1 M: 4 E\n SG_ Sel M : 0|8@1+ ({scale},{offset}) [0|0] "" X\n SG_ A m0 : 8|8@1+ (1,0) [0|0] "" X\n SG_ B m1 : 8|8@1+ (0.5,0) [0|0] "" X\n SG_ Always : 16|8@1- (1,0) [0|0] "" X\n'


def test_mux(spark):
    _, known, plan, long, wide = samples(spark, MUX.format(scale=1, offset=0), [b"\x00\x05\xff\x00", b"\x01\x05\x02\x00", b"\x02\x05\x02\x00"])
    assert set(wide) == {0, 1} and (wide[0].A, wide[0].Always) == (5, -1) and math.isnan(wide[0].B) and (wide[1].A, wide[1].B) == (0, 2.5)
    assert long[1, "A"].phys == 0 and not long[1, "A"].active and math.isnan(long[0, "B"].phys) and (2, "A") not in long
    assert [r.valid for r in decode.routed_frames(known, plan).orderBy("seq").collect()] == [True, True, False]


def test_scaled_selector_routes_on_its_value(spark):
    _, known, plan, long, wide = samples(spark, MUX.format(scale=2, offset=-4), [b"\x02\x07\x00\x00", b"\x00\x07\x00\x00"])
    assert set(wide) == {0} and wide[0].A == 7 and wide[0].Sel == 0.0
    assert {k[0] for k in long} == {0}
    none = samples(spark, MUX.format(scale=1, offset=0).replace(" m0", "").replace(" m1", ""), [b"\x00\x05\xff\x00"])
    assert none[4] == {}


def test_enum_keeps_raw(spark):
    text = 'BO_ 1 E: 4 E\n SG_ K : 0|2@1+ (1,0) [0|0] "%" X\n SG_ T : 8|16@1+ (0.1,-50) [0|0] "degC" X\nVAL_ 1 K 0 "Standby" 1 "Closed" ;\nVAL_ 1 T 3050 "Invalid Value" ;\n'
    m, _, _, long, wide = samples(spark, text, [b"\x01\xea\x0b\x00", b"\x03\x64\x00\x00"])
    assert (wide[0].K, wide[0].T, wide[1].T) == (1, 3050, 100) and {s.ref_dtype for s in m.signals} == {"u8", "u16"}
    table = {r.signal_name: r for r in decode.conversions(dbc.signals_table(spark, [dbc.parse(text, "c")])).collect()}
    assert table["T"].default_kind == "linear" and table["T"].default_unit == "degC" and table["K"].default_unit is None
    raw = local(spark, [(3050, {3050: "Invalid Value"}), (100, {3050: "Invalid Value"})], "r long, c map<bigint,string>")
    assert [r[0] for r in raw.select(decode.enum_text(raw.r, raw.c, 0.1, -50.0)).collect()] == ["Invalid Value", "-40.0"]


def test_words_and_padding(spark):
    df = local(spark, [(b"\x01\x02\x03\x04\x05\x06\x07\x88\x99",), (b"",)], "d binary")
    got = df.select(bits.words_of(df.d, 2).alias("w"), bits.padded(df.d, 4).alias("p")).collect()
    assert got[0].w == words_of(b"\x01\x02\x03\x04\x05\x06\x07\x88\x99") and bytes(got[0].p) == b"\x01\x02\x03\x04" and bytes(got[1].p) == b"\x00" * 4
    sizes = local(spark, [(5,), (2048,), (3 * 1024**2,), (5 * 1024**3,)], "n long")
    assert [r[0] for r in sizes.select(bits.size_text(sizes.n)).collect()] == ["5 B", "2.0 KB", "3.0 MB", "5.0 GB"]
    names = local(spark, [("x/A19/PF.dbc",), ("C:\\A\\b.dbc",)], "p string")
    assert [r[0] for r in names.select(bits.display_name(names.p)).collect()] == ["PF.dbc（A19）", "b.dbc（A）"]


@pytest.mark.parametrize("n,kind", [(1, "u8"), (8, "u8"), (9, "u16"), (17, "u32"), (33, "u64"), (64, "u64")])
def test_storage(n, kind):
    assert SignalDef("s", 0, n).ref_dtype == kind and SignalDef("s", 0, n, is_signed=True).ref_dtype == "i" + kind[1:]
