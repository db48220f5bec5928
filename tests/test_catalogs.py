"""Catalog text, maps, bindings."""

import pytest

from canloom import model
from canloom.functions import bits
from canloom.functions.tables import local
from canloom.operators import bindings as bind
from canloom.operators import frames as fr
from canloom.operators import batch
from canloom.sources import dbc, project

BASIC = 'BO_ 100 ABC: 8 ECU\n SG_ Speed : 0|16@1+ (0.01,0) [0|655.35] "km/h" X\n SG_ Temp : 16|8@1+ (1,-40) [-40|215] "degC" X\n'


def test_basic_and_padding(tmp_path):
    path = tmp_path / "A19" / "PF.dbc"
    path.parent.mkdir()
    path.write_bytes(('VERSION ""\n\nNS_ :\n\tCM_\n\nBS_:\n\nBU_: ECU X\n\n' + BASIC + 'CM_ SG_ 100 Speed "a\nb";\n').encode() + b"\x00" * 734)
    c = dbc.load(str(path))
    m = c.messages[100]
    assert [(s.name, s.start_bit, s.length, s.scale, s.offset, s.unit) for s in m.signals] == [("Speed", 0, 16, 0.01, 0.0, "km/h"), ("Temp", 16, 8, 1.0, -40.0, "degC")]
    assert (m.node, m.frame_length, c.display_name) == ("ECU", 8, "PF.dbc（A19）")


def test_gbk_and_malformed(tmp_path):
    p = tmp_path / "g.dbc"
    p.write_bytes((BASIC + 'VAL_ 100 Temp 0 "正常；" 1 "b" ;\n').encode("gbk"))
    assert {s.name: s.choices for s in dbc.load(str(p)).messages[100].signals}["Temp"] == {0: "正常；", 1: "b"}
    for text in ("garbage line 1\nstill not dbc\n", "BO_ 100 ABC\n", "BO_ 1 A: 8 E\n SG_ broken\n"):
        p.write_text(text)
        with pytest.raises(ValueError, match=str(p)):
            dbc.load(str(p))


def test_mux_values_types_and_ids():
    c = dbc.parse(
        'BO_ 2147483904 M2: 8 Vector__XXX\n SG_ Sel M : 0|8@1+ (0,0) [0|0] "" X\n SG_ A m0 : 8|8@1- (2,1) [0|0] "" X\n SG_ F m1 : 32|32@1- (1,0) [0|0] "" X\n SG_ C : 16|16@0+ (1,0) [0|0] "" X\n'
        'VAL_ 2147483904 C 0 "off"\n 1 "on" ;\nSIG_VALTYPE_ 2147483904 F : 1;\nSG_MUL_VAL_ 2147483904 A Sel 0-0, 3-5;\n'
    )
    m = c.messages[0x80000100]
    s = {x.name: x for x in m.signals}
    assert m.is_extended and m.node == "Unknown" and m.selector.name == "Sel" and s["Sel"].scale == 1.0
    assert s["A"].multiplexer_ids == (0, 3, 4, 5) and s["F"].is_float and s["C"].choices == {0: "off", 1: "on"} and s["C"].byte_order == "big"
    assert (s["A"].kind, s["F"].kind, s["C"].kind, s["Sel"].kind) == ("scaled", "float", "enum", "int")
    assert (s["A"].ref_dtype, s["C"].ref_dtype, s["Sel"].ref_dtype) == ("f64", "u16", "u8")
    assert [x.position for x in m.signals] == sorted(x.position for x in m.signals)


def test_normalize_and_classify(spark):
    ids = spark.createDataFrame([(0x123, False), (0x123, True), (0x1FFFFFFF, True), (0x80000001, True)], "a long, e boolean")
    assert [r[0] for r in ids.select(bits.normalize_id(ids.a, ids.e)).collect()] == [0x123, 0x80000123, 0x9FFFFFFF, 0x80000001]
    c = dbc.parse("BO_ 100 ABC: 8 E\nBO_ 2147483904 X: 8 E\n", "c")
    rows = [(100, False, 8), (100, False, 9), (100, False, 7), (0x100, True, 8), (0x100, True, 0), (999, False, 8), (0x100, False, 8)]
    frames = local(spark, [(i, 0, a, e, n) for i, (a, e, n) in enumerate(rows)], "seq long, channel int, arb_id long, is_extended boolean, data_len int")
    got = fr.classify(frames, local(spark, [(0, "c"), (1, None)], "channel int, dbc string"), dbc.messages_table(spark, [c]))
    assert [r.valid for r in got.orderBy("seq").collect()] == [True, True, False, True, False, False, False]
    empty = fr.classify(frames, local(spark, [(0, "c")], "channel int, dbc string"), dbc.messages_table(spark, [dbc.parse("", "c")]))
    assert empty.where("valid").count() == 0 and empty.count() == 7


def test_mapping(tmp_path):
    text = "old——CFCAN1——CAN7\n\n# note\nVDC——\nA——B——CANx\nA——PFCAN1——CAN1\n"
    assert project.parse_mapping(text) == {"CFCAN1": 7, "PFCAN1": 1}
    assert project.parse_mapping("some words\n# c\nA——B\n") == {}
    p = tmp_path / "map.txt"
    p.write_bytes(text.encode("gbk"))
    assert project.load_mapping(p) == {"CFCAN1": 7, "PFCAN1": 1}
    p.write_text("nothing")
    assert project.load_mapping(p) == project.load_mapping() == project.load_mapping("gone") == project.DEFAULT_MAPPING


LINES = ["旧——a——c——CAN3", "a——b——CANx——d——CAN4", "old——CFCAN1——CAN7——later words", "a —— b —— CAN 3 ", "# a——b——CAN1", "  #a——b——CAN1", "a——b——", "a——b", "a——b——CAN-2", "a——b——CAN+5", "——c——LIN9", "a——d——CAN", "a——e——1234", ""]


def test_mapping_lines_of_both_forms(spark):
    """The third part holds the channel, behind three signs; what follows it doesn't count."""
    table = local(spark, [(line,) for line in LINES], "line string")
    for line in LINES:
        rows = {r.new_name: r.channel for r in batch.mapping_lines(table.where(table.line == line)).collect()}
        assert project.parse_mapping(line) == rows, line
    assert project.parse_mapping("\n".join(LINES)) == {"CFCAN1": 7, "b": 5, "c": 9, "e": 4}


def test_projects(tmp_path):
    root = tmp_path / "inputs" / "dbc_ccu3.0"
    for n in ("B/PFCAN1.dbc", "B/IFCAN.dbc", "A/x.dbc"):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(BASIC)
    (root / "empty").mkdir()
    assert project.find_root(tmp_path) == root and project.find_root(None) is None and project.find_root(root) is None
    assert project.list_projects(root) == ["A", "B"] and project.list_projects(None) == []
    found = project.load_project(root, "B")
    assert [c.file_name for c in found] == ["IFCAN.dbc", "PFCAN1.dbc"]
    assert project.auto_bindings(found, project.DEFAULT_MAPPING) == {12: found[0].path, 1: found[1].path}
    (root / "B" / "bad.dbc").write_text("junk words here\n")
    with pytest.raises(ValueError, match="bad.dbc"):
        project.load_project(root, "B")
    with pytest.raises(ValueError):
        project.load_project(root, "empty")


@pytest.mark.parametrize(
    "log,auto,prev,paths,want",
    [
        ([1, 2], {}, None, [], {1: None, 2: None}),
        ([1], {1: "a"}, None, ["a"], {1: "a"}),
        ([1], {1: "a", 5: "b"}, None, ["a", "b"], {1: "a", 5: "b"}),
        ([1], {1: "a"}, {1: None}, ["a"], {1: None}),
        ([1], {1: "a"}, {1: "b"}, ["a", "b"], {1: "b"}),
        ([1], {1: "a"}, {1: "gone"}, ["a"], {1: "a"}),
        ([1], {1: "a"}, {1: "gone"}, [], {1: None}),
        ([1], {1: "gone"}, None, ["a"], {1: None}),
        ([], {3: "gone"}, None, ["a"], {3: None}),
        ([1], {}, {9: "a"}, ["a"], {1: None}),
    ],
)
def test_decisions(spark, log, auto, prev, paths, want):
    t = lambda d: local(spark, list((d or {}).items()), "channel int, dbc string")
    rows = bind.decide(local(spark, [(c,) for c in log], "channel int"), t(auto), t(prev), local(spark, [(p,) for p in paths], "dbc string")).collect()
    assert {r.channel: r.binding for r in rows} == want and [r.channel for r in rows] == sorted(want)
    assert all(r.state == ("NO_DATA" if r.channel not in log else "BOUND" if r.binding else "NOT_EXPORTED") for r in rows)
    assert set(model.STATES) >= {r.state for r in rows}
