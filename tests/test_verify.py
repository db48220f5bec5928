"""Samples, artifacts, the gate and the command line."""

import os

import pytest

from canloom import cli
from canloom.operators import convert, verify
from canloom.sources import project
from tests.test_convert import ABC, rich


def test_samples_and_gate(spark, tmp_path, capsys):
    cat = tmp_path / "dbc" / "P1"
    cat.mkdir(parents=True)
    (cat / "PFCAN1.dbc").write_text(ABC)
    for n in ("s1", "s2"):
        (tmp_path / "gold" / "CC" / "P1" / n).mkdir(parents=True)
        rich(tmp_path / "gold" / "CC" / "P1" / n / "source.blf")
    with pytest.raises(FileNotFoundError, match="s1 lacks canoe.mdf"):
        verify.discover_samples(tmp_path / "gold")
    with pytest.raises(FileNotFoundError):
        verify.discover_samples(tmp_path / "none")
    source = str(tmp_path / "gold/CC/P1/s1/source.blf")
    bound = verify.bound_catalogs(spark, tmp_path / "dbc", "P1", source)
    assert list(bound) == [project.DEFAULT_MAPPING["PFCAN1"]]
    for n in ("s1", "s2"):
        convert.convert(spark, source, bound if n == "s1" else {2: bound[1]}, str(tmp_path / "gold/CC/P1" / n / "canoe.mdf"))
    samples = verify.discover_samples(tmp_path / "gold")
    assert [(s.platform, s.project, s.name) for s in samples] == [("CC", "P1", "s1"), ("CC", "P1", "s2")]
    assert cli.main(["verify", str(tmp_path / "gold"), str(tmp_path / "dbc"), str(tmp_path / "out")]) == 1
    assert capsys.readouterr().out.split("\n")[:2] == ["ok CC P1 s1", "differs CC P1 s2"]
    newest = verify.latest_artifact(tmp_path / "out", samples[0])
    later = newest.parent / verify.artifact_name("20990101_000000", samples[0])
    later.mkdir()
    os.utime(later, (2**32, 2**32))
    assert verify.latest_artifact(tmp_path / "out", samples[0]) == later and verify.latest_artifact(tmp_path / "gold", samples[0]) is None
    assert cli.main(["channels", source]) == 0 and capsys.readouterr().out.strip() == "1 2 4"
    assert cli.main(["compare", str(newest), str(newest)]) == 0
    assert cli.main(["export", str(newest), str(tmp_path / "a.mdf")]) == 0 and (tmp_path / "a.mdf").read_bytes()[:3] == b"MDF"
