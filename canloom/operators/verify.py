"""Verification of conversions against stored reference measurements."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.operators import bindings as bind
from canloom.operators import compare, compare_stats, convert
from canloom.sources import blf, project
from canloom.functions.tables import local

#: What a sample folder holds.
SOURCE, REFERENCE = "source.blf", "canoe.mdf"


@dataclass(frozen=True)
class Sample:
    platform: str
    project: str
    name: str
    source: Path
    reference: Path


def discover_samples(root: str | Path) -> list[Sample]:
    """Samples of a tree platform/project/sample, in order; a sample that lacks one of its two parts is an error."""
    root = Path(root)
    if not root.is_dir():
        raise FileNotFoundError(f"no samples at {root}")
    found, lacking = [], []
    for folder in sorted(p for p in root.glob("*/*/*") if p.is_dir()):
        absent = [n for n in (SOURCE, REFERENCE) if not (folder / n).exists()]
        if absent:
            lacking.append(f"{folder.relative_to(root)} lacks {', '.join(absent)}")
        else:
            found.append(Sample(*folder.relative_to(root).parts, folder / SOURCE, folder / REFERENCE))
    if lacking:
        raise FileNotFoundError("samples are incomplete:\n" + "\n".join(lacking))
    return found


def artifact_name(stamp: str, s: Sample) -> str:
    return f"cmp_{stamp}_{s.platform}_{s.project}_{s.name}.mdf"


def latest_artifact(folder: str | Path, s: Sample) -> Path | None:
    """The newest result of a sample, by exact name."""
    name = re.compile(rf"cmp_\d{{8}}_\d{{6}}_{re.escape(s.platform)}_{re.escape(s.project)}_{re.escape(s.name)}\.mdf")
    return max((p for p in Path(folder).iterdir() if name.fullmatch(p.name)), key=lambda p: p.stat().st_mtime, default=None)


def bound_catalogs(spark: SparkSession, root: str | Path, name: str, log: str, mapping: str | Path | None = None) -> dict:
    """{channel: catalog} of a log by the project's suggestions, as an import without choices binds it."""
    catalogs = project.load_project(root, name)
    auto = project.auto_bindings(catalogs, project.load_mapping(mapping))
    table = lambda rows, ddl: local(spark, rows, ddl)
    rows = bind.decide(table([(c,) for c in blf.list_channels(spark, log)], "channel int"), table(list(auto.items()), "channel int, dbc string"), table([], "channel int, dbc string"), table([(c.path,) for c in catalogs], "dbc string"))
    by = {c.path: c for c in catalogs}
    return {r.channel: by[r.binding] for r in rows.where("binding is not null").collect()}


def report(spark: SparkSession, ours: str, reference: str, layout: compare_stats.Layout = compare_stats.OWN_LAYOUT) -> DataFrame:
    """All differences with their severity: values decide, and the axis of the statistics; the rest are notes."""
    found = convert.differences(spark, ours, reference, exact=False, layout=layout)
    decides = (F.col("dimension") == "values") | ((F.col("dimension") == "stats") & F.split("detail", " ")[0].isin(*compare_stats.DECIDES))
    return compare.with_severity(found, ~decides)


def passes(spark: SparkSession, ours: str, reference: str, layout: compare_stats.Layout = compare_stats.OWN_LAYOUT) -> bool:
    return compare.gate(report(spark, ours, reference, layout)).limit(1).count() == 0
