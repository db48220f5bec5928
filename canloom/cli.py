"""Command line: convert, channels, compare and verify.

    python -m canloom.cli convert CATALOGS PROJECT PATH... [--raw] [--no-overwrite]
    python -m canloom.cli channels PATH
    python -m canloom.cli compare A B [--tolerance] [--dims header,values]
    python -m canloom.cli export MEASUREMENT FILE.mdf
    python -m canloom.cli verify SAMPLES CATALOGS OUT [--mapping FILE]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from canloom.operators import compare as cmp
from canloom.operators import convert as conv
from canloom.operators import export, verify
from canloom.sources import blf, project, resolver

#: Differences of a dimension that are listed below their number.
REPORTED = 50


def bound_catalogs(root: str, name: str, mapping: str | None) -> dict:
    catalogs = project.load_project(root, name)
    by = {c.path: c for c in catalogs}
    return {ch: by[p] for ch, p in project.auto_bindings(catalogs, project.load_mapping(mapping)).items()}


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="canloom")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("root")
    c.add_argument("project")
    c.add_argument("paths", nargs="+")
    c.add_argument("--mapping")
    c.add_argument("--raw", action="store_true")
    c.add_argument("--no-overwrite", action="store_true")
    ch = sub.add_parser("channels")
    ch.add_argument("path")
    d = sub.add_parser("compare")
    d.add_argument("a")
    d.add_argument("b")
    d.add_argument("--tolerance", action="store_true")
    d.add_argument("--dims", default=",".join(cmp.DIMENSIONS))
    e = sub.add_parser("export")
    e.add_argument("measurement")
    e.add_argument("file")
    v = sub.add_parser("verify")
    v.add_argument("samples")
    v.add_argument("catalogs")
    v.add_argument("out")
    v.add_argument("--mapping")
    o = top.parse_args(args)
    spark = SparkSession.builder.appName("canloom").getOrCreate()
    if o.command == "channels":
        print(*blf.list_channels(spark, o.path))
        return 0
    if o.command == "export":
        export.write_mdf(spark, o.measurement, o.file)
        return 0
    if o.command == "verify":
        bad = 0
        for s in verify.discover_samples(o.samples):
            out = str(Path(o.out) / verify.artifact_name(time.strftime("%Y%m%d_%H%M%S"), s))
            conv.convert(spark, str(s.source), verify.bound_catalogs(spark, o.catalogs, s.project, str(s.source), o.mapping), out)
            ok = verify.passes(spark, out, str(s.reference))
            bad += not ok
            print("ok" if ok else "differs", s.platform, s.project, s.name)
        return int(bool(bad))
    if o.command == "compare":
        found = conv.differences(spark, o.a, o.b, dims=set(o.dims.split(",")), exact=not o.tolerance)
        found = found.persist()
        counts = {r.dimension: r["count"] for r in found.groupBy("dimension").count().collect()}
        for dimension in (d for d in cmp.DIMENSIONS if d in counts):
            print(f"{dimension}: {counts[dimension]}")
            for r in found.where(F.col("dimension") == dimension).orderBy("label", "detail").limit(REPORTED).collect():
                print(" ", r.label, r.detail)
        found.unpersist()
        return int(bool(counts))
    todo, skipped = conv.to_convert(resolver.resolve(o.paths), not o.no_overwrite)
    result = conv.run_batch(spark, todo, bound_catalogs(o.root, o.project, o.mapping), raw_export=o.raw)
    for x in result.outcomes:
        print("ok" if x.ok else f"failed: {x.error}", x.candidate.display)
    print(f"{len(result.outcomes) - len(result.failures)} ok, {len(result.failures)} failed, {len(skipped)} skipped")
    return int(not result.all_succeeded)


if __name__ == "__main__":
    sys.exit(main())
