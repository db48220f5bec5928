"""The Spark source ``blf``.

    spark.dataSource.register(BlfSource)
    spark.read.format("blf").option("path", "/logs/*.blf").load()

Options: ``path`` (files, globs or folders, several parted by commas), ``mode`` = frames (default), channels (distinct
channels alone) or file_info (start time, latest time, containers), ``channels`` = numbers parted by commas, and
``onError`` = fail (default), skip, or row (file_info: a row with the column ``error`` for a log that can't be read).

A file is a partition, or several small ones are (``tasks``: pieces are packed into no fewer partitions). ``frames``, ``list_channels`` and conversions part a large log further (``split``): its containers are
found by their headers alone, ranges of them are counted at the same time, and where one range leaves off is held to where the
next began. So numbers of frames, containers, errors and objects across a seam are those of one reader from the start. The modes
``index`` and ``survey`` are these two steps; the option ``ranges`` hands their result to the scan.

``frames``, ``file_info`` and ``list_channels`` also take paths of stores that only Spark opens. Equality and membership filters on ``channel`` are pushed down where
spark.sql.python.filterPushdown.enabled is set (``register`` does).
"""

from __future__ import annotations

import glob
import io
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from threading import Lock
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from canloom import model
from canloom.sources import blf_layout as L
from canloom.sources import blf_read
from canloom.sources.blf_read import Place, Range, Survey

_LOCK = Lock()
_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
_START = T.StructType().add("file", _STRING).add("start_s", T.DoubleType())
_INDEX = T.StructType().add("file", _STRING).add("at", _LONG).add("first", _INT).add("stop", _LONG).add("before", _LONG)
_SURVEY = (
    T.StructType().add("file", _STRING).add("first", _INT).add("entry_at", _LONG).add("entry_skip", _LONG).add("frames", _LONG).add("containers", _INT)
    .add("latest", _LONG).add("channels", T.ArrayType(_INT)).add("left_at", _LONG).add("left_skip", _LONG).add("error", _STRING)
)
SCHEMAS = {"frames": model.FRAMES, "channels": model.CHANNELS, "file_info": model.FILE_INFO, "index": _INDEX, "survey": _SURVEY, "start": _START}
#: Bytes of a range: a core's share of the large logs, but between these two.
SMALLEST, LARGEST = 4 << 20, 256 << 20
#: Partitions a core that small logs and ranges are packed into, and the bytes that opening one counts for.
WAVES, OPENING = 8, 1 << 18


def schema_of(options: dict) -> T.StructType:
    mode = options.get("mode", "frames")
    if mode == "file_info" and error_option(options) == "row":
        return T.StructType([*model.FILE_INFO.fields, T.StructField("error", T.StringType())])
    return SCHEMAS[mode]


def error_option(options: dict) -> str:
    return options.get("onerror", options.get("onError", "fail"))


def expand(path: str) -> list[str]:
    """Log files of a path option, each once, in order."""
    out: dict[str, None] = {}
    for part in (p.strip().removeprefix("file://") for p in path.split(",")):
        if os.path.isdir(part):
            found = (os.path.join(d, n) for d, _, names in os.walk(part) for n in names if n.lower().endswith(".blf"))
        else:
            found = glob.glob(part) if glob.has_magic(part) else [part]
        out |= dict.fromkeys(sorted(found))
    return list(out)


class FilePartition(InputPartition):
    """Logs, or ranges of them, that a task reads one after the other."""

    def __init__(self, pieces: list[tuple[str, Range | None]]):
        super().__init__(pieces[0][0])
        self.pieces = pieces


def weight(path: str, part: Range | None) -> int:
    """Bytes of a piece, with what opening it counts for."""
    if part is not None and part.stop is not None:
        return OPENING + part.stop - part.at
    try:
        return OPENING + max(0, os.path.getsize(path) - (part.at if part else 0))
    except OSError:
        return OPENING  # whoever reads it says so


def gathered(pieces: list[tuple[str, Range | None]], tasks: int) -> list[list[tuple[str, Range | None]]]:
    """Pieces in order, those that follow each other together up to a share of all for each of ``tasks`` (0: each by itself)."""
    sizes = [weight(*p) for p in pieces] if tasks else []
    share = min(sum(sizes) / tasks, LARGEST) if tasks else 0
    out, held = [], 0
    for i, p in enumerate(pieces):
        n = sizes[i] if tasks else 0
        if not out or not tasks or held + n > share:
            out.append([])
            held = 0
        out[-1].append(p)
        held += n
    return out


def packed(ranges: dict[str, list[Range]]) -> str:
    return json.dumps({p: [list(r) for r in rs] for p, rs in ranges.items()})


def unpacked(text: str) -> dict[str, list[Range]]:
    return {p: [Range(*r)._replace(entry=r[4] and Place(*r[4])) for r in rs] for p, rs in json.loads(text).items()}


class BlfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = expand(options["path"])
        self.mode = options.get("mode", "frames")
        if self.mode not in SCHEMAS:
            raise ValueError(f"mode {self.mode!r} is none of {sorted(SCHEMAS)}")
        self.on_error = error_option(options)
        if self.on_error not in ("fail", "skip") and not (self.on_error == "row" and self.mode == "file_info"):
            raise ValueError(f"onError {self.on_error!r} isn't known in mode {self.mode}")
        wanted = options.get("channels")
        self.channels = {int(x) for x in wanted.split(",")} if wanted else None
        self.ranges = unpacked(options.get("ranges", "{}"))
        self.each = int(options.get("splitbytes", options.get("splitBytes", SMALLEST)))
        self.tasks = int(options.get("tasks", 0))

    def __getstate__(self) -> dict:
        """What tasks need: the pieces come with each partition, so that a task isn't sent the list of all."""
        return self.__dict__ | {"paths": [], "ranges": {}}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel",) and self.mode in ("frames", "channels"):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("channel",) and self.mode in ("frames", "channels"):
                own = set(f.value)
            else:
                yield f
                continue
            self.channels = own if self.channels is None else self.channels & own

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(own) for own in gathered([(p, r) for p in self.paths for r in self.ranges.get(p, [None])], self.tasks)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        for path, part in partition.pieces:
            yield from self.tried(lambda path=path: open(path, "rb"), path, part)  # closed by tried

    def tried(self, opened: Callable[[], BinaryIO], path: str, part: Range | None = None) -> Iterator[pa.RecordBatch]:
        """What the log gives, or what ``onError`` asks for."""
        try:
            with opened() as stream:
                for batch in self.parsed(stream, path, part):
                    yield self._without_error(batch)
        except (OSError, ValueError, L.struct.error) as e:
            if self.on_error == "fail":
                raise
            if self.on_error == "row":
                arrays = [pa.array([path]), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())), pa.array([f"{type(e).__name__}: {e}"])]
                yield pa.RecordBatch.from_arrays(arrays, [*model.FILE_INFO.names, "error"])

    def _without_error(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("error", pa.nulls(batch.num_rows, pa.string())) if self.on_error == "row" else batch

    def parsed(self, stream: BinaryIO, path: str, part: Range | None = None) -> Iterator[pa.RecordBatch]:
        if self.mode == "file_info":
            start, latest, n = blf_read.extent(stream)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([L.ms_part(start)]), pa.array([latest]), pa.array([n], pa.int32())], model.FILE_INFO.names)
        elif self.mode == "channels":
            seen = blf_read.channels(stream)
            own = sorted(seen if self.channels is None else seen & self.channels)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array(own, pa.int32())], model.CHANNELS.names)
        elif self.mode == "start":
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([blf_read.start_ns(stream)[0] * 1e-9])], _START.names)
        elif self.mode == "index":
            yield pa.RecordBatch.from_pylist([{"file": path, "at": r.at, "first": r.first, "stop": r.stop, "before": r.before} for r in blf_read.index(stream, self.each)], to_arrow_schema(_INDEX))
        elif self.mode == "survey":
            x = blf_read.survey(stream, part)
            (entry_at, entry_skip), (left_at, left_skip) = x.range.entry or (None, None), x.left or (None, None)
            row = {"file": path, "first": x.range.first, "entry_at": entry_at, "entry_skip": entry_skip, "frames": x.frames, "containers": x.containers, "latest": x.latest, "channels": sorted(x.channels), "left_at": left_at, "left_skip": left_skip, "error": x.error}
            yield pa.RecordBatch.from_pylist([row], to_arrow_schema(_SURVEY))
        else:
            for batch, _ in blf_read.batches(stream, path, part):
                if self.channels is not None:
                    batch = batch.filter(pa.array(np.isin(batch.column(3).to_numpy(), list(self.channels))))
                if batch.num_rows:
                    yield batch


class BlfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blf"

    def schema(self):
        return schema_of(dict(self.options))

    def reader(self, schema) -> BlfReader:
        return BlfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known; it takes pushed filters, which Spark hands to Python sources only if set to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    with _LOCK:  # conversions of a batch register from threads of their own
        spark.dataSource.register(BlfSource)


def _remote(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    """Logs in a store that only Spark's readers open: a file is a row of bytes (2 GB at most), parsed where it is read."""
    reader = BlfReader({**options, "path": ""})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[bB][lL][fF]").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(*(c.to_pylist() for c in batch.columns)):
                yield from reader.tried(lambda body=body: io.BytesIO(body), path)

    return files.mapInArrow(run, schema_of(options))


def _load(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    register(spark)
    paths = path.split(",") if isinstance(path, str) else list(path)
    if any("://" in p and not p.strip().startswith("file://") for p in paths):
        return _remote(spark, [p.strip() for p in paths], options)
    return _scan(spark, paths, **options)


@dataclass
class Split:
    """Large logs by range, and what the survey says of those that have no fault."""

    ranges: dict[str, list[Range]] = field(default_factory=dict)
    latest: dict[str, int] = field(default_factory=dict)
    channels: dict[str, set[int]] = field(default_factory=dict)


def _scan(spark: SparkSession, paths: Iterable[str], **options: str) -> DataFrame:
    return spark.read.format("blf").options(path=",".join(paths), tasks=str(WAVES * spark.sparkContext.defaultParallelism), **options).load()


def _surveyed(spark: SparkSession, ranges: dict[str, list[Range]]) -> dict[tuple[str, int], Survey]:
    """A survey by file and first container; a task takes one range."""
    by = {(p, r.first): r for p, rs in ranges.items() for r in rs}
    out = {}
    for x in _scan(spark, ranges, mode="survey", ranges=packed(ranges)).collect():
        entry, left = (None if at is None else Place(at, skip) for at, skip in ((x.entry_at, x.entry_skip), (x.left_at, x.left_skip)))
        out[x.file, x.first] = Survey(by[x.file, x.first]._replace(entry=entry), x.frames, x.containers, x.latest, frozenset(x.channels), left, x.error)
    return out


def settled(ranges: dict[str, list[Range]], ask: Callable[[dict[str, list[Range]]], dict[tuple[str, int], Survey]]) -> Split:
    """Ranges whose entries are right, by what ``ask`` surveys of them.

    Ranges whose guessed entry isn't where the one before left off are surveyed again from there, all at once, until none is left;
    each round settles one range of a log more at least. What follows a fault is no range any more: the range with the fault raises
    it, or skips the rest, where it is read.
    """
    found = ask(ranges) if ranges else {}
    while True:
        again: dict[str, list[Range]] = {}
        for p, rs in ranges.items():
            for a, b in pairwise(found[p, r.first] for r in rs):
                if a.left is not None and a.left != b.range.entry:
                    again.setdefault(p, []).append(b.range._replace(entry=a.left))
        if not again:
            break
        found |= ask(again)
    out = Split()
    for p, rs in ranges.items():
        out.ranges[p], seq = [], 0
        for s in (own := [found[p, r.first] for r in rs]):
            out.ranges[p].append(s.range._replace(seq=seq))
            seq += s.frames
            if s.error is not None:
                break
        else:
            out.latest[p], out.channels[p] = max(s.latest for s in own), set().union(*(s.channels for s in own))
    return out


def split(spark: SparkSession, path: str | list[str], each: int | None = None) -> Split:
    """Ranges of the logs that are larger than ``each`` bytes (None: a core's share of all, between SMALLEST and LARGEST).

    A row a range comes to the driver, as Spark's own readers keep a row a split.
    """
    paths = path.split(",") if isinstance(path, str) else list(path)
    if any("://" in p and not p.strip().startswith("file://") for p in paths):
        return Split()
    sizes = {p: os.path.getsize(p) for p in expand(",".join(paths)) if os.path.isfile(p)}
    each = each or min(max(SMALLEST, sum(sizes.values()) // spark.sparkContext.defaultParallelism), LARGEST)
    large = [p for p, n in sizes.items() if n > each]
    if not large:
        return Split()
    register(spark)
    ranges: dict[str, list[Range]] = {}
    for x in _scan(spark, large, mode="index", splitBytes=str(each), onError="skip").orderBy("file", "first").collect():
        ranges.setdefault(x.file, []).append(Range(x.at, x.first, x.stop, x.before))
    return settled({p: rs for p, rs in ranges.items() if len(rs) > 1}, lambda asked: _surveyed(spark, asked))


def frames(spark: SparkSession, path: str | list[str], channels: list[int] | None = None, on_error: str = "fail", parts: Split | None = None) -> DataFrame:
    """Frames of logs; ``parts`` is a split made before (None: made here)."""
    parts = split(spark, path) if parts is None else parts
    options = {"channels": ",".join(map(str, channels))} if channels else {}
    return _load(spark, path, onError=on_error, **options, **({"ranges": packed(parts.ranges)} if parts.ranges else {}))


def file_info(spark: SparkSession, path: str | list[str], on_error: str = "fail") -> DataFrame:
    return _load(spark, path, mode="file_info", onError=on_error)


def start_times(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Start of each log in seconds since 1970, from the file headers."""
    return _load(spark, path, mode="start")


def list_channels(spark: SparkSession, path: str | list[str]) -> list[int]:
    """Channels with frames, sorted; frames aren't gathered, and large logs are read by ranges."""
    parts = split(spark, path)
    seen = set().union(*parts.channels.values())
    left = path if not seen else [p for p in expand(path if isinstance(path, str) else ",".join(path)) if p not in parts.channels]
    if left:
        seen |= {r.channel for r in _load(spark, left, mode="channels").select("channel").distinct().collect()}
    return sorted(seen)


def read_start_ns(path: str) -> int:
    with open(path, "rb") as stream:
        return blf_read.start_ns(stream)[0]


def read_start_time(path: str) -> float:
    """Start of the measurement in seconds since 1970, from the file header."""
    return read_start_ns(path) * 1e-9
