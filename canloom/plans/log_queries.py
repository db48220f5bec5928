"""Queries that go through log files: the frame view written as logs by tasks, read by the source, converted and read back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.functions import bits
from canloom.functions.shared import new_folder
from canloom.functions.tables import local
from canloom.model import SignalDef
from canloom.operators import compare, compare_stats, convert, decode, sink, stats
from canloom.operators import frames as fr
from canloom.plans import frame_view as view
from canloom.plans import queries as q
from canloom.plans.frame_view import sql
from canloom.plans.registry import query
from canloom.sources import blf, blf_write, dbc
from canloom.sources.blf_read import Frame
from canloom.sources.resolver import Candidate, resolve

#: Frames of a log, and bytes of its containers, which cut objects anywhere.
LOG_FRAMES, CONTAINER = 5_000, 16_384
#: Every so many frames, an object that is no frame follows, LATER behind it in time; three bytes of nothing follow others.
MARK, LATER, GAP = 97, 5_000_000, 89
#: A log starts at 2026-07-22 10:00:00.250, and as many minutes later as its number says, up to ten hours.
MS_PART, MINUTES = 250_000_000, 600


def folder(spark: SparkSession) -> str:
    """A new folder where the session's shared files are; logs are written and read by Python's files there."""
    made = new_folder(spark, "logs")
    if "://" in made and not made.startswith("file://"):
        raise ValueError(f"logs are written as files of the system, and {made} is none")
    path = Path(made.removeprefix("file://").removeprefix("file:"))
    path.mkdir(parents=True)
    return str(path)


def _write_log(path: str, table: pa.Table) -> None:
    """One log; the name is taken when it is whole, so that a task may run again."""
    number = table.column("log")[0].as_py()

    def objects() -> Iterator[Frame | bytes]:
        for r in table.sort_by("seq").to_pylist():
            yield Frame(r["channel"], r["abs_ns"], r["arb_id"], r["is_extended"], r["is_fd"], r["data_len"], r["w0"].to_bytes(8, "little")[: r["data_len"]], r["is_remote"], r["is_error"])
            if r["seq"] % MARK == 0:
                yield blf_write.obj(65, r["abs_ns"] + LATER, b"LOBJmark")
            if r["seq"] % GAP == 0:
                yield bytes(3)

    minute = number % MINUTES
    part = f"{path}/{uuid.uuid4().hex}.part"
    with open(part, "wb") as stream:
        blf_write.write(stream, objects(), (2026, 7, 3, 22, 10 + minute // 60, minute % 60, 0, 250), CONTAINER)
    os.replace(part, f"{path}/view-{number:06d}.blf")


def logs(spark: SparkSession, sf_dir: str) -> str:
    """The frame view as a folder of logs, each written by a task; a log is a bounded run of frames."""
    path = folder(spark)
    rows = view.frames(spark, sf_dir).select(F.expr(f"seq div {LOG_FRAMES}").alias("log"), "seq", "channel", "abs_ns", "arb_id", "is_extended", "is_fd", "is_remote", "is_error", "data_len", "w0")

    def write(table: pa.Table) -> pa.Table:
        _write_log(path, table)
        return pa.table({"log": table.column("log")[:1]})

    rows.groupBy("log").applyInArrow(write, "log long").write.format("noop").mode("overwrite").save()
    return path


def _log() -> Column:
    """A log's number, from its name."""
    return F.regexp_extract("file", r"view-(\d+)\.blf", 1).cast("long").alias("log")


def _seq() -> Column:
    return (_log() * LOG_FRAMES + F.col("seq")).alias("seq")



# the logs' frames: numbered in order, later by the start's milliseconds; error frames are neither FD nor remote
_LOGGED = f"""logged AS (SELECT seq // {LOG_FRAMES} AS log, seq // {LOG_FRAMES} * {LOG_FRAMES} + row_number() OVER (PARTITION BY seq // {LOG_FRAMES} ORDER BY seq) - 1 AS seq, seq % {MARK} = 0 AS marked, seq % {GAP} = 0 AS gap,
             channel, abs_ns + {MS_PART} AS abs_ns, arb_id, is_extended, is_fd AND NOT is_error AS is_fd, is_remote AND NOT is_error AS is_remote, is_error, data_len, w0 FROM frames)"""


@query("log_frames", sql("SELECT seq, channel, abs_ns, arb_id, is_extended, is_fd, is_remote, is_error, data_len, w0 FROM logged", _LOGGED))
def log_frames(spark, sf_dir):
    return blf.frames(spark, logs(spark, sf_dir)).select(_seq(), "channel", "abs_ns", "arb_id", "is_extended", "is_fd", "is_remote", "is_error", "data_len", F.element_at("words", 1).alias("w0"))


@query("log_ranges", sql("SELECT seq, channel, abs_ns, arb_id, is_error, data_len, w0 FROM logged", _LOGGED))
def log_ranges(spark, sf_dir):
    """Each log read by several tasks, in ranges of a few containers; objects lie across the seams."""
    path = logs(spark, sf_dir)
    frames = blf.frames(spark, path, parts=blf.split(spark, path, 2 * CONTAINER // 3))
    return frames.select(_seq(), "channel", "abs_ns", "arb_id", "is_error", "data_len", F.element_at("words", 1).alias("w0"))


@query("log_payloads", sql("SELECT seq, data_len, substr(hex(w0_hex), 1, 2 * data_len) AS payload FROM (SELECT seq, data_len, unhex(string_agg(lpad(upper(to_hex((w0 >> (8 * i)) & 255)), 2, '0'), '' ORDER BY i)) AS w0_hex FROM logged, range(0, 8) t(i) GROUP BY seq, data_len)", _LOGGED))
def log_payloads(spark, sf_dir):
    return blf.frames(spark, logs(spark, sf_dir)).select(_seq(), "data_len", F.hex("data").alias("payload"))


@query("log_channels", sql("SELECT DISTINCT channel FROM frames"))
def log_channels(spark, sf_dir):
    return local(spark, [(c,) for c in blf.list_channels(spark, logs(spark, sf_dir))], "channel int")


@query("log_channel_filter", sql("SELECT channel, count(*) AS n_frames, max(abs_ns) AS last_ns FROM logged WHERE channel IN (1, 3, 7) GROUP BY channel", _LOGGED))
def log_channel_filter(spark, sf_dir):
    return blf.frames(spark, logs(spark, sf_dir), channels=[1, 3, 7]).groupBy("channel").agg(F.count("*").alias("n_frames"), F.max("abs_ns").alias("last_ns"))


@query("log_pushed_filter", sql("SELECT seq, arb_id FROM logged WHERE channel = 5", _LOGGED))
def log_pushed_filter(spark, sf_dir):
    return blf.frames(spark, logs(spark, sf_dir)).where("channel = 5").select(_seq(), "arb_id")


_STARTED = f"epoch_us(TIMESTAMP '2026-07-22 10:00:00.25' + to_minutes(CAST(log % {MINUTES} AS INTEGER)))"
_SIZE = "CASE WHEN is_error THEN 64 WHEN is_fd THEN 116 ELSE 48 END + CASE WHEN marked THEN 40 ELSE 0 END + CASE WHEN gap THEN 3 ELSE 0 END"


@query(
    "log_file_info",
    sql(
        f"SELECT log, {_STARTED} * 1000 AS start_ns, CAST({MS_PART} AS BIGINT) AS ms_part_ns, max(abs_ns + CASE WHEN marked THEN {LATER} ELSE 0 END) AS max_obj_ns, CAST(ceil(sum({_SIZE}) / {CONTAINER}.0) AS INTEGER) AS n_containers FROM logged GROUP BY log",
        _LOGGED,
    ),
)
def log_file_info(spark, sf_dir):
    return blf.file_info(spark, logs(spark, sf_dir)).select(_log(), "start_ns", "ms_part_ns", "max_obj_ns", "n_containers")


@query("log_start_time", sql(f"SELECT DISTINCT log, CAST({_STARTED} AS DOUBLE) / 1e6 AS start_s FROM logged", _LOGGED))
def log_start_time(spark, sf_dir):
    """From the headers alone, each read by a task."""
    return blf.start_times(spark, logs(spark, sf_dir)).select(_log(), "start_s")


@query("log_remote_store", sql("SELECT channel, count(*) AS n_frames, sum(w0 & 65535) AS low FROM logged GROUP BY channel", _LOGGED))
def log_remote_store(spark, sf_dir):
    """The same logs by the way of stores that only Spark's readers open."""
    low = F.element_at("words", 1).bitwiseAND(F.lit(65535).cast("long"))
    return blf._remote(spark, [logs(spark, sf_dir)], {}).groupBy("channel").agg(F.count("*").alias("n_frames"), F.sum(low).alias("low"))


def _converted(spark: SparkSession, candidates: list[Candidate], out: str) -> DataFrame:
    """Logs of the view converted together into the folder ``out``; their numbers (the log's own) by their places."""
    by = {c.path: c for c in view.catalogs()}
    bound = {c: by[(view.PATH_A, view.PATH_B)[c % 2]] if c < view.BOUND else None for c in range(16)}
    done = convert.run_fleet(spark, candidates, bound, out)
    if failed := done.where("error is not null").select("error").first():
        raise ValueError(failed.error)
    return done.select(F.col("log").alias("place"), _log())


@query("log_converted_samples", sql("SELECT signal_name AS signal, count(*) AS n, min(phys) AS low, max(phys) AS high FROM long WHERE message_name <> 'PURCHASE' GROUP BY signal_name", q._SIGNAL_VALUES))
def log_converted_samples(spark, sf_dir):
    """From the logs to the sink and back; of the multiplexed message, a group has rows for inactive signals too."""
    path = logs(spark, sf_dir)
    _converted(spark, resolve([path]), f"{path}_t")
    samples = sink.read_fleet_samples(spark, f"{path}_t")
    return samples.where(~F.col("signal").isin("Mode", "A", "B", "C", "Always")).groupBy("signal").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(
    "log_converted_summary",
    sql(f"SELECT seq // {LOG_FRAMES} AS log, channel, count(*) FILTER (WHERE valid AND routed) AS decoded_frames, count(*) FILTER (WHERE NOT (valid AND routed)) AS unknown_frames FROM (SELECT *, message_name IS NULL OR message_name <> 'PURCHASE' OR (w0 >> 16) & 3 < 2 AS routed FROM classified) GROUP BY ALL"),
)
def log_converted_summary(spark, sf_dir):
    path = logs(spark, sf_dir)
    done = _converted(spark, resolve([path]), f"{path}_t")
    summary = spark.read.parquet(f"{path}_t/summary").where("bound").withColumnRenamed("log", "place")
    return summary.join(done, "place").select("log", "channel", "decoded_frames", "unknown_frames")


@query("log_converted_twice", sql(f"SELECT seq // {LOG_FRAMES} AS log, count(*) FILTER (WHERE valid AND (message_name <> 'PURCHASE' OR (w0 >> 16) & 3 < 2)) AS decoded_frames, 'no difference' AS verdict FROM classified GROUP BY log"))
def log_converted_twice(spark, sf_dir):
    """Two conversions of each log don't differ in any dimension."""
    path = logs(spark, sf_dir)
    pair = f"{path}_t", f"{path}_again"
    done = [_converted(spark, resolve([path]), p) for p in pair][0]
    # all but the values are compared in one way alone
    found = [convert.fleet_differences(spark, *pair, exact=e, dims=d).select(F.col("log").alias("place")) for e, d in ((True, set(compare.DIMENSIONS)), (False, {"values"}))]
    differs = found[0].unionByName(found[1]).groupBy("place").agg(F.count("*").alias("n"))
    decoded = spark.read.parquet(f"{pair[0]}/summary").groupBy(F.col("log").alias("place")).agg(F.sum("decoded_frames").alias("decoded_frames"))
    verdict = F.when(F.col("n").isNull(), "no difference").otherwise("differs").alias("verdict")
    return done.join(decoded, "place").join(differs, "place", "left").select("log", "decoded_frames", verdict)


_ITEM = "CASE class WHEN 'Std' THEN 0 WHEN 'Ext' THEN 1 WHEN 'StdRemote' THEN 2 WHEN 'ExtRemote' THEN 3 ELSE 4 END"


@query(
    "bus_stats_items",
    sql("SELECT g.channel, g.k, count(*) * 2 AS n_items, sum(run) AS total FROM (SELECT g.channel, g.class, g.k, sum(coalesce(n, 0)) OVER (PARTITION BY g.channel, g.class ORDER BY g.k) AS run FROM grid g LEFT JOIN hits h ON h.channel = g.channel AND h.class = g.class AND h.k = g.k) g GROUP BY g.channel, g.k", *q._STATS, q._COUNT_HITS),
)
def bus_stats_items(spark, sf_dir):
    """The items as exported: ten a channel, the counts among them at even places."""
    frames = view.frames(spark, sf_dir)
    items = stats.items(stats.bus_statistics(frames, q.global_end(frames)))
    count = F.col("item").isin([a for a, _ in stats.ITEMS.values()])
    return items.groupBy("channel", "k").agg(F.countDistinct("item_ordinal").alias("n_items"), F.sum(F.when(count, F.col("value"))).cast("long").alias("total"))


_NAMES = "names AS (SELECT name, i FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(compare_stats.ORDER)) + ") t(name, i))"


@query(
    "compare_statistics",
    sql("""SELECT 'shift' AS run, '1s' AS label, 'axis' AS kind, n || ' ' || n || ' prefix 50 other end' AS detail FROM size
        UNION ALL SELECT 'shift', 'CAN2.' || name, 'points', CAST((SELECT count(*) FROM axis WHERE k % 7 = 0) AS VARCHAR) FROM names
        UNION ALL SELECT 'gap', '1s', 'hole', n || ' ' || (n - 10) || ' prefix 100' FROM size
        UNION ALL SELECT 'gap', 'CAN' || c || '.' || name, 'length', n || ' ' || (n - 10) FROM names, size, range(0, 16) t(c)""", *q._STATS, _NAMES, "size AS (SELECT count(*) AS n FROM axis)"),
)
def compare_statistics(spark, sf_dir):
    """Statistics against another tool's blocks of 22 items: a shifted axis and changed values, then a gap that it leaves out."""
    frames = view.frames(spark, sf_dir)
    items = stats.items(stats.bus_statistics(frames, q.global_end(frames)))
    layout = (22, {n: 21 - 2 * i for i, n in enumerate(compare_stats.ORDER)})
    ours = items.select((F.col("channel") * 10 + F.col("item_ordinal")).alias("ordinal"), "item", "k", "t", "value")
    other = items.select((F.col("channel") * 22 + 21 - 2 * F.col("item_ordinal")).alias("ordinal"), "item", "k", "t", "value", "channel")
    k = F.col("k")
    shifted = other.withColumn("t", F.when(k >= 50, F.col("t") + 0.25).otherwise(F.col("t"))).withColumn("value", F.when((F.col("channel") == 2) & (k % 7 == 0), F.col("value") + 1).otherwise(F.col("value")))
    gap = other.where((k < 100) | (k >= 110)).withColumn("k", F.when(k >= 110, k - 10).otherwise(k))
    found = [compare_stats.differences(ours, x.drop("channel"), layout).select(F.lit(n).alias("run"), "label", "kind", "detail") for n, x in (("shift", shifted), ("gap", gap))]
    return found[0].unionByName(found[1])


# decoding beyond the view's catalogs


@query(
    "decode_float",
    "SELECT event_id, (CASE WHEN event_id % 2 = 1 THEN -1e0 ELSE 1e0 END) * (1e0 + CAST(event_id * 4096 AS DOUBLE) / 4503599627370496e0) * pow(2e0, event_id % 21 - 10) AS f64, "
    "(CASE WHEN event_id % 2 = 1 THEN -1e0 ELSE 1e0 END) * (1e0 + CAST(event_id % 8388608 AS DOUBLE) / 8388608e0) * pow(2e0, event_id % 21 - 10) AS f32 FROM events",
)
def decode_float(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    sign, power = F.col("event_id") % 2, F.col("event_id") % 21 - 10
    wide = F.shiftleft(sign, 63).bitwiseOR(F.shiftleft(power + 1023, 52)).bitwiseOR(F.shiftleft(F.col("event_id"), 12))
    narrow = F.shiftleft(sign, 31).bitwiseOR(F.shiftleft(power + 127, 23)).bitwiseOR(F.col("event_id") % 8388608)
    return e.select("event_id", bits.float64_value(wide).alias("f64"), bits.float32_value(narrow).alias("f32"))


_SCALED = """
BO_ 256 CLICK: 8 ECU_A
 SG_ Mode M : 16|2@1+ (2,10) [0|0] "" X
 SG_ A m10 : 24|16@1+ (1,0) [0|0] "" X
 SG_ B m12 : 24|8@1- (1,0) [0|0] "" X
 SG_ Always : 0|16@1+ (1,0) [0|0] "" X
"""


@query(
    "decode_mux_scaled",
    sql(
        """SELECT seq, 'Mode' AS signal_name, CAST(mode * 2 + 10 AS DOUBLE) AS phys FROM clicks WHERE mode < 2 UNION ALL SELECT seq, 'Always', CAST(w0 & 65535 AS DOUBLE) FROM clicks WHERE mode < 2
        UNION ALL SELECT seq, 'A', CAST((w0 >> 24) & 65535 AS DOUBLE) FROM clicks WHERE mode = 0
        UNION ALL SELECT seq, 'B', CAST(CASE WHEN (w0 >> 24) & 255 >= 128 THEN ((w0 >> 24) & 255) - 256 ELSE (w0 >> 24) & 255 END AS DOUBLE) FROM clicks WHERE mode = 1""",
        "clicks AS (SELECT seq, w0, (w0 >> 16) & 3 AS mode FROM frames WHERE arb_id = 256 AND NOT is_extended AND data_len = 8)",
    ),
)
def decode_mux_scaled(spark, sf_dir):
    catalog = dbc.parse(_SCALED, "P1/C.dbc")
    bound = local(spark, [(c, catalog.path) for c in range(16)], "channel int, dbc string")
    classified = fr.classify(view.frames(spark, sf_dir), bound, dbc.messages_table(spark, [catalog]))
    samples = decode.long(classified, decode.plan_table(spark, [catalog]), routed=True)
    return samples.where("active").select("seq", "signal_name", "phys")


_SIGNALS = [
    ("bit", 1, False, False, 1.0, 0.0, False), ("byte", 8, False, False, 1.0, 0.0, False), ("signed9", 9, True, False, 1.0, 0.0, False), ("word", 17, False, False, 1.0, 0.0, False), ("long33", 33, True, False, 1.0, 0.0, False),
    ("all64", 64, False, False, 1.0, 0.0, False), ("scaled", 8, False, False, 0.5, 0.0, False), ("moved", 8, True, False, 1.0, -40.0, False), ("float", 32, True, True, 1.0, 0.0, False), ("table", 4, False, False, 0.1, 5.0, True),
]


@query(
    "signal_storage",
    "SELECT * FROM (VALUES ('bit', 'int', 'u8'), ('byte', 'int', 'u8'), ('signed9', 'int', 'i16'), ('word', 'int', 'u32'), ('long33', 'int', 'i64'), ('all64', 'int', 'u64'), ('scaled', 'scaled', 'f64'), ('moved', 'scaled', 'f64'), ('float', 'float', 'f64'), ('table', 'enum', 'u8')) AS t(signal, kind, dtype)",
)
def signal_storage(spark, sf_dir):
    made = [SignalDef(name=n, start_bit=0, length=size, is_signed=s, is_float=f, scale=a, offset=b, choices={1: "on"} if c else {}) for n, size, s, f, a, b, c in _SIGNALS]
    return local(spark, [(x.name, x.kind, x.ref_dtype) for x in made], "signal string, kind string, dtype string")


@query(
    "text_helpers",
    """SELECT c_custkey, regexp_extract(p, '[^/]*$') || '（' || regexp_extract(p, '([^/]*)/[^/]*$', 1) || '）' AS display, c_name AS cleaned,
        CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size,
        (c_custkey % 7 + CAST(25 AS DOUBLE) / 100) / 7 * 100 AS percent
        FROM (SELECT c_custkey, c_name, 'logs/' || c_mktsegment || '/' || c_name || '.blf' AS p, c_custkey * c_custkey * 1000 + 1 AS n FROM customer)""",
)
def text_helpers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = F.concat(F.lit("logs\\"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".blf"))
    size = F.col("c_custkey").cast("long") * F.col("c_custkey") * 1000 + 1
    padded = F.concat("c_name", F.unhex(F.lit("0000")).cast("string"))
    return c.select("c_custkey", bits.display_name(path).alias("display"), bits.clean_text(padded).alias("cleaned"), bits.size_text(size).alias("size"), bits.overall_percent(F.col("c_custkey") % 7, 7, 25.0).alias("percent"))


# cross-checks of two tools' files

_MATCH = (
    "set_a AS (SELECT group_ordinal, string_agg(signal, '|' ORDER BY signal) AS s FROM (SELECT DISTINCT group_ordinal, signal FROM side_a) GROUP BY group_ordinal)",
    "set_b AS (SELECT group_ordinal, string_agg(signal, '|' ORDER BY signal) AS s FROM (SELECT DISTINCT group_ordinal, signal FROM side_b) GROUP BY group_ordinal)",
    "nth_a AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY group_ordinal) AS k FROM set_a)",
    "nth_b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY group_ordinal) AS k FROM set_b)",
    "met AS (SELECT a.group_ordinal AS ga, b.group_ordinal AS gb FROM nth_a a JOIN nth_b b ON a.s = b.s AND a.k = b.k)",
)


def _other_tool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pair with the second side's groups named as another tool would."""
    a, b = q._pair(spark, sf_dir)
    return a, b.withColumn("group_name", F.concat(F.lit("CAN"), F.col("group_ordinal").cast("string"), F.lit("::x")))


@query(
    "compare_signal_sets",
    sql(
        """SELECT 'G' || CAST(ga AS VARCHAR) AS group_name, signal, count(av) AS n_a, count(bv) AS n_b, count(*) FILTER (WHERE ta <> tb) AS bad_times, count(*) FILTER (WHERE abs(av - bv) > 1e-6 + 1e-6 * abs(bv)) AS bad_values FROM
        (SELECT coalesce(a.ga, b.ga) AS ga, coalesce(a.signal, b.signal) AS signal, a.value AS av, b.value AS bv, a.ts AS ta, b.ts AS tb FROM
         (SELECT x.*, ga FROM side_a x JOIN met ON ga = x.group_ordinal) a FULL OUTER JOIN (SELECT x.*, ga FROM side_b x JOIN met ON gb = x.group_ordinal) b ON a.ga = b.ga AND a.signal = b.signal AND a.seq = b.seq)
        GROUP BY ga, signal HAVING count(av) <> count(bv) OR count(*) FILTER (WHERE ta <> tb) > 0 OR count(*) FILTER (WHERE abs(av - bv) > 1e-6 + 1e-6 * abs(bv)) > 0""",
        *q._PAIR,
        *_MATCH,
    ),
)
def compare_signal_sets(spark, sf_dir):
    """Groups are matched by their signals, though no name agrees."""
    a, b = _other_tool(spark, sf_dir)
    met = compare.within_tolerance(a, b).select("group_name", "signal", "n_a", "n_b", "bad_times", "bad_values")
    return met.where(F.col("n_a") > 0).where(F.col("n_b") > 0)


@query("compare_renamed_groups", sql("SELECT 'G' || CAST(ga AS VARCHAR) AS name_a, 'CAN' || CAST(gb AS VARCHAR) || '::x' AS name_b FROM met", *q._PAIR, *_MATCH))
def compare_renamed_groups(spark, sf_dir):
    return compare.renamed_groups(*_other_tool(spark, sf_dir))


@query(
    "compare_gate",
    sql("""SELECT label, count(*) AS n FROM (SELECT coalesce(a.signal, b.signal) AS label, CASE WHEN b.seq IS NULL THEN 'missing' WHEN a.seq IS NULL THEN 'extra' WHEN a.ts <> b.ts THEN 'time' ELSE 'value' END AS kind
        FROM side_a a FULL OUTER JOIN side_b b ON a.group_ordinal = b.group_ordinal AND a.signal = b.signal AND a.seq = b.seq
        WHERE a.seq IS NULL OR b.seq IS NULL OR a.ts <> b.ts OR abs(a.value - b.value) > 1e-12) WHERE kind <> 'missing' GROUP BY label""", *q._PAIR),
)
def compare_gate(spark, sf_dir):
    """Missing samples are known and explained; the others decide."""
    found = compare.identical(*q._pair(spark, sf_dir)).select(F.lit("values").alias("dimension"), F.col("signal").alias("label"), "kind")
    return compare.gate(compare.with_severity(found, F.col("kind") == "missing")).groupBy("label").agg(F.count("*").alias("n"))
