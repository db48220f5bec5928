"""Relational queries over the frame view: each applies the engine's operators, and is stated in SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.functions import bits, timegrid
from canloom.operators import batch as batch_ops
from canloom.operators import bindings as bind
from canloom.operators import compare, decode, stats
from canloom.operators import fleet as operators_fleet
from canloom.operators import frames as fr
from canloom.plans import frame_view as view
from canloom.plans.frame_view import sql
from canloom.plans.registry import query
from canloom.sources import dbc

N_FRAMES_END = "(SELECT CAST(max(abs_ns) AS DOUBLE) * 1e-9 AS g FROM frames)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.classify(view.frames(spark, sf_dir), view.bindings(spark), dbc.messages_table(spark, view.catalogs()))


def global_end(frames: DataFrame) -> float:
    latest = frames.agg(F.max("abs_ns")).first()[0]
    return float(latest or 0) * 1e-9


def message(name: str, path: str = view.PATH_A):
    catalog = next(c for c in view.catalogs() if c.path == path)
    return next(m for m in catalog.messages.values() if m.name == name)


def one_message(spark: SparkSession, sf_dir: str, name: str, path: str = view.PATH_A) -> DataFrame:
    return decode.wide(classified(spark, sf_dir), message(name, path), path)


# 1. classification and the flagship


@query("frames_classify", sql("SELECT seq, channel, arb_norm, dbc, message_name, valid FROM classified"))
def frames_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("seq", "channel", "arb_norm", "dbc", "message_name", "valid")


@query(
    "frames_unknown_summary",
    sql("SELECT channel, count(*) AS total_frames, count(*) FILTER (WHERE NOT valid) AS unknown_frames, count(DISTINCT CASE WHEN NOT valid THEN arb_id END) AS unknown_ids FROM classified GROUP BY channel"),
)
def frames_unknown_summary(spark, sf_dir):
    return fr.channel_counts(classified(spark, sf_dir))


_SIGNAL_VALUES = """long AS (
  SELECT channel, message_name, seq, 'User' AS signal_name, CAST(w0 & 65535 AS DOUBLE) AS phys FROM classified WHERE valid AND message_name IN ('CLICK', 'CLICK_EXT')
  UNION ALL SELECT channel, message_name, seq, 'K', CAST((w0 >> 16) & 255 AS DOUBLE) FROM classified WHERE valid AND message_name = 'CLICK' AND dbc = 'P1/A.dbc'
  UNION ALL SELECT channel, message_name, seq, 'Value', CAST((w0 >> 24) & 65535 AS DOUBLE) * 0.01 + 0 FROM classified WHERE valid AND message_name = 'CLICK' AND dbc = 'P1/A.dbc'
  UNION ALL SELECT channel, message_name, seq, 'EventLow', CAST((w0 >> 40) & 4194303 AS DOUBLE) FROM classified WHERE valid AND message_name = 'CLICK' AND dbc = 'P1/A.dbc'
  UNION ALL SELECT channel, message_name, seq, 'SK', CAST(CASE WHEN (w0 >> 16) & 255 >= 128 THEN ((w0 >> 16) & 255) - 256 ELSE (w0 >> 16) & 255 END AS DOUBLE) FROM classified WHERE valid AND message_name = 'CLICK_EXT'
  UNION ALL SELECT channel, message_name, seq, 'BeUser', CAST((w0 & 255) * 256 + ((w0 >> 8) & 255) AS DOUBLE) FROM classified WHERE valid AND message_name = 'VIEW' AND dbc = 'P1/A.dbc'
  UNION ALL SELECT channel, message_name, seq, 'BeVal', CAST(CASE WHEN x >= 32768 THEN x - 65536 ELSE x END AS DOUBLE) FROM (SELECT channel, message_name, seq, ((w0 >> 24) & 255) * 256 + ((w0 >> 32) & 255) AS x FROM classified WHERE valid AND message_name = 'VIEW' AND dbc = 'P1/A.dbc')
  UNION ALL SELECT channel, message_name, seq, 'LeVal', CAST(CASE WHEN x >= 32768 THEN x - 65536 ELSE x END AS DOUBLE) * 0.5 + -10 FROM (SELECT channel, message_name, seq, (w0 >> 24) & 65535 AS x FROM classified WHERE valid AND message_name = 'VIEW' AND dbc = 'P1/A.dbc')
  UNION ALL SELECT channel, message_name, seq, 'Low', CAST(w0 AS DOUBLE) FROM classified WHERE valid AND message_name = 'VIEW' AND dbc = 'P1/B.dbc'
  UNION ALL SELECT channel, message_name, seq, 'Mode', CAST((w0 >> 16) & 3 AS DOUBLE) FROM classified WHERE valid AND message_name = 'PURCHASE' AND (w0 >> 16) & 3 < 2
  UNION ALL SELECT channel, message_name, seq, 'Always', CAST(w0 & 65535 AS DOUBLE) FROM classified WHERE valid AND message_name = 'PURCHASE' AND (w0 >> 16) & 3 < 2
  UNION ALL SELECT channel, message_name, seq, 'A', CAST((w0 >> 24) & 65535 AS DOUBLE) * 0.5 + -10 FROM classified WHERE valid AND message_name = 'PURCHASE' AND (w0 >> 16) & 3 = 0
  UNION ALL SELECT channel, message_name, seq, 'C', CAST((w0 >> 40) & 255 AS DOUBLE) FROM classified WHERE valid AND message_name = 'PURCHASE' AND (w0 >> 16) & 3 = 0
  UNION ALL SELECT channel, message_name, seq, 'B', CAST(CASE WHEN (w0 >> 24) & 255 >= 128 THEN ((w0 >> 24) & 255) - 256 ELSE (w0 >> 24) & 255 END AS DOUBLE) FROM classified WHERE valid AND message_name = 'PURCHASE' AND (w0 >> 16) & 3 = 1
  UNION ALL SELECT channel, message_name, seq, 'Kind', CAST((w0 >> 16) & 3 AS DOUBLE) FROM classified WHERE valid AND message_name = 'SIGNUP'
  UNION ALL SELECT channel, message_name, seq, 'Level', CAST((w0 >> 24) & 65535 AS DOUBLE) FROM classified WHERE valid AND message_name = 'SIGNUP')"""


@query("decode_flagship", sql("SELECT channel, message_name, signal_name, seq, phys FROM long", _SIGNAL_VALUES))
def decode_flagship(spark, sf_dir):
    samples = decode.long(classified(spark, sf_dir), decode.plan_table(spark, view.catalogs()), routed=True)
    return samples.where("active").select("channel", "message_name", "signal_name", "seq", "phys")


# 2. bus statistics

_CLASS = "CASE WHEN is_error THEN 'Err' WHEN is_extended AND is_remote THEN 'ExtRemote' WHEN is_remote THEN 'StdRemote' WHEN is_extended THEN 'Ext' ELSE 'Std' END"
_STATS = (
    f"dev AS (SELECT channel AS dc, max(abs(ts * 1000.0 - round_even(ts * 1000.0, 0))) AS worst FROM frames GROUP BY channel)",
    f"marked AS (SELECT channel, {_CLASS} AS class, CASE WHEN worst <= 2e-4 THEN round_even(ts * 1000.0, 0) * 1e6 * 1e-9 ELSE ts END AS ts FROM frames JOIN dev ON channel = dc)",
    f"ends AS {N_FRAMES_END}",
    "ks AS (SELECT CAST(unnest(range(0, (SELECT CAST(ceil(g) AS BIGINT) + 1 FROM ends))) AS INTEGER) AS k)",
    "axis0 AS (SELECT k, CASE WHEN k = 0 THEN 0e0 WHEN k = ceil(g) THEN g WHEN k = 1 THEN 1.1e0 + 0.009e0 ELSE CAST(k AS DOUBLE) + 0.009e0 END AS t FROM ks, ends)",
    "axis AS (SELECT k, CASE WHEN (SELECT max(abs(t * 1000.0 - round_even(t * 1000.0, 0))) FROM axis0) <= 2e-4 THEN round_even(t * 1000.0, 0) * 1e6 * 1e-9 ELSE t END AS t FROM axis0)",
    "classes AS (SELECT * FROM (VALUES ('Std'), ('Ext'), ('StdRemote'), ('ExtRemote'), ('Err')) AS v(class))",
    "grid AS (SELECT channel, class, k FROM (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS channel), classes, ks)",
)
_COUNT_HITS = "hits AS (SELECT channel, class, CASE WHEN ts < 1.1e0 + 0.009e0 THEN 1 WHEN floor(ts) >= 2 AND ts < floor(ts) + 0.009e0 THEN CAST(floor(ts) AS INTEGER) ELSE CAST(greatest(floor(ts) + 1, 2) AS INTEGER) END AS k, count(*) AS n FROM marked GROUP BY ALL)"
_RATE_HITS = "hits AS (SELECT channel, class, CASE WHEN ts < 1.1e0 - 0.001e0 THEN 1 ELSE CAST(greatest(floor(ts) + 1, 2) AS INTEGER) END AS k, count(*) AS n FROM marked GROUP BY ALL)"


@query(
    "bus_stats_counts",
    sql("SELECT g.channel, g.class, g.k, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.channel, g.class ORDER BY g.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS count FROM grid g LEFT JOIN hits h ON h.channel = g.channel AND h.class = g.class AND h.k = g.k", *_STATS, _COUNT_HITS),
)
def bus_stats_counts(spark, sf_dir):
    frames = view.frames(spark, sf_dir)
    return stats.bus_statistics(frames, global_end(frames)).select("channel", "class", "k", F.col("count").cast("long").alias("count"))


@query(
    "bus_stats_rates",
    sql(
        "SELECT channel, class, k, CASE WHEN k = n_last THEN coalesce(lag(rate) OVER (PARTITION BY channel, class ORDER BY k), 0e0) ELSE rate END AS rate FROM rated",
        *_STATS,
        _RATE_HITS,
        "rated AS (SELECT g.channel, g.class, g.k, CAST(ceil(e.g) AS INTEGER) AS n_last, CASE WHEN g.k >= 1 AND g.k < ceil(e.g) THEN CAST(coalesce(n, 0) AS DOUBLE) / (CASE WHEN g.k = 1 THEN 1.1e0 WHEN g.k = 2 THEN 2e0 - 1.1e0 ELSE 1e0 END) ELSE 0e0 END AS rate FROM grid g CROSS JOIN ends e LEFT JOIN hits h ON h.channel = g.channel AND h.class = g.class AND h.k = g.k)",
    ),
)
def bus_stats_rates(spark, sf_dir):
    frames = view.frames(spark, sf_dir)
    return stats.bus_statistics(frames, global_end(frames)).select("channel", "class", "k", "rate")


@query("bus_stats_axis", sql("SELECT k, t FROM axis", *_STATS))
def bus_stats_axis(spark, sf_dir):
    return stats.axis(spark, global_end(view.frames(spark, sf_dir)))


@query("frame_class_counts", sql(f"SELECT channel, {_CLASS} AS class, count(*) AS n_frames FROM frames GROUP BY ALL"))
def frame_class_counts(spark, sf_dir):
    return stats.class_counts(view.frames(spark, sf_dir))


# five logs in one plan: each has an end, and an axis, of its own

_FLEET = (
    "logs AS (SELECT *, 'L' || CAST(seq % 5 AS VARCHAR) AS file FROM frames WHERE seq % 5 < 4 OR abs_ns < 77000000000)",
    "dev AS (SELECT file AS df, channel AS dc, max(abs(ts * 1000.0 - round_even(ts * 1000.0, 0))) AS worst FROM logs GROUP BY ALL)",
    f"marked AS (SELECT file, channel, {_CLASS} AS class, CASE WHEN worst <= 2e-4 THEN round_even(ts * 1000.0, 0) * 1e6 * 1e-9 ELSE ts END AS ts FROM logs JOIN dev ON channel = dc AND file = df)",
    "ends AS (SELECT file, CAST(max(abs_ns) AS DOUBLE) * 1e-9 AS g FROM logs GROUP BY file)",
    "ks AS (SELECT file, g, CAST(ceil(g) AS INTEGER) AS last, CAST(unnest(range(0, CAST(ceil(g) AS BIGINT) + 1)) AS INTEGER) AS k FROM ends)",
    "axis0 AS (SELECT *, CASE WHEN k = 0 THEN 0e0 WHEN k = last THEN g WHEN k = 1 THEN 1.1e0 + 0.009e0 ELSE CAST(k AS DOUBLE) + 0.009e0 END AS t0 FROM ks)",
    "axis AS (SELECT file, last, k, CASE WHEN max(abs(t0 * 1000.0 - round_even(t0 * 1000.0, 0))) OVER (PARTITION BY file) <= 2e-4 THEN round_even(t0 * 1000.0, 0) * 1e6 * 1e-9 ELSE t0 END AS t FROM axis0)",
    "grid AS (SELECT a.*, channel, class FROM axis a, (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS channel), (VALUES ('Std'), ('Ext'), ('StdRemote'), ('ExtRemote'), ('Err')) AS v(class))",
    "c AS (SELECT file, channel, class, CASE WHEN ts < 1.1e0 + 0.009e0 THEN 1 WHEN floor(ts) >= 2 AND ts < floor(ts) + 0.009e0 THEN CAST(floor(ts) AS INTEGER) ELSE CAST(greatest(floor(ts) + 1, 2) AS INTEGER) END AS k, count(*) AS n FROM marked GROUP BY ALL)",
    "r AS (SELECT file, channel, class, CASE WHEN ts < 1.1e0 - 0.001e0 THEN 1 ELSE CAST(greatest(floor(ts) + 1, 2) AS INTEGER) END AS k, count(*) AS n FROM marked GROUP BY ALL)",
    "dense AS (SELECT g.*, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.file, g.channel, g.class ORDER BY g.k) AS count, CASE WHEN g.k >= 1 AND g.k < last THEN CAST(coalesce(r.n, 0) AS DOUBLE) / (CASE WHEN g.k = 1 THEN 1.1e0 WHEN g.k = 2 THEN 2e0 - 1.1e0 ELSE 1e0 END) ELSE 0e0 END AS rate "
    "FROM grid g LEFT JOIN c ON c.file = g.file AND c.channel = g.channel AND c.class = g.class AND c.k = g.k LEFT JOIN r ON r.file = g.file AND r.channel = g.channel AND r.class = g.class AND r.k = g.k)",
)


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames of five logs, one of them shorter, and the logs."""
    frames = view.frames(spark, sf_dir).withColumn("file", F.concat(F.lit("L"), (F.col("seq") % 5).cast("string"))).where("seq % 5 < 4 or abs_ns < 77000000000")
    return frames, frames.groupBy("file").agg(F.max("abs_ns").alias("max_obj_ns"), F.lit(None).cast("string").alias("error"))


@query("fleet_statistics", sql("SELECT file, channel, class, k, t, CAST(count AS BIGINT) AS count, CASE WHEN k = last THEN coalesce(lag(rate) OVER (PARTITION BY file, channel, class ORDER BY k), 0e0) ELSE rate END AS rate FROM dense", *_FLEET))
def fleet_statistics(spark, sf_dir):
    fleet = operators_fleet.measured(*_logs(spark, sf_dir), view.bindings(spark), view.catalogs())
    return fleet.statistics.withColumn("count", F.col("count").cast("long"))


_FLEET_CLASSIFIED = "known AS (SELECT f.*, c.message_name, c.valid, c.arb_norm AS norm FROM logs f JOIN classified c ON c.seq = f.seq)"


@query(
    "fleet_groups",
    sql("""SELECT file, channel, message_name, n_frames, CAST(row_number() OVER (PARTITION BY file, channel ORDER BY first_seq) AS INTEGER) AS series_order, max(last_ts) OVER (PARTITION BY file) - min(first_ts) OVER (PARTITION BY file) AS duration_seconds
        FROM (SELECT file, channel, norm, message_name, count(*) AS n_frames, min(seq) AS first_seq, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts FROM known WHERE valid GROUP BY ALL)""", _FLEET[0], _FLEET_CLASSIFIED),
)
def fleet_groups(spark, sf_dir):
    fleet = operators_fleet.measured(*_logs(spark, sf_dir), view.bindings(spark), view.catalogs())
    return fleet.groups.join(fleet.durations, "file").select("file", "channel", "message_name", "n_frames", "series_order", "duration_seconds")


@query(
    "fleet_summary",
    sql("""SELECT l.file, b.channel, b.dbc IS NOT NULL AS bound, coalesce(n.decoded, 0) AS decoded_frames, coalesce(n.unknown, 0) AS unknown_frames, coalesce(n.ids, 0) AS unknown_ids, coalesce(s.n, 0) AS signal_count
        FROM (SELECT DISTINCT file FROM logs) l CROSS JOIN bound b LEFT JOIN n ON n.file = l.file AND n.channel = b.channel LEFT JOIN s ON s.file = l.file AND s.channel = b.channel""",
        _FLEET[0],
        "known AS (SELECT f.file, c.* FROM logs f JOIN classified c ON c.seq = f.seq)",
        "n AS (SELECT file, channel, count(*) FILTER (WHERE valid) AS decoded, count(*) FILTER (WHERE NOT valid) AS unknown, count(DISTINCT CASE WHEN NOT valid THEN arb_id END) AS ids FROM known GROUP BY ALL)",
        "s AS (SELECT file, channel, CAST(sum(n_signals) AS BIGINT) AS n FROM (SELECT DISTINCT file, channel, dbc, arb_norm FROM known WHERE valid) d JOIN messages m ON m.dbc = d.dbc AND m.arb_norm = d.arb_norm GROUP BY ALL)"),
)
def fleet_summary(spark, sf_dir):
    fleet = operators_fleet.measured(*_logs(spark, sf_dir), view.bindings(spark), view.catalogs())
    return fleet.summary.select("file", "channel", "bound", "decoded_frames", "unknown_frames", "unknown_ids", "signal_count")


_ALIGN = "mixed AS (SELECT seq, channel, CASE WHEN channel % 2 = 0 THEN round_even(ts * 1000.0, 0) / 1000.0 + 1e-8 ELSE ts END AS ts FROM frames)"


@query(
    "align_ms_grid",
    sql("SELECT seq, m.channel, CASE WHEN worst <= 2e-4 THEN round_even(ts * 1000.0, 0) * 1e6 * 1e-9 ELSE ts END AS ts FROM mixed m JOIN (SELECT channel, max(abs(ts * 1000.0 - round_even(ts * 1000.0, 0))) AS worst FROM mixed GROUP BY channel) d ON d.channel = m.channel", _ALIGN),
)
def align_ms_grid(spark, sf_dir):
    frames = view.frames(spark, sf_dir)
    near = F.rint(F.col("ts") * 1000.0) / 1000.0 + F.lit(1e-8)
    mixed = frames.select("seq", "channel", F.when(F.col("channel") % 2 == 0, near).otherwise(F.col("ts")).alias("ts"))
    return timegrid.align(mixed, ["channel"]).select("seq", "channel", "ts")


# 3. decoding


def _wide_sql(name: str, columns: str, more: str = "", path: str = view.PATH_A) -> str:
    return sql(f"SELECT channel, seq, {columns} FROM classified WHERE valid AND message_name = '{name}' AND dbc = '{path}' {more}")


@query("decode_le", _wide_sql("CLICK", 'w0 & 65535 AS "User", (w0 >> 16) & 255 AS "K", CAST((w0 >> 24) & 65535 AS DOUBLE) * 0.01 + 0 AS "Value", (w0 >> 40) & 4194303 AS "EventLow"'))
def decode_le(spark, sf_dir):
    out = one_message(spark, sf_dir, "CLICK")
    return out.select("channel", "seq", *(F.col(c).cast("long").alias(c) for c in ("User", "K", "EventLow")), "Value")


@query("decode_be", _wide_sql("VIEW", '(w0 & 255) * 256 + ((w0 >> 8) & 255) AS "BeUser"'))
def decode_be(spark, sf_dir):
    return one_message(spark, sf_dir, "VIEW").select("channel", "seq", F.col("BeUser").cast("long").alias("BeUser"))


@query("decode_signed", _wide_sql("VIEW", 'CASE WHEN ((w0 >> 24) & 255) * 256 + ((w0 >> 32) & 255) >= 32768 THEN ((w0 >> 24) & 255) * 256 + ((w0 >> 32) & 255) - 65536 ELSE ((w0 >> 24) & 255) * 256 + ((w0 >> 32) & 255) END AS "BeVal"'))
def decode_signed(spark, sf_dir):
    return one_message(spark, sf_dir, "VIEW").select("channel", "seq", F.col("BeVal").cast("long").alias("BeVal"))


@query("decode_scaled", _wide_sql("VIEW", 'CAST(CASE WHEN (w0 >> 24) & 65535 >= 32768 THEN ((w0 >> 24) & 65535) - 65536 ELSE (w0 >> 24) & 65535 END AS DOUBLE) * 0.5 + -10 AS "LeVal"'))
def decode_scaled(spark, sf_dir):
    return one_message(spark, sf_dir, "VIEW").select("channel", "seq", "LeVal")


@query(
    "decode_enum_lookup",
    sql("""SELECT channel, seq, (w0 >> 16) & 3 AS kind_raw, CASE (w0 >> 16) & 3 WHEN 0 THEN 'off' WHEN 1 THEN 'on' WHEN 2 THEN 'auto' ELSE 'value' END AS kind_text, (w0 >> 24) & 65535 AS level_raw,
        (w0 >> 24) & 65535 = 3050 AS level_named, CAST((w0 >> 24) & 65535 AS DOUBLE) * 0.1 + -50 AS level_default FROM classified WHERE valid AND message_name = 'SIGNUP'"""),
)
def decode_enum_lookup(spark, sf_dir):
    own = one_message(spark, sf_dir, "SIGNUP")
    level = next(s for s in message("SIGNUP").signals if s.name == "Level")
    table = lambda name: F.create_map(*(F.lit(x) for s in message("SIGNUP").signals if s.name == name for k, v in sorted(s.choices.items()) for x in (k, v)))
    named = lambda name: F.try_element_at(table(name), F.col(name).cast("int"))
    return own.select(
        "channel", "seq", F.col("Kind").cast("long").alias("kind_raw"), F.coalesce(named("Kind"), F.lit("value")).alias("kind_text"), F.col("Level").cast("long").alias("level_raw"),
        named("Level").isNotNull().alias("level_named"), bits.physical(F.col("Level").cast("long"), level.scale, level.offset).alias("level_default"),
    )


@query(
    "decode_mux",
    sql("""SELECT channel, seq, (w0 >> 16) & 3 AS "Mode", CASE WHEN (w0 >> 16) & 3 = 0 THEN CAST((w0 >> 24) & 65535 AS DOUBLE) * 0.5 + -10 ELSE CAST('NaN' AS DOUBLE) END AS "A",
        CASE WHEN (w0 >> 16) & 3 = 0 THEN (w0 >> 40) & 255 ELSE 0 END AS "C", CASE WHEN (w0 >> 16) & 3 <> 1 THEN 0 WHEN (w0 >> 24) & 255 >= 128 THEN ((w0 >> 24) & 255) - 256 ELSE (w0 >> 24) & 255 END AS "B",
        w0 & 65535 AS "Always" FROM classified WHERE valid AND message_name = 'PURCHASE' AND (w0 >> 16) & 3 < 2"""),
)
def decode_mux(spark, sf_dir):
    out = one_message(spark, sf_dir, "PURCHASE")
    return out.select("channel", "seq", "A", *(F.col(c).cast("long").alias(c) for c in ("Mode", "C", "B", "Always")))


@query(
    "decode_mux_unknown",
    sql("SELECT channel, count(*) FILTER (WHERE valid AND NOT (message_name = 'PURCHASE' AND (w0 >> 16) & 3 >= 2)) AS decoded_frames, count(*) FILTER (WHERE NOT valid OR message_name = 'PURCHASE' AND (w0 >> 16) & 3 >= 2) AS unknown_frames FROM classified GROUP BY channel"),
)
def decode_mux_unknown(spark, sf_dir):
    routed = decode.routed_frames(classified(spark, sf_dir), decode.plan_table(spark, view.catalogs()))
    return routed.groupBy("channel").agg(F.count_if("valid").alias("decoded_frames"), F.count_if(~F.col("valid")).alias("unknown_frames"))


_WIDE_DBC = """
BO_ 1 T: 64 X
 SG_ Le : 0|512@1+ (1,0) [0|0] "" X
 SG_ Be : 7|512@0+ (1,0) [0|0] "" X
 SG_ Cross : 60|10@1+ (1,0) [0|0] "" X
"""


@query("decode_truncate64", sql("SELECT seq, whole AS le, seq AS be, CAST((whole // 1152921504606846976) + ((whole + 7) % 64) * 16 AS BIGINT) AS crossing FROM f0"))
def decode_truncate64(spark, sf_dir):
    """Of 512 bits, a little-endian signal keeps the first 64, a big-endian one the last; another crosses two words."""
    signals = {s.name: s for s in dbc.parse(_WIDE_DBC).messages[1].signals}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.rint(F.col("value") * 100).cast("long").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id")
    mask = lambda c, m: F.col(c).bitwiseAND(F.lit(m).cast("long"))
    whole = F.shiftleft(F.col("seq") % 4194304, 40).bitwiseOR(F.shiftleft(mask("v", 65535), 24)).bitwiseOR(F.shiftleft(mask("k", 255), 16)).bitwiseOR(mask("user_id", 65535))
    zero = F.lit(0).cast("long")
    words = F.array(whole, whole + 7, *[zero] * 5, bits.swap_bytes(F.col("seq")))
    return events.select("seq", words.alias("words")).select(
        "seq",
        *(decode.signal_value(F.col("words"), bits.big_words(F.col("words")), signals[n]).cast("long").alias(a) for n, a in (("Le", "le"), ("Be", "be"), ("Cross", "crossing"))),
    )


# 4. grouping, order and names

_BUCKETS = "buckets AS (SELECT channel, arb_norm, message_name, count(*) AS n_frames, min(seq) AS first_seq, arg_min(arb_id, seq) AS first_arb_id, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts FROM classified WHERE valid GROUP BY channel, arb_norm, message_name)"
_ORDERED = "ordered AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY first_seq) AS series_order FROM buckets)"


@query("bucket_first_seen", sql("SELECT channel, arb_norm, message_name, n_frames, first_seq, first_arb_id FROM buckets", _BUCKETS))
def bucket_first_seen(spark, sf_dir):
    return fr.buckets(classified(spark, sf_dir)).select("channel", "arb_norm", "message_name", "n_frames", "first_seq", "first_arb_id")


@query("series_order", sql("SELECT channel, message_name, CAST(series_order AS INTEGER) AS series_order FROM ordered", _BUCKETS, _ORDERED))
def series_order(spark, sf_dir):
    return fr.buckets(classified(spark, sf_dir)).select("channel", "message_name", "series_order")


@query(
    "group_name_dedupe",
    sql("SELECT channel, message_name, CASE WHEN row_number() OVER (PARTITION BY message_name ORDER BY channel, series_order) = 1 THEN message_name ELSE 'CAN' || CAST(channel AS VARCHAR) || '::' || message_name END AS group_name FROM ordered", _BUCKETS, _ORDERED),
)
def group_name_dedupe(spark, sf_dir):
    return fr.group_names(fr.buckets(classified(spark, sf_dir))).select("channel", "message_name", "group_name")


@query("channel_duration", sql("SELECT coalesce(max(last_ts) - min(first_ts), 0e0) AS duration_seconds FROM buckets", _BUCKETS))
def channel_duration(spark, sf_dir):
    return fr.duration(fr.buckets(classified(spark, sf_dir)))


@query(
    "ingest_summary",
    sql("""SELECT b.channel, b.dbc IS NOT NULL AS bound, coalesce(c.decoded, 0) AS decoded_frames, coalesce(s.n, 0) AS signal_count, coalesce(c.unknown, r.lost, 0) AS unknown_frames,
        coalesce(c.ids, r.ids, 0) AS unknown_ids, coalesce(r.kept, 0) AS raw_frames,
        CASE WHEN b.dbc IS NOT NULL AND coalesce(s.n, 0) = 0 THEN 'NO_FRAMES' WHEN b.dbc IS NULL AND coalesce(r.lost, 0) > 0 AND coalesce(r.kept, 0) = 0 THEN 'NO_MATCH' END AS warning
        FROM bound b LEFT JOIN counts c ON c.channel = b.channel LEFT JOIN emitted s ON s.channel = b.channel LEFT JOIN raws r ON r.channel = b.channel""",
        "counts AS (SELECT channel, count(*) FILTER (WHERE valid) AS decoded, count(*) FILTER (WHERE NOT valid) AS unknown, count(DISTINCT CASE WHEN NOT valid THEN arb_id END) AS ids FROM classified GROUP BY channel)",
        "emitted AS (SELECT channel, CAST(sum(n_signals) AS BIGINT) AS n FROM (SELECT DISTINCT channel, dbc, arb_norm FROM classified WHERE valid) d JOIN messages m ON m.dbc = d.dbc AND m.arb_norm = d.arb_norm GROUP BY channel)",
        "raws AS (SELECT channel, count(*) FILTER (WHERE known) AS kept, count(*) FILTER (WHERE NOT known) AS lost, count(DISTINCT CASE WHEN NOT known THEN arb_id END) AS ids FROM (SELECT f.channel, f.arb_id, f.arb_norm IN (SELECT arb_norm FROM messages) AS known FROM frames f JOIN bound b ON b.channel = f.channel AND b.dbc IS NULL) GROUP BY channel)"),
)
def ingest_summary(spark, sf_dir):
    catalogs = view.catalogs()
    messages, bound, frames = dbc.messages_table(spark, catalogs), view.bindings(spark), view.frames(spark, sf_dir)
    counts = local(spark, [(c.path, m.arb_norm, len(m.signals)) for c in catalogs for m in c.messages.values()], "dbc string, arb_norm long, n_signals long")
    return fr.ingest_summary(bound, classified(spark, sf_dir), counts, fr.raw_frames(frames, bound, messages))


@query("signal_profile", sql("SELECT message_name AS group_name, signal_name AS signal, count(*) AS n, arg_min(phys, seq) AS first_value, arg_max(phys, seq) AS last_value FROM long GROUP BY message_name, signal_name", _SIGNAL_VALUES))
def signal_profile(spark, sf_dir):
    samples = decode.long(classified(spark, sf_dir), decode.plan_table(spark, view.catalogs()), routed=True).where("active")
    own = samples.select(F.col("message_name").alias("group_name"), F.col("signal_name").alias("signal"), "seq", "ts", F.col("phys").alias("value"))
    return compare.profile(own).select("group_name", "signal", "n", "first_value", "last_value")


# 5. bindings and catalogs


@query("channels_distinct", sql("SELECT DISTINCT channel FROM frames"))
def channels_distinct(spark, sf_dir):
    return view.frames(spark, sf_dir).select("channel").distinct()


_SUPPLIERS = "(SELECT 'F' || CAST(s_nationkey AS VARCHAR) AS stem, 'P/' || s_name || '.dbc' AS dbc, s_suppkey AS load_order FROM supplier)"
_MAP = "(SELECT 'F' || CAST(n_nationkey AS VARCHAR) AS stem, CAST(n_nationkey % 16 AS INTEGER) AS channel FROM nation WHERE n_nationkey % 5 <> 3)"


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for catalogs, nations for the lines of the map."""
    catalogs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("stem"), F.concat(F.lit("P/"), "s_name", F.lit(".dbc")).alias("dbc"), F.col("s_suppkey").alias("load_order"))
    mapping = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 5 <> 3").select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("stem"), (F.col("n_nationkey") % 16).cast("int").alias("channel"))
    return bind.suggestions(catalogs, mapping)


_AUTO = f"auto AS (SELECT channel, arg_max(dbc, load_order) AS dbc FROM {_SUPPLIERS} c JOIN {_MAP} m ON m.stem = c.stem GROUP BY channel)"


@query("auto_bindings", f"WITH {_AUTO} SELECT channel, dbc FROM auto")
def auto_bindings(spark, sf_dir):
    return _suggested(spark, sf_dir)


_DECISION = (
    _AUTO,
    "log AS (SELECT DISTINCT channel FROM frames WHERE channel % 3 <> 1)",
    "prev AS (SELECT CAST(n_nationkey AS INTEGER) AS channel, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'gone.dbc' ELSE (SELECT min(dbc) FROM loaded) END AS dbc FROM nation WHERE n_nationkey < 12 AND n_nationkey % 2 < 2)",
    "rows0 AS (SELECT coalesce(l.channel, a.channel) AS channel, l.channel IS NOT NULL AS in_log, a.dbc AS auto_dbc FROM log l FULL OUTER JOIN auto a ON a.channel = l.channel)",
    "decided AS (SELECT r.channel, in_log, CASE WHEN p.channel IS NOT NULL AND p.dbc IS NULL THEN NULL WHEN p.dbc IN (SELECT dbc FROM loaded) THEN p.dbc WHEN auto_dbc IN (SELECT dbc FROM loaded) THEN auto_dbc END AS binding FROM rows0 r LEFT JOIN prev p ON p.channel = r.channel)",
    "stated AS (SELECT channel, binding, CASE WHEN NOT in_log THEN 'NO_DATA' WHEN binding IS NOT NULL THEN 'BOUND' ELSE 'NOT_EXPORTED' END AS state FROM decided)",
)
_LOADED = "loaded AS (SELECT 'P/' || s_name || '.dbc' AS dbc FROM supplier WHERE s_suppkey % 4 <> 0)"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("P/"), "s_name", F.lit(".dbc")).alias("dbc"))
    least = loaded.agg(F.min("dbc")).first()[0]
    previous = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 12").select(
        F.col("n_nationkey").cast("int").alias("channel"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(None)).when(F.col("n_nationkey") % 4 == 1, "gone.dbc").otherwise(F.lit(least)).alias("dbc")
    )
    log = view.frames(spark, sf_dir).where("channel % 3 <> 1").select("channel")
    return bind.decide(log, _suggested(spark, sf_dir), previous, loaded)


@query("binding_decision", sql("SELECT channel, binding, state FROM stated", _LOADED, *_DECISION))
def binding_decision(spark, sf_dir):
    return _decided(spark, sf_dir)


@query("binding_state_counts", sql("SELECT state, count(*) AS n_channels FROM stated GROUP BY state", _LOADED, *_DECISION))
def binding_state_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n_channels"))


@query("known_ids_union", sql("SELECT DISTINCT CAST(arb_norm AS BIGINT) AS arb_norm FROM messages"))
def known_ids_union(spark, sf_dir):
    return fr.known_ids(view.bindings(spark), dbc.messages_table(spark, view.catalogs()))


@query(
    "mapping_parse",
    """SELECT new_name, CAST(substr(chan, 4) AS INTEGER) AS channel FROM (SELECT split_part(line, '——', 2) AS new_name, split_part(line, '——', 3) AS chan FROM
       (SELECT CASE WHEN c_custkey % 7 = 0 THEN '# note' WHEN c_custkey % 5 = 0 THEN c_name || '——N' || CAST(c_custkey AS VARCHAR) || '——' ELSE c_name || '——N' || CAST(c_custkey AS VARCHAR) || '——CAN' || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END END AS line FROM customer)
       WHERE line NOT LIKE '#%') WHERE regexp_matches(substr(chan, 4), '^[0-9]+$')""",
)
def mapping_parse(spark, sf_dir):
    """Lines of a map as a table: skipped are comments, lines without a channel, and what isn't a number."""
    c = F.col
    key = c("c_custkey").cast("string")
    head = F.concat("c_name", F.lit("——N"), key, F.lit("——"))
    number = F.when(c("c_custkey") % 11 == 0, "x").otherwise(c("c_nationkey").cast("string"))
    line = F.when(c("c_custkey") % 7 == 0, "# note").when(c("c_custkey") % 5 == 0, head).otherwise(F.concat(head, F.lit("CAN"), number))
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(line.alias("line"))
    return batch_ops.mapping_lines(lines)


# 6. raw export and payloads

_UNBOUND = "raw AS (SELECT f.*, f.arb_norm IN (SELECT arb_norm FROM messages) AS exported FROM frames f JOIN bound b ON b.channel = f.channel AND b.dbc IS NULL)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.raw_frames(view.frames(spark, sf_dir), view.bindings(spark), dbc.messages_table(spark, view.catalogs()))


@query("raw_unbound_semi", sql("SELECT seq, channel, arb_id FROM raw", _UNBOUND))
def raw_unbound_semi(spark, sf_dir):
    return _raw(spark, sf_dir).select("seq", "channel", "arb_id")


@query("raw_known_filter", sql("SELECT seq, channel, arb_id, w0 FROM raw WHERE exported", _UNBOUND))
def raw_known_filter(spark, sf_dir):
    return _raw(spark, sf_dir).where("exported").select("seq", "channel", "arb_id", "w0")


@query("raw_unknown_anti", sql("SELECT channel, arb_id, count(*) AS n_frames FROM raw WHERE NOT exported GROUP BY channel, arb_id", _UNBOUND))
def raw_unknown_anti(spark, sf_dir):
    return _raw(spark, sf_dir).where("not exported").groupBy("channel", "arb_id").agg(F.count("*").alias("n_frames"))


_HEX = " || ".join(f"CASE WHEN data_len > {i} THEN printf('%02x', (w0 >> {8 * i}) & 255) ELSE '00' END" for i in range(8))


def _with_data(frames: DataFrame) -> DataFrame:
    """data: the first data_len bytes of the payload, low byte first."""
    return frames.withColumn("data", F.expr("substring(unhex(lpad(hex(w0), 16, '0')), 1, 8)")).withColumn("data", F.unhex(F.expr("substring(" + "concat(" + ", ".join(f"substring(hex(data), {15 - 2 * i}, 2)" for i in range(8)) + "), 1, 2 * data_len)")))


@query("payload_pad", sql(f"SELECT seq, channel, CAST(data_len AS INTEGER) AS dlc, {_HEX} AS data FROM raw WHERE exported", _UNBOUND))
def payload_pad(spark, sf_dir):
    raw = _with_data(_raw(spark, sf_dir))
    return fr.raw_groups(raw).select("seq", "channel", "dlc", F.lower(F.hex(bits.padded(F.col("data"), 8))).alias("data"))


@query("payload_length_hist", sql("SELECT channel, is_fd, data_len, count(*) AS n_frames, CAST(sum(data_len) AS BIGINT) AS n_bytes FROM frames GROUP BY ALL"))
def payload_length_hist(spark, sf_dir):
    return view.frames(spark, sf_dir).groupBy("channel", "is_fd", "data_len").agg(F.count("*").alias("n_frames"), F.sum("data_len").alias("n_bytes"))


# 7. cross-checks

_PAIR = (
    "side_a AS (SELECT channel AS group_ordinal, 'G' || CAST(channel AS VARCHAR) AS group_name, 'S' || CAST(arb_id AS VARCHAR) AS signal, seq, ts, CAST(w0 & 65535 AS DOUBLE) AS value FROM frames)",
    "side_b AS (SELECT group_ordinal, CASE WHEN group_ordinal = 3 THEN 'G33' ELSE group_name END AS group_name, signal, seq, CASE WHEN seq % 97 = 0 THEN ts + 1e-3 ELSE ts END AS ts, CASE WHEN seq % 101 = 0 THEN value + 1 WHEN seq % 103 = 0 THEN value * (1 + 1e-8) ELSE value END AS value FROM side_a WHERE seq % 89 <> 0 AND NOT (group_ordinal = 5 AND signal = 'S258'))",
)


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The frames as samples, and a copy that misses some, moves some and changes some."""
    f, c = view.frames(spark, sf_dir), F.col
    a = f.select(
        c("channel").alias("group_ordinal"), F.concat(F.lit("G"), c("channel").cast("string")).alias("group_name"), F.concat(F.lit("S"), c("arb_id").cast("string")).alias("signal"), "seq", "ts",
        F.element_at("words", 1).bitwiseAND(F.lit(65535).cast("long")).cast("double").alias("value"), F.lit(None).cast("string").alias("text"), F.lit("f64").alias("dtype"),
    )
    b = a.where((c("seq") % 89 != 0) & ~((c("group_ordinal") == 5) & (c("signal") == "S258")))
    b = b.withColumn("group_name", F.when(c("group_ordinal") == 3, "G33").otherwise(c("group_name")))
    b = b.withColumn("ts", F.when(c("seq") % 97 == 0, c("ts") + F.lit(1e-3)).otherwise(c("ts")))
    return a, b.withColumn("value", F.when(c("seq") % 101 == 0, c("value") + 1).when(c("seq") % 103 == 0, c("value") * (1 + F.lit(1e-8))).otherwise(c("value")))


@query(
    "compare_identical",
    sql("""SELECT coalesce(a.group_ordinal, b.group_ordinal) AS group_ordinal, coalesce(a.signal, b.signal) AS signal, coalesce(a.seq, b.seq) AS seq,
        CASE WHEN b.seq IS NULL THEN 'missing' WHEN a.seq IS NULL THEN 'extra' WHEN a.ts <> b.ts THEN 'time' ELSE 'value' END AS kind
        FROM side_a a FULL OUTER JOIN side_b b ON a.group_ordinal = b.group_ordinal AND a.signal = b.signal AND a.seq = b.seq
        WHERE a.seq IS NULL OR b.seq IS NULL OR a.ts <> b.ts OR abs(a.value - b.value) > 1e-12""", *_PAIR),
)
def compare_identical(spark, sf_dir):
    return compare.identical(*_pair(spark, sf_dir)).select("group_ordinal", "signal", "seq", "kind")


_SETS = tuple(
    f"set_{x} AS (SELECT group_ordinal, group_name, string_agg(signal, '|' ORDER BY signal) AS s, count(*) AS n, row_number() OVER (PARTITION BY string_agg(signal, '|' ORDER BY signal) ORDER BY group_ordinal) AS k FROM (SELECT DISTINCT group_ordinal, group_name, signal FROM side_{x}) GROUP BY group_ordinal, group_name)"
    for x in "ab"
)


@query(
    "compare_tolerance",
    sql("""SELECT coalesce(min(ga), min(gb)) AS group_name, signal, count(av) AS n_a, count(bv) AS n_b, count(*) FILTER (WHERE ta <> tb) AS bad_times, count(*) FILTER (WHERE abs(av - bv) > 1e-6 + 1e-6 * abs(bv)) AS bad_values FROM
        (SELECT a.group_name AS ga, b.group_name AS gb, coalesce(a.s, b.s) AS s, coalesce(a.k, b.k) AS k, coalesce(a.signal, b.signal) AS signal, a.value AS av, b.value AS bv, a.ts AS ta, b.ts AS tb FROM
         (SELECT x.*, s, k FROM side_a x JOIN set_a ON set_a.group_ordinal = x.group_ordinal) a FULL OUTER JOIN (SELECT x.*, s, k FROM side_b x JOIN set_b ON set_b.group_ordinal = x.group_ordinal) b
         ON a.s = b.s AND a.k = b.k AND a.signal = b.signal AND a.seq = b.seq) GROUP BY s, k, signal
        HAVING count(av) <> count(bv) OR count(*) FILTER (WHERE ta <> tb) > 0 OR count(*) FILTER (WHERE abs(av - bv) > 1e-6 + 1e-6 * abs(bv)) > 0""", *_PAIR, *_SETS),
)
def compare_tolerance(spark, sf_dir):
    return compare.within_tolerance(*_pair(spark, sf_dir)).select("group_name", "signal", "n_a", "n_b", "bad_times", "bad_values")


@query(
    "compare_missing_groups",
    sql(
        "SELECT 'a' AS side, group_name, n AS n_signals FROM set_a WHERE NOT EXISTS (SELECT 1 FROM set_b WHERE set_b.s = set_a.s AND set_b.k = set_a.k) UNION ALL SELECT 'b', group_name, n FROM set_b WHERE NOT EXISTS (SELECT 1 FROM set_a WHERE set_b.s = set_a.s AND set_b.k = set_a.k)",
        *_PAIR,
        *_SETS,
    ),
)
def compare_missing_groups(spark, sf_dir):
    return compare.missing_groups(*_pair(spark, sf_dir))


@query(
    "compare_nearest_time",
    sql("""SELECT series, b_seq, a_seq FROM (SELECT b.channel AS series, b.seq AS b_seq, a.seq AS a_seq, row_number() OVER (PARTITION BY b.seq ORDER BY abs(a.ts - b.ts), a.seq) AS rn
        FROM frames b JOIN frames a ON a.channel = b.channel AND a.arb_id = 256 AND b.arb_id = 257 AND abs(a.ts - b.ts) <= 5e-2) WHERE rn = 1"""),
)
def compare_nearest_time(spark, sf_dir):
    f = view.frames(spark, sf_dir).select(F.col("channel").alias("series"), "seq", "ts", "arb_id")
    return compare.nearest(f.where("arb_id = 256"), f.where("arb_id = 257"), 5e-2).select("series", "b_seq", "a_seq")


@query(
    "axis_steps",
    sql("""SELECT k, CASE WHEN k = 1 THEN CASE WHEN abs(step - 1.109) > 1e-9 THEN 'first' ELSE 'ok' END WHEN k = 2 THEN CASE WHEN abs(step - 0.9) > 1e-9 THEN 'second' ELSE 'ok' END
        WHEN k < n THEN CASE WHEN abs(step - 1.0) > 1e-9 THEN 'inner' ELSE 'ok' END ELSE CASE WHEN step > 1.0 + 1e-9 THEN 'last' ELSE 'ok' END END AS verdict
        FROM (SELECT k, t - lag(t) OVER (ORDER BY k) AS step, max(k) OVER () AS n FROM moved) WHERE k >= 1""", *_STATS, "moved AS (SELECT k, CASE WHEN k = 50 THEN t + 0.25 ELSE t END AS t FROM axis)"),
)
def axis_steps(spark, sf_dir):
    axis = stats.axis(spark, global_end(view.frames(spark, sf_dir)))
    moved = axis.select(F.lit(0).alias("series"), "k", F.when(F.col("k") == 50, F.col("t") + 0.25).otherwise(F.col("t")).alias("t"))
    return compare.axis_steps(moved).select("k", "verdict")


@query(
    "axis_contract",
    sql("SELECT n AS n_ours, n - 10 AS n_theirs, CAST(100 AS BIGINT) AS prefix, true AS same_end, CAST(0 AS BIGINT) AS bad_steps, 'hole' AS verdict FROM (SELECT count(*) AS n FROM axis)", *_STATS),
)
def axis_contract(spark, sf_dir):
    """Against an axis that leaves ten points out, as a tool does that starts anew after a gap."""
    axis = stats.axis(spark, global_end(view.frames(spark, sf_dir)))
    gap = axis.where("k < 100 or k >= 110").withColumn("k", F.when(F.col("k") >= 110, F.col("k") - 10).otherwise(F.col("k")))
    return compare.axis_contract(axis, gap)


@query(
    "stats_layout_check",
    sql("""SELECT channel, item, count(*) FILTER (WHERE v % 5 = 0) AS n_bad FROM (SELECT CAST(channel AS INTEGER) AS channel, 'I' || CAST(arb_id - 256 AS VARCHAR) AS item, seq AS v FROM frames) GROUP BY channel, item HAVING count(*) FILTER (WHERE v % 5 = 0) > 0"""),
)
def stats_layout_check(spark, sf_dir):
    """Items at offsets of another tool's blocks: of every fifth value there, the other is one more."""
    f = view.frames(spark, sf_dir)
    offsets = {f"I{i}": 21 - 4 * i for i in range(5)}
    ours = f.select("channel", F.concat(F.lit("I"), (F.col("arb_id") - 256).cast("string")).alias("item"), F.col("seq").alias("k"), F.col("seq").cast("double").alias("value"))
    at = F.col("channel") * 22 + (21 - 4 * (F.col("arb_id") - 256)).cast("int")
    theirs = f.select(at.alias("ordinal"), F.col("seq").alias("k"), (F.col("seq") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)).cast("double").alias("value"))
    return compare.stats_by_layout(ours, theirs, 22, offsets)


# 8. source resolution and batches


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for files: loose ones, the same in folders, names that differ in case, and other types."""
    c = F.col
    n = (c("o_orderkey") % 400).cast("string")
    ext = F.when(c("o_orderkey") % 13 == 0, ".txt").when(c("o_orderkey") % 3 == 0, ".BLF").otherwise(".blf")
    path = F.concat(F.lit("/logs/D"), (c("o_orderkey") % 400 % 7).cast("string"), F.lit("/run"), n, ext)
    entry = F.when(c("o_custkey") % 2 == 0, F.concat(F.lit("/logs/D"), (c("o_orderkey") % 400 % 7).cast("string"))).otherwise(path)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(entry.alias("entry"), path.alias("path"), c("o_orderkey").alias("size"))


_PATHS = (
    "p AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN '/logs/D' || CAST(o_orderkey % 400 % 7 AS VARCHAR) ELSE path END AS entry, path, o_orderkey AS size FROM (SELECT *, '/logs/D' || CAST(o_orderkey % 400 % 7 AS VARCHAR) || '/run' || CAST(o_orderkey % 400 AS VARCHAR) || CASE WHEN o_orderkey % 13 = 0 THEN '.txt' WHEN o_orderkey % 3 = 0 THEN '.BLF' ELSE '.blf' END AS path FROM orders))",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY lower(entry), path, size) AS rn FROM p WHERE lower(path) LIKE '%.blf')",
    "kept AS (SELECT path, size, entry <> path AS in_folder, CASE WHEN entry = path THEN regexp_replace(path, '^.*/', '') ELSE substr(path, length(entry) + 2) END AS display, CASE WHEN entry = path THEN regexp_replace(path, '\\.[^.]*$', '') || '_t.mdf' ELSE entry || '_t' || regexp_replace(substr(path, length(entry) + 1), '\\.[^.]*$', '') || '_t.mdf' END AS output FROM ranked WHERE rn = 1)",
)


@query("resolve_dedupe", "WITH " + ", ".join(_PATHS) + " SELECT path, in_folder, size FROM kept")
def resolve_dedupe(spark, sf_dir):
    return batch_ops.candidates(_paths(spark, sf_dir)).select("path", "in_folder", "size")


@query("mirror_paths", "WITH " + ", ".join(_PATHS) + " SELECT path, display, output FROM kept")
def mirror_paths(spark, sf_dir):
    return batch_ops.candidates(_paths(spark, sf_dir)).select("path", "display", "output")


@query(
    "batch_outcomes",
    "SELECT status, count(*) AS n_files, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status FROM orders) GROUP BY status",
)
def batch_outcomes(spark, sf_dir):
    c = F.col
    files = spark.read.parquet(f"{sf_dir}/orders.parquet")
    skipped = files.where(c("o_orderkey") % 10 == 0).select("o_orderkey")
    done = files.join(skipped, "o_orderkey", "left_anti").select("o_orderkey", F.when(c("o_orderstatus") == "F", "boom").alias("error"))
    return batch_ops.outcome_counts(done, skipped)


@query(
    "overwrite_precheck",
    "WITH " + ", ".join(_PATHS) + " SELECT path, output FROM kept WHERE output NOT IN (SELECT output FROM kept WHERE size % 4 = 0)",
)
def overwrite_precheck(spark, sf_dir):
    """Files whose output isn't there yet (here: that of every fourth size is)."""
    found = batch_ops.candidates(_paths(spark, sf_dir))
    return batch_ops.not_existing(found, found.where("size % 4 = 0").select("output")).select("path", "output")


@query("channel_union_files", sql("SELECT DISTINCT channel FROM (SELECT channel FROM frames WHERE seq % 2 = 0 AND channel < 9 UNION SELECT channel FROM frames WHERE seq % 2 = 1 AND channel > 4)"))
def channel_union_files(spark, sf_dir):
    f = view.frames(spark, sf_dir)
    return batch_ops.channel_union([f.where("seq % 2 = 0 and channel < 9"), f.where("seq % 2 = 1 and channel > 4")])


@query(
    "min_send_distance",
    sql("SELECT channel, arb_id, is_extended, min(gap) AS min_distance, count(*) AS n_frames FROM (SELECT channel, arb_id, is_extended, ts - lag(ts) OVER (PARTITION BY channel, arb_id, is_extended ORDER BY ts, seq) AS gap FROM frames) GROUP BY channel, arb_id, is_extended"),
)
def min_send_distance(spark, sf_dir):
    return stats.min_send_distance(view.frames(spark, sf_dir))


@query(
    "group_layout_order",
    sql("SELECT group_name, row_number() OVER (ORDER BY channel, series_order) AS group_ordinal FROM (SELECT channel, series_order, CASE WHEN row_number() OVER (PARTITION BY message_name ORDER BY channel, series_order) = 1 THEN message_name ELSE 'CAN' || CAST(channel AS VARCHAR) || '::' || message_name END AS group_name FROM ordered)", _BUCKETS, _ORDERED),
)
def group_layout_order(spark, sf_dir):
    """Groups in the order of a written measurement: by channel, then first appearance."""
    named = fr.group_names(fr.buckets(classified(spark, sf_dir)))
    return named.select("group_name", F.row_number().over(Window.orderBy("channel", "series_order")).cast("long").alias("group_ordinal"))


@query(
    "enum_conversions",
    """SELECT * FROM (VALUES ('Kind', '0=off|1=on|2=auto', 'identity', CAST(NULL AS VARCHAR)), ('Level', '3050=Invalid', 'linear', 'degC')) AS t(signal_name, pairs, default_kind, default_unit)""",
)
def enum_conversions(spark, sf_dir):
    table = decode.conversions(dbc.signals_table(spark, view.catalogs()))
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["key"].cast("string"), F.lit("="), p["value"])), "|")
    return table.select("signal_name", pairs.alias("pairs"), "default_kind", "default_unit")
