"""A view of the events table as bus frames, in DataFrame form and as SQL, with catalogs and bindings for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.model import Catalog
from canloom.sources import dbc

DBC_A = """
BO_ 256 CLICK: 8 ECU_A
 SG_ User : 0|16@1+ (1,0) [0|0] "" X
 SG_ K : 16|8@1+ (1,0) [0|0] "" X
 SG_ Value : 24|16@1+ (0.01,0) [0|0] "V" X
 SG_ EventLow : 40|22@1+ (1,0) [0|0] "" X
BO_ 2147483904 CLICK_EXT: 4 ECU_A
 SG_ User : 0|16@1+ (1,0) [0|0] "" X
 SG_ SK : 16|8@1- (1,0) [0|0] "" X
BO_ 257 VIEW: 6 ECU_B
 SG_ BeUser : 7|16@0+ (1,0) [0|0] "" X
 SG_ BeVal : 31|16@0- (1,0) [0|0] "" X
 SG_ LeVal : 24|16@1- (0.5,-10) [0|0] "A" X
BO_ 258 PURCHASE: 8 ECU_B
 SG_ Mode M : 16|2@1+ (1,0) [0|0] "" X
 SG_ A m0 : 24|16@1+ (0.5,-10) [0|0] "" X
 SG_ C m0 : 40|8@1+ (1,0) [0|0] "" X
 SG_ B m1 : 24|8@1- (1,0) [0|0] "" X
 SG_ Always : 0|16@1+ (1,0) [0|0] "" X
BO_ 259 SIGNUP: 5 ECU_C
 SG_ Kind : 16|2@1+ (1,0) [0|0] "" X
 SG_ Level : 24|16@1+ (0.1,-50) [0|0] "degC" X
VAL_ 259 Kind 0 "off" 1 "on" 2 "auto" ;
VAL_ 259 Level 3050 "Invalid" ;
"""
DBC_B = """
BO_ 256 CLICK: 8 ECU_A
 SG_ User : 0|16@1+ (1,0) [0|0] "" X
BO_ 257 VIEW: 8 ECU_B
 SG_ Low : 0|64@1- (1,0) [0|0] "" X
"""
PATH_A, PATH_B = "P1/A.dbc", "P1/B.dbc"
#: Channels 0 to 9 are bound, even ones to A and odd ones to B; 10 to 15 aren't.
BOUND = 10


def catalogs() -> list[Catalog]:
    return [dbc.parse(DBC_A, PATH_A), dbc.parse(DBC_B, PATH_B)]


def bindings(spark: SparkSession) -> DataFrame:
    return local(spark, [(c, (PATH_A, PATH_B)[c % 2] if c < BOUND else None) for c in range(16)], "channel int, dbc string")


def frames(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """Frames of the events: 30 days squeezed to about 600 s, the payload packed from the row's numbers."""
    events = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = events.agg(F.min("ts").cast("timestamp").alias("t")).select(F.unix_micros("t")).first()[0] or 0
    return of_events(events, us - F.lit(first - first % 1_000_000)).withColumn("file", F.lit(table))


def of_events(events: DataFrame, us: Column, *keys: Column) -> DataFrame:
    """Frames of events that came ``us`` microseconds after their log began; file is null, ``keys`` are further columns."""
    long = lambda c: c.cast("long")
    e = events.select(*keys, "event_id", "user_id", "event_type", us.alias("us"), long(F.rint(F.col("value") * 100)).alias("v"), long(F.get_json_object("props", "$.k")).alias("k"))
    kind = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(("click", "view", "purchase", "signup", "error")) for x in (n, 256 + i))), F.col("event_type"))
    w0 = (
        F.shiftleft(F.col("event_id") % 4194304, 40)
        .bitwiseOR(F.shiftleft(F.col("v").bitwiseAND(F.lit(65535).cast("long")), 24))
        .bitwiseOR(F.shiftleft(F.col("k").bitwiseAND(F.lit(255).cast("long")), 16))
        .bitwiseOR(F.col("user_id").bitwiseAND(F.lit(65535).cast("long")))
    )
    length = (4 + F.col("event_id") % 5).cast("int")
    own = F.when(length == 8, w0).otherwise(w0.bitwiseAND(F.expr("shiftleft(1L, 8 * cast(4 + event_id % 5 as int)) - 1")))
    abs_ns = F.expr("(us div 4320) * 1000")
    return e.select(
        *e.columns[: len(keys)],
        F.lit(None).cast("string").alias("file"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 16).cast("int").alias("channel"),
        abs_ns.alias("abs_ns"),
        (abs_ns.cast("double") * F.lit(1e-9)).alias("ts"),
        long(kind).alias("arb_id"),
        (F.col("event_id") % 7 == 0).alias("is_extended"),
        (F.col("event_id") % 5 == 0).alias("is_fd"),
        (F.col("event_id") % 11 == 0).alias("is_remote"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("is_error"),
        length.alias("dlc"),
        length.alias("data_len"),
        F.array(own).alias("words"),
        own.alias("w0"),
    )


#: The same view as SQL; columns as above.
FRAMES_SQL = """
e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(round_even(value * 100, 0) AS BIGINT) AS v,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
z AS (SELECT (min(us) // 1000000) * 1000000 AS t0 FROM e),
f0 AS (SELECT event_id AS seq, CAST(user_id % 16 AS INTEGER) AS channel, ((us - t0) // 4320) * 1000 AS abs_ns,
             CAST(CASE event_type WHEN 'click' THEN 256 WHEN 'view' THEN 257 WHEN 'purchase' THEN 258 WHEN 'signup' THEN 259 ELSE 260 END AS BIGINT) AS arb_id,
             event_id % 7 = 0 AS is_extended, event_id % 5 = 0 AS is_fd, event_id % 11 = 0 AS is_remote,
             event_type = 'error' AND event_id % 3 = 0 AS is_error, CAST(4 + event_id % 5 AS INTEGER) AS data_len,
             (event_id % 4194304) * 1099511627776 + (v & 65535) * 16777216 + (k & 255) * 65536 + (user_id & 65535) AS whole FROM e, z),
frames AS (SELECT seq, channel, abs_ns, CAST(abs_ns AS DOUBLE) * 1e-9 AS ts, arb_id, is_extended, is_fd, is_remote, is_error, data_len,
             CASE data_len WHEN 8 THEN whole WHEN 7 THEN whole % 72057594037927936 WHEN 6 THEN whole % 281474976710656 WHEN 5 THEN whole % 1099511627776 ELSE whole % 4294967296 END AS w0,
             arb_id + CASE WHEN is_extended THEN 2147483648 ELSE 0 END AS arb_norm FROM f0),
bound AS (SELECT c AS channel, CASE WHEN c < 10 THEN CASE WHEN c % 2 = 0 THEN 'P1/A.dbc' ELSE 'P1/B.dbc' END END AS dbc FROM (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS c)),
messages AS (SELECT * FROM (VALUES ('P1/A.dbc', 256, 'CLICK', 8, 4), ('P1/A.dbc', 2147483904, 'CLICK_EXT', 4, 2), ('P1/A.dbc', 257, 'VIEW', 6, 3),
             ('P1/A.dbc', 258, 'PURCHASE', 8, 5), ('P1/A.dbc', 259, 'SIGNUP', 5, 2), ('P1/B.dbc', 256, 'CLICK', 8, 1), ('P1/B.dbc', 257, 'VIEW', 8, 1)) AS t(dbc, arb_norm, message_name, frame_length, n_signals)),
classified AS (SELECT f.*, b.dbc, m.message_name, m.frame_length, m.message_name IS NOT NULL AND f.data_len >= m.frame_length AS valid
             FROM frames f JOIN bound b ON f.channel = b.channel AND b.dbc IS NOT NULL LEFT JOIN messages m ON m.dbc = b.dbc AND m.arb_norm = f.arb_norm)
"""


def sql(tail: str, *more: str) -> str:
    """A query over the view: ``more`` are further named tables."""
    return "WITH " + ",\n".join([FRAMES_SQL.strip(), *more]) + "\n" + tail
