"""Decoding payloads into signals.

``long`` decodes all messages of all catalogs in one plan: frames meet the catalog's signals in a broadcast join, and
position, length, order and scale are columns of the bit algebra. Its plan doesn't grow with the catalog. ``wide`` gives
one message as a table with a column for each signal, its parameters as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.functions.tables import local
from canloom.functions import bits
from canloom.model import Catalog, MessageDef, SignalDef
from canloom.operators.frames import small

PLAN = (
    "dbc string, arb_norm long, ordinal int, signal_name string, position int, length int, little boolean, is_signed boolean, is_float boolean, kind string, "
    "scale double, offset double, unit string, multiplexer_ids array<bigint>, sel_position int, sel_length int, sel_little boolean, sel_signed boolean, sel_float boolean, sel_scale double, sel_offset double, sel_kind string, routed array<double>"
)


def plan_rows(catalog: Catalog) -> list[tuple]:
    out = []
    for m in catalog.messages.values():
        sel = m.selector
        pick = (*sel.kept, sel.byte_order == "little", sel.is_signed, sel.is_float, sel.scale, sel.offset, sel.kind) if sel else (None,) * 8
        routed = sorted(map(float, m.routes())) if sel else None
        for i, s in enumerate(m.signals):
            ids = list(s.multiplexer_ids) if s.multiplexer_ids is not None else None
            out.append((catalog.path, m.arb_norm, i, s.name, *s.kept, s.byte_order == "little", s.is_signed, s.is_float, s.kind, s.scale, s.offset, s.unit, ids, *pick, routed))
    return out


def plan_table(spark: SparkSession, catalogs: list[Catalog]) -> DataFrame:
    """Signals of all catalogs with what their extraction needs, and their message's selector."""
    return local(spark, [r for c in catalogs for r in plan_rows(c)], PLAN)


def _placed(plan: DataFrame, name: str, position: str, length: str) -> DataFrame:
    """plan with <name>i and <name>j, the places of the two words that a signal's bits lie in, <name>shift within the first,
    <name>other for the second, <name>cut for the bits beyond its length: worked out once for a signal, not for each sample."""
    place, shift = F.col(position).cast("int"), F.col(position).cast("int") % 64
    return plan.withColumns({f"{name}i": F.floor(place / 64).cast("int") + 1, f"{name}j": F.floor(place / 64).cast("int") + 2, f"{name}shift": shift, f"{name}other": 64 - shift, f"{name}cut": (64 - F.col(length)).cast("int")})


def _numbers(df: DataFrame, name: str, length: str, little: str, is_signed: str, is_float: str) -> DataFrame:
    """df with <name>bits, <name>long and <name>number of the signal that the columns, and those of ``_placed``, describe.

    Each step is a column of its own, which the next ones name: nested, the steps would repeat in each other, and plans and
    generated code would grow beyond what compiles."""
    c = F.col
    n = lambda x: c(f"{name}{x}")
    call, none = F.call_function, F.lit(0).cast("long")
    df = df.withColumn(f"{name}from", F.when(c(little), c("words")).otherwise(c("_big")))
    df = df.withColumns({f"{name}{w}": F.coalesce(F.try_element_at(n("from"), n(at)), none) for w, at in (("first", "i"), ("second", "j"))})
    up = call("shiftrightunsigned", n("first"), n("shift")).bitwiseOR(F.when(n("shift") > 0, call("shiftleft", n("second"), n("other"))).otherwise(none))
    down = call("shiftleft", n("first"), n("shift")).bitwiseOR(F.when(n("shift") > 0, call("shiftrightunsigned", n("second"), n("other"))).otherwise(none))
    # the bits at the top, then cut to the length with or without their sign
    df = df.withColumn(f"{name}top", F.when(c(little), call("shiftleft", up, n("cut"))).otherwise(down))
    df = df.withColumn(f"{name}bits", call("shiftrightunsigned", n("top"), n("cut")))
    df = df.withColumn(f"{name}long", F.when(c(is_signed), call("shiftright", n("top"), n("cut"))).otherwise(n("bits")))
    e, m = bits.float_fields(n("bits"), c(length))
    df = df.withColumns({f"{name}e": e, f"{name}m": m})
    whole = F.when((n("long") < 0) & ~c(is_signed), bits.unsigned_double(n("long"))).otherwise(n("long").cast("double"))
    return df.withColumn(f"{name}number", F.when(c(is_float), bits.float_of(n("bits"), c(length), n("e"), n("m"))).otherwise(whole))


def _selected(df: DataFrame) -> DataFrame:
    """df with _selector, the number that routes: raw, or scaled where the selector has a scale (null without selector)."""
    own = _numbers(df, "_s_", "sel_length", "sel_little", "sel_signed", "sel_float")
    return own.withColumn("_selector", F.when(F.col("sel_position").isNotNull(), F.col("_s_number") * F.col("sel_scale") + F.col("sel_offset")))


def long(classified: DataFrame, plan: DataFrame, *keys: str, routed: bool = False) -> DataFrame:
    """Samples of all valid frames: channel, message_name, signal_name, ordinal, seq, ts, bits, raw, phys, active, routed_ok,
    and columns of the frames (``keys``) before them.

    raw is the number in decimal(20,0), bits the same as a long (negative for unsigned numbers of 2**63 and more).

    A child of another branch is inactive: raw 0, phys 0 (NaN for a float). A frame whose selector value has no children
    is unknown: routed_ok is false on its rows; with ``routed`` they are left out.
    """
    c = F.col
    own = classified.where("valid").select(*keys, "channel", "dbc", "arb_norm", "arb_id", "message_name", "seq", "ts", "words", bits.big_words(c("words")).alias("_big"))
    placed = _placed(_placed(plan, "_", "position", "length"), "_s_", "sel_position", "sel_length")
    joined = own.join(small(placed), ["dbc", "arb_norm"])
    ok = c("_selector").isNull() | F.coalesce(F.array_contains("routed", c("_selector")), F.lit(False))
    chosen = _selected(joined)
    if routed:
        # a column that isn't deterministic keeps this filter, and later ones, where they are: pushed down to the join, they
        # would take copies of the whole selector's expression along, and the stage no longer compiles
        chosen = chosen.withColumn("_here", F.spark_partition_id()).where(ok & (c("_here") >= 0))
    selected = _numbers(chosen, "_", "length", "little", "is_signed", "is_float")
    active = c("multiplexer_ids").isNull() | F.coalesce(F.exists("multiplexer_ids", lambda k: k.cast("double") == c("_selector")), F.lit(False))
    exact = F.when(bits.beyond_long(c("_long"), c("is_signed")), bits.unsigned(c("_long"))).otherwise(c("_long").cast(bits.U64))
    selected = selected.withColumn("_exact", exact)
    value = F.when(c("is_float"), c("_number") * c("scale") + c("offset")).when(c("kind") == "scaled", bits.physical(c("_exact"), c("scale"), c("offset"), c("_number"))).otherwise(c("_number"))
    real = c("kind").isin("float", "scaled")
    return selected.withColumn("active", active).select(
        *keys,
        "channel",
        "dbc",
        "arb_norm",
        "arb_id",
        "message_name",
        "signal_name",
        "ordinal",
        "seq",
        "ts",
        F.when(c("active"), c("_long")).otherwise(F.lit(0).cast("long")).alias("bits"),
        F.when(c("active"), c("_exact")).otherwise(F.lit(0).cast(bits.U64)).alias("raw"),
        F.when(c("active"), value).when(real, F.lit(float("nan"))).otherwise(F.lit(0.0)).alias("phys"),
        "active",
        ok.alias("routed_ok"),
    )


def routed_frames(classified: DataFrame, plan: DataFrame) -> DataFrame:
    """classified, with frames whose selector has a value without children made unknown (valid = false)."""
    selectors = plan.where("sel_position is not null").select("dbc", "arb_norm", *(x for x in plan.columns if x.startswith("sel_")), "routed").dropDuplicates(["dbc", "arb_norm"])
    joined = _selected(classified.withColumn("_big", bits.big_words(F.col("words"))).join(small(_placed(selectors, "_s_", "sel_position", "sel_length")), ["dbc", "arb_norm"], "left"))
    ok = F.col("sel_position").isNull() | F.array_contains("routed", F.col("_selector"))
    return joined.withColumn("valid", F.col("valid") & F.coalesce(ok, F.lit(False))).select(*classified.columns)


def signal_bits(words: Column, big: Column, s: SignalDef) -> Column:
    return bits.extract(words, big, *s.kept, s.byte_order == "little")


def signal_value(words: Column, big: Column, s: SignalDef) -> Column:
    """The stored value of an active signal, in its own type."""
    own, (_, length) = signal_bits(words, big, s), s.kept
    if s.is_float:
        return (bits.float32_value(own) if s.length == 32 else bits.float64_value(own)) * F.lit(s.scale) + F.lit(s.offset)
    number = bits.sign_extend(own, length) if s.is_signed else own if length < 64 else bits.unsigned(own)
    if s.kind == "scaled":
        return bits.physical(number, s.scale, s.offset)
    return number.cast(s.spark_type)


def wide(classified: DataFrame, message: MessageDef, dbc: str | None = None) -> DataFrame:
    """Samples of one message: channel, seq, ts and a column for each signal; unrouted frames are left out."""
    words, big = F.col("words"), F.col("_big")
    own = classified.where(F.col("valid") & (F.col("arb_norm") == message.arb_norm))
    if dbc is not None:
        own = own.where(F.col("dbc") == dbc)
    own = own.withColumn("_big", bits.big_words(words))
    sel = message.selector
    selector = None
    if sel is not None:
        number = signal_bits(words, big, sel)
        number = bits.float_value(number, sel.kept[1]) if sel.is_float else bits.integer_double(number, sel.kept[1], sel.is_signed)
        selector = number * F.lit(sel.scale) + F.lit(sel.offset)
        own = own.where(selector.isin(*map(float, message.routes())) if message.routes() else F.lit(False))
    columns = []
    for s in message.signals:
        value = signal_value(words, big, s)
        if s.multiplexer_ids is not None:
            idle = F.lit(float("nan")) if s.kind in ("float", "scaled") else F.lit(0).cast(s.spark_type)
            value = F.when(selector.isin(*map(float, s.multiplexer_ids)), value).otherwise(idle) if selector is not None else idle
        columns.append(value.alias(s.name))
    return own.select("channel", "seq", "ts", *columns)


def enum_text(raw: Column, choices: Column, scale: Column | float = 1.0, offset: Column | float = 0.0) -> Column:
    """The text of a raw value, or the number that the default conversion gives, as text."""
    number = raw.cast("double") * bits.col_of(scale) + bits.col_of(offset)
    return F.coalesce(F.try_element_at(choices, raw.cast("long")), number.cast("string"))


def conversions(signals: DataFrame) -> DataFrame:
    """Value tables of enum signals: sorted raw values with texts, and the default for others (with its unit if scaled)."""
    own = signals.where(~F.col("is_float") & (F.size("choices") > 0))
    scaled = (F.col("scale") != 1) | (F.col("offset") != 0)
    pairs = F.array_sort(F.map_entries("choices"))
    return own.select("dbc", "arb_norm", "signal_name", pairs.alias("pairs"), "scale", "offset", F.when(scaled, F.col("unit")).alias("default_unit"), F.when(scaled, F.lit("linear")).otherwise(F.lit("identity")).alias("default_kind"))
