"""Schemas of the measurement tables, storage types of signals, and state codes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EFF_BIT = 0x80000000
ID_MASK = 0x1FFFFFFF
#: Channels that bus statistics always cover.
STAT_CHANNELS = 16

FRAMES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("container", T.IntegerType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("abs_ns", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("arb_id", T.LongType()),
        T.StructField("is_extended", T.BooleanType()),
        T.StructField("is_fd", T.BooleanType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("dlc", T.IntegerType()),
        T.StructField("data_len", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.LongType(), False)),
    ]
)
FILE_INFO = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("ms_part_ns", T.LongType()),
        T.StructField("max_obj_ns", T.LongType()),
        T.StructField("n_containers", T.IntegerType()),
    ]
)
CHANNELS = T.StructType([T.StructField("file", T.StringType()), T.StructField("channel", T.IntegerType())])
MESSAGES = "dbc string, arb_norm long, message_name string, node string, is_extended boolean, frame_length int"
SIGNALS = (
    "dbc string, arb_norm long, ordinal int, file_ordinal int, signal_name string, start_bit int, length int, byte_order string, "
    "is_signed boolean, is_float boolean, scale double, offset double, unit string, is_multiplexer boolean, multiplexer_ids array<bigint>, choices map<bigint,string>"
)

#: Binding states and channel warnings: our codes with the words that users of the converter know them by.
STATES = {"BOUND": "已绑定", "NOT_EXPORTED": "不导出", "NO_DATA": "无数据"}
WARNINGS = {"NO_FRAMES": "该通道无匹配帧", "NO_MATCH": "全部原始帧未匹配 DBC"}


@dataclass(frozen=True)
class SignalDef:
    name: str
    start_bit: int
    length: int
    scale: float = 1.0
    offset: float = 0.0
    unit: str = ""
    is_signed: bool = False
    is_float: bool = False
    byte_order: str = "little"
    choices: dict[int, str] = field(default_factory=dict)
    is_multiplexer: bool = False
    multiplexer_ids: tuple[int, ...] | None = None
    file_ordinal: int = 0

    @property
    def position(self) -> int:
        """First bit in stream order: of a little-endian signal its start bit, else counted from the first byte's high bit."""
        return self.start_bit if self.byte_order == "little" else 8 * (self.start_bit // 8) + 7 - self.start_bit % 8

    @property
    def kept(self) -> tuple[int, int]:
        """Position and length of the bits that a 64-bit value keeps: the first of a little-endian signal, else the last."""
        if self.length <= 64:
            return self.position, self.length
        return (self.position, 64) if self.byte_order == "little" else (self.position + self.length - 64, 64)

    @property
    def kind(self) -> str:
        """enum (raw values with a table), float, scaled or int."""
        if self.is_float:
            return "float"
        if self.choices:
            return "enum"
        return "int" if self.scale == 1 and self.offset == 0 else "scaled"

    @property
    def ref_dtype(self) -> str:
        """Smallest storage of the values: depends on the definition alone."""
        if self.kind in ("float", "scaled"):
            return "f64"
        return ("i" if self.is_signed else "u") + str(next(w for w in (8, 16, 32, 64) if self.length <= w or w == 64))

    @property
    def spark_type(self) -> T.DataType:
        return {
            "f64": T.DoubleType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
            "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
        }[self.ref_dtype]


@dataclass(frozen=True)
class MessageDef:
    name: str
    arb_norm: int
    node: str
    frame_length: int
    signals: tuple[SignalDef, ...]

    @property
    def is_extended(self) -> bool:
        return bool(self.arb_norm & EFF_BIT)

    @property
    def selector(self) -> SignalDef | None:
        return next((s for s in self.signals if s.is_multiplexer), None)

    @property
    def native_selector(self) -> bool:
        """Whether the selector's raw value routes as it is (no scale and no value table)."""
        s = self.selector
        return s is None or s.kind == "int"

    def routes(self) -> dict[int, list[SignalDef]]:
        out: dict[int, list[SignalDef]] = {}
        for s in self.signals:
            for k in s.multiplexer_ids or ():
                out.setdefault(k, []).append(s)
        return out


@dataclass(frozen=True)
class Catalog:
    path: str
    messages: dict[int, MessageDef]

    @property
    def file_name(self) -> str:
        return self.path.replace("\\", "/").rsplit("/", 1)[-1]

    @property
    def stem(self) -> str:
        return self.file_name.rsplit(".", 1)[0]

    @property
    def display_name(self) -> str:
        """File name with its folder, which tells catalogs of equal names apart."""
        folder = self.path.replace("\\", "/").rsplit("/", 2)[-2:-1]
        return f"{self.file_name}（{folder[0] if folder else ''}）"
