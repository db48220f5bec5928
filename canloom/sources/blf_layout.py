"""Layout of BLF logs (little-endian). Fixed values.

File: header ``LOGG``, header size u32, 8 bytes of application data, file size u64, uncompressed size u64, object count
u32, objects read u32, start and stop as SYSTEMTIME (8 u16: year, month, weekday, day, hour, minute, second,
millisecond). Objects follow from the header's end. Object: ``LOBJ``, header size u16, header version u16, object size
u32, type u32. Container (type 10): method u16, 6 bytes, uncompressed size u32, 4 bytes, then the objects' bytes.
Inside, version 1 adds flags u32, client u16, object version u16, time u64 (a body at byte 32), version 2 eight more
bytes (a body at byte 40). Flags 1 means a time unit of 10 us, anything else 1 ns.
"""

from __future__ import annotations

import struct
from datetime import datetime, timezone

FILE_SIGNATURE, OBJECT_SIGNATURE = b"LOGG", b"LOBJ"
FILE_HEADER = struct.Struct("<4sLBBBBBBBBQQLL8H8H")
FILE_HEADER_SIZE = 144
OBJECT = struct.Struct("<4sHHLL")
CONTAINER = struct.Struct("<H6xL4x")
TIMED = struct.Struct("<LHHQ")
#: Object types.
CONTAINER_TYPE = 10
CAN_MESSAGE, CAN_MESSAGE2, CAN_ERROR_EXT, CAN_FD_MESSAGE, CAN_FD_MESSAGE_64 = 1, 86, 73, 100, 101
#: Container methods.
STORED, ZLIB = 0, 2
#: Size of the fields that a frame object has before its data, or with it, by type.
BODY = {CAN_MESSAGE: 16, CAN_MESSAGE2: 16, CAN_ERROR_EXT: 32, CAN_FD_MESSAGE: 84, CAN_FD_MESSAGE_64: 40}
HEADER = {1: 32, 2: 40}
EXTENDED = 0x80000000
REMOTE = 0x80
FD64_FD, FD64_REMOTE = 0x1000, 0x0010
TEN_MICROSECONDS = 10_000
#: Data length by length code.
DLC_LENGTH = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)


def dlc_length(code: int) -> int:
    return DLC_LENGTH[code] if code < len(DLC_LENGTH) else 64


def systemtime_ns(fields: tuple[int, ...]) -> int:
    """Nanoseconds since 1970 of a SYSTEMTIME in UTC, in integers; 0 where it isn't a date."""
    year, month, _, day, hour, minute, second, ms = fields
    try:
        whole = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
    except ValueError:
        return 0
    days = whole.date().toordinal() - 719163
    return ((days * 86400 + hour * 3600 + minute * 60 + second) * 1000 + ms) * 1_000_000


def ms_part(start_ns: int) -> int:
    """The part of a start time below a second: times count from the whole second."""
    return start_ns % 1_000_000_000


class LogError(ValueError):
    """The log breaks its format."""
