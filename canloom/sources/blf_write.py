"""Logs of frames, for tests, samples and benches: one file, times in nanoseconds."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from typing import BinaryIO

from canloom.sources import blf_layout as L
from canloom.sources.blf_read import Frame

EACH = 20_000
_CLASSIC, _ERROR, _FD = struct.Struct("<HBBL8s"), struct.Struct("<H8xB5xL4x8s"), struct.Struct("<HBBL4xxBB5x64s")


def _body(x: Frame) -> tuple[int, bytes]:
    arb = x.arb_id | (L.EXTENDED if x.is_extended else 0)
    flags = L.REMOTE if x.is_remote else 0
    if x.is_error:
        return L.CAN_ERROR_EXT, _ERROR.pack(x.channel + 1, x.dlc, arb, x.data)
    if x.is_fd:
        return L.CAN_FD_MESSAGE, _FD.pack(x.channel + 1, flags, L.DLC_LENGTH.index(x.dlc), arb, 1, len(x.data), x.data)
    return L.CAN_MESSAGE, _CLASSIC.pack(x.channel + 1, flags, x.dlc, arb, x.data)


def _container(objects: list[bytes]) -> bytes:
    plain = b"".join(objects)
    body = L.CONTAINER.pack(L.ZLIB, len(plain)) + zlib.compress(plain)
    size = L.OBJECT.size + len(body)
    return L.OBJECT.pack(L.OBJECT_SIGNATURE, L.OBJECT.size, 1, size, L.CONTAINER_TYPE) + body + bytes(size % 4)


def obj(kind: int, abs_ns: int, body: bytes) -> bytes:
    head = L.HEADER[1]
    return L.OBJECT.pack(L.OBJECT_SIGNATURE, head, 1, head + len(body), kind) + L.TIMED.pack(2, 0, 0, abs_ns) + body


def write(stream: BinaryIO, frames: Iterable[Frame | bytes], start: tuple[int, ...], size: int | None = None) -> int:
    """Write frames, and objects as bytes, in order; the number of containers.

    ``start`` is a SYSTEMTIME, and abs_ns counts from its millisecond. A container holds EACH objects, or ``size`` bytes, as loggers
    cut them: then an object may begin in one and end in the next.
    """
    stream.write(bytes(L.FILE_HEADER_SIZE))
    held, length, containers = [], 0, 0
    for x in frames:
        if not isinstance(x, bytes):
            kind, body = _body(x)
            x = obj(kind, x.abs_ns, body)
        held.append(x)
        length += len(x)
        if size is None and len(held) == EACH:
            stream.write(_container(held))
            held, containers = [], containers + 1
        elif size is not None and length >= size:
            plain = b"".join(held)
            length %= size
            full = len(plain) - length
            for at in range(0, full, size):
                stream.write(_container([plain[at : at + size]]))
                containers += 1
            held = [plain[full:]] if length else []
    if held:
        stream.write(_container(held))
        containers += 1
    end = stream.tell()
    stream.seek(0)
    stream.write(L.FILE_HEADER.pack(L.FILE_SIGNATURE, L.FILE_HEADER_SIZE, *[0] * 8, end, 0, 0, 0, *start, *start))
    return containers
