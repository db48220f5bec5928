"""Writes synthetic logs."""

from __future__ import annotations

import struct
import zlib

from canloom.sources import blf_layout as L

START = (2026, 7, 3, 22, 10, 0, 0, 250)


def obj(kind, body, rel=0, flags=2, version=1, pad=None, size=None):
    head = L.TIMED.pack(flags, 0, 0, rel) + b"\x00" * (8 if version == 2 else 0)
    header = 40 if version == 2 else 32
    size = header + len(body) if size is None else size
    return L.OBJECT.pack(b"LOBJ", header, version, size, kind) + head + body + b"\x00" * (size % 4 if pad is None else pad)


def can(channel, arb, data, rel=0, ext=False, remote=False, dlc=None, kind=L.CAN_MESSAGE, **kw):
    return obj(kind, struct.pack("<HBBL8s", channel + 1, 0x80 if remote else 0, len(data) if dlc is None else dlc, arb | (L.EXTENDED if ext else 0), data), rel, **kw)


def error(channel, arb, data, rel=0, ext=False, **kw):
    return obj(L.CAN_ERROR_EXT, struct.pack("<HHLBBBxLLHx x8s".replace(" ", ""), channel + 1, 0, 0, 0, 0, len(data), 0, arb | (L.EXTENDED if ext else 0), 0, data), rel, **kw)


def fd(channel, arb, data, rel=0, ext=False, is_fd=True, code=None, **kw):
    code = L.DLC_LENGTH.index(len(data)) if code is None else code
    return obj(L.CAN_FD_MESSAGE, struct.pack("<HBBLLBBB5x64s", channel + 1, 0, code, arb | (L.EXTENDED if ext else 0), 0, 0, int(is_fd), len(data), data), rel, **kw)


def fd64(channel, arb, data, rel=0, ext=False, code=None, valid=None, ext_off=0, flags64=L.FD64_FD, **kw):
    code = L.DLC_LENGTH.index(len(data)) if code is None else code
    body = bytearray(40)
    body[0], body[1], body[2] = channel + 1, code, len(data) if valid is None else valid
    body[4:8] = struct.pack("<L", arb | (L.EXTENDED if ext else 0))
    body[12:16] = struct.pack("<L", flags64)
    body[35] = ext_off
    return obj(L.CAN_FD_MESSAGE_64, bytes(body) + data, rel, **kw)


def container(payload, method=L.ZLIB):
    body = L.CONTAINER.pack(method, len(payload)) + (zlib.compress(payload) if method == L.ZLIB else payload)
    size = L.OBJECT.size + len(body)
    return L.OBJECT.pack(b"LOBJ", 16, 1, size, L.CONTAINER_TYPE) + body + b"\x00" * (size % 4)


def log(*containers, start=START):
    body = b"".join(containers)
    head = L.FILE_HEADER.pack(b"LOGG", L.FILE_HEADER_SIZE, 5, 0, 0, 0, 2, 6, 8, 1, L.FILE_HEADER_SIZE + len(body), 0, 0, 0, *start, *start)
    return head.ljust(L.FILE_HEADER_SIZE, b"\x00") + body


def write(path, *containers, start=START):
    path.write_bytes(log(*containers, start=start))
    return str(path)
