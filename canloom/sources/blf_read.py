"""Reading BLF logs: containers, objects, and their frames as Arrow batches.

The chain of objects (each header tells where the next begins) is walked once; fields are then gathered for all
objects of a type together. ``walk`` states the format object by object and is what tests hold ``parse`` to.

A log may be read in ranges of containers. An object may begin in one range and end in the next, so a range has an
``entry``: where the object begins that the containers before it left open. ``survey`` guesses the entry and tells
where its own range leaves off; a guess is right if it is where the range before left off.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa

from canloom.sources import blf_layout as L


@dataclass(frozen=True)
class Frame:
    channel: int
    abs_ns: int
    arb_id: int
    is_extended: bool
    is_fd: bool
    dlc: int
    data: bytes
    is_remote: bool = False
    is_error: bool = False


def start_ns(stream: BinaryIO) -> tuple[int, int]:
    """(start time in ns, size of the file header)."""
    head = stream.read(L.FILE_HEADER.size)
    if len(head) < L.FILE_HEADER.size or head[:4] != L.FILE_SIGNATURE:
        raise _error("unexpected file format")
    fields = L.FILE_HEADER.unpack(head)
    return L.systemtime_ns(fields[14:22]), fields[1]


def _error(what: str) -> L.LogError:
    return L.LogError(what)


class Place(NamedTuple):
    """A byte of the containers' contents: the container by its offset in the file, and how many of its bytes come before."""

    at: int
    skip: int


class Range(NamedTuple):
    """Containers of a log from the one at ``at`` to before ``stop`` (None: to the end).

    ``first`` is the number of the first container and ``before`` the offset of the one before it; ``seq`` numbers the first frame.
    """

    at: int
    first: int = 0
    stop: int | None = None
    before: int | None = None
    entry: Place | None = None
    seq: int = 0


def whole(stream: BinaryIO) -> Range:
    stream.seek(0)
    return Range(start_ns(stream)[1])


def heads(stream: BinaryIO, at: int, stop: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(offset, size, type) of the outer objects from ``at`` on; the stream stands behind a header when it is given."""
    while stop is None or at < stop:
        stream.seek(at)
        head = stream.read(L.OBJECT.size)
        if not head:
            return
        signature, _, _, size, kind = L.OBJECT.unpack(head.ljust(L.OBJECT.size, b"\x00"))
        if signature != L.OBJECT_SIGNATURE:
            raise _error("object signature expected")
        if size < L.OBJECT.size:
            raise _error(f"an object of {size} bytes")
        yield at, size, kind
        at += size + size % 4


def located(stream: BinaryIO, at: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each container; other objects and unknown methods are skipped."""
    for offset, size, kind in heads(stream, at, stop):
        if kind != L.CONTAINER_TYPE:
            continue
        body = stream.read(size - L.OBJECT.size)
        method, _ = L.CONTAINER.unpack_from(body)
        if method == L.STORED:
            yield offset, body[L.CONTAINER.size :]
        elif method == L.ZLIB:
            try:
                yield offset, zlib.decompress(body[L.CONTAINER.size :])
            except zlib.error as e:
                raise _error(f"container of {size} bytes: {e}") from e


def index(stream: BinaryIO, each: int) -> list[Range]:
    """Ranges of about ``each`` bytes, from the headers alone. The last one goes to the end, and so meets what is broken."""
    begin = whole(stream).at
    out, before, n = [Range(begin)], None, 0
    try:
        for at, _, kind in heads(stream, begin):
            if kind != L.CONTAINER_TYPE or L.CONTAINER.unpack(stream.read(L.CONTAINER.size))[0] not in (L.STORED, L.ZLIB):
                continue
            if before is not None and at - out[-1].at >= each:
                out[-1] = out[-1]._replace(stop=at)
                out.append(Range(at, n, None, before))
            before, n = at, n + 1
    except (L.LogError, struct.error):
        pass  # whoever reads the last range says so
    return out


def chain(data: bytes) -> tuple[list[tuple[int, int, int, int, int]], int, str]:
    """Objects as (start, header size, version, size, type); where the rest begins; what ended the walk.

    An object begins within 8 bytes of where the last one ended. The walk ends with "tail" where too little is left
    and with "lost" where no object begins.
    """
    out, at, end = [], 0, len(data)
    unpack = L.OBJECT.unpack_from
    find = data.find
    while True:
        begin = find(L.OBJECT_SIGNATURE, at, at + 8)
        if begin < 0:
            return out, at, "tail" if at + 8 > end else "lost"
        if begin + L.OBJECT.size > end:
            return out, at, "tail"
        _, header, version, size, kind = unpack(data, begin)
        if begin + size > end:
            return out, at, "tail"
        out.append((begin, header, version, size, kind))
        if size < 4:
            return out, begin + size, "lost"
        at = begin + size


_FIELDS = np.dtype([("signature", "<u4"), ("header", "<u2"), ("version", "<u2"), ("size", "<u4"), ("kind", "<u4")])


def chain_table(data: bytes) -> tuple[np.ndarray, int, str]:
    """As ``chain``, with the objects as rows of a table.

    All places of the signature are found at once. Where each place's object ends right before the next place, the chain
    is a run of places; only where it doesn't (a signature inside of data, a gap, the end) is a step taken by itself.
    """
    end, sign = len(data), int.from_bytes(L.OBJECT_SIGNATURE, "little")
    empty = np.empty((0, 5), np.int64)
    if data.find(L.OBJECT_SIGNATURE, 0, 8) < 0:
        return empty, 0, "tail" if 8 > end else "lost"
    spots = [np.flatnonzero(np.frombuffer(data, "<u4", (end - o) // 4, o) == sign) * 4 + o for o in range(4) if end - o >= 4]
    begin = np.sort(np.concatenate(spots))
    begin = begin[begin + L.OBJECT.size <= end]
    if not len(begin):
        return empty, 0, "tail"
    fields = np.frombuffer(data, np.uint8)[begin[:, None] + np.arange(L.OBJECT.size)].view(_FIELDS).ravel()
    size = fields["size"].astype(np.int64)
    stop = begin + size
    following = np.searchsorted(begin, stop)
    fits = (stop <= end) & (size >= 4)
    reached = begin[np.minimum(following, len(begin) - 1)]
    plain = fits & (following == np.arange(1, len(begin) + 1)) & (following < len(begin)) & (reached <= stop + 4)
    turns = np.append(np.flatnonzero(~plain), len(begin))
    runs, at, i = [], 0, 0
    while True:
        j = int(turns[np.searchsorted(turns, i)])
        if j > i:
            runs.append(np.arange(i, j))
        if stop[j] > end:
            at, why = (int(stop[j - 1]) if j > i else at), "tail"
            break
        runs.append(np.array([j]))
        at = int(stop[j])
        if size[j] < 4:
            why = "lost"
            break
        k = int(following[j])
        found = data.find(L.OBJECT_SIGNATURE, at, at + 8)
        if found < 0:
            why = "tail" if at + 8 > end else "lost"
            break
        if k >= len(begin) or begin[k] != found:
            why = "tail"  # too little is left for a header
            break
        i = k
    own = np.concatenate(runs) if runs else np.empty(0, np.int64)
    table = np.stack([begin, *(fields[n].astype(np.int64) for n in ("header", "version")), size, fields["kind"].astype(np.int64)], 1)
    return table[own], at, why


def walk(data: bytes, ms_part: int) -> tuple[list[Frame], bytes, int]:
    """Frames, unused tail and latest time of the objects in a container, one object at a time."""
    objects, rest, why = chain(data)
    frames, latest, at = [], 0, 0
    for begin, header, version, size, kind in objects:
        first = at
        at = begin + size
        if version not in L.HEADER:
            continue
        flags, _, _, rel = L.TIMED.unpack_from(data, begin + L.OBJECT.size)
        if begin + L.HEADER[version] > len(data):
            raise struct.error("header cut short")
        ns = ms_part + (rel * L.TEN_MICROSECONDS if flags == 1 else rel)
        latest = max(latest, ns)
        b = begin + L.HEADER[version]
        if kind in L.BODY and b + L.BODY[kind] > len(data):
            return frames, data[first:], latest
        u16 = lambda o: int.from_bytes(data[b + o : b + o + 2], "little")
        u32 = lambda o: int.from_bytes(data[b + o : b + o + 4], "little")
        if kind in (L.CAN_MESSAGE, L.CAN_MESSAGE2):
            n = data[b + 3]
            frames.append(Frame(u16(0) - 1, ns, u32(4) & 0x1FFFFFFF, bool(u32(4) & L.EXTENDED), False, n, data[b + 8 : b + 8 + min(n, 8)], bool(data[b + 2] & L.REMOTE)))
        elif kind == L.CAN_ERROR_EXT:
            n = data[b + 10]
            frames.append(Frame(u16(0) - 1, ns, u32(16) & 0x1FFFFFFF, bool(u32(16) & L.EXTENDED), False, n, data[b + 24 : b + 24 + min(n, 8)], is_error=True))
        elif kind == L.CAN_FD_MESSAGE:
            frames.append(Frame(u16(0) - 1, ns, u32(4) & 0x1FFFFFFF, bool(u32(4) & L.EXTENDED), bool(data[b + 13] & 1), L.dlc_length(data[b + 3]), data[b + 20 : b + 20 + min(data[b + 14], 64)], bool(data[b + 2] & L.REMOTE)))
        elif kind == L.CAN_FD_MESSAGE_64:
            valid, ext = data[b + 2], data[b + 35]
            n = min(valid, (ext or size) - header - 40)
            own = data[b + 40 : b + 40 + n] if n >= 0 else data[b + 40 : n]
            frames.append(Frame(data[b] - 1, ns, u32(4) & 0x1FFFFFFF, bool(u32(4) & L.EXTENDED), bool(u32(12) & L.FD64_FD), L.dlc_length(data[b + 1]), own.ljust(valid, b"\x00"), bool(u32(12) & L.FD64_REMOTE)))
    if why == "lost":
        raise _error("could not find next object")
    return frames, data[rest:], latest


@dataclass
class Columns:
    """Frames of a container by column; ``taken`` bytes of each frame's data are at ``where``, zeros follow to ``length``."""

    channel: np.ndarray
    abs_ns: np.ndarray
    arb_id: np.ndarray
    is_extended: np.ndarray
    is_fd: np.ndarray
    is_remote: np.ndarray
    is_error: np.ndarray
    dlc: np.ndarray
    length: np.ndarray
    where: np.ndarray
    taken: np.ndarray


_KINDS = np.array(sorted(L.BODY), np.int64)
_BODIES = np.array([L.BODY[k] for k in sorted(L.BODY)], np.int64)
_LENGTHS = np.array([L.dlc_length(i) for i in range(256)], np.int64)


def _bytes_at(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for i in range(n - 1, -1, -1):
        out = (out << 8) | buf[at + i]
    return out


@dataclass
class Objects:
    """Objects of a container: rows of ``chain_table``, where bodies begin, which have a time, which are frames; the unused tail."""

    table: np.ndarray
    body: np.ndarray
    timed: np.ndarray
    own: np.ndarray
    tail: bytes
    buf: np.ndarray

    def times(self, part: int) -> np.ndarray:
        begin = self.table[self.timed, 0]
        rel, flags = _bytes_at(self.buf, begin + 24, 8), _bytes_at(self.buf, begin + 16, 4)
        return part + np.where(flags == 1, rel * L.TEN_MICROSECONDS, rel)

    def channels(self) -> np.ndarray:
        """Channel of each frame: two bytes an object."""
        b = self.body[self.own]
        return np.where(self.table[self.own, 4] == L.CAN_FD_MESSAGE_64, self.buf[b].astype(np.int64), _bytes_at(self.buf, b, 2)) - 1


def objects(data: bytes) -> Objects:
    table, rest, why = chain_table(data)
    begin, _, version, size, kind = table.T
    known = (version == 1) | (version == 2)
    body = begin + np.where(version == 1, 32, 40)
    framed = np.isin(kind, _KINDS) & known
    need = np.zeros(len(table), np.int64)
    need[framed] = _BODIES[np.searchsorted(_KINDS, kind[framed])]
    broken = np.flatnonzero(framed & (body + need > len(data)))
    cut = int(broken[0]) if len(broken) else len(table)
    if len(short := np.flatnonzero(known & (body > len(data)))) and short[0] <= cut:
        raise struct.error("header cut short")
    if len(broken):
        rest = int(begin[cut - 1] + size[cut - 1]) if cut else 0
    elif why == "lost":
        raise _error("could not find next object")
    timed = np.flatnonzero(known)
    timed = timed[: np.searchsorted(timed, cut, "right")]
    return Objects(table, body, timed, np.flatnonzero(framed[:cut]), data[rest:], np.frombuffer(data + b"\x00" * 8, np.uint8))


def parse(data: bytes, ms_part: int) -> tuple[Columns, bytes, int]:
    """As ``walk``, gathered by type."""
    o = objects(data)
    own, buf, (_, header, _, size, kind) = o.own, o.buf, o.table.T
    times = o.times(ms_part)
    ns = np.zeros(len(o.table), np.int64)
    ns[o.timed] = times
    b, k, n = o.body[own], kind[own], len(own)
    classic, error, fd, fd64 = np.isin(k, (L.CAN_MESSAGE, L.CAN_MESSAGE2)), k == L.CAN_ERROR_EXT, k == L.CAN_FD_MESSAGE, k == L.CAN_FD_MESSAGE_64
    at = lambda o: buf[b + o].astype(np.int64)
    raw_id = np.where(error, _bytes_at(buf, b + np.where(error, 16, 0), 4), _bytes_at(buf, b + 4, 4))
    valid = np.where(fd64, at(2), at(14))
    code = np.where(fd64, at(1), at(3))
    plain = np.where(error, buf[b + np.where(error, 10, 0)], at(3))
    length = np.where(fd64, valid, np.where(fd, np.minimum(valid, 64), np.minimum(plain, 8)))
    ext = buf[b + np.where(fd64, 35, 0)].astype(np.int64)
    there = np.where(ext > 0, ext, size[own]) - header[own] - 40
    where = b + np.select([classic, error, fd], [8, 24, 20], 40)
    stop = np.where(fd64, np.where(there >= 0, where + np.minimum(valid, there), len(data) + there), where + length)
    taken = np.clip(np.minimum(stop, len(data)) - where, 0, None)
    flags64 = _bytes_at(buf, b + 12, 4)
    cols = Columns(
        channel=o.channels(),
        abs_ns=ns[own],
        arb_id=raw_id & 0x1FFFFFFF,
        is_extended=(raw_id & L.EXTENDED) != 0,
        is_fd=np.where(fd64, (flags64 & L.FD64_FD) != 0, fd & ((at(13) & 1) != 0)).astype(bool),
        is_remote=np.where(fd64, (flags64 & L.FD64_REMOTE) != 0, ~error & ((at(2) & L.REMOTE) != 0)).astype(bool),
        is_error=error,
        dlc=np.where(fd | fd64, _LENGTHS[code], plain),
        length=np.where(fd64, np.maximum(valid, taken), np.minimum(length, taken)),
        where=where,
        taken=taken,
    )
    assert n == len(cols.dlc)
    return cols, o.tail, max(0, int(times.max(initial=0)))


def payloads(data: bytes, c: Columns) -> tuple[pa.Array, pa.Array]:
    """Data as binary, and as arrays of little-endian longs, of all frames."""
    n = len(c.length)
    width = max(8, -(-int(c.length.max(initial=0)) // 8) * 8)
    buf = np.frombuffer(data + b"\x00" * width, np.uint8)
    table = buf[c.where[:, None] + np.arange(width)] if n else np.empty((0, width), np.uint8)
    table = np.where(np.arange(width) < c.taken[:, None], table, 0).astype(np.uint8)
    flat = table[np.arange(width) < c.length[:, None]]
    binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(c.length))).astype(np.int32)), pa.py_buffer(flat.tobytes())])
    each = np.maximum(1, -(-c.length // 8))
    longs = table.view("<i8").reshape(n, width // 8)[np.arange(width // 8) < each[:, None]]
    words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(longs, pa.int64()))
    return binary, words


def _walked(stream: BinaryIO, r: Range, read: Callable[[bytes], tuple]) -> Iterator[tuple[int, bytes, tuple, Place]]:
    """(container, its bytes behind what was left open, what ``read`` makes of them, where that leaves off) by container.

    The second item that ``read`` returns is the tail, which is carried to the next container.
    """
    held, tail = [], b""
    if r.entry is not None:
        opened = list(located(stream, r.entry.at, r.at))
        held, tail = [(at, len(b)) for at, b in opened], b"".join(b for _, b in opened)[r.entry.skip :]
    for i, (at, own) in enumerate(located(stream, r.at, r.stop), r.first):
        held.append((at, len(own)))
        data = tail + own
        result = read(data)
        tail = result[1]
        while len(held) > 1 and len(tail) <= sum(n for _, n in held[1:]):
            held.pop(0)
        yield i, data, result, Place(held[0][0], sum(n for _, n in held) - len(tail))


def batches(stream: BinaryIO, name: str, r: Range | None = None) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Frames of a log, or of a range of it, by container, with the latest time of its objects."""
    r = r or whole(stream)
    stream.seek(0)
    part, seq = L.ms_part(start_ns(stream)[0]), r.seq
    for i, data, (c, _, latest), _ in _walked(stream, r, lambda data: parse(data, part)):
        n = len(c.dlc)
        binary, words = payloads(data, c)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n, pa.string()), pa.array(np.arange(seq, seq + n)), pa.array(np.full(n, i, np.int32)), pa.array(c.channel.astype(np.int32)), pa.array(c.abs_ns), pa.array(c.abs_ns * 1e-9), pa.array(c.arb_id),
                pa.array(c.is_extended), pa.array(c.is_fd), pa.array(c.is_remote), pa.array(c.is_error), pa.array(c.dlc.astype(np.int32)), pa.array(c.length.astype(np.int32)), binary, words,
            ],
            ["file", "seq", "container", "channel", "abs_ns", "ts", "arb_id", "is_extended", "is_fd", "is_remote", "is_error", "dlc", "data_len", "data", "words"],
        ), latest
        seq += n


@dataclass(frozen=True)
class Survey:
    """What a range holds, without payloads: ``left`` is where it leaves off, ``error`` what broke it."""

    range: Range
    frames: int = 0
    containers: int = 0
    latest: int = 0
    channels: frozenset[int] = frozenset()
    left: Place | None = None
    error: str | None = None


#: Signatures at which a guess starts; wrong guesses cost a second survey and change no result.
GUESSES = 8


def guess(stream: BinaryIO, before: int) -> Place | None:
    """Where the container at ``before`` leaves off, told from its own bytes: by the longest chain from one of its first signatures."""
    data = next(located(stream, before))[1]
    best, at = None, -1
    for _ in range(GUESSES):
        if (at := data.find(L.OBJECT_SIGNATURE, at + 1)) < 0:
            break
        try:
            o = objects(data[at:])
        except (L.LogError, struct.error):
            continue
        if best is None or len(o.table) > best[0]:
            best = len(o.table), len(data) - len(o.tail)
    return best and Place(before, best[1])


def survey(stream: BinaryIO, r: Range) -> Survey:
    """Count a range; without an entry, one is guessed. What is broken ends it."""
    stream.seek(0)
    part = L.ms_part(start_ns(stream)[0])
    found, seen = Survey(r), set()
    try:
        if r.entry is None and r.before is not None:
            r = r._replace(entry=guess(stream, r.before))
        found = Survey(r, left=r.entry)
        for _, _, (o, _), left in _walked(stream, r, lambda data: (o := objects(data), o.tail)):
            seen.update(np.unique(o.channels()).tolist())
            latest = max(found.latest, int(o.times(part).max(initial=0)))
            found = replace(found, frames=found.frames + len(o.own), containers=found.containers + 1, latest=latest, channels=frozenset(seen), left=left)
    except (ValueError, struct.error) as e:
        return replace(found, left=None, error=f"{type(e).__name__}: {e}")
    return found


def channels(stream: BinaryIO) -> set[int]:
    """Channels of all frames: of each object, two bytes beside its header are read."""
    seen = set()
    for _, _, (o, _), _ in _walked(stream, whole(stream), lambda data: (o := objects(data), o.tail)):
        seen.update(np.unique(o.channels()).tolist())
    return seen


def extent(stream: BinaryIO) -> tuple[int, int, int]:
    """(start in ns, latest time of any timed object, containers) of a log; frames aren't gathered."""
    r = whole(stream)
    stream.seek(0)
    start, n, latest = start_ns(stream)[0], 0, 0
    for _, _, (o, _), _ in _walked(stream, r, lambda data: (o := objects(data), o.tail)):
        n, latest = n + 1, max(latest, int(o.times(L.ms_part(start)).max(initial=0)))
    return start, latest, n
