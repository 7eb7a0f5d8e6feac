"""ZIP packages of stored members: a writer with ZIP64 records, and a reader that fetches ranges only.

Signatures, field orders and the 0xFFFF / 0xFFFFFFFF escapes are fixed values of the ZIP format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x0001
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DOS_EPOCH = 0x0021  # 1 January 1980
_LOCAL, _CENTRAL, _END = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
_END64, _LOCATOR64 = struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def pack(members: list[tuple[str, bytes]], zip64: bool = True) -> list[bytes]:
    """The parts of a package whose members are stored as they are."""
    parts, central, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", EXTRA64, 16, n, n) if zip64 else b""
        small = FULL32 if zip64 else n
        head = _LOCAL.pack(LOCAL, 45, 0x800, 0, 0, DOS_EPOCH, crc, small, small, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", EXTRA64, 24, n, n, at) if zip64 else b""
        central.append(_CENTRAL.pack(CENTRAL, 45, 45, 0x800, 0, 0, DOS_EPOCH, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, FULL32 if zip64 else at) + raw + extra)
        parts += [head, data]
        at += len(head) + n
    listing = b"".join(central)
    parts.append(listing)
    if zip64:
        parts.append(_END64.pack(END64, 44, 45, 45, 0, 0, len(members), len(members), len(listing), at))
        parts.append(_LOCATOR64.pack(LOCATOR64, 0, at + len(listing), 1))
    count, size, start = (FULL16, FULL32, FULL32) if zip64 else (len(members), len(listing), at)
    parts.append(_END.pack(END, 0, 0, count, count, size, start, 0))
    return parts


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """Members by name, from the end record (searched backwards past a comment) and, where escaped, its ZIP64 form."""
    tail_at = max(0, size - _END.size - FULL16)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(struct.pack("<I", END))
    while k >= 0 and k + _END.size + int.from_bytes(tail[k + 20 : k + 22], "little") != len(tail):
        k = tail.rfind(struct.pack("<I", END), 0, k)
    if k < 0:
        raise ValueError("not a ZIP package: no end record")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, k)
    if FULL16 == count or FULL32 in (length, start):
        mark, _, end64, _ = _LOCATOR64.unpack(read(tail_at + k - _LOCATOR64.size, _LOCATOR64.size))
        if mark != LOCATOR64:
            raise ValueError("damaged ZIP package: no ZIP64 locator")
        mark, *_, count, length, start = _END64.unpack(read(end64, _END64.size))
        if mark != END64:
            raise ValueError("damaged ZIP package: no ZIP64 end record")
    raw, at, found = read(start, length), 0, {}
    for _ in range(count):
        mark, _, _, _, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, _, header = _CENTRAL.unpack_from(raw, at)
        if mark != CENTRAL:
            raise ValueError("damaged ZIP package: bad central directory")
        at += _CENTRAL.size
        name, extra = raw[at : at + n_name].decode(), raw[at + n_name : at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == EXTRA64:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full, packed, header = (next(wide) if x == FULL32 else x for x in (full, packed, header))
            extra = extra[4 + n :]
        found[name] = Member(name, method, crc, packed, full, header)
    return found


def data_offset(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin, so that ranges of it can be read in place."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed by ZIP; only stored members can be read by range")
    mark, *_, n_name, n_extra = _LOCAL.unpack(read(member.header, _LOCAL.size))
    if mark != LOCAL:
        raise ValueError("damaged ZIP package: bad local header")
    return member.header + _LOCAL.size + n_name + n_extra
