"""Decoders that Python's libraries lack: deflate64, lz4 frames, branch filters alone, ARM64 branches and BCJ2."""

from __future__ import annotations

import lzma
import struct

from ..functions.status import ContainerError

#: Base and extra bits of deflate's lengths and distances; deflate64 changes the last length and adds two distances.
LENGTH_EXTRA = [0] * 8 + [x for x in range(1, 6) for _ in range(4)] + [16]
DISTANCE_EXTRA = [0, 0] + [x for x in range(15) for _ in range(2)]
CODE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _bases(extra: list[int], first: int) -> list[int]:
    out = [first]
    for e in extra[:-1]:
        out.append(out[-1] + (1 << e))
    return out


LENGTH_BASE = _bases(LENGTH_EXTRA, 3)
LENGTH_BASE[-1] = 3
DISTANCE_BASE = _bases(DISTANCE_EXTRA, 1)


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at >= len(self.data) + 8:
                raise ContainerError("CORRUPT", "the stream is cut")
            self.hold |= (self.data[self.at] if self.at < len(self.data) else 0) << self.n
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        self.need(n)
        value = self.hold & ((1 << n) - 1)
        self.hold >>= n
        self.n -= n
        return value


class Codes:
    """Canonical prefix codes as a table over the longest code's bits, reversed as the stream has them."""

    def __init__(self, lengths: list[int]):
        self.width = max(lengths, default=0)
        if not self.width:
            raise ContainerError("CORRUPT", "no codes")
        self.table = [-1] * (1 << self.width)
        code = 0
        for n in range(1, self.width + 1):
            for symbol, have in enumerate(lengths):
                if have == n:
                    if code >> n:
                        raise ContainerError("CORRUPT", "too many codes")
                    for i in range(int(f"{code:0{n}b}"[::-1], 2), 1 << self.width, 1 << n):
                        self.table[i] = symbol << 4 | n
                    code += 1
            code <<= 1

    def next(self, bits: Bits) -> int:
        bits.need(self.width)
        got = self.table[bits.hold & ((1 << self.width) - 1)]
        if got < 0:
            raise ContainerError("CORRUPT", "code")
        bits.hold >>= got & 15
        bits.n -= got & 15
        return got >> 4


def deflate64(data: bytes, cap: int) -> bytes:
    bits, out, last = Bits(data), bytearray(), 0
    while not last:
        last, kind = bits.take(1), bits.take(2)
        if kind == 0:
            bits.take(bits.n % 8)
            n, complement = bits.take(16), bits.take(16)
            if n ^ complement != 0xFFFF:
                raise ContainerError("CORRUPT", "stored block")
            out += bytes(bits.take(8) for _ in range(n))
        elif kind == 3:
            raise ContainerError("CORRUPT", "block type")
        else:
            if kind == 1:
                literals, distances = Codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), Codes([5] * 32)
            else:
                n_literals, n_distances, n_codes = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
                widths = [0] * 19
                for i in CODE_ORDER[:n_codes]:
                    widths[i] = bits.take(3)
                reader, lengths = Codes(widths), []
                while len(lengths) < n_literals + n_distances:
                    s = reader.next(bits)
                    if s == 16 and not lengths:
                        raise ContainerError("CORRUPT", "code lengths")
                    lengths += [s] if s < 16 else [lengths[-1]] * (3 + bits.take(2)) if s == 16 else [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
                literals = Codes(lengths[:n_literals])
                distances = Codes(lengths[n_literals : n_literals + n_distances]) if any(lengths[n_literals:]) else None
            while (s := literals.next(bits)) != 256:
                if s < 256:
                    out.append(s)
                else:
                    if s > 285 or distances is None:
                        raise ContainerError("CORRUPT", "length code")
                    n = LENGTH_BASE[s - 257] + bits.take(LENGTH_EXTRA[s - 257])
                    d = distances.next(bits)
                    back = DISTANCE_BASE[d] + bits.take(DISTANCE_EXTRA[d])
                    if back > len(out):
                        raise ContainerError("CORRUPT", "distance")
                    _repeat(out, back, n)
                if len(out) > cap:
                    raise ContainerError("LIMIT_CODEC_BYTES")
        if len(out) > cap:
            raise ContainerError("LIMIT_CODEC_BYTES")
    if bits.at - bits.n // 8 < len(data) or bits.at - bits.n // 8 > len(data):
        raise ContainerError("CORRUPT", "the stream's end")
    return bytes(out)


def _repeat(out: bytearray, back: int, n: int) -> None:
    start = len(out) - back
    chunk = bytes(out[start : start + n])
    out += (chunk * (n // len(chunk) + 1))[:n]


def lz4(data: bytes, cap: int) -> bytes:
    """One lz4 frame; bytes behind it are CORRUPT.  Checksums are read over, sizes are enforced."""
    try:
        if data[:4] != b"\x04\x22\x4d\x18" or data[4] >> 6 != 1:
            raise ContainerError("CORRUPT", "frame")
        flags, at = data[4], 6
        size = None
        if flags & 8:
            size, at = struct.unpack_from("<Q", data, at)[0], at + 8
        at += 5 if flags & 1 else 1
        out = bytearray()
        while n := struct.unpack_from("<I", data, at)[0]:
            at += 4
            raw, n = n >> 31, n & 0x7FFFFFFF
            block = data[at : at + n]
            if len(block) < n:
                raise ContainerError("CORRUPT", "the frame is cut")
            at += n + (4 if flags & 16 else 0)
            if raw:
                out += block
            else:
                _lz4_block(block, out, cap)
            if len(out) > cap:
                raise ContainerError("LIMIT_CODEC_BYTES")
        at += 8 if flags & 4 else 4
    except (IndexError, struct.error):
        raise ContainerError("CORRUPT", "the frame is cut") from None
    if at != len(data) or size not in (None, len(out)):
        raise ContainerError("CORRUPT", "the frame's end")
    return bytes(out)


def _lz4_block(block: bytes, out: bytearray, cap: int) -> None:
    at = 0

    def longer(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                b = block[at]
                at += 1
                n += b
                if b < 255:
                    break
        return n

    while at < len(block):
        token = block[at]
        at += 1
        n = longer(token >> 4)
        out += block[at : at + n]
        at += n
        if at >= len(block):
            break
        back = block[at] | block[at + 1] << 8
        at += 2
        n = longer(token & 15) + 4
        if not 0 < back <= len(out):
            raise ContainerError("CORRUPT", "offset")
        _repeat(out, back, n)
        if len(out) > cap:
            raise ContainerError("LIMIT_CODEC_BYTES")


def branch(data: bytes, filter_id: int) -> bytes:
    """A branch filter alone.  The library only runs it in front of LZMA, so the bytes take that way around."""
    plain = [{"id": lzma.FILTER_LZMA2, "preset": 0}]
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=plain), lzma.FORMAT_RAW, filters=[{"id": filter_id}, *plain])


def arm64(data: bytes) -> bytes:
    """BL and ADRP targets from absolute back to relative."""
    out = bytearray(data)
    for at in range(0, len(out) - 3, 4):
        (x,) = struct.unpack_from("<I", out, at)
        if x >> 26 == 0x25:
            x = 0x94000000 | (x - (at >> 2)) & 0x3FFFFFF
        elif x & 0x9F000000 == 0x90000000:
            page = x >> 29 & 3 | x >> 3 & 0x1FFFFC
            if page + 0x20000 & 0x1C0000:
                continue
            page -= at >> 12
            x = x & 0x9000001F | (page & 3) << 29 | (page & 0x3FFFC) << 3 | -(page & 0x20000) & 0xE00000
        else:
            continue
        struct.pack_into("<I", out, at, x)
    return bytes(out)


def bcj2(main: bytes, call: bytes, jump: bytes, coded: bytes, size: int) -> bytes:
    """x86 branches from their own streams; a range coder says which branches were moved there."""
    out = bytearray()
    if len(coded) < 5 or coded[0]:
        raise ContainerError("CORRUPT", "range coder")
    code, width, at = int.from_bytes(coded[1:5], "big"), 0xFFFFFFFF, 5
    if code == 0xFFFFFFFF:
        raise ContainerError("CORRUPT", "range coder")
    odds, read, places, before = [1024] * 258, 0, [0, 0], 0
    while len(out) < size:
        if read >= len(main):
            raise ContainerError("CORRUPT", "main stream")
        b = main[read]
        read += 1
        out.append(b)
        if b & 0xFE == 0xE8 or (before == 0x0F and b & 0xF0 == 0x80):
            slot = 2 + before if b == 0xE8 else 1 if b == 0xE9 else 0
            bound = (width >> 11) * odds[slot]
            if code < bound:
                width, moved = bound, False
                odds[slot] += 2048 - odds[slot] >> 5
            else:
                width, code, moved = width - bound, code - bound, True
                odds[slot] -= odds[slot] >> 5
            if width < 1 << 24:
                if at >= len(coded):
                    raise ContainerError("CORRUPT", "range coder")
                width, code, at = width << 8 & 0xFFFFFFFF, (code << 8 | coded[at]) & 0xFFFFFFFF, at + 1
            if moved:
                which = 0 if b == 0xE8 else 1
                source = (call, jump)[which]
                word = source[places[which] : places[which] + 4]
                if len(word) < 4:
                    raise ContainerError("CORRUPT", "branch stream")
                places[which] += 4
                if size - len(out) < 4:
                    raise ContainerError("CORRUPT", "a branch runs past the end")
                target = int.from_bytes(word, "big") - (len(out) + 4) & 0xFFFFFFFF
                out += target.to_bytes(4, "little")
                before = out[-1]
                continue
        before = b
    if (read, places[0], places[1], at) != (len(main), len(call), len(jump), len(coded)) or code:
        raise ContainerError("CORRUPT", "unused input")
    return bytes(out)
