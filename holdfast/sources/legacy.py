"""zip's oldest methods, read only: shrink (1), reduce (2 to 5) and implode (6).  All need the declared size."""

from __future__ import annotations

from ..functions.status import ContainerError
from .decoders import Bits, _repeat


def unshrink(data: bytes, size: int) -> bytes:
    """Dynamic LZW of 9 to 13 bits; code 256 speaks to the decoder: 1 widens codes, 2 frees the leaves of the tree."""
    bits, out, width = Bits(data), bytearray(), 9
    parent, suffix = [-1] * 8192, list(range(256)) + [0] * 7936
    free = list(range(8191, 256, -1))
    last, first = None, 0
    while len(out) < size:
        code = bits.take(width)
        if code == 256:
            order = bits.take(width)
            if order == 1 and width < 13:
                width += 1
            elif order == 2:
                inner = {p for p in parent if p >= 0}
                for c in range(257, 8192):
                    if parent[c] >= 0 and c not in inner:
                        parent[c] = -1
                free = [c for c in range(8191, 256, -1) if parent[c] < 0]
            else:
                raise ContainerError("CORRUPT", "shrink order")
            continue
        if last is None:
            if code > 255:
                raise ContainerError("CORRUPT", "shrink code")
            out.append(code)
            last = first = code
            continue
        word, c = bytearray(), code
        if c > 256 and parent[c] < 0:  # the code about to be made
            word.append(first)
            c = last
        while c > 255:
            if parent[c] < 0 or len(word) > 8192:
                raise ContainerError("CORRUPT", "shrink code")
            word.append(suffix[c])
            c = parent[c]
        word.append(c)
        first = c
        out += word[::-1]
        if free:
            new = free.pop()
            parent[new], suffix[new] = last, first
        last = code
    return bytes(out[:size])


def expand(data: bytes, size: int, factor: int) -> bytes:
    """Reduce: follower sets give bytes, then byte 144 introduces copies."""
    bits = Bits(data)
    followers = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        n = bits.take(6)
        if n > 32:
            raise ContainerError("CORRUPT", "followers")
        followers[c] = [bits.take(8) for _ in range(n)]

    last = 0

    def byte() -> int:
        nonlocal last
        own = followers[last]
        if not own or bits.take(1):
            last = bits.take(8)
        else:
            at = bits.take(max(1, (len(own) - 1).bit_length()))
            if at >= len(own):
                raise ContainerError("CORRUPT", "follower")
            last = own[at]
        return last

    out, low = bytearray(), (1 << (8 - factor)) - 1
    while len(out) < size:
        b = byte()
        if b != 144:
            out.append(b)
            continue
        v = byte()
        if v == 0:
            out.append(144)
            continue
        n = v & low
        if n == low:
            n += byte()
        back = (v >> (8 - factor)) * 256 + byte() + 1
        _copy(out, back, n + 3)
    return bytes(out[:size])


def _copy(out: bytearray, back: int, n: int) -> None:
    """A copy that may begin before the first byte, where zeros are."""
    while back > len(out) and n:
        out.append(0)
        n -= 1
    if n:
        _repeat(out, back, n)


class Shannon:
    """Codes by lengths, longest first from zero, each read from its highest bit."""

    def __init__(self, bits: Bits, count: int):
        lengths: list[int] = []
        for _ in range(bits.take(8) + 1):
            b = bits.take(8)
            lengths += [(b & 15) + 1] * ((b >> 4) + 1)
        if len(lengths) != count:
            raise ContainerError("CORRUPT", "implode tree")
        self.codes: dict[tuple[int, int], int] = {}
        code = step = width = 0
        for s in sorted(range(count), key=lambda i: (lengths[i], i), reverse=True):
            code += step
            if lengths[s] != width:
                width = lengths[s]
                step = 1 << (16 - width)
            if code >> 16:
                raise ContainerError("CORRUPT", "implode tree")
            self.codes[width, code >> (16 - width)] = s

    def next(self, bits: Bits) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.take(1)
            if (n, code) in self.codes:
                return self.codes[n, code]
        raise ContainerError("CORRUPT", "implode code")


def explode(data: bytes, size: int, flags: int) -> bytes:
    """Implode: flag 2 says an 8 KiB window (7 low distance bits), flag 4 a tree for literals."""
    bits = Bits(data)
    low = 7 if flags & 2 else 6
    literals = Shannon(bits, 256) if flags & 4 else None
    lengths, distances = Shannon(bits, 64), Shannon(bits, 64)
    out = bytearray()
    while len(out) < size:
        if bits.take(1):
            out.append(literals.next(bits) if literals else bits.take(8))
            continue
        back = bits.take(low)
        back |= distances.next(bits) << low
        n = lengths.next(bits)
        if n == 63:
            n += bits.take(8)
        _copy(out, back + 1, n + (3 if literals else 2))
    return bytes(out[:size])
