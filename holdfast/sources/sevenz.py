"""7z: header grammar, linear coder chains, substreams; a writer of one-coder folders."""

from __future__ import annotations

import hashlib
import lzma
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

from ..functions.status import ContainerError
from . import decoders
from .aes import cbc_decrypt
from .member import Limits
from .streams import Source, compress, decompress

MAGIC = b"7z\xbc\xaf\x27\x1c"
HEADER_CAP = 64 << 20
EPOCH = 11644473600
#: Coder ids.
COPY, LZMA1, LZMA2, BZIP2, DEFLATE, DEFLATE64, DELTA = b"\0", b"\3\1\1", b"\x21", b"\4\2\2", b"\4\1\x08", b"\4\1\x09", b"\3"
AES, BCJ2, ARM64 = b"\6\xf1\7\1", b"\3\3\1\x1b", b"\x0a"
BRANCH = {
    b"\4": lzma.FILTER_X86, b"\3\3\1\3": lzma.FILTER_X86, b"\5": lzma.FILTER_POWERPC, b"\3\3\2\5": lzma.FILTER_POWERPC, b"\6": lzma.FILTER_IA64, b"\3\3\4\1": lzma.FILTER_IA64,
    b"\7": lzma.FILTER_ARM, b"\3\3\5\1": lzma.FILTER_ARM, b"\x08": lzma.FILTER_ARMTHUMB, b"\3\3\7\1": lzma.FILTER_ARMTHUMB, b"\x09": lzma.FILTER_SPARC, b"\3\3\x08\5": lzma.FILTER_SPARC,
}


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ContainerError("CORRUPT", "the header ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Leading one bits of the first byte say how many bytes follow; its other bits are the highest."""
        first, value, mask = self.byte(), 0, 0x80
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        if value >= 1 << 63:
            raise ContainerError("CORRUPT", "number")
        return value

    def count(self) -> int:
        n = self.number()
        if n > 8 * len(self.data):
            raise ContainerError("CORRUPT", "count")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if d else None for d in self.defined(n)]

    def expect(self, *ids: int) -> int:
        got = self.byte()
        if got not in ids:
            raise ContainerError("CORRUPT", f"property {got}")
        return got


class Folder:
    def __init__(self, c: Cursor):
        n = c.number()
        if not 1 <= n <= 32:
            raise ContainerError("CORRUPT" if not n else "UNSUPPORTED", "coders")
        self.coders, ins, outs = [], 0, 0
        for _ in range(n):
            flags = c.byte()
            if flags & 0x80:
                raise ContainerError("UNSUPPORTED", "coder flags")
            coder = c.take(flags & 15)
            i, o = (c.number(), c.number()) if flags & 0x10 else (1, 1)
            props = c.take(c.number()) if flags & 0x20 else b""
            self.coders.append((coder, props, i, o))
            ins, outs = ins + i, outs + o
        if outs == 0 or ins > 1024:
            raise ContainerError("CORRUPT", "streams")
        self.binds = [(c.number(), c.number()) for _ in range(outs - 1)]
        packed = ins - len(self.binds)
        if packed < 1:
            raise ContainerError("CORRUPT", "packed streams")
        bound = {i for i, _ in self.binds}
        self.packed = [c.number() for _ in range(packed)] if packed > 1 else [i for i in range(ins) if i not in bound][:1]
        self.outs, self.sizes, self.crc, self.pack_offset, self.pack_sizes = outs, [], None, 0, []

    @property
    def size(self) -> int:
        bound = {o for _, o in self.binds}
        return self.sizes[next(i for i in range(self.outs) if i not in bound)]

    @property
    def encrypted(self) -> bool:
        return any(c[0] == AES for c in self.coders)

    def chain(self) -> list[tuple[bytes, bytes, int]]:
        """Coders from the packed stream to the result; only a line of one-to-one coders."""
        if any((i, o) != (1, 1) for _, _, i, o in self.coders):
            raise ContainerError("UNSUPPORTED", "coder with several streams")
        feeds = {o: i for i, o in self.binds}  # an output feeds the input of another coder
        at, out = self.packed[0], []
        while True:
            if at >= len(self.coders) or len(out) > len(self.coders):
                raise ContainerError("CORRUPT", "coder graph")
            out.append((self.coders[at][0], self.coders[at][1], self.sizes[at]))
            if at not in feeds:
                break
            at = feeds[at]
        if len(out) != len(self.coders):
            raise ContainerError("CORRUPT", "coder graph")
        return out


def lzma_filter(coder: bytes, props: bytes) -> dict:
    try:
        if coder == LZMA1:
            p = props[0]
            if p >= 225:
                raise ContainerError("CORRUPT", "LZMA properties")
            return {"id": lzma.FILTER_LZMA1, "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45, "dict_size": max(4096, struct.unpack_from("<I", props, 1)[0])}
        p = props[0]
        if p > 40:
            raise ContainerError("CORRUPT", "LZMA2 dictionary")
        return {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if p == 40 else (2 | p & 1) << (p // 2 + 11)}
    except (IndexError, struct.error):
        raise ContainerError("CORRUPT", "coder properties") from None


def undelta(data: bytes, distance: int) -> bytes:
    import numpy as np

    x = np.frombuffer(data, np.uint8)
    out = np.empty_like(x)
    for i in range(min(distance, len(x))):
        out[i::distance] = np.cumsum(x[i::distance], dtype=np.uint8)
    return out.tobytes()


def aes_key(password: bytes, salt: bytes, power: int, limits: Limits, keys: dict) -> bytes:
    if power == 63:
        return (salt + password)[:32].ljust(32, b"\0")
    if power > 24:
        raise ContainerError("UNSUPPORTED", "key rounds")
    if (salt, power) not in keys:
        keys["spent"] = keys.get("spent", 0) + (1 << power)
        if limits.max_key_rounds and keys["spent"] > limits.max_key_rounds:
            raise ContainerError("LIMIT_KEY_ROUNDS")
        h, part = hashlib.sha256(), salt + password
        for at in range(0, 1 << power, 1024):
            h.update(b"".join(part + struct.pack("<Q", i) for i in range(at, min(at + 1024, 1 << power))))
        keys[salt, power] = h.digest()
    return keys[salt, power]


class SevenZipWalk:
    def __init__(self, source: Source, limits: Limits, password: bytes | None = None):
        self.s, self.limits, self.keys = source, limits, {}
        self.password = None if password is None else password.decode("utf-8").encode("utf-16-le")

    def _graph(self, f: Folder) -> bytes:
        """A folder whose coders take several streams: each output is made from its inputs, back to packed streams."""
        packed, at = {}, 32 + f.pack_offset
        for i, n in zip(f.packed, f.pack_sizes):
            self.s.seek(at)
            packed[i] = self.s.exact(n)
            at += n
        firsts = [sum(c[2] for c in f.coders[:k]) for k in range(len(f.coders))]
        if any(o != 1 for _, _, _, o in f.coders):
            raise ContainerError("UNSUPPORTED", "coder with several outputs")
        feeds = dict(f.binds)

        def made(k: int, depth: int = 0) -> bytes:
            if k >= len(f.coders) or depth > len(f.coders):
                raise ContainerError("CORRUPT", "coder graph")
            coder, props, n_in, _ = f.coders[k]
            inputs = [packed[i] if i in packed else made(feeds[i], depth + 1) if i in feeds else None for i in range(firsts[k], firsts[k] + n_in)]
            if None in inputs:
                raise ContainerError("CORRUPT", "coder graph")
            if coder == BCJ2:
                if n_in != 4:
                    raise ContainerError("CORRUPT", "BCJ2 inputs")
                return decoders.bcj2(*inputs, f.sizes[k])
            if n_in != 1:
                raise ContainerError("UNSUPPORTED", f"coder {coder.hex()}")
            return self._run([(coder, props, f.sizes[k])], inputs[0], f)

        bound = {o for _, o in f.binds}
        data = made(next(i for i in range(f.outs) if i not in bound))
        if f.crc is not None and zlib.crc32(data) != f.crc:
            raise ContainerError("CORRUPT", "folder CRC")
        return data

    def _decode(self, f: Folder) -> bytes:
        if any(c[2] != 1 for c in f.coders):
            return self._graph(f)
        self.s.seek(32 + f.pack_offset)
        data = self.s.exact(f.pack_sizes[0])
        data = self._run(f.chain(), data, f)
        if f.crc is not None and zlib.crc32(data) != f.crc:
            raise ContainerError("PASSWORD_OR_CORRUPT" if f.encrypted else "CORRUPT", "folder CRC")
        return data

    def _run(self, chain: list[tuple[bytes, bytes, int]], data: bytes, f: Folder) -> bytes:
        i = 0
        try:
            while i < len(chain):
                coder, props, size = chain[i]
                if coder == COPY:
                    pass
                elif coder == AES:
                    data = self._aes(data, props)[:size]
                elif coder in (LZMA1, LZMA2):
                    # Branch and delta filters stand in front of LZMA in its own library's chain.
                    behind = []
                    while i + 1 < len(chain) and (chain[i + 1][0] in BRANCH or chain[i + 1][0] == DELTA):
                        i += 1
                        behind.insert(0, {"id": BRANCH[chain[i][0]]} if chain[i][0] in BRANCH else {"id": lzma.FILTER_DELTA, "dist": chain[i][1][0] + 1})
                    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[*behind, lzma_filter(coder, props)])
                    size = chain[i][2]
                    data = d.decompress(data, size) if size else b""
                elif coder == BZIP2:
                    data = decompress("bzip2", data, max(size, 1))
                elif coder == DEFLATE:
                    data = decompress("deflate", data, max(size, 1))
                elif coder == DEFLATE64:
                    data = decompress("deflate64", data, max(size, 1))
                elif coder == DELTA:
                    data = undelta(data, props[0] + 1)
                elif coder == ARM64:
                    data = decoders.arm64(data)
                elif coder in BRANCH:
                    data = decoders.branch(data, BRANCH[coder])
                else:
                    raise ContainerError("UNSUPPORTED", f"coder {coder.hex()}")
                if len(data) != size:
                    raise ContainerError("CORRUPT", "coder size")
                i += 1
        except lzma.LZMAError:
            raise ContainerError("PASSWORD_OR_CORRUPT" if f.encrypted else "CORRUPT") from None
        except ContainerError as e:
            if f.encrypted and e.status in ("CORRUPT", "LIMIT_CODEC_BYTES"):
                raise ContainerError("PASSWORD_OR_CORRUPT") from None
            raise
        return data

    def _aes(self, data: bytes, props: bytes) -> bytes:
        if self.password is None:
            raise ContainerError("PASSWORD_REQUIRED")
        if not props:
            raise ContainerError("CORRUPT", "AES properties")
        salt = iv = b""
        if props[0] & 0xC0:
            n, k = (props[0] >> 7 & 1) + (props[1] >> 4), (props[0] >> 6 & 1) + (props[1] & 15)
            if len(props) < 2 + n + k:
                raise ContainerError("CORRUPT", "AES properties")
            salt, iv = props[2 : 2 + n], props[2 + n : 2 + n + k]
        if len(data) % 16:
            raise ContainerError("CORRUPT", "AES length")
        return cbc_decrypt(data, aes_key(self.password, salt, props[0] & 63, self.limits, self.keys), iv.ljust(16, b"\0"))

    def _streams(self, c: Cursor) -> tuple[list[Folder], list[list[tuple[int, int | None]]]]:
        pack_at, packs, folders, subs = 0, [], [], []
        while (kind := c.byte()) != 0:
            if kind == 6:
                pack_at, n = c.number(), c.count()
                while (p := c.expect(0, 9, 10)) != 0:
                    if p == 9:
                        packs = [c.number() for _ in range(n)]
                    else:
                        c.digests(n)
                if len(packs) != n:
                    raise ContainerError("CORRUPT", "pack sizes")
            elif kind == 7:
                c.expect(0x0B)
                n = c.count()
                if c.byte():
                    raise ContainerError("UNSUPPORTED", "external folders")
                folders = [Folder(c) for _ in range(n)]
                c.expect(0x0C)
                for f in folders:
                    f.sizes = [c.number() for _ in range(f.outs)]
                while (p := c.expect(0, 10)) != 0:
                    for f, d in zip(folders, c.digests(n)):
                        f.crc = d
            elif kind == 8:
                subs = self._substreams(c, folders)
            else:
                raise ContainerError("CORRUPT", f"property {kind}")
        at = pack_at
        where = 0
        for f in folders:
            n = len(f.packed)
            if where + n > len(packs):
                raise ContainerError("CORRUPT", "packed streams")
            f.pack_offset, f.pack_sizes = at, packs[where : where + n]
            at += sum(f.pack_sizes)
            where += n
        if not subs:
            subs = [[(f.size, f.crc)] for f in folders]
        return folders, subs

    def _substreams(self, c: Cursor, folders):
        counts, p = [1] * len(folders), c.byte()
        if p == 0x0D:
            counts, p = [c.count() for _ in folders], c.byte()
        sizes = []
        for f, n in zip(folders, counts):
            own = [c.number() for _ in range(n - 1)] if p == 9 else []
            if n > 1 and p != 9 or sum(own) > f.size:
                raise ContainerError("CORRUPT", "substream sizes")
            sizes.append([*own, f.size - sum(own)] if n else [])
        if p == 9:
            p = c.byte()
        crcs: list[list[int | None]] = [[f.crc] if n == 1 and f.crc is not None else [None] * n for f, n in zip(folders, counts)]
        while p != 0:
            if p == 10:
                open_ = [(i, k) for i, (f, n) in enumerate(zip(folders, counts)) if not (n == 1 and f.crc is not None) for k in range(n)]
                for (i, k), d in zip(open_, c.digests(len(open_))):
                    crcs[i][k] = d
            else:
                raise ContainerError("CORRUPT", f"property {p}")
            p = c.byte()
        return [list(zip(a, b)) for a, b in zip(sizes, crcs)]

    def _header(self) -> Cursor:
        self.s.seek(0)
        start = self.s.exact(32)
        if start[6] != 0:
            raise ContainerError("UNSUPPORTED", "version")
        if zlib.crc32(start[12:]) != struct.unpack_from("<I", start, 8)[0]:
            raise ContainerError("CORRUPT", "start header")
        offset, size, crc = struct.unpack_from("<QQI", start, 12)
        if not size:
            if offset or crc:
                raise ContainerError("CORRUPT", "empty header")
            return Cursor(b"")
        if size > HEADER_CAP:
            raise ContainerError("LIMIT_EXTRA_BYTES")
        if 32 + offset + size > self.s.size:
            raise ContainerError("CORRUPT", "header place")
        self.s.seek(32 + offset)
        data = self.s.exact(size)
        if zlib.crc32(data) != crc:
            raise ContainerError("CORRUPT", "header CRC")
        for _ in range(5):
            c = Cursor(data)
            kind = c.byte()
            if kind == 1:
                return c
            if kind != 0x17:
                raise ContainerError("CORRUPT", "header")
            folders, _ = self._streams(c)
            if len(folders) != 1:
                raise ContainerError("CORRUPT", "encoded header")
            data = self._decode(folders[0])
        raise ContainerError("CORRUPT", "header nesting")

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        c = self._header()
        folders, subs, files = [], [], []
        while c.at < len(c.data) and (kind := c.byte()) != 0:
            if kind == 2:
                while (p := c.number()) != 0:
                    c.take(c.number())
            elif kind == 4:
                folders, subs = self._streams(c)
            elif kind == 5:
                files = self._files(c)
            else:
                raise ContainerError("CORRUPT", f"property {kind}")
        slots = [(i, at, *x) for i, own in enumerate(subs) for at, x in zip(accumulate((x[0] for x in own), initial=0), own)]
        if sum(f["stream"] for f in files) != len(slots):
            raise ContainerError("CORRUPT", "files and streams")
        place, decoded, failed = iter(slots), {}, {}
        for ordinal, f in enumerate(files):
            slot = next(place) if f["stream"] else None
            attributes = f.get("attributes", 0)
            mode = attributes >> 16 if attributes & 0x8000 else None
            kind = "directory" if not slot and not f["empty_file"] or attributes & 0x10 else "symlink" if mode and mode & 0o170000 == 0o120000 else "file"
            m = {
                "name": f.get("name", b""), "name_encoding": "utf-8", "type": kind, "size": slot[2] if slot else 0, "stored_size": None, "mode": mode, "header_offset": ordinal,
                "sevenz": {"folder": slot[0] if slot else None, "encrypted": bool(slot and folders[slot[0]].encrypted), "crc32": slot[3] if slot else None},
            }
            if "ticks" in f:
                seconds, rest = divmod(f["ticks"], 10_000_000)
                m |= {"mtime_seconds": seconds - EPOCH, "mtime_ns": rest * 100, "mtime_source": "7z-filetime"}

            def data(slot=slot) -> bytes:
                if slot is None:
                    return b""
                i, at, n, crc = slot
                if i in failed:
                    raise ContainerError(failed[i])
                if i not in decoded:
                    decoded.clear()  # a solid folder is decoded once, and held while its members pass
                    if self.limits.max_total_bytes and folders[i].size > self.limits.max_total_bytes:
                        raise ContainerError("LIMIT_TOTAL_BYTES")
                    try:
                        decoded[i] = self._decode(folders[i])
                    except ContainerError as e:
                        failed[i] = e.status
                        raise
                got = decoded[i][at : at + n]
                if crc is not None and zlib.crc32(got) != crc:
                    raise ContainerError("PASSWORD_OR_CORRUPT" if folders[i].encrypted else "CORRUPT", "CRC")
                return got

            if slot and folders[slot[0]].encrypted and self.password is None:
                m["data_status"] = "PASSWORD_REQUIRED"
            elif kind == "symlink" and slot and slot[2] <= (self.limits.max_name_bytes or slot[2]):
                try:
                    m |= {"link_target": data(), "size": slot[2]}
                except ContainerError as e:
                    m["data_status"] = e.status
            yield m, data

    def _files(self, c: Cursor) -> list[dict]:
        n = c.count()
        files = [{"stream": True, "empty_file": False} for _ in range(n)]
        without = []
        while (kind := c.number()) != 0:
            own = Cursor(c.take(c.number()))
            if kind == 0x0E:
                flags = own.bits(n)
                for f, e in zip(files, flags):
                    f["stream"] = not e
                without = [f for f in files if not f["stream"]]
            elif kind == 0x0F:
                for f, e in zip(without, own.bits(len(without))):
                    f["empty_file"] = e
            elif kind == 0x11:
                if own.byte():
                    raise ContainerError("UNSUPPORTED", "external names")
                for f in files:
                    end = own.data.find(b"\0\0", own.at)
                    while end >= 0 and (end - own.at) % 2:  # not between two units
                        end = own.data.find(b"\0\0", end + 1)
                    if self.limits.max_name_bytes and (end if end >= 0 else len(own.data)) - own.at > 4 * self.limits.max_name_bytes:
                        raise ContainerError("LIMIT_NAME_BYTES")
                    name = own.take(end - own.at)
                    own.take(2)
                    # A lone surrogate becomes the replacement character; pairs join.
                    f["name"] = name.decode("utf-16-le", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").encode()
            elif kind in (0x14, 0x15):
                defined = own.defined(n)
                if own.byte():
                    raise ContainerError("UNSUPPORTED", "external times")
                for f, d in zip(files, defined):
                    if d and kind == 0x14:
                        f["ticks"] = struct.unpack("<Q", own.take(8))[0]
                    elif d:
                        f["attributes"] = struct.unpack("<I", own.take(4))[0]
        return files


def put_number(value: int) -> bytes:
    for i in range(8):
        if value < 1 << 7 * (i + 1):
            low = value & ((1 << 8 * i) - 1)
            return bytes([0xFF00 >> i & 0xFF | value >> 8 * i]) + low.to_bytes(i, "little")
    return b"\xff" + value.to_bytes(8, "little")


def put_coder(coder: bytes, props: bytes = b"") -> bytes:
    return bytes([len(coder) | (0x20 if props else 0)]) + coder + (put_number(len(props)) + props if props else b"")


def put_bits(flags: list[bool]) -> bytes:
    out = bytearray((len(flags) + 7) // 8)
    for i, f in enumerate(flags):
        out[i // 8] |= (0x80 >> i % 8) * bool(f)
    return bytes(out)


class SevenZipWriter:
    """Folders of one coder, behind a filter if asked for: all members in one (solid), or one a member.

    filter: one of FILTERS; encode_header: the header is coded too, as other writers do for many members.
    """

    METHODS = ("copy", "lzma", "lzma2", "bzip2", "deflate")
    FILTERS = {
        "x86": (b"\3\3\1\3", {"id": lzma.FILTER_X86}), "ppc": (b"\3\3\2\5", {"id": lzma.FILTER_POWERPC}), "ia64": (b"\3\3\4\1", {"id": lzma.FILTER_IA64}),
        "arm": (b"\3\3\5\1", {"id": lzma.FILTER_ARM}), "armthumb": (b"\3\3\7\1", {"id": lzma.FILTER_ARMTHUMB}), "sparc": (b"\3\3\x08\5", {"id": lzma.FILTER_SPARC}),
        "delta": (DELTA, {"id": lzma.FILTER_DELTA, "dist": 4}),
    }

    def __init__(self, out, method: str = "lzma2", solid: bool = True, level: int | None = None, filter: str | None = None, encode_header: bool = False):
        if method not in self.METHODS or filter is not None and filter not in self.FILTERS:
            raise ContainerError("UNSUPPORTED", method if method not in self.METHODS else filter)
        self.out, self.method, self.solid, self.level, self.files, self.filter, self.encode_header = out, method, solid, level, [], filter, encode_header

    def _filtered(self, data: bytes) -> bytes:
        """Its library only filters in front of LZMA, which is taken off again."""
        plain = [{"id": lzma.FILTER_LZMA2, "preset": 0}]
        coded = lzma.compress(data, lzma.FORMAT_RAW, filters=[self.FILTERS[self.filter][1], *plain])
        return lzma.decompress(coded, lzma.FORMAT_RAW, filters=plain)

    def add(self, m: dict, data: bytes = b"") -> None:
        kind, name = m.get("type") or "file", m["name"]
        if kind not in ("file", "directory", "symlink"):
            raise ContainerError("UNSUPPORTED", kind)
        if not name:
            raise ContainerError("INVALID")
        try:
            name = name.rstrip(b"/").decode("utf-8").encode("utf-16-le")
        except UnicodeDecodeError:
            raise ContainerError("UNSUPPORTED", "name is not UTF-8") from None
        self.files.append((m | {"type": kind}, name, (m.get("link_target") or b"") if kind == "symlink" else data if kind == "file" else b""))

    def _code(self, data: bytes) -> tuple[bytes, bytes, bytes]:
        """Coder id, properties, coded bytes."""
        preset = 6 if self.level is None else self.level
        if self.method == "lzma":
            f = {"id": lzma.FILTER_LZMA1, "preset": preset, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 23}
            return LZMA1, struct.pack("<BI", 0x5D, 1 << 23), lzma.compress(data, lzma.FORMAT_RAW, filters=[f])
        if self.method == "lzma2":
            return LZMA2, b"\x16", lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": 1 << 23}])
        if self.method == "copy":
            return COPY, b"", data
        return (BZIP2, b"", compress("bzip2", data, self.level)) if self.method == "bzip2" else (DEFLATE, b"", compress("deflate", data, self.level))

    def finish(self) -> None:
        full = [d for _, _, d in self.files if d]
        groups = ([full] if full else []) if self.solid else [[d] for d in full]
        packed, folders, sizes = [], b"", b""
        for g in groups:
            data = b"".join(g)
            coder, props, coded = self._code(self._filtered(data) if self.filter else data)
            packed.append(coded)
            coders = [(coder, props)]
            if self.filter:  # its input, number 1, is the other coder's output, number 0
                coders.append((self.FILTERS[self.filter][0], b"\3" if self.filter == "delta" else b""))
            folders += put_number(len(coders)) + b"".join(put_coder(*c) for c in coders) + (b"\1\0" if self.filter else b"")
            sizes += put_number(len(data)) * len(coders)
        n = len(groups)
        h = b"\x01"
        if n:
            h += b"\x04\x06\x00" + put_number(n) + b"\x09" + b"".join(put_number(len(p)) for p in packed) + b"\x00"
            h += b"\x07\x0b" + put_number(n) + b"\x00" + folders + b"\x0c" + sizes + b"\x00"
            h += b"\x08" + (b"\x0d" + b"".join(put_number(len(g)) for g in groups) if any(len(g) != 1 for g in groups) else b"")
            h += b"\x09" + b"".join(put_number(len(d)) for g in groups for d in g[:-1]) if any(len(g) > 1 for g in groups) else b""
            h += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for g in groups for d in g) + b"\x00\x00"

        def prop(kind: int, body: bytes) -> bytes:
            return bytes([kind]) + put_number(len(body)) + body

        if self.files:
            h += b"\x05" + put_number(len(self.files))
            empty = [not d for _, _, d in self.files]
            if any(empty):
                h += prop(0x0E, put_bits(empty))
                h += prop(0x0F, put_bits([m["type"] == "file" for (m, _, d) in self.files if not d]))
            h += prop(0x11, b"\0" + b"".join(name + b"\0\0" for _, name, _ in self.files))
            timed = [m.get("mtime_seconds") is not None for m, _, _ in self.files]
            if any(timed):
                ticks = b"".join(struct.pack("<Q", (m["mtime_seconds"] + EPOCH) * 10_000_000 + (m.get("mtime_ns") or 0) // 100) for (m, _, _), t in zip(self.files, timed) if t)
                h += prop(0x14, (b"\x01" if all(timed) else b"\x00" + put_bits(timed)) + b"\0" + ticks)
            attributes = b""
            for m, _, _ in self.files:
                a, mode = 0x10 if m["type"] == "directory" else 0x20, m.get("mode")
                if mode is not None or m["type"] == "symlink":
                    a |= 0x8000 | ((0o777 if mode is None else mode & 0o7777) | {"directory": 0o40000, "symlink": 0o120000}.get(m["type"], 0o100000)) << 16
                attributes += struct.pack("<I", a)
            h += prop(0x15, b"\x01\0" + attributes) + b"\x00"
        h += b"\x00"
        body = b"".join(packed)
        if self.encode_header and self.files:
            f = {"id": lzma.FILTER_LZMA1, "preset": 6, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}
            coded, props = lzma.compress(h, lzma.FORMAT_RAW, filters=[f]), struct.pack("<BI", 0x5D, 1 << 20)
            outer = b"\x17\x06" + put_number(len(body)) + b"\x01\x09" + put_number(len(coded)) + b"\x00"
            outer += b"\x07\x0b\x01\x00\x01" + put_coder(LZMA1, props) + b"\x0c" + put_number(len(h)) + b"\x0a\x01" + struct.pack("<I", zlib.crc32(h)) + b"\x00\x00"
            body, h = body + coded, outer
        tail = struct.pack("<QQI", len(body), len(h), zlib.crc32(h)) if self.files else bytes(20)
        self.out.write(MAGIC + b"\0\4" + struct.pack("<I", zlib.crc32(tail)) + tail + body + (h if self.files else b""))
