"""zip: central directory and sequential walks, zip64, extras, codecs, ZipCrypto and WinZip AES reading; a writer."""

from __future__ import annotations

import hashlib
import hmac
import lzma
import os
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from ..functions.status import ContainerError
from . import legacy
from .aes import ctr_little_endian
from .member import Limits
from .streams import Source, compress, decompress

#: Signatures.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR, SPAN = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\7\x08", b"PK00PK"
SEARCH = 65557
CODECS = {0: None, 8: "deflate", 9: "deflate64", 12: "bzip2", 93: "zstd", 95: "xz"}
METHODS = {"stored": 0, "deflate": 8, "bzip2": 12, "lzma": 14, "zstd": 93, "xz": 95}
VERSIONS = {0: 20, 8: 20, 12: 46, 14: 63, 93: 63, 95: 63}
TOP = 0xFFFFFFFF


def identify(block: bytes) -> bool:
    return block.startswith((LOCAL, END, SPAN))


def dos_epoch(stamp: int) -> int | None:
    d, t = stamp >> 16, stamp & 0xFFFF
    try:
        return int(datetime((d >> 9) + 1980, d >> 5 & 15, d & 31, t >> 11, t >> 5 & 63, (t & 31) * 2, tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def epoch_dos(seconds: int) -> int:
    x = datetime.fromtimestamp(min(max(seconds, 315532800), 4354819198), timezone.utc)
    return ((x.year - 1980) << 9 | x.month << 5 | x.day) << 16 | x.hour << 11 | x.minute << 5 | x.second // 2


def extras(data: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(data):
        key, n = struct.unpack_from("<HH", data, at)
        if at + 4 + n > len(data):
            raise ContainerError("CORRUPT", "extra field")
        out.setdefault(key, data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def crypto_keys(password: bytes) -> list[int]:
    keys = [0x12345678, 0x23456789, 0x34567890]
    for b in password:
        _advance(keys, b)
    return keys


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _table()


def _advance(k: list[int], b: int) -> None:
    k[0] = k[0] >> 8 ^ _CRC[(k[0] ^ b) & 255]
    k[1] = ((k[1] + (k[0] & 255)) * 134775813 + 1) & TOP
    k[2] = k[2] >> 8 ^ _CRC[(k[2] ^ k[1] >> 24) & 255]


def zipcrypto(data: bytes, password: bytes) -> bytes:
    """Header and data, decrypted."""
    k, out = crypto_keys(password), bytearray()
    for b in data:
        t = (k[2] | 2) & 0xFFFF
        b ^= t * (t ^ 1) >> 8 & 255
        _advance(k, b)
        out.append(b)
    return bytes(out)


class ZipWalk:
    def __init__(self, source: Source, limits: Limits, password: bytes | None = None, container: dict | None = None, disks: list[int] | None = None):
        self.s, self.limits, self.password, self.container = source, limits, password, {} if container is None else container
        #: Where each disk of a split set begins.
        self.disks = [sum((disks or [])[:k]) for k in range(len(disks or [0]))]
        self.keep_raw = False  # members then carry their stored bytes, for copies that decode nothing

    # Both walks make members of the same parts.
    def _member(self, made, flags, method, stamp, crc, csize, size, name, extra, eattr, offset, zip64):
        ext = extras(extra)
        m = {
            "name": name, "name_encoding": "utf-8" if flags & 0x800 else "undeclared", "size": size, "stored_size": csize, "header_offset": offset, "uid": None, "gid": None,
        }
        seconds = dos_epoch(stamp)
        if seconds is not None:
            m |= {"mtime_seconds": seconds, "mtime_ns": 0, "mtime_source": "zip DOS date/time"}
        if len(x := ext.get(0x5455, b"")) >= 5 and x[0] & 1:
            m |= {"mtime_seconds": struct.unpack_from("<i", x, 1)[0], "mtime_ns": 0, "mtime_source": "zip extended timestamp"}
        x = ext.get(0x0A, b"")
        if len(x) >= 32 and struct.unpack_from("<HH", x, 4) == (1, 24):
            seconds, ticks = divmod(struct.unpack_from("<Q", x, 8)[0], 10_000_000)
            m |= {"mtime_seconds": seconds - 11644473600, "mtime_ns": ticks * 100, "mtime_source": "zip NTFS timestamp"}
        x = ext.get(0x7875, b"")
        if len(x) >= 3 and x[0] == 1:
            n = x[1]
            m["uid"] = int.from_bytes(x[2 : 2 + n], "little")
            m["gid"] = int.from_bytes(x[3 + n : 3 + n + x[2 + n]], "little") if len(x) > 2 + n else None
        mode = eattr >> 16 if made >> 8 == 3 else 0
        kind = {0o040000: "directory", 0o120000: "symlink", 0o010000: "fifo", 0o020000: "character device", 0o060000: "block device", 0o140000: "other"}.get(mode & 0o170000, "file")
        if kind == "file" and (name.endswith(b"/") or (eattr & 0x10 and made >> 8 in (0, 10, 11, 14))):
            kind = "directory"
        m["mode"], m["type"] = (mode & 0o177777) or None, kind
        aes = ext.get(0x9901)
        encryption = "WinZip AES" if method == 99 else "ZipCrypto (broken)" if flags & 1 else "none"
        m["zip"] = {
            "method": method, "flags": flags, "compressed_size": csize, "crc32": crc, "version_made_by": made, "external_attributes": eattr, "encryption": encryption, "extra_length": len(extra), "used_zip64": zip64,
        }
        actual = struct.unpack_from("<H", aes, 5)[0] if aes and len(aes) >= 7 else method
        if method == 99 and not aes:
            m["data_status"] = "CORRUPT"
        elif flags & 0x40 or (actual not in CODECS and actual != 14 and not 1 <= actual <= 6):
            m["data_status"] = "UNSUPPORTED"
        elif encryption != "none" and self.password is None:
            m["data_status"] = "PASSWORD_REQUIRED"
        if actual == 0 and not flags & 1 and size != csize:
            raise ContainerError("CORRUPT", "stored sizes differ")
        return m, actual, aes

    def _sixty_four(self, ext, size, csize, offset, disk=0):
        """Values of the zip64 extra in place of the markers; unresolved markers are CORRUPT."""
        data, used = ext.get(1, b""), False
        out = []
        for v, marker in ((size, TOP), (csize, TOP), (offset, TOP)):
            if v == marker:
                if len(data) < 8:
                    raise ContainerError("CORRUPT", "zip64 marker")
                v, data, used = struct.unpack_from("<Q", data)[0], data[8:], True
                if v >= 1 << 63:
                    raise ContainerError("CORRUPT", "size")
            out.append(v)
        return *out, used

    def _decode(self, raw: bytes, m: dict, actual: int, aes: bytes | None, check: int) -> bytes:
        z = m["zip"]
        if z["encryption"] == "WinZip AES":
            raw = self._aes(raw, aes)
        elif z["encryption"] != "none":
            plain = zipcrypto(raw, self.password)
            if len(plain) < 12:
                raise ContainerError("CORRUPT")
            if plain[11] != check:
                raise ContainerError("PASSWORD_REJECTED")
            raw = plain[12:]
        try:
            if actual == 0:
                data = raw
            elif 1 <= actual <= 6:
                data = legacy.unshrink(raw, m["size"]) if actual == 1 else legacy.explode(raw, m["size"], z["flags"]) if actual == 6 else legacy.expand(raw, m["size"], actual - 1)
            elif actual == 14:
                n = struct.unpack_from("<H", raw, 2)[0]
                props, dictionary = raw[4], struct.unpack_from("<I", raw, 5)[0]
                d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": props % 9, "lp": props // 9 % 5, "pb": props // 45, "dict_size": dictionary}])
                data = d.decompress(raw[4 + n :], m["size"] + 1)
            else:
                data = decompress(CODECS[actual], raw, max(m["size"], 1))
        except (lzma.LZMAError, struct.error, IndexError):
            raise ContainerError("CORRUPT") from None
        except ContainerError as e:
            raise ContainerError("PASSWORD_OR_CORRUPT" if z["encryption"].startswith("ZipCrypto") and e.status == "CORRUPT" else "CORRUPT" if e.status == "LIMIT_CODEC_BYTES" else e.status) from None
        version = struct.unpack_from("<H", aes)[0] if aes and z["encryption"] == "WinZip AES" else 0
        if len(data) != m["size"] or (version != 2 and zlib.crc32(data) != z["crc32"]):
            raise ContainerError("PASSWORD_OR_CORRUPT" if z["encryption"].startswith("ZipCrypto") else "CORRUPT", "size or CRC")
        return data

    def _aes(self, raw: bytes, extra: bytes) -> bytes:
        strength = extra[4]
        if strength not in (1, 2, 3):
            raise ContainerError("UNSUPPORTED")
        n, k = 4 + 4 * strength, 8 + 8 * strength
        if len(raw) < n + 12:
            raise ContainerError("CORRUPT")
        key = hashlib.pbkdf2_hmac("sha1", self.password, raw[:n], 1000, 2 * k + 2)
        if not hmac.compare_digest(key[-2:], raw[n : n + 2]):
            raise ContainerError("PASSWORD_REJECTED")
        body = raw[n + 2 : -10]
        if not hmac.compare_digest(hmac.digest(key[k : 2 * k], body, "sha1")[:10], raw[-10:]):
            raise ContainerError("CORRUPT", "authentication")
        return ctr_little_endian(body, key[:k])

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        return self._seeking() if self.s.seekable else self._sequential()

    def end_record(self) -> tuple[int, bytes]:
        """The end record nearest the end whose comment reaches it exactly."""
        n = min(self.s.size, SEARCH)
        self.s.seek(self.s.size - n)
        tail = self.s.exact(n)
        at = len(tail) - 22
        while at >= 0:
            at = tail.rfind(END, 0, at + 4)
            if at < 0:
                break
            if at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return self.s.size - n + at, tail[at:]
            at -= 1
        self.s.seek(0)
        raise ContainerError("CORRUPT" if identify(self.s.read(4)) else "FORMAT", "no end record")

    def _seeking(self):
        at, end = self.end_record()
        disk, cdisk, here, total, size, offset, _ = struct.unpack_from("<HHHHIIH", end, 4)
        directory_end, sixty_four = at, False
        if at >= 20:
            self.s.seek(at - 20)
            locator = self.s.exact(20)
            if locator[:4] == LOCATOR:
                where = struct.unpack_from("<Q", locator, 8)[0]
                for place in (where, at - 76):
                    if 0 <= place <= at - 76:
                        self.s.seek(place)
                        record = self.s.exact(56)
                        if record[:4] == END64:
                            total, size, offset = struct.unpack_from("<QQQ", record, 32)
                            directory_end, sixty_four, disk = place, True, 0
                            break
                else:
                    if TOP in (size, offset) or total == 0xFFFF:
                        raise ContainerError("CORRUPT", "zip64 end record")
        split = len(self.disks) > 1 and disk > 0 and not sixty_four  # else a whole zip was cut into parts
        if (disk or cdisk or here != total) and not sixty_four and not split and disk != cdisk:
            raise ContainerError("UNSUPPORTED", "several disks")
        if split and (disk != len(self.disks) - 1 or cdisk > disk):
            raise ContainerError("CORRUPT", "disk number")
        begin = self.disks[cdisk] + offset if split else directory_end - size
        if begin < 0 or begin < offset or split and begin + size > directory_end:
            raise ContainerError("CORRUPT", "directory place")
        if split:
            directory_end = begin + size
        base = 0 if split else begin - offset
        self.container.update(base_offset=base, zip_declared_members=total, zip_has_zip64_end=sixty_four, zip_comment=end[22:])
        where = begin
        for _ in range(total):
            self.s.seek(where)
            if where + 46 > directory_end:
                raise ContainerError("CORRUPT", "directory ends early")
            head = self.s.exact(46)
            if head[:4] != CENTRAL:
                raise ContainerError("CORRUPT", "directory entry")
            made, _, flags, method, time, date, crc, csize, fsize, nlen, xlen, clen, on, _, eattr, lho = struct.unpack_from("<HHHHHHIIIHHHHHII", head, 4)
            if self.limits.max_name_bytes and nlen > self.limits.max_name_bytes:
                raise ContainerError("LIMIT_NAME_BYTES")
            if self.limits.max_extra_bytes and xlen + clen > self.limits.max_extra_bytes:
                raise ContainerError("LIMIT_EXTRA_BYTES")
            if where + 46 + nlen + xlen + clen > directory_end:
                raise ContainerError("CORRUPT", "directory entry")
            name, extra = self.s.exact(nlen), self.s.exact(xlen)
            where += 46 + nlen + xlen + clen
            fsize, csize, lho, used = self._sixty_four(extras(extra), fsize, csize, lho)
            if split and on > disk:
                raise ContainerError("CORRUPT", "disk number")
            place = (self.disks[on] if split else base) + lho
            if place + 30 > begin:
                raise ContainerError("CORRUPT", "local header place")
            self.s.seek(place)
            local = self.s.exact(30)
            lname, lextra = struct.unpack_from("<HH", local, 26)
            if local[:4] != LOCAL or self.s.exact(lname) != name:
                raise ContainerError("CORRUPT", "local header")
            start = place + 30 + lname + lextra
            if start + csize > begin:
                raise ContainerError("CORRUPT", "data overlaps the directory")
            m, actual, aes = self._member(made, flags, method, date << 16 | time, crc, csize, fsize, name, extra, eattr, lho, used)
            if m["type"] == "symlink" and actual == 0 and not flags & 1 and fsize <= (self.limits.max_name_bytes or fsize):
                self.s.seek(start)
                m["link_target"] = self.s.exact(csize)
            if self.keep_raw:
                self.s.seek(start)
                m["raw"] = (self.s.exact(csize), head, extra)
            yield m, self._lazy(start, csize, m, actual, aes, (time >> 8) if flags & 8 else crc >> 24)

    def _lazy(self, start, csize, m, actual, aes, check):
        def data() -> bytes:
            self.s.seek(start)
            return self._decode(self.s.exact(csize), m, actual, aes, check)

        return data

    def _sequential(self):
        """Local headers in order; descriptors; at the end the directory must say the same."""
        seen, pending = [], None
        while True:
            if pending is not None:
                pending()
            at = self.s.at
            sign = self.s.exact(4)
            if sign != LOCAL:
                break
            head = self.s.exact(26)
            _, flags, method, time, date, crc, csize, size, nlen, xlen = struct.unpack("<HHHHHIIIHH", head)
            if self.limits.max_name_bytes and nlen > self.limits.max_name_bytes:
                raise ContainerError("LIMIT_NAME_BYTES")
            name, extra = self.s.exact(nlen), self.s.exact(xlen)
            ext = extras(extra)
            if flags & 8 and (flags & 1 or method not in (0, 8, 12, 93, 95)):
                raise ContainerError("UNSUPPORTED", "descriptor behind data of unknown end")
            size, csize, _, used = self._sixty_four(ext, size, csize, 0)
            holder: dict = {}
            if flags & 8:
                raw, data = self._until_end(method) if method else self._scanned(1 in ext)
                sign = self.s.exact(4)
                rest = self.s.exact(12 if 1 not in ext else 20) if sign == DESCRIPTOR else sign + self.s.exact(8 if 1 not in ext else 16)
                crc, csize, size = struct.unpack("<III" if 1 not in ext else "<IQQ", rest)
                if csize != len(raw) or size != len(data) or crc != zlib.crc32(data):
                    raise ContainerError("CORRUPT", "descriptor")
                holder["data"] = data
            m, actual, aes = self._member(0, flags, method, date << 16 | time, crc, csize, size, name, extra, 0, at, used)
            m["size_unknown"] = bool(flags & 8)
            if not flags & 8:
                holder["left"] = csize

            def pending(h=holder):
                if "left" in h:
                    self.s.skip(h.pop("left"))

            def data(h=holder, m=m, actual=actual, aes=aes, check=(time >> 8) if flags & 8 else crc >> 24):
                return h["data"] if "data" in h else self._decode(self.s.exact(h.pop("left")), m, actual, aes, check)

            seen.append((name, method, crc, csize, size, flags & 0x41, at))
            yield m, data
        self._confirm(sign, seen)

    def _scanned(self, large: bool):
        """Stored bytes up to the first descriptor that describes just them."""
        raw, shape = bytearray(), "<IQQ" if large else "<III"
        while True:
            raw += self.s.exact(1)
            if self.limits.max_member_bytes and len(raw) > self.limits.max_member_bytes + 4:
                raise ContainerError("LIMIT_MEMBER_BYTES")
            if raw.endswith(DESCRIPTOR):
                rest, body = self.s.exact(struct.calcsize(shape)), bytes(raw[:-4])
                if struct.unpack(shape, rest) == (zlib.crc32(body), len(body), len(body)):
                    self.s.unread(DESCRIPTOR + rest)
                    return body, body
                self.s.unread(rest)

    def _until_end(self, method):
        """Coded bytes up to the codec's own end."""
        import bz2

        d = zlib.decompressobj(-15) if method == 8 else bz2.BZ2Decompressor() if method == 12 else lzma.LZMADecompressor(lzma.FORMAT_XZ) if method == 95 else None
        if d is None:
            raise ContainerError("UNSUPPORTED", "zstd of unknown length in a sequential walk")
        raw, out = bytearray(), bytearray()
        try:
            while not d.eof:  # byte by byte near the end is what a pipe without push-back costs
                b = self.s.exact(1)
                raw += b
                out += d.decompress(b)
                if self.limits.max_member_bytes and len(out) > self.limits.max_member_bytes:
                    raise ContainerError("LIMIT_MEMBER_BYTES")
        except (zlib.error, OSError, lzma.LZMAError):
            raise ContainerError("CORRUPT") from None
        return bytes(raw), bytes(out)

    def _confirm(self, sign, seen):
        at = self.s.at - 4
        listed = []
        while sign == CENTRAL:
            made, _, flags, method, time, date, crc, csize, size, nlen, xlen, clen, _, _, _, lho = struct.unpack("<HHHHHHIIIHHHHHII", self.s.exact(42))
            name, extra = self.s.exact(nlen), self.s.exact(xlen)
            self.s.skip(clen)
            size, csize, lho, _ = self._sixty_four(extras(extra), size, csize, lho)
            listed.append((name, method, crc, csize, size, flags & 0x41, lho))
            sign = self.s.exact(4)
        if listed != seen:
            raise ContainerError("CORRUPT", "the directory disagrees with the members")
        if sign == END64:
            n = struct.unpack("<Q", self.s.exact(8))[0]
            self.s.skip(n)
            if self.s.exact(4) != LOCATOR:
                raise ContainerError("CORRUPT", "locator")
            self.s.skip(16)
            sign = self.s.exact(4)
        if sign != END:
            raise ContainerError("CORRUPT", "end record")
        rest = self.s.exact(18)
        total, size, offset, clen = struct.unpack_from("<HIIH", rest, 6)
        self.container.update(base_offset=0, zip_declared_members=len(listed), zip_comment=self.s.exact(clen))
        if (total != len(listed) & 0xFFFF and total != 0xFFFF) or (offset not in (at, TOP)):
            raise ContainerError("CORRUPT", "end record")
        if self.s.read(1):
            raise ContainerError("FORMAT", "bytes behind the container")


class ZipWriter:
    """Members with a method each; zip64 where a size or an offset needs it; descriptors on request."""

    def __init__(self, out, method: str = "deflate", level: int | None = None, descriptors: bool = False, comment: bytes = b"", password: str | None = None, volume: int | None = None):
        if method not in METHODS:
            raise ContainerError("UNSUPPORTED", method)
        self.out, self.method, self.level, self.descriptors, self.comment = out, method, level, descriptors, comment
        self.at, self.central, self.password = 0, [], None if password is None else password.encode()
        #: Volumes of so many bytes, and where each begins; the first opens with the mark of a split set.
        self.volume, self.disks = volume, [0]
        if volume is not None:
            if volume < 1 << 10:
                raise ContainerError("INVALID", "a volume is too small")
            self._write(DESCRIPTOR)

    def _lock(self, coded: bytes) -> bytes:
        """WinZip's AES-256: salt, verifier, counter mode, and ten bytes of authentication."""
        salt = os.urandom(16)
        key = hashlib.pbkdf2_hmac("sha1", self.password, salt, 1000, 66)
        body = ctr_little_endian(coded, key[:32])
        return salt + key[-2:] + body + hmac.digest(key[32:64], body, "sha1")[:10]

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _reserve(self, n: int) -> tuple[int, int]:
        """Disk and offset there of a record of n bytes, which goes to the next volume if this one has no room for it whole."""
        if self.volume is None:
            return 0, self.at
        if n > self.volume:
            raise ContainerError("UNSUPPORTED", "a record is larger than a volume")
        if self.at - self.disks[-1] + n > self.volume:
            self.disks.append(self.at)
        return len(self.disks) - 1, self.at - self.disks[-1]

    def _write_data(self, data: bytes) -> None:
        """Data may be cut at a volume's end."""
        if self.volume is not None:
            left = self.volume - (self.at - self.disks[-1])
            for cut in range(left, len(data), self.volume):
                self.disks.append(self.at + cut)
        self._write(data)

    def add(self, m: dict, data: bytes = b"") -> None:
        kind, name = m.get("type") or "file", m["name"]
        if kind not in ("file", "directory", "symlink"):
            raise ContainerError("UNSUPPORTED", kind)
        if not name or len(name) > 0xFFFF:
            raise ContainerError("INVALID")
        if kind == "directory":
            name, data = name.rstrip(b"/") + b"/", b""
        if kind == "symlink":
            data = m.get("link_target") or b""
        method = METHODS[self.method] if data and kind == "file" else 0
        if method == 14:
            c = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "preset": 6 if self.level is None else self.level, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 23}])
            coded = struct.pack("<HHBI", 0x0119, 5, 0x5D, 1 << 23) + c.compress(data) + c.flush()
        else:
            coded = compress(CODECS[method], data, self.level) if method else data
        crc, stamp = zlib.crc32(data), epoch_dos(m.get("mtime_seconds") or 0)
        locked = self.password is not None and kind == "file" and data
        if locked:
            coded = self._lock(coded)
        utf8 = 0
        if not name.isascii():
            try:
                name.decode()
                utf8 = 0x800
            except UnicodeDecodeError:
                pass
        late = self.descriptors and bool(data) and kind == "file" and not locked
        flags = utf8 | (8 if late else 0) | (2 if method == 14 else 0) | (1 if locked else 0)
        large = max(len(data), len(coded)) >= TOP
        extra = b""
        s = m.get("mtime_seconds")
        if s is not None and dos_epoch(stamp) != s and -(1 << 31) <= s < 1 << 31:
            extra = struct.pack("<HHBi", 0x5455, 5, 1, s)
        if locked:  # the second vendor version leaves the CRC out
            extra += struct.pack("<HHHHBH", 0x9901, 7, 2, 0x4541, 3, method)
            crc = 0
        zip64 = struct.pack("<HHQQ", 1, 16, len(data), len(coded)) if large else b""
        version = max(VERSIONS[method], 45 if large or self.at >= TOP else 20)
        version, method = (51, 99) if locked else (version, method)
        sizes = (0, 0, 0) if late else (crc, TOP if large else len(coded), TOP if large else len(data))
        local = LOCAL + struct.pack("<HHHHHIIIHH", version, flags, method, stamp & 0xFFFF, stamp >> 16, *sizes, len(name), len(zip64 + extra)) + name + zip64 + extra
        disk, offset = self._reserve(len(local))
        self._write(local)
        self._write_data(coded)
        if late:
            told = DESCRIPTOR + struct.pack("<IQQ" if large else "<III", crc, len(coded), len(data))
            self._reserve(len(told))
            self._write(told)
        body = (struct.pack("<QQ", len(data), len(coded)) if large else b"") + (struct.pack("<Q", offset) if offset >= TOP else b"")
        extra = (struct.pack("<HH", 1, len(body)) + body if body else b"") + extra
        mode = m.get("mode") if m.get("mode") is not None else {"directory": 0o755, "symlink": 0o777}.get(kind, 0o644)
        attributes = (mode & 0o7777 | {"directory": 0o40000, "symlink": 0o120000}.get(kind, 0o100000)) << 16 | (0x10 if kind == "directory" else 0)
        self.central.append(
            CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 0x031E, version, flags, method, stamp & 0xFFFF, stamp >> 16, crc, TOP if large else len(coded), TOP if large else len(data), len(name), len(extra), 0, disk, 0, attributes, min(offset, TOP)) + name + extra
        )

    def add_raw(self, raw: tuple[bytes, bytes, bytes], name: bytes, crc: int, size: int) -> None:
        """A member as another zip stores it: its bytes, method, times, attributes and extra fields stay."""
        coded, head, extra = raw
        made, version, flags, method, time, date = struct.unpack_from("<HHHHHH", head, 4)
        attributes = struct.unpack_from("<I", head, 38)[0]
        flags &= ~8 if not flags & 1 else ~0  # sizes are known; an encrypted member's check byte hangs on the flag
        parts, at = b"", 0
        while at + 4 <= len(extra):
            key, n = struct.unpack_from("<HH", extra, at)
            parts += extra[at : at + 4 + n] if key != 1 else b""
            at += 4 + n
        if max(size, len(coded)) >= TOP or self.at >= TOP:
            raise ContainerError("UNSUPPORTED", "raw zip64")
        offset = self.at
        facts = struct.pack("<HHHHIII", flags, method, time, date, crc, len(coded), size)
        self._write(LOCAL + struct.pack("<H", version) + facts + struct.pack("<HH", len(name), len(parts)) + name + parts + coded)
        if flags & 8:
            self._write(DESCRIPTOR + struct.pack("<III", crc, len(coded), size))
        self.central.append(CENTRAL + struct.pack("<HH", made, version) + facts + struct.pack("<HHHHHII", len(name), len(parts), 0, 0, 0, attributes, offset) + name + parts)

    def finish(self) -> None:
        n, first, here = len(self.central), None, []
        for entry in self.central:
            where = self._reserve(len(entry))
            first = first or where
            here.append(where[0])
            self._write(entry)
        disk, _ = self._reserve(22 + len(self.comment))
        (cdisk, start), size = first or (disk, self.at - self.disks[-1]), sum(map(len, self.central))
        if self.volume is not None:
            if n >= 0xFFFF or max(start, size) >= TOP:
                raise ContainerError("UNSUPPORTED", "zip64 in volumes")
            self._write(END + struct.pack("<HHHHIIH", disk, cdisk, here.count(disk), n, size, start, len(self.comment)) + self.comment)
            return
        if n >= 0xFFFF or start >= TOP or size >= TOP:
            record = self.at
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 0x031E, 45, 0, 0, n, n, size, start) + LOCATOR + struct.pack("<IQI", 0, record, 1))
        self._write(END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, TOP), min(start, TOP), len(self.comment)) + self.comment)


def copy_raw(data: bytes, rename=lambda name: name, keep=lambda member: True) -> bytes:
    """A zip of another zip's members, some left out or renamed, without decoding or decrypting any."""
    import io

    walk = ZipWalk(Source(io.BytesIO(data)), Limits())
    walk.keep_raw = True
    out = io.BytesIO()
    writer = ZipWriter(out)
    for m, _ in walk:
        if keep(m):
            writer.add_raw(m["raw"], rename(m["name"]), m["zip"]["crc32"], m["size"])
    writer.comment = walk.container.get("zip_comment") or b""
    writer.finish()
    return out.getvalue()
