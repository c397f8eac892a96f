"""ar and cpio (reading and writing) and shar (writing)."""

from __future__ import annotations

import binascii
from collections.abc import Iterator

from ..functions.status import ContainerError
from .member import Limits
from .streams import Source

AR_MAGIC, AR_END = b"!<arch>\n", b"`\n"
AR_TABLE_CAP = 16 << 20
TRAILER = b"TRAILER!!!"
TYPES = {0o100000: "file", 0o040000: "directory", 0o120000: "symlink", 0o010000: "fifo", 0o020000: "character device", 0o060000: "block device"}
BITS = {v: k for k, v in TYPES.items()}


def _digits(raw: bytes, base: int, exact: bool = False) -> int:
    text = raw if exact else raw.rstrip(b" ")
    if not text and not exact:
        return 0
    try:
        if not text.isalnum():
            raise ValueError
        return int(text, base)
    except ValueError:
        raise ContainerError("CORRUPT", "number") from None


class ArWalk:
    def __init__(self, source: Source, limits: Limits):
        self.s, self.limits = source, limits

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        if self.s.exact(8) != AR_MAGIC:
            raise ContainerError("FORMAT")
        table, first = None, True
        while True:
            at = self.s.at
            head = self.s.read(60)
            if not head:
                return
            if len(head) < 60 or head[58:] != AR_END:
                raise ContainerError("CORRUPT", "member header")
            raw, size = head[:16].rstrip(b" "), _digits(head[48:58], 10)
            end = self.s.at + size + size % 2
            if raw == b"//":
                if table is not None or size > AR_TABLE_CAP:
                    raise ContainerError("CORRUPT", "name table")
                table = self.s.exact(size)
                self._to(end)
                continue
            if first and raw in (b"/", b"/SYM64/") or first and raw.startswith(b"__.SYMDEF"):
                self._to(end)
                continue
            name, skip = raw, 0
            if raw.startswith(b"#1/"):
                skip = _digits(raw[3:], 10)
                if skip > size or skip > 4096:
                    raise ContainerError("CORRUPT", "name length")
                name = self.s.exact(skip).rstrip(b"\0")
                if first and name.startswith(b"__.SYMDEF"):
                    self._to(end)
                    continue
            elif raw.startswith(b"/") and raw[1:].isdigit():
                offset = int(raw[1:])
                if table is None or offset >= len(table):
                    raise ContainerError("CORRUPT", "name offset")
                stop = table.find(b"\n", offset)
                name = table[offset : stop if stop >= 0 else len(table)].removesuffix(b"/")
            else:
                name = raw.removesuffix(b"/")
            first = False
            start, n = self.s.at, size - skip
            m = {
                "name": name, "size": n, "stored_size": n, "mtime_seconds": _digits(head[16:28], 10), "mtime_ns": 0, "mtime_source": "unix-seconds", "uid": _digits(head[28:34], 10),
                "gid": _digits(head[34:40], 10), "mode": _digits(head[40:48], 8) & 0o7777, "header_offset": at,
            }
            yield m, lambda n=n: self.s.exact(n)
            self._to(end, last=True, start=start + n)

    def _to(self, end: int, last: bool = False, start: int = 0) -> None:
        if last and end > start and self.s.at < end:  # the padding byte of the last member may be missing
            self.s.skip(start - self.s.at)
            self.s.read(end - start)
        else:
            self.s.skip(end - self.s.at)


class ArWriter:
    def __init__(self, out):
        self.out = out
        out.write(AR_MAGIC)

    def add(self, m: dict, data: bytes = b"") -> None:
        name = m["name"]
        if (m.get("type") or "file") != "file":
            raise ContainerError("UNSUPPORTED", "only files")
        if not name or b"\0" in name:
            raise ContainerError("INVALID")
        short = len(name) <= 15 and b"/" not in name and not name.endswith(b" ") and not name.startswith(b"#1/")
        field, extra = (name + b"/", b"") if short else (b"#1/%d" % len(name), name)
        mode = m.get("mode") if m.get("mode") is not None else 0o644
        body = extra + data
        head = b"%-16s%-12d%-6d%-6d%-8o%-10d" % (field, max(0, m.get("mtime_seconds") or 0), m.get("uid") or 0, m.get("gid") or 0, mode & 0o7777 | 0o100000, len(body))
        if len(head) != 58:
            raise ContainerError("UNSUPPORTED", "a number is too wide")
        self.out.write(head + AR_END + body + b"\n" * (len(body) % 2))

    def finish(self) -> None:
        pass


class CpioWalk:
    """newc and crc (hexadecimal) and odc (octal)."""

    def __init__(self, source: Source, limits: Limits):
        self.s, self.limits = source, limits

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        first = True
        while True:
            at = self.s.at
            magic = self.s.read(6)
            if not magic and not first:
                return
            first = False
            if magic in (b"070701", b"070702"):
                raw = self.s.exact(104)
                ino, mode, uid, gid, nlink, mtime, size, major, minor, rmajor, rminor, nlen, check = (_digits(raw[i : i + 8], 16, True) for i in range(0, 104, 8))
                pad = 4
            elif magic == b"070707":
                raw = self.s.exact(70)
                fields, place = [], 0
                for n in (6, 6, 6, 6, 6, 6, 6, 11, 6, 11):
                    fields.append(_digits(raw[place : place + n], 8, True))
                    place += n
                _, ino, mode, uid, gid, nlink, rdev, mtime, nlen, size = fields
                major = minor = check = 0
                rmajor, rminor, pad = rdev >> 8, rdev & 255, 1
            else:
                raise ContainerError("CORRUPT", "member header")
            if self.limits.max_name_bytes and nlen > self.limits.max_name_bytes + 1:
                raise ContainerError("LIMIT_NAME_BYTES")
            name = self.s.exact(nlen)
            if not nlen or name[-1] or b"\0" in name[:-1]:
                raise ContainerError("CORRUPT", "name")
            name = name[:-1]
            self.s.skip(-(self.s.at - at) % pad)
            if name == TRAILER:
                return
            kind = TYPES.get(mode & 0o170000, "other")
            m = {
                "name": name, "type": kind, "size": size, "stored_size": size, "mtime_seconds": mtime, "mtime_ns": 0, "mtime_source": "unix-seconds", "mode": mode & 0o7777, "uid": uid, "gid": gid, "header_offset": at,
            }
            if kind.endswith("device"):
                m |= {"device_major": rmajor, "device_minor": rminor}
            start = self.s.at
            if kind == "symlink":
                if self.limits.max_name_bytes and size > self.limits.max_name_bytes:
                    raise ContainerError("LIMIT_NAME_BYTES")
                m |= {"link_target": self.s.exact(size), "size": 0}

            def data(size=size, check=check if magic == b"070702" else None):
                got = self.s.exact(size)
                if check is not None and sum(got) & 0xFFFFFFFF != check:
                    raise ContainerError("CORRUPT", "byte sum")
                return got

            yield m, data
            end = start + size
            self.s.skip(end + (-(end - at) % pad if pad > 1 else 0) - self.s.at)


class CpioWriter:
    def __init__(self, out, variant: str = "newc"):
        if variant not in ("newc", "odc"):
            raise ContainerError("UNSUPPORTED", variant)
        self.out, self.variant, self.n, self.at = out, variant, 0, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _member(self, name, mode, uid, gid, links, mtime, data, device=(0, 0)) -> None:
        self.n += name != TRAILER
        ino = self.n if name != TRAILER else 0
        if self.variant == "newc":
            if not 0 <= mtime <= 0xFFFFFFFF or len(data) > 0xFFFFFFFF:
                raise ContainerError("UNSUPPORTED", "a number is too wide")
            values = (ino, mode, uid, gid, links, mtime, len(data), 0, 0, *device, len(name) + 1, 0)
            self._put(b"070701" + b"".join(b"%08X" % v for v in values) + name + b"\0")
            self._put(bytes(-self.at % 4))
            self._put(data)
            self._put(bytes(-self.at % 4))
        else:
            if ino > 0o777777 or max(uid, gid) > 0o777777 or not 0 <= mtime < 8**11 or len(data) >= 8**11:
                raise ContainerError("UNSUPPORTED", "a number is too wide")
            self._put(b"070707%06o%06o%06o%06o%06o%06o%06o%011o%06o%011o" % (0, ino, mode, uid, gid, links, device[0] << 8 | device[1], mtime, len(name) + 1, len(data)) + name + b"\0" + data)

    def add(self, m: dict, data: bytes = b"") -> None:
        kind, name = m.get("type") or "file", m["name"]
        if kind not in BITS or name == TRAILER:
            raise ContainerError("UNSUPPORTED", kind)
        if not name or b"\0" in name:
            raise ContainerError("INVALID")
        mode = m.get("mode") if m.get("mode") is not None else 0o755 if kind == "directory" else 0o644
        body = (m.get("link_target") or b"") if kind == "symlink" else data if kind == "file" else b""
        self._member(name, mode & 0o7777 | BITS[kind], m.get("uid") or 0, m.get("gid") or 0, 2 if kind == "directory" else 1, m.get("mtime_seconds") or 0, body, (m.get("device_major") or 0, m.get("device_minor") or 0))

    def finish(self) -> None:
        self._member(TRAILER, 0, 0, 0, 1, 0, b"")
        self._put(bytes(-self.at % 512))


class SharWriter:
    """A shell script that recreates its members.  Text goes through sed, other bytes through uudecode."""

    def __init__(self, out, uuencode: bool = False):
        self.out, self.uuencode = out, uuencode
        out.write(b"#!/bin/sh\n# This is a shell archive; run it with sh to extract.\n")

    @staticmethod
    def quoted(name: bytes) -> bytes:
        return b"'" + name.replace(b"'", b"'\\''") + b"'"

    def add(self, m: dict, data: bytes = b"") -> None:
        kind, name = m.get("type") or "file", m["name"]
        if not name or b"\0" in name or b"\n" in name:
            raise ContainerError("INVALID")
        q = self.quoted(b"./" + name if name.startswith(b"-") else name)
        self.out.write(b"echo x " + q + b"\n")
        if kind == "directory":
            self.out.write(b"mkdir -p " + q + b"\n")
        elif kind == "symlink":
            self.out.write(b"ln -fs " + self.quoted(m.get("link_target") or b"") + b" " + q + b"\n")
        elif kind != "file":
            raise ContainerError("UNSUPPORTED", kind)
        elif not data:
            self.out.write(b": > " + q + b"\n")
        elif self.uuencode:
            lines = [binascii.b2a_uu(data[i : i + 45], backtick=True) for i in range(0, len(data), 45)]
            self.out.write(b"uudecode -o " + q + b" << 'SHAR_END'\nbegin 644 x\n" + b"".join(lines) + b"`\nend\nSHAR_END\n")
        else:
            if b"\0" in data or not data.endswith(b"\n"):
                raise ContainerError("UNSUPPORTED", "not text")
            self.out.write(b"sed 's/^X//' > " + q + b" << 'SHAR_END'\n" + b"".join(b"X" + x + b"\n" for x in data[:-1].split(b"\n")) + b"SHAR_END\n")
        if m.get("mode") is not None and kind == "file":
            self.out.write(b"chmod %o " % (m["mode"] & 0o7777) + q + b"\n")

    def finish(self) -> None:
        self.out.write(b"exit 0\n")
