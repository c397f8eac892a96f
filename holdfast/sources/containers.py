"""Containers of any format: identification, reading to rows, writing from rows."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

from ..functions.status import ContainerError
from . import sevenz, tar, unix, zips
from .member import Limits, rows
from .streams import Source, compress, decompress, sniff_codec

WRITERS = {
    "tar": lambda out, o: tar.TarWriter(out, o.get("variant", "pax"), int(o.get("blocking", 1))),
    "zip": lambda out, o: zips.ZipWriter(out, o.get("method", "deflate"), o.get("level"), bool(o.get("descriptors", False)), o.get("comment", b""), o.get("password")),
    "7z": lambda out, o: sevenz.SevenZipWriter(out, o.get("method", "lzma2"), bool(o.get("solid", True)), o.get("level"), o.get("filter"), bool(o.get("encode_header", False))),
    "ar": lambda out, o: unix.ArWriter(out),
    "cpio": lambda out, o: unix.CpioWriter(out, o.get("variant", "newc")),
    "shar": lambda out, o: unix.SharWriter(out, bool(o.get("uuencode", False))),
}


class Peeked(io.RawIOBase):
    """A forward-only source that gives back the bytes looked at first."""

    def __init__(self, head: bytes, f):
        self.head, self.f = head, f

    def readable(self):
        return True

    def seekable(self):
        return False

    def read(self, n=-1):
        if self.head:
            got, self.head = (self.head, b"") if n < 0 else (self.head[:n], self.head[n:])
            return got
        return self.f.read(n)


def identify(block: bytes) -> str | None:
    """The format by the first 512 bytes, asked in a fixed order."""
    if tar.identify(block):
        return "tar"
    if block.startswith(unix.AR_MAGIC):
        return "ar"
    if block[:6] in (b"070701", b"070702", b"070707"):
        return "cpio"
    if block[:2] in (b"\xc7\x71", b"\x71\xc7"):
        raise ContainerError("UNSUPPORTED", "binary cpio")
    if block.startswith(sevenz.MAGIC):
        return "7z"
    return "zip" if zips.identify(block) else None


def self_extracting(data: bytes) -> int | None:
    """Where a 7z begins behind a program: in its first 8 MiB, with a valid start header."""
    if not data.startswith((b"MZ", b"\x7fELF", b"\xfe\xed\xfa", b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe", b"\xca\xfe\xba\xbe")):
        return None
    at = data.find(sevenz.MAGIC, 0, 8 << 20)
    while at >= 0:
        if len(data) >= at + 32 and zlib.crc32(data[at + 12 : at + 32]) == int.from_bytes(data[at + 8 : at + 12], "little"):
            return at
        at = data.find(sevenz.MAGIC, at + 1, 8 << 20)
    return None


def read_container(path: str, data: bytes, container: dict, limits: Limits | None = None, access: str = "random", codec: str = "auto", password: str | None = None, with_content: bool = True, name_hint: bool = False, only: int | None = None, disks: list[int] | None = None, holes: bool = True) -> Iterator[dict]:
    """Member rows of one container (disks: the lengths of a split one's parts); ``container`` becomes its own row.  access: random, or sequential as from a pipe.  holes=False: sparse members' content is that of their regions, end to end."""
    limits = limits or Limits()
    secret = None if password is None else password.encode()
    container.update(path=path, format="unknown", codec=None, base_offset=None, zip_declared_members=None, zip_has_zip64_end=None, zip_comment=None, member_count=0, total_declared_bytes=0)
    try:
        if not data:
            raise ContainerError("CORRUPT", "empty")
        kind, random = identify(data[:512]), access == "random"
        if kind is None and codec == "auto" and (found := sniff_codec(data[:64], path, name_hint)) or codec not in ("auto", "none"):
            container["codec"] = found = codec if codec not in ("auto", "none") else found
            data, random = decompress(found, data), False
            kind = identify(data[:512])
            if not data:
                raise ContainerError("CORRUPT", "empty")
        if kind is None and random and (at := self_extracting(data)) is not None:
            container["base_offset"], data, kind = at, data[at:], "7z"
        if kind is None and random:
            # A stub may stand in front of a zip: its end record decides.
            source = Source(io.BytesIO(data))
            zips.ZipWalk(source, limits).end_record()
            kind = "zip"
        if kind is None:
            raise ContainerError("FORMAT")
        container["format"] = kind
        source = Source(io.BytesIO(data)) if random else Source(Peeked(data[:512], io.BytesIO(data[512:])), False)
        if kind == "7z" and not random:
            raise ContainerError("NOT_SEEKABLE")
        walk = {
            "tar": lambda: tar.TarWalk(source, limits, holes),
            "ar": lambda: unix.ArWalk(source, limits),
            "cpio": lambda: unix.CpioWalk(source, limits),
            "zip": lambda: zips.ZipWalk(source, limits, secret, container, disks),
            "7z": lambda: sevenz.SevenZipWalk(source, limits, secret),
        }[kind]()
        yield from rows(path, iter(walk), limits, with_content, container, only)
    except ContainerError as e:
        container["status"] = e.status


def write_container(format: str, members: Iterator[tuple[dict, bytes]], codec: str | None = None, on_refusal: str = "fail", **options) -> bytes:
    """The bytes of a container.  A member that the format refuses has written nothing: it raises, or is skipped if asked."""
    if format not in WRITERS:
        raise ContainerError("UNSUPPORTED", format)
    out = io.BytesIO()
    writer = WRITERS[format](out, options)
    for m, data in members:
        try:
            writer.add(m, data)
        except ContainerError:
            if on_refusal != "skip":
                raise
    writer.finish()
    return compress(codec, out.getvalue()) if codec else out.getvalue()
