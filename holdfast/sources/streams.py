"""Byte sources: bounded views, parts end to end, codec-wrapped streams.  A short read is CORRUPT."""

from __future__ import annotations

import bz2
import io
import lzma
import zlib

from ..functions.status import ContainerError
from .decoders import deflate64, lz4

CHUNK = 1 << 16
CODEC_CAP, ZSTD_STEP = 512 << 20, 1 << 12
#: First bytes of codecs that are trusted without a name.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd", "lz4": b"\x04\x22\x4d\x18"}


class Source:
    """A file-like with exact reads and skips; knows whether it can seek and, if so, its size."""

    def __init__(self, f, seekable: bool | None = None):
        self.f = f
        self.seekable = f.seekable() if seekable is None else seekable
        self.at = f.tell() if self.seekable else 0
        self.size = None
        if self.seekable:
            self.size = f.seek(0, io.SEEK_END)
            f.seek(self.at)

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            got = self.f.read(left)
            if not got:
                break
            parts.append(got)
            left -= len(got)
        self.at += n - left
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def exact(self, n: int) -> bytes:
        got = self.read(n)
        if len(got) < n:
            raise ContainerError("CORRUPT", "the source ends early")
        return got

    def skip(self, n: int) -> None:
        if self.seekable:
            if self.at + n > self.size:
                raise ContainerError("CORRUPT", "the source ends early")
            self.at = self.f.seek(self.at + n)
            return
        while n:
            n -= len(self.exact(min(n, CHUNK)))

    def unread(self, data: bytes) -> None:
        """Gives bytes back to a forward-only source, which hands them out again first."""
        self.f.head = data + self.f.head
        self.at -= len(data)

    def seek(self, at: int) -> None:
        if not self.seekable:
            raise ContainerError("NOT_SEEKABLE")
        self.at = self.f.seek(at)


class Concat(io.RawIOBase):
    """Parts of a split container, end to end."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.offsets, total = parts, [], 0
        for p in parts:
            self.offsets.append(total)
            total += len(p)
        self.total, self.at = total, 0

    def seekable(self):
        return True

    def readable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=io.SEEK_SET):
        self.at = offset + (0 if whence == io.SEEK_SET else self.at if whence == io.SEEK_CUR else self.total)
        return self.at

    def read(self, n=-1):
        end, out = self.total if n < 0 else min(self.total, self.at + n), []
        for p, o in zip(self.parts, self.offsets):
            if o < end and o + len(p) > self.at:
                out.append(p[max(0, self.at - o) : end - o])
        self.at = max(self.at, end)
        return b"".join(out)


def sniff_codec(head: bytes, path: str = "", name_hint: bool = False) -> str | None:
    for codec, magic in MAGIC.items():
        if head.startswith(magic):
            return codec
    low = path.lower()
    if name_hint and low.endswith((".br", ".tbr")):
        return "brotli"
    return "lzma" if name_hint and low.endswith((".lzma", ".tlzma")) else None


def decompress(codec: str, data: bytes, cap: int = CODEC_CAP) -> bytes:
    """All frames of bzip2, xz and zstd; the one of gzip, zlib and lzma, behind which any byte is CORRUPT."""
    out, left, total = [], data, 0

    def add(part: bytes) -> None:
        nonlocal total
        out.append(part)
        total += len(part)
        if total > cap:
            raise ContainerError("LIMIT_CODEC_BYTES")

    try:
        if codec in ("gzip", "zlib", "deflate"):
            d = zlib.decompressobj({"gzip": 31, "zlib": 15, "deflate": -15}[codec])
            add(d.decompress(left, cap + 1))
            if not d.eof or d.unused_data:
                raise ContainerError("CORRUPT", "bytes behind the stream" if d.eof else "the stream is cut")
        elif codec == "lzma":
            d = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
            add(d.decompress(left, cap + 1))
            if not d.eof or d.unused_data:
                raise ContainerError("CORRUPT")
        elif codec in ("bzip2", "xz"):
            while left or not out:
                d = bz2.BZ2Decompressor() if codec == "bzip2" else lzma.LZMADecompressor(lzma.FORMAT_XZ)
                add(d.decompress(left, cap + 1))
                if not d.eof:
                    raise ContainerError("LIMIT_CODEC_BYTES" if len(out[-1]) > cap else "CORRUPT")
                left = d.unused_data
                if codec == "xz":
                    left = left.lstrip(b"\x00") if len(left) % 4 == 0 else left
        elif codec == "zstd":
            import zstandard

            while left or not out:
                # Small steps: what one of them can yield is bounded before the cap is asked.
                d, at, left = zstandard.ZstdDecompressor(max_window_size=CODEC_CAP).decompressobj(), 0, memoryview(left)
                while at < len(left) and not d.eof:
                    add(d.decompress(left[at : at + ZSTD_STEP]))
                    at += ZSTD_STEP
                if not d.eof:
                    raise ContainerError("CORRUPT", "the frame is cut")
                left = d.unused_data + bytes(left[at:])
        elif codec == "brotli":
            import pyarrow as pa

            # The end of a stream isn't told: what stands behind it is not seen.
            with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as stream:
                while part := stream.read(CHUNK):
                    add(part)
        elif codec in ("lz4", "deflate64"):
            add((lz4 if codec == "lz4" else deflate64)(left, cap))
        else:
            raise ContainerError("UNSUPPORTED", f"codec {codec}")
    except (zlib.error, lzma.LZMAError, OSError, EOFError) as e:
        raise ContainerError("CORRUPT", str(e)) from None
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise ContainerError("CORRUPT", str(e)) from None
        raise
    return b"".join(out)


def compress(codec: str, data: bytes, level: int | None = None) -> bytes:
    if codec in ("gzip", "zlib", "deflate"):
        c = zlib.compressobj(6 if level is None else level, zlib.DEFLATED, {"gzip": 31, "zlib": 15, "deflate": -15}[codec])
        return c.compress(data) + c.flush()
    if codec == "bzip2":
        return bz2.compress(data, level or 9)
    if codec in ("xz", "lzma"):
        return lzma.compress(data, lzma.FORMAT_XZ if codec == "xz" else lzma.FORMAT_ALONE, preset=6 if level is None else level)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3 if level is None else level, write_content_size=True).compress(data)
    if codec in ("lz4", "brotli"):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, codec) as stream:
            stream.write(data)
        return sink.getvalue().to_pybytes()
    raise ContainerError("UNSUPPORTED", f"codec {codec}")
