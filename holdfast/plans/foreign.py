"""Queries over containers that other code wrote: the standard library, pyarrow, or bytes laid out here by the formats' public descriptions.

Each reads what it finds back to rows; the SQL twin says what the table held.  FIXED holds small containers byte by byte.
"""

from __future__ import annotations

import gzip
import io
import lzma
import random
import stat
import struct
import tarfile
import time
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import containers as ops
from ..sources import aes, sevenz, zips
from ..sources.containers import write_container
from ..sources.tar import checksums
from .queries import DOCUMENTS_SQL, query, table


def written(rows: DataFrame, write) -> DataFrame:
    """(path, content) by a plain function of a container's rows, sorted by name."""

    def run(t: pa.Table) -> pa.Table:
        members = sorted(t.to_pylist(), key=lambda r: r["name"])
        return pa.table({"path": [members[0]["path"]], "content": pa.array([write(members)], pa.binary())})

    return rows.groupBy("path").applyInArrow(run, "path string, content binary")


def texts(spark, sf_dir, name: str) -> DataFrame:
    """path, id, name, content of all documents; name is an SQL expression."""
    rows = table(spark, sf_dir, "documents").selectExpr("lang", "doc_id AS id", f"CAST({name} AS BINARY) AS name", "CAST(coalesce(text, '') AS BINARY) AS content")
    return ops.parted(rows, F.col("lang"), F.col("name"), F.col("content")).drop("lang")


def parts(spark, sf_dir, *columns: str) -> DataFrame:
    """path, id, name, content of all parts, a container a brand."""
    return table(spark, sf_dir, "part").selectExpr("p_brand AS path", "p_partkey AS id", "p_size AS n", "CAST('m' || p_partkey AS BINARY) AS name", "CAST(p_name AS BINARY) AS content", *columns)


def many(rows: DataFrame) -> DataFrame:
    """rows, their containers cut to parts whose members one task can hold: path-part."""
    return ops.parted(rows, F.col("path"), F.col("name"), F.col("content"), 8 << 20)


def shown(rows: DataFrame, *more) -> DataFrame:
    return rows.select(F.decode("name", "UTF-8").alias("name"), "size", F.sha2("content", 256).alias("sha256"), *more)


# tar ----------------------------------------------------------------------------------------------------------------


def tar_of(form: int, describe):
    def write(rows):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=form, encoding="utf-8") as t:
            for r in rows:
                info = tarfile.TarInfo(r["name"].decode())
                info.size = len(r["content"])
                describe(info, r)
                t.addfile(info, io.BytesIO(r["content"]) if info.isreg() else None)
        return out.getvalue()

    return write


def _long_pax(info, r):
    info.mtime, info.uname = 1000000000 + r["id"] * 2 + 0.25, "owner" * 9


@query(
    """
SELECT source || '/' || repeat('übung-mit-langem-namen/', 8) || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256,
  doc_id * 2 + 1000000000 AS mtime, 250000000 AS mtime_ns, 'pax decimal' AS mtime_source, 'pax' AS variant, 'utf-8' AS name_encoding, repeat('owner', 9) AS uname FROM documents
"""
)
def tar_stdlib_pax_scan(spark, sf_dir):
    rows = texts(spark, sf_dir, "source || '/' || repeat('übung-mit-langem-namen/', 8) || doc_id || '.txt'")
    return shown(
        ops.members(written(rows, tar_of(tarfile.PAX_FORMAT, _long_pax))), F.col("mtime_seconds").alias("mtime"), "mtime_ns", "mtime_source", F.col("tar.variant").alias("variant"), "name_encoding", F.decode("uname", "UTF-8").alias("uname")
    )


def _wide_gnu(info, r):
    info.mtime, info.uid = -r["id"] - 1, (1 << 33) + r["id"]


@query(
    """
SELECT source || '/' || repeat('a-long-component/', 9) || doc_id AS name, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256,
  -doc_id - 1 AS mtime, 8589934592 + doc_id AS uid, 'gnu' AS variant FROM documents
"""
)
def tar_stdlib_gnu_scan(spark, sf_dir):
    """Long names in members of their own; numbers in base 256, negative ones too."""
    rows = texts(spark, sf_dir, "source || '/' || repeat('a-long-component/', 9) || doc_id")
    return shown(ops.members(written(rows, tar_of(tarfile.GNU_FORMAT, _wide_gnu))), F.col("mtime_seconds").alias("mtime"), "uid", F.col("tar.variant").alias("variant"))


KINDS = (tarfile.REGTYPE, tarfile.DIRTYPE, tarfile.SYMTYPE, tarfile.LNKTYPE, tarfile.CHRTYPE, tarfile.BLKTYPE, tarfile.FIFOTYPE)


def _any_type(info, r):
    info.type, info.mode = KINDS[r["id"] % 7], 0o640
    if not info.isreg():
        info.size = 0
    if info.issym() or info.islnk():
        info.linkname = "to/" * (1 + r["id"] % 60) + str(r["id"])
    if info.isdev() and not info.isfifo():
        info.devmajor, info.devminor = r["id"] % 256, r["id"] % 100


_TYPE = "CASE p_partkey % 7 WHEN 0 THEN 'file' WHEN 1 THEN 'directory' WHEN 2 THEN 'symlink' WHEN 3 THEN 'hardlink' WHEN 4 THEN 'character device' WHEN 5 THEN 'block device' ELSE 'fifo' END"


def typed(spark, sf_dir) -> DataFrame:
    return written(parts(spark, sf_dir), tar_of(tarfile.PAX_FORMAT, _any_type))


@query(
    f"""
SELECT 'm' || p_partkey || CASE WHEN p_partkey % 7 = 1 THEN '/' ELSE '' END AS name, {_TYPE} AS type, CASE WHEN p_partkey % 7 = 0 THEN strlen(p_name) ELSE 0 END AS size,
  CASE WHEN p_partkey % 7 IN (2, 3) THEN repeat('to/', 1 + p_partkey % 60) || p_partkey END AS link_target,
  CASE WHEN p_partkey % 7 IN (4, 5) THEN p_partkey % 256 END AS device_major, CASE WHEN p_partkey % 7 IN (4, 5) THEN p_partkey % 100 END AS device_minor, 416 AS mode FROM part
"""
)
def tar_types_scan(spark, sf_dir):
    """Every type of member, link targets beyond the header's field, device numbers."""
    rows = ops.members(typed(spark, sf_dir))
    return rows.select(F.decode("name", "UTF-8").alias("name"), "type", "size", F.decode("link_target", "UTF-8").alias("link_target"), "device_major", "device_minor", F.col("mode").cast("int").alias("mode"))


@query(
    f"""
WITH m AS (SELECT p_brand AS path, row_number() OVER (PARTITION BY p_brand ORDER BY 'm' || p_partkey) - 1 AS idx, {_TYPE} AS type FROM part),
s AS (SELECT *, min(CASE WHEN type NOT IN ('file', 'directory') THEN idx END) OVER (PARTITION BY path) AS stop FROM m)
SELECT path, idx, CASE WHEN idx = stop THEN 'type' WHEN type NOT IN ('file', 'directory') THEN 'type' END AS refusal,
  CASE WHEN idx < coalesce(stop, idx + 1) THEN 'extract' WHEN idx = stop THEN 'refuse' ELSE 'skip' END AS action FROM s
"""
)
def extract_plan_types(spark, sf_dir):
    """Links and devices are refused, and end the extraction."""
    return ops.extract_plan(ops.members(typed(spark, sf_dir), with_content=False)).select("path", "idx", "refusal", "action")


@query(
    f"""
WITH m AS (SELECT p_brand AS path, row_number() OVER (PARTITION BY p_brand ORDER BY 'm' || p_partkey) - 1 AS idx, *, {_TYPE} AS type FROM part)
SELECT path, idx || ' ' || type || ' ' || CASE WHEN p_partkey % 7 = 0 THEN strlen(p_name) ELSE 0 END || ' m' || p_partkey || CASE WHEN p_partkey % 7 = 1 THEN '/' ELSE '' END
  || CASE WHEN p_partkey % 7 IN (2, 3) THEN ' -> ' || repeat('to/', 1 + p_partkey % 60) || p_partkey ELSE '' END AS line FROM m
"""
)
def member_dump(spark, sf_dir):
    return ops.dump(ops.members(typed(spark, sf_dir), with_content=False)).select("path", "line")


def _v7(rows):
    out = []
    for r in rows:
        info = tarfile.TarInfo("é" + r["name"].decode())
        info.size = len(r["content"])
        block = bytearray(info.tobuf(tarfile.USTAR_FORMAT, "utf-8"))
        block[257:512], block[148:156] = bytes(255), b" " * 8
        block[148:156] = b"%06o\0 " % (checksums(block)[1])
        out += (block, padded(r["content"]))
    return b"".join(out) + bytes(1024)


@query("SELECT 'ém' || p_partkey AS name, strlen(p_name) AS size, sha256(p_name) AS sha256, 'v7' AS variant, true AS checksum_signed FROM part")
def tar_v7_scan(spark, sf_dir):
    """No magic, and sums over signed bytes as old writers made them."""
    return shown(ops.members(written(many(parts(spark, sf_dir)), _v7)), F.col("tar.variant").alias("variant"), F.col("tar.checksum_signed").alias("checksum_signed"))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 512)


def _pax(*pairs: tuple[str, object]) -> bytes:
    """An extended header with these records."""
    body = b""
    for key, value in pairs:
        rest = f" {key}={value}\n".encode()
        n = len(rest) + 1
        while len(str(n)) + len(rest) != n:
            n += 1
        body += str(n).encode() + rest
    return _header("pax", len(body), b"x") + padded(body)


def _header(name: str, size: int, kind: bytes = b"0", form: int = tarfile.USTAR_FORMAT) -> bytes:
    info = tarfile.TarInfo(name)
    info.size, info.type = size, kind
    return info.tobuf(form)


def _regions(n: int) -> tuple[list[tuple[int, int]], bytes, int]:
    k = 1 + n % 6
    return [(8192 * i, 10 + i) for i in range(k)], b"".join(bytes([97 + i]) * (10 + i) for i in range(k)), 8192 * k


def _sparse(rows):
    out = []
    for r in rows:
        (found, data, real), name, form = _regions(r["n"]), r["name"].decode(), r["form"]
        listed = [str(x) for region in found for x in region]
        if form == 0:
            block = bytearray(_header(name, len(data), b"S", tarfile.GNU_FORMAT))
            pairs = [b"%011o\0%011o\0" % x for x in found]
            block[386:482], block[482], block[483:495], block[148:156] = b"".join(pairs[:4]).ljust(96, b"\0"), len(pairs) > 4, b"%011o\0" % real, b" " * 8
            block[148:156] = b"%06o\0 " % sum(block)
            out += (block, b"".join(pairs[4:]).ljust(512, b"\0") if len(pairs) > 4 else b"")
        elif form == 1:
            both = [x for o, n in found for x in (("GNU.sparse.offset", o), ("GNU.sparse.numbytes", n))]
            out += (_pax(("GNU.sparse.size", real), ("GNU.sparse.numblocks", len(found)), *both), _header(name, len(data)))
        elif form == 2:
            out += (_pax(("GNU.sparse.size", real), ("GNU.sparse.numblocks", len(found)), ("GNU.sparse.name", name), ("GNU.sparse.map", ",".join(listed))), _header("other", len(data)))
        else:
            data = padded(("\n".join([str(len(found)), *listed]) + "\n").encode()) + data
            out += (_pax(("GNU.sparse.major", 1), ("GNU.sparse.minor", 0), ("GNU.sparse.name", name), ("GNU.sparse.realsize", real)), _header("other", len(data)))
        out.append(padded(data))
    return b"".join(out) + bytes(1024)


SPARSE_SQL = """
WITH r AS (SELECT *, 1 + p_size % 6 AS k FROM part)
SELECT f.form, 'm' || p_partkey AS name, (8192 * k)::BIGINT AS size, true AS sparse, array_to_string(list_transform(range(0, k), lambda i: (8192 * i) || ':' || (10 + i)), ',') AS regions,
  array_to_string(list_transform(range(0, k), lambda i: repeat(chr((97 + i)::INTEGER), (10 + i)::INTEGER)), '') AS letters, true AS in_place
FROM r, (VALUES (0), (1), (2), (3)) f(form)
"""


def _found(row: dict) -> dict:
    """A sparse member's letters, and whether the last region's are in their place, from its whole content."""
    data, regions = row["content"], row["sparse_map"]
    if data is None or not regions:
        return {"letters": None, "in_place": None}
    at, n = regions[-1]["offset"], regions[-1]["length"]
    return {"letters": data.translate(None, b"\0").decode("iso-8859-1"), "in_place": data[at : at + n] == bytes([96 + len(regions)]) * n}


def _sparse_rows(files: DataFrame) -> DataFrame:
    rows = ops.members(files, seen=("letters string, in_place boolean", _found))
    return rows.select(
        F.element_at(F.split("path", "-"), -2).cast("int").alias("form"), F.decode("name", "UTF-8").alias("name"), "size", "sparse",
        F.array_join(F.transform("sparse_map", lambda x: F.concat(x.offset, F.lit(":"), x.length)), ",").alias("regions"), "letters", "in_place",
    )


def _sparse_files(spark, sf_dir) -> DataFrame:
    rows = parts(spark, sf_dir).withColumn("form", F.explode(F.array(*map(F.lit, range(4)))))
    return written(many(rows.withColumn("path", F.concat("path", F.lit("-"), "form"))), _sparse)


@query(SPARSE_SQL)
def tar_sparse_scan(spark, sf_dir):
    """The old form with extension blocks, and the three of pax records."""
    return _sparse_rows(_sparse_files(spark, sf_dir))


@query(SPARSE_SQL)
def tar_sparse_copy(spark, sf_dir):
    """Copies stay sparse."""
    return _sparse_rows(ops.copy(_sparse_files(spark, sf_dir), "tar"))


def _damaged(rows):
    """A stored zip whose first member has a wrong byte."""
    data = bytearray(write_container("zip", ((r | {"type": "file"}, r["content"]) for r in rows), method="stored"))
    data[30 + len(rows[0]["name"])] ^= 0xFF
    return bytes(data)


@query("SELECT 'm' || p_partkey AS name, strlen(p_name) AS size, sha256(p_name) AS sha256 FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY 'm' || p_partkey) > 1")
def copy_skips_damage(spark, sf_dir):
    return shown(ops.members(ops.copy(written(parts(spark, sf_dir), _damaged), "cpio", on_error="skip")))


def _linked(rows):
    """z holds the data, names before it in the alphabet link to it."""
    first = [({"name": b"z", "type": "file"}, b"data")]
    return write_container("tar", iter(first + [({"name": r["name"], "type": "hardlink", "link_target": b"z"}, b"") for r in rows]))


@query(
    """
WITH m AS (SELECT p_brand AS path, 'm' || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY 'm' || p_partkey) AS idx FROM part)
SELECT path, idx, name, 'hardlink' AS type, 'z' AS link_target FROM m UNION ALL SELECT DISTINCT p_brand, 0, 'z', 'file', NULL FROM part
"""
)
def copy_keeps_order(spark, sf_dir):
    rows = ops.members(ops.copy(written(parts(spark, sf_dir), _linked), "tar"))
    return rows.select("path", "idx", F.decode("name", "UTF-8").alias("name"), "type", F.decode("link_target", "UTF-8").alias("link_target"))


for _codec in ("lz4", "brotli", "lzma"):

    def _wrapped(spark, sf_dir, codec=_codec):
        from .queries import documents

        files = ops.pack(documents(spark, sf_dir), "tar", codec).withColumn("path", F.concat("path", F.lit({"lz4": ".lz4", "brotli": ".tbr", "lzma": ".tlzma"}[codec])))
        return shown(ops.members(files, name_hint=True), F.col("mtime_seconds").alias("mtime"))

    query(DOCUMENTS_SQL, f"tar_{_codec}_scan")(_wrapped)


# zip ----------------------------------------------------------------------------------------------------------------


class Pipe:
    """A target that can't seek or tell: the zip module then writes descriptors."""

    def __init__(self):
        self.data = bytearray()

    def write(self, b):
        self.data += b
        return len(b)

    def flush(self):
        pass


def zip_of(methods, target=Pipe, prologue: bytes = b"", comment: bytes = b""):
    def write(rows):
        out = target()
        out.write(prologue)
        with zipfile.ZipFile(out, "w") as z:
            z.comment = comment
            for r in rows:
                info = zipfile.ZipInfo(r["name"].decode(), time.gmtime(1000000000 + 2 * r["id"])[:6])
                info.external_attr = (stat.S_IFREG | 0o600) << 16
                z.writestr(info, r["content"], methods[r["id"] % len(methods)])
        return bytes(out.data) if target is Pipe else out.getvalue()

    return write


_NAMED = "source || '/ü' || doc_id"
_ZIPPED = f"SELECT {_NAMED} AS name, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256, doc_id * 2 + 1000000000 AS mtime"


@query(_ZIPPED + ", ['stored', 'deflate', 'bzip2', 'lzma'][1 + doc_id % 4] AS method, 'utf-8' AS name_encoding, 788 AS version_made_by, 'none' AS encryption, 0 AS extra_length, true AS described, 33152 AS mode FROM documents")
def zip_stdlib_scan(spark, sf_dir):
    from ..functions.fields import method_text

    methods = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    rows = ops.members(written(texts(spark, sf_dir, _NAMED), zip_of(methods)))
    z = F.col("zip")
    # The zip module asks for version 20 with stored and deflated members and for later ones with others.
    made = z.version_made_by - z.version_made_by.bitwiseAND(F.lit(255)) + 20
    return shown(
        rows, F.col("mtime_seconds").alias("mtime"), method_text(z.method).alias("method"), "name_encoding", made.alias("version_made_by"), z.encryption.alias("encryption"), z.extra_length.alias("extra_length"),
        (z.flags.bitwiseAND(F.lit(8)) > 0).alias("described"), F.col("mode").cast("int").alias("mode"),
    )


@query(_ZIPPED + ", true AS size_unknown FROM documents")
def zip_stdlib_sequential_scan(spark, sf_dir):
    """From a pipe: stored members end where a descriptor fits them, others where their codec ends."""
    files = written(texts(spark, sf_dir, _NAMED), zip_of((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)))
    return shown(ops.members(files, access="sequential"), F.col("mtime_seconds").alias("mtime"), "size_unknown")


@query("SELECT lang, count(*)::BIGINT AS declared, 'said' AS comment, 1000 AS base_offset, 'zip' AS format, 'END' AS status, false AS zip64 FROM documents GROUP BY lang")
def zip_behind_a_program(spark, sf_dir):
    """A stub in front, a comment behind."""
    files = written(texts(spark, sf_dir, _NAMED), zip_of((zipfile.ZIP_DEFLATED,), io.BytesIO, comment=b"said")).select("path", F.concat(F.lit(b"MZ" + bytes(998)), "content").alias("content"))
    rows = ops.walks(files)
    return rows.groupBy(F.substring_index("path", "-", 1).alias("lang"), F.decode("zip_comment", "UTF-8").alias("comment"), F.col("base_offset").cast("int").alias("base_offset"), "format", "status", F.col("zip_has_zip64_end").alias("zip64")).agg(
        F.sum("zip_declared_members").alias("declared")
    )


def laid(rows, entry, end64: bool = False) -> bytes:
    """A zip by hand.  entry gives a row's facts: method, flags, coded, crc, size, and the extras of both headers."""
    out, central, n = b"", b"", len(rows)
    for r in rows:
        e = entry(r)
        big, name = e.get("big", False), r["name"]
        coded, size = e["coded"], e["size"]
        told = (0xFFFFFFFF, 0xFFFFFFFF) if big else (len(coded), size)
        shape = struct.pack("<HHHHI", e.get("flags", 0), e.get("method", 0), 0, 0x21, e["crc"]) + struct.pack("<II", *told)
        wide = struct.pack("<HHQQ", 1, 16, size, len(coded)) if big else b""
        far = struct.pack("<HHQQQ", 1, 24, size, len(coded), len(out)) if big else b""
        extra = e.get("extra", b"")
        at = 0xFFFFFFFF if big else len(out)
        central += b"PK\1\2" + struct.pack("<HH", 0x31E, 45 if big else 20) + shape + struct.pack("<HHHHHII", len(name), len(far + extra), 0, 0, 0, e.get("attributes", 0), at) + name + far + extra
        out += b"PK\3\4" + struct.pack("<H", 45 if big else 20) + shape + struct.pack("<HH", len(name), len(wide + extra)) + name + wide + extra + coded
    start = len(out)
    out += central
    if end64:
        out += b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), start) + b"PK\6\7" + struct.pack("<IQI", 0, start + len(central), 1)
        return out + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return out + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), start, 0)


def _plain(r, **more):
    return {"coded": r["content"], "crc": zlib.crc32(r["content"]), "size": len(r["content"])} | more


_PARTS = "SELECT 'm' || p_partkey AS name, strlen(p_name) AS size, sha256(p_name) AS sha256"


@query(_PARTS + ", true AS used_zip64, 28 AS extra_length FROM part")
def zip_sixty_four_scan(spark, sf_dir):
    """Sizes, offsets and the end record only in their 64-bit forms."""
    files = written(parts(spark, sf_dir), lambda rows: laid(rows, lambda r: _plain(r, big=True), True))
    return shown(ops.members(files), F.col("zip.used_zip64").alias("used_zip64"), F.col("zip.extra_length").alias("extra_length"))


@query("SELECT p_brand AS path, true AS zip64, count(*) AS declared, 'END' AS status FROM part GROUP BY p_brand")
def zip_sixty_four_end(spark, sf_dir):
    files = written(parts(spark, sf_dir), lambda rows: laid(rows, lambda r: _plain(r, big=True), True))
    return ops.walks(files).select("path", F.col("zip_has_zip64_end").alias("zip64"), F.col("zip_declared_members").alias("declared"), "status")


def _timed(r):
    s, i = 1000000001 + r["id"], r["id"]
    extra = (
        struct.pack("<HHBi", 0x5455, 5, 1, -i), struct.pack("<HHIHHQQQ", 0x0A, 32, 0, 1, 24, (s + 11644473600) * 10_000_000 + 7, 0, 0), struct.pack("<HHBBIBI", 0x7875, 11, 1, 4, i, 4, i + 1), b"",
    )[i % 4]
    return _plain(r, extra=extra)


@query(
    _PARTS + """, CASE p_partkey % 4 WHEN 0 THEN -p_partkey WHEN 1 THEN 1000000001 + p_partkey ELSE 315532800 END AS mtime, (CASE p_partkey % 4 WHEN 1 THEN 700 ELSE 0 END)::INTEGER AS mtime_ns,
  CASE p_partkey % 4 WHEN 0 THEN 'zip extended timestamp' WHEN 1 THEN 'zip NTFS timestamp' ELSE 'zip DOS date/time' END AS mtime_source,
  CASE WHEN p_partkey % 4 = 2 THEN p_partkey END AS uid, CASE WHEN p_partkey % 4 = 2 THEN p_partkey + 1 END AS gid FROM part"""
)
def zip_extra_fields(spark, sf_dir):
    files = written(parts(spark, sf_dir), lambda rows: laid(rows, _timed))
    return shown(ops.members(files), F.col("mtime_seconds").alias("mtime"), "mtime_ns", "mtime_source", "uid", "gid")


def _with_type(r):
    kind = (stat.S_IFREG, stat.S_IFDIR, stat.S_IFLNK, stat.S_IFIFO)[r["id"] % 4]
    return _plain(r, attributes=(kind | 0o750) << 16)


@query(
    """
SELECT 'm' || p_partkey AS name, ['file', 'directory', 'symlink', 'fifo'][1 + p_partkey % 4] AS type, CASE WHEN p_partkey % 4 = 2 THEN p_name END AS link_target,
  [33256, 16872, 41448, 4584][1 + p_partkey % 4] AS mode, [33256, 16872, 41448, 4584][1 + p_partkey % 4]::BIGINT * 65536 AS external_attributes FROM part
"""
)
def zip_types(spark, sf_dir):
    rows = ops.members(written(parts(spark, sf_dir), lambda rows: laid(rows, _with_type)))
    return rows.select(F.decode("name", "UTF-8").alias("name"), "type", F.decode("link_target", "UTF-8").alias("link_target"), F.col("mode").cast("int").alias("mode"), F.col("zip.external_attributes").alias("external_attributes"))


@query(DOCUMENTS_SQL.replace("doc_id * 2 + 1000000000 AS mtime", "'enhanced deflate (deflate64)' AS method"))
def zip_deflate64_scan(spark, sf_dir):
    """Streams without matches mean the same in deflate and deflate64."""
    from ..functions.fields import method_text

    def coded(r):
        c = zlib.compressobj(6, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
        return _plain(r, method=9, coded=c.compress(r["content"]) + c.flush())

    files = written(texts(spark, sf_dir, "source || '/' || doc_id || '.txt'"), lambda rows: laid(rows, coded))
    return shown(ops.members(files), method_text(F.col("zip.method")).alias("method"))


PASSWORD = "pä55"


def _locked(r):
    """ZipCrypto: a header of 12 bytes, the last of which is the CRC's highest."""
    k, crc, out = zips.crypto_keys(PASSWORD.encode()), zlib.crc32(r["content"]), bytearray()
    for b in random.Random(r["id"]).randbytes(11) + bytes([crc >> 24]) + r["content"]:
        t = (k[2] | 2) & 0xFFFF
        out.append(b ^ (t * (t ^ 1) >> 8 & 255))
        zips._advance(k, b)
    return _plain(r, flags=1, coded=bytes(out))


@query(_PARTS + ", 'ZipCrypto (broken)' AS encryption FROM part")
def zip_crypto_scan(spark, sf_dir):
    files = written(parts(spark, sf_dir), lambda rows: laid(rows, _locked))
    return shown(ops.members(files, password=PASSWORD), F.col("zip.encryption").alias("encryption"))


@query(_PARTS + ", 'WinZip AES' AS encryption, 99 AS method FROM part")
def zip_aes_scan(spark, sf_dir):
    files = ops.pack(parts(spark, sf_dir), "zip", password=PASSWORD)
    return shown(ops.members(files, password=PASSWORD), F.col("zip.encryption").alias("encryption"), F.col("zip.method").alias("method"))


@query("SELECT r AS n_regionkey, w.word, w.status FROM (SELECT DISTINCT n_regionkey AS r FROM nation), (VALUES ('none', 'PASSWORD_REQUIRED'), ('wrong', 'refused')) w(word, status)")
def zip_passwords(spark, sf_dir):
    """Without a password its want is told; a wrong one is refused by its check bytes, or by the sum behind the data."""
    rows = table(spark, sf_dir, "nation").selectExpr("CAST(n_regionkey AS STRING) AS path", "CAST(n_name AS BINARY) AS name", "CAST(n_name AS BINARY) AS content")
    files = ops.pack(rows, "zip", password=PASSWORD)
    none, wrong = (ops.members(files, password=p).select("path", F.lit(w).alias("word"), "data_status") for w, p in (("none", None), ("wrong", "no")))
    status = F.when(F.col("data_status").isin("PASSWORD_REJECTED", "CORRUPT", "PASSWORD_OR_CORRUPT"), "refused").otherwise(F.col("data_status"))
    return none.unionByName(wrong).select(F.col("path").cast("int").alias("n_regionkey"), "word", status.alias("status")).distinct()


# 7z -----------------------------------------------------------------------------------------------------------------

_FILTERS = sorted(sevenz.SevenZipWriter.FILTERS)
_FILTERED = "SELECT f.filter, 'm' || p_partkey AS name, strlen(p_name) + 4 AS size FROM part, (VALUES " + ", ".join(f"('{f}')" for f in _FILTERS) + ") f(filter)"


def filtered(method: str):
    """Members that hold a branch instruction of x86, behind each of the filters in turn, under a coded header."""

    def run(spark, sf_dir):
        rows = parts(spark, sf_dir).withColumn("path", F.explode(F.array(*map(F.lit, _FILTERS)))).withColumn("content", F.concat(F.lit(b"\xe8\x10\x00\x00"), "content"))
        files = written(many(rows), lambda rows: write_container("7z", ((r | {"type": "file"}, r["content"]) for r in rows), method=method, filter=rows[0]["path"].partition("-")[0], encode_header=True))
        return ops.members(files).where(F.substring("content", 1, 4) == F.lit(b"\xe8\x10\x00\x00")).select(F.substring_index("path", "-", 1).alias("filter"), F.decode("name", "UTF-8").alias("name"), "size")

    return run


query(_FILTERED, "sevenz_filters_scan")(filtered("lzma2"))
query(_FILTERED, "sevenz_filters_deflate_scan")(filtered("deflate"))


def one_folder(rows, coders: bytes, packed: list[bytes], sizes: list[int]) -> bytes:
    """A 7z of all rows in one folder, given its coders and their packed streams and sizes."""
    put, n, data = sevenz.put_number, len(rows), [r["content"] for r in rows]
    h = b"\x01\x04\x06\x00" + put(len(packed)) + b"\x09" + b"".join(put(len(p)) for p in packed) + b"\x00\x07\x0b\x01\x00" + coders + b"\x0c" + b"".join(map(put, sizes)) + b"\x00"
    h += b"\x08\x0d" + put(n) + b"\x09" + b"".join(put(len(d)) for d in data[:-1]) + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for d in data) + b"\x00\x00"
    shown_names = b"\0" + b"".join(r["name"].decode().encode("utf-16-le") + b"\0\0" for r in rows)
    h += b"\x05" + put(n) + b"\x11" + put(len(shown_names)) + shown_names + b"\x00\x00"
    body = b"".join(packed)
    tail = struct.pack("<QQI", len(body), len(h), zlib.crc32(h))
    return sevenz.MAGIC + b"\0\4" + struct.pack("<I", zlib.crc32(tail)) + tail + body + h


def _bcj2(rows):
    """Four streams; text has no branch, so that only the first holds something and nothing is asked of the range coder."""
    data = b"".join(r["content"] for r in rows)
    return one_folder(rows, b"\x01\x14" + sevenz.BCJ2 + b"\x04\x01" + b"\x00\x01\x02\x03", [data, b"", b"", bytes(5)], [len(data)])


def _aes_folder(rows):
    data = b"".join(r["content"] for r in rows)
    whole, iv, salt, power = data + bytes(-len(data) % 16), bytes(range(16)), b"salt" * 4, 6
    key = sevenz.aes_key(PASSWORD.encode("utf-16-le"), salt, power, sevenz.Limits(), {})
    keys, before, coded = aes.round_keys(key), iv, b""
    for at in range(0, len(whole), 16):
        before = aes.encrypt_block(bytes(a ^ b for a, b in zip(whole[at : at + 16], before)), keys)
        coded += before
    props = bytes([0xC0 | power, 0xFF]) + salt + iv
    return one_folder(rows, b"\x01" + sevenz.put_coder(sevenz.AES, props), [coded], [len(data)])


@query(_PARTS + " FROM part")
def sevenz_bcj2_scan(spark, sf_dir):
    return shown(ops.members(written(parts(spark, sf_dir), _bcj2)))


@query(_PARTS + ", true AS encrypted FROM part")
def sevenz_aes_scan(spark, sf_dir):
    return shown(ops.members(written(parts(spark, sf_dir), _aes_folder), password=PASSWORD), F.col("sevenz.encrypted").alias("encrypted"))


@query("SELECT p_brand AS path, '7z' AS format, 4098::BIGINT AS base_offset, count(*) AS members, 'END' AS status FROM part GROUP BY p_brand")
def sevenz_behind_a_program(spark, sf_dir):
    files = ops.pack(parts(spark, sf_dir), "7z").select("path", F.concat(F.lit(b"\x7fELF" + bytes(4094)), "content").alias("content"))
    return ops.walks(files).select("path", "format", "base_offset", F.col("member_count").alias("members"), "status")


# ar, cpio, identification --------------------------------------------------------------------------------------------


def _ar(rows):
    """Names in a table of the whole file, as GNU's ar keeps long ones; a symbol table in front."""
    listed, places = b"", []
    for r in rows:
        places.append(len(listed))
        listed += b"a-long-name-of-" + r["name"] + b"/\n"

    def member(name, data):
        return b"%-16s%-12d%-6d%-6d%-8o%-10d`\n" % (name, 7, 1, 2, 0o100600, len(data)) + data + b"\n" * (len(data) % 2)

    return b"!<arch>\n" + member(b"/", bytes(4)) + member(b"//", listed) + b"".join(member(b"/%d" % at, r["content"]) for at, r in zip(places, rows))


@query(_PARTS.replace("'m' ||", "'a-long-name-of-m' ||") + ", 384 AS mode, 1::BIGINT AS uid, 2::BIGINT AS gid, 7::BIGINT AS mtime FROM part")
def ar_name_table_scan(spark, sf_dir):
    return shown(ops.members(written(parts(spark, sf_dir), _ar)), F.col("mode").cast("int").alias("mode"), "uid", "gid", F.col("mtime_seconds").alias("mtime"))


def _cpio_crc(rows):
    """The variant with sums; the member of every tenth id has a wrong one."""
    out = b""
    for r in [*rows, {"name": b"TRAILER!!!", "content": b"", "id": 1}]:
        total = sum(r["content"]) + (r["id"] % 10 == 0)
        values = (1, 0o100644, 0, 0, 1, 9, len(r["content"]), 0, 0, 0, 0, len(r["name"]) + 1, total)
        head = b"070702" + b"".join(b"%08x" % v for v in values) + r["name"] + b"\0"
        out += head + bytes(-len(head) % 4) + r["content"] + bytes(-len(r["content"]) % 4)
    return out


@query("SELECT 'm' || p_partkey AS name, strlen(p_name) AS size, CASE WHEN p_partkey % 10 = 0 THEN 'CORRUPT' ELSE 'OK' END AS data_status, CASE WHEN p_partkey % 10 <> 0 THEN sha256(p_name) END AS sha256 FROM part")
def cpio_crc_scan(spark, sf_dir):
    return shown(ops.members(written(parts(spark, sf_dir), _cpio_crc)), "data_status")


def _legacy(method: int, coded: str, plain: bytes, flags: int = 0) -> bytes:
    return laid([{"name": b"f", "content": plain}], lambda r: _plain(r, method=method, coded=bytes.fromhex(coded), flags=flags))


#: Small containers: case, bytes, and what the walk says of them.
FIXED = (
    ("empty file", b"", "unknown", None, 0, "CORRUPT"),
    ("no format", b"nothing here" * 100, "unknown", None, 0, "FORMAT"),
    ("binary cpio", b"\xc7\x71" + bytes(600), "unknown", None, 0, "UNSUPPORTED"),
    ("swapped binary cpio", b"\x71\xc7" + bytes(600), "unknown", None, 0, "UNSUPPORTED"),
    ("tar of nothing", bytes(1024), "tar", None, 0, "END"),
    ("tar without an end", tarfile.TarInfo("a").tobuf(), "tar", None, 1, "CORRUPT"),
    ("zip of nothing", b"PK\5\6" + bytes(18), "zip", None, 0, "END"),
    ("zip without an end", b"PK\3\4" + bytes(60), "zip", None, 0, "CORRUPT"),
    ("ar of nothing", b"!<arch>\n", "ar", None, 0, "END"),
    ("ar cut in a header", b"!<arch>\nabc", "ar", None, 0, "CORRUPT"),
    ("7z of nothing", sevenz.MAGIC + b"\0\4" + struct.pack("<I", zlib.crc32(bytes(20))) + bytes(20), "7z", None, 0, "END"),
    ("7z of a wrong sum", sevenz.MAGIC + b"\0\4" + bytes(24), "7z", None, 0, "CORRUPT"),
    ("cpio cut in a header", b"070701" + b"0" * 50, "cpio", None, 0, "CORRUPT"),
    ("tar in gzip", gzip.compress(bytes(1024), mtime=0), "tar", "gzip", 0, "END"),
    ("xz cut", lzma.compress(bytes(1024))[:-9], "unknown", "xz", 0, "CORRUPT"),
)
#: A member in each of the methods of old: case, bytes, its text.
LEGACY = (
    ("shrunk", _legacy(1, "61c4041c2850cc9880070d225ca8b02041860923427ce8b0a1448b0c294ec4c85123c78b173d82dc985024c98d263fa2ac78f223", b"abababababcabcabcabcabcabc" * 9), "abababababcabcabcabcabcabc" * 9),
    ("reduced, factor 1", _legacy(2, "00" * 192 + "68656c6c6f20900205900021", b"hello hello\x90!"), "hello hello\x90!"),
    ("imploded", _legacy(6, "03f5f5f5f503f5f5f5f5c38a1d23fc07", b"abcabcabcabc"), "abcabcabcabc"),
    ("ppmd", _legacy(98, "00", b"x"), None),
)


def _values(rows) -> str:
    def said(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


@query("SELECT * FROM (VALUES " + _values([(c, *rest) for c, _, *rest in FIXED]) + ") v(path, format, codec, members, status)")
def identification(spark, sf_dir):
    files = spark.createDataFrame([(c, bytearray(b)) for c, b, *_ in FIXED], "path string, content binary")
    return ops.walks(files).select("path", "format", "codec", F.col("member_count").cast("int").alias("members"), "status")


# Names --------------------------------------------------------------------------------------------------------------

#: Bytes behind a name and the finding's bit that they are for.
NOT_TEXT = ((b"\x00", 64), (b"\xff", 16384), (b"\xc0\xaf", 16384), (b"\xed\xa0\x80", 16384), (b"\xf4\x90\x80\x80", 16384), (b"\xe2\x82", 16384), (b"\xe2\x82\xac", 0), (b"\x00\xff", 16448))


@query("SELECT p_partkey AS id, form, mask, CASE WHEN mask & 64 > 0 THEN 1 ELSE 0 END + CASE WHEN mask & 16384 > 0 THEN 1 ELSE 0 END AS found, mask <> 0 AS refused FROM part, (VALUES " + _values([(i, m) for i, (_, m) in enumerate(NOT_TEXT)]) + ") v(form, mask)")
def name_check_bytes(spark, sf_dir):
    """NUL and what isn't UTF-8: stray, overlong, surrogate, too high and cut sequences."""
    tails = F.posexplode(F.array(*(F.lit(b) for b, _ in NOT_TEXT))).alias("form", "tail")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("m"), "p_partkey").cast("binary").alias("n"), tails)
    marked = rows.select("id", "form", names.name_mask(F.concat("n", "tail")).alias("mask"))
    return marked.select("id", "form", "mask", F.size(names.findings(F.col("mask"))).alias("found"), names.refused(F.col("mask")).alias("refused"))


# Ranges and order ---------------------------------------------------------------------------------------------------


@query(
    """
WITH p AS (SELECT o_custkey AS set, o_orderkey AS part_no, strlen(o_comment_) AS length, coalesce(sum(strlen(o_comment_)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT *, o_orderpriority || o_orderstatus AS o_comment_ FROM orders)),
m AS (SELECT o_custkey AS set, o_orderkey AS idx, (o_orderkey * 7) % 60 AS first, 1 + o_orderkey % 20 AS n FROM orders)
SELECT m.set, m.idx, p.part_no FROM m JOIN p ON m.set = p.set AND m.first < p.b + p.length AND p.b < m.first + m.n
"""
)
def member_parts(spark, sf_dir):
    """The parts of a split container that a member's bytes lie in."""
    orders = table(spark, sf_dir, "orders")
    volumes = ops.volume_offsets(orders.selectExpr("o_custkey AS set", "o_orderkey AS part_no", "CAST(length(o_orderpriority || o_orderstatus) AS BIGINT) AS length"))
    ranges = orders.selectExpr("o_custkey AS set", "o_orderkey AS idx", "(o_orderkey * 7) % 60 AS first", "1 + o_orderkey % 20 AS length")
    return ops.touched_parts(ranges, volumes, 16).select("set", "idx", "part_no")


@query(
    """
SELECT m.user_id AS path, m.event_id AS idx, g.event_id AS since FROM (SELECT * FROM events WHERE event_type <> 'view') m
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') g ON m.user_id = g.user_id AND m.event_id > g.event_id
"""
)
def globals_in_force(spark, sf_dir):
    """The latest global record in front of each member, by order in its container."""
    events = table(spark, sf_dir, "events").selectExpr("user_id AS path", "event_id AS idx", "event_type")
    return ops.in_force(events.where("event_type <> 'view'").select("path", "idx"), events.where("event_type = 'view'").selectExpr("path", "idx", "idx AS since"), "since")


@query("SELECT * FROM (VALUES " + _values([(c, "OK" if t is not None else "UNSUPPORTED", c, t) for c, _, t in LEGACY]) + ") v(path, data_status, method, text)")
def zip_old_methods(spark, sf_dir):
    from ..functions.fields import method_text

    files = spark.createDataFrame([(c, bytearray(b)) for c, b, _ in LEGACY], "path string, content binary")
    return ops.members(files).select("path", "data_status", method_text(F.col("zip.method")).alias("method"), F.decode("content", "ISO-8859-1").alias("text"))


@query(
    """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'data descriptor' WHEN 2 THEN 'local header' ELSE 'unknown' END AS sizes FROM part
"""
)
def zip_sizes_texts(spark, sf_dir):
    from ..functions.fields import zip_sizes_text

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), zip_sizes_text(F.col("p_partkey") % 4).alias("sizes"))


@query("SELECT p_brand AS path, 'zip: ' || count(*) || ' members, ' || sum(strlen(p_name)) || ' bytes, END # said' AS line FROM part GROUP BY p_brand")
def container_dump(spark, sf_dir):
    files = ops.pack(parts(spark, sf_dir), "zip", comment=b"said")
    return ops.dump_walks(ops.walks(files)).select("path", "line")


@query(DOCUMENTS_SQL)
def zip_disks_scan(spark, sf_dir):
    """Zips over several disks, put together by their names and read by disk and offset."""
    from .queries import documents

    volumes = ops.zip_volumes(documents(spark, sf_dir), 50_000)
    return shown(ops.members(ops.joined_volumes(volumes)), F.col("mtime_seconds").alias("mtime"))


def _cut_members(rows):
    """Two volumes: a member begins in the first and goes on behind a header of its own in the second."""
    whole = b"".join(r["content"] for r in rows) + b"." * 2000
    head = _header("joined", len(whole), form=tarfile.GNU_FORMAT)
    rest = whole[1024:]
    again = bytearray(_header("joined", len(rest), b"M", tarfile.GNU_FORMAT))
    again[369:381], again[148:156] = b"%011o\0" % 1024, b" " * 8
    again[148:156] = b"%06o\0 " % sum(again)
    return [head + whole[:1024], bytes(again) + padded(rest) + bytes(1024)]


@query("SELECT p_brand AS path, 'joined' AS name, sum(strlen(p_name))::BIGINT + 2000 AS size, sha256(string_agg(p_name, '' ORDER BY 'm' || p_partkey) || repeat('.', 2000)) AS sha256 FROM part GROUP BY p_brand")
def tar_volumes_scan(spark, sf_dir):
    rows = parts(spark, sf_dir)
    volumes = [written(rows, lambda members, k=k: _cut_members(members)[k]).withColumn("part", F.lit(k)) for k in (0, 1)]
    joined = ops.joined_tar_volumes(volumes[0].unionByName(volumes[1]))
    return shown(ops.members(joined), "path")
