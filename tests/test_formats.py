"""Round trips, independent readers, damage and caps, without Spark."""

import io
import subprocess
import shutil
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.sources.containers import read_container, write_container
from holdfast.sources.member import Limits
from holdfast.sources.streams import compress, decompress
from holdfast.functions.status import ContainerError
from holdfast.sources import aes, tar

MEMBERS = [
    ({"name": b"a/b.txt", "mtime_seconds": 1000000000, "mode": 0o644}, b"hello\n" * 100),
    ({"name": b"d/", "type": "directory"}, b""),
    ({"name": ("x/" * 90 + "é.txt").encode(), "mtime_seconds": 1000000001}, b"data"),
    ({"name": b"empty"}, b""),
]
KINDS = [
    ("tar", {}), *(("zip", {"method": m}) for m in ("stored", "deflate", "bzip2", "lzma", "zstd", "xz")), ("zip", {"descriptors": True}),
    *(("7z", {"method": m, "solid": s}) for m in ("copy", "lzma", "lzma2", "bzip2", "deflate") for s in (True, False)), ("ar", {}), ("cpio", {}), ("cpio", {"variant": "odc"}),
]


def read(data, **o):
    container = {}
    return list(read_container("p", data, container, **o)), container


@pytest.mark.parametrize("kind,options", KINDS)
@pytest.mark.parametrize("access", ["random", "sequential"])
def test_round_trip(kind, options, access):
    want = [x for x in MEMBERS if kind != "ar" or x[0].get("type") != "directory"]
    rows, container = read(write_container(kind, iter(want), **options), access=access)
    if kind == "7z" and access == "sequential":
        assert container["status"] == "NOT_SEEKABLE" and not rows
        return
    assert container["status"] == "END" and container["member_count"] == len(want)
    assert [(r["name"].rstrip(b"/"), r["content"] or b"") for r in rows] == [(m["name"].rstrip(b"/"), d) for m, d in want]
    assert rows[0]["mtime_seconds"] == 1000000000


@pytest.mark.parametrize("codec", ["gzip", "bzip2", "xz", "zstd"])
def test_codec_wrapping(codec):
    rows, container = read(write_container("tar", iter(MEMBERS), codec))
    assert (container["codec"], container["status"], len(rows)) == (codec, "END", 4)


def test_python_reads_ours_and_we_read_python():
    ours = write_container("tar", iter(MEMBERS))
    with tarfile.open(fileobj=io.BytesIO(ours)) as t:
        assert [x.name for x in t] == [m["name"].decode().rstrip("/") for m, _ in MEMBERS]
    assert zipfile.ZipFile(io.BytesIO(write_container("zip", iter(MEMBERS)))).testzip() is None
    for form, variant in ((tarfile.USTAR_FORMAT, "ustar"), (tarfile.GNU_FORMAT, "gnu"), (tarfile.PAX_FORMAT, "pax")):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=form) as t:
            info = tarfile.TarInfo("n" * (90 if variant == "ustar" else 180))
            info.size, info.mtime = 3, 7
            t.addfile(info, io.BytesIO(b"abc"))
        rows, _ = read(out.getvalue())
        assert rows[0]["tar"]["variant"] == variant and rows[0]["content"] == b"abc" and rows[0]["mtime_seconds"] == 7


@pytest.mark.skipif(not shutil.which("bsdtar"), reason="bsdtar is an optional reader")
@pytest.mark.parametrize("kind,options", [x for x in KINDS if x[0] != "ar"])
def test_bsdtar_reads_ours(kind, options, tmp_path):
    (tmp_path / "x").write_bytes(write_container(kind, iter(MEMBERS), **options))
    got = subprocess.run(["bsdtar", "-xOf", str(tmp_path / "x"), "a/b.txt"], capture_output=True)
    if got.returncode and b"support" in got.stderr:
        pytest.skip("a codec that this bsdtar lacks")
    assert got.stdout == MEMBERS[0][1]


def test_damage_keeps_the_rows_before_it():
    data = bytearray(write_container("tar", iter(MEMBERS)))
    at = len(data) - 1024 - 512  # the last member's header
    data[at + 150] ^= 1
    rows, container = read(bytes(data))
    assert container["status"] == "CORRUPT" and len(rows) == 3
    z = bytearray(write_container("zip", iter(MEMBERS), method="stored"))
    z[40] ^= 0xFF
    rows, container = read(bytes(z))
    assert container["status"] == "END" and [r["data_status"] for r in rows] == ["CORRUPT", "OK", "OK", "OK"]


def test_identification():
    assert read(b"")[1]["status"] == "CORRUPT"
    assert read(b"nothing here" * 100)[1]["status"] == "FORMAT"
    assert read(b"\xc7\x71" + bytes(600))[1]["status"] == "UNSUPPORTED"
    stub = b"MZ" + bytes(1000) + write_container("zip", iter(MEMBERS))
    rows, container = read(stub)
    assert container["base_offset"] == 1002 and len(rows) == 4


@pytest.mark.parametrize("cap,status,kept", [("max_members", "LIMIT_MEMBERS", 2), ("max_member_bytes", "LIMIT_MEMBER_BYTES", 0), ("max_total_bytes", "LIMIT_TOTAL_BYTES", 0), ("max_name_bytes", "LIMIT_NAME_BYTES", 2)])
def test_caps(cap, status, kept):
    limit = {"max_members": 2, "max_member_bytes": 100, "max_total_bytes": 100, "max_name_bytes": 20}[cap]
    for kind in ("tar", "zip", "cpio", "7z"):
        rows, container = read(write_container(kind, iter(MEMBERS)), limits=Limits(**{cap: limit}))
        assert container["status"] == status and (len(rows) == kept or kind == "7z")


def test_codecs_refuse_what_follows():
    for codec in ("gzip", "zlib"):
        with pytest.raises(ContainerError):
            decompress(codec, compress(codec, b"a") + compress(codec, b"b"))
    for codec in ("bzip2", "xz", "zstd"):
        assert decompress(codec, compress(codec, b"a") + compress(codec, b"b")) == b"ab"
    with pytest.raises(ContainerError) as e:
        decompress("bzip2", compress("bzip2", bytes(5000)), cap=1000)
    assert e.value.status == "LIMIT_CODEC_BYTES"


def test_zstd_stops_at_the_cap():
    bomb = compress("zstd", bytes(200 << 20))
    with pytest.raises(ContainerError) as e:
        decompress("zstd", bomb + bomb, cap=1 << 20)
    assert e.value.status == "LIMIT_CODEC_BYTES"


@pytest.mark.parametrize("codec", ["lz4", "brotli"])
def test_codecs_of_arrow(codec):
    data = b"".join(b"%d hello %d\n" % (i % 17, i) for i in range(20000)) + bytes(100000)
    assert decompress(codec, compress(codec, data)) == data
    for damaged in (compress(codec, data)[:-9], b"\xff" * 50):
        with pytest.raises(ContainerError):
            decompress(codec, damaged)


def test_sparse_members_and_names_that_are_not_text():
    regions = [{"offset": 5, "length": 3}, {"offset": 5000, "length": 4}]
    data = b"\0" * 5 + b"abc" + bytes(4992) + b"defg" + bytes(100)
    name = b"\xff" * 120
    rows, container = read(write_container("tar", iter([({"name": b"dir/holes", "sparse_map": regions}, data), ({"name": name}, b"x")])))
    assert container["status"] == "END" and rows[0]["name"] == b"dir/holes" and rows[0]["content"] == data and rows[0]["sparse_map"] == regions
    assert rows[1]["name"] == name and rows[1]["name_encoding"] == "undeclared"
    with pytest.raises(ContainerError):
        write_container("tar", iter([({"name": b"n", "sparse_map": [{"offset": 90, "length": 20}]}, bytes(100))]))


@pytest.mark.parametrize("method", ["stored", "deflate", "bzip2", "xz"])
def test_descriptors_from_a_pipe(method):
    members = [({"name": b"a"}, b"PK\x07\x08" * 30), ({"name": b"e"}, b""), ({"name": b"b"}, bytes(range(256)) * 9)]
    rows, container = read(write_container("zip", iter(members), method=method, descriptors=True), access="sequential")
    assert container["status"] == "END" and [(r["name"], r["content"] or b"") for r in rows] == [(m["name"], d) for m, d in members]


@pytest.mark.parametrize("volume", [1024, 1500, 5000, 1 << 20])
def test_zip_volumes_cut_no_record(volume):
    import struct

    from holdfast.sources.zips import ZipWriter

    members = [({"name": b"n%d" % i * 9, "mtime_seconds": 1000000001 + i}, bytes(range(256)) * (i % 7)) for i in range(40)]
    out = io.BytesIO()
    w = ZipWriter(out, "stored", volume=volume)
    for m, d in members:
        w.add(m, d)
    w.finish()
    data, cuts = out.getvalue(), [*w.disks, out.tell()]
    assert all(0 < b - a <= volume for a, b in zip(cuts, cuts[1:])) and (len(w.disks) > 1) == (volume < len(data))
    rows, container = read(data, disks=[b - a for a, b in zip(cuts, cuts[1:])])
    assert container["status"] == "END" and [(r["name"], r["content"] or b"") for r in rows] == [(m["name"], d) for m, d in members]
    if len(w.disks) > 1:
        assert struct.unpack_from("<H", data, len(data) - 18)[0] == len(w.disks) - 1
        assert read(data, disks=[len(data) - 1, 1])[1]["status"] == "CORRUPT"


def test_aes_known_answer():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    keys = aes.round_keys(key)
    assert aes.encrypt_block(plain, keys).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes.decrypt_block(aes.encrypt_block(plain, keys), keys) == plain


@given(st.integers(-(1 << 62), (1 << 62) - 1))
def test_base_256(value):
    assert tar.number(tar._base256(value, 12), True) == value


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=300).filter(lambda n: b"\0" not in n and not n.endswith(b"/")), st.binary(max_size=2000)), max_size=5))
def test_any_member_round_trips(members):
    for kind in ("tar", "zip"):
        data = write_container(kind, iter([({"name": n}, d) for n, d in members]))
        rows, container = read(data)
        assert container["status"] == "END" and [(r["name"], r["content"]) for r in rows] == members
        assert data == write_container(kind, iter([({"name": n}, d) for n, d in members]))
        assert kind != "tar" or len(data) % 512 == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(KINDS), st.integers(0, 5000), st.integers(0, 255))
def test_damaged_bytes_never_crash(noise, kind, at, value):
    data = bytearray(write_container(kind[0], iter(x for x in MEMBERS if kind[0] != "ar" or x[0].get("type") != "directory"), **kind[1]))
    data[at % len(data)] = value
    for x in (bytes(data), bytes(data[: at % len(data)]), noise):
        for access in ("random", "sequential"):
            rows, container = read(x, access=access)
            assert container["status"] in ("END", "CORRUPT", "UNSUPPORTED", "FORMAT", "NOT_SEEKABLE") or container["status"].startswith("LIMIT")
            assert all(r["content"] is None or len(r["content"]) <= r["size"] for r in rows)


def test_deflate64_agrees_with_deflate_where_they_are_alike():
    import random
    import zlib

    from holdfast.sources.decoders import deflate64

    r = random.Random(1)
    for level in (0, 1, 6, 9):
        data = b"".join(bytes(r.choices(b"abcdef", k=r.randint(1, 9))) for _ in range(3000))  # no match of 258 bytes
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        assert deflate64(c.compress(data) + c.flush(), len(data)) == data
    for strategy in (zlib.Z_FIXED, zlib.Z_HUFFMAN_ONLY):
        c = zlib.compressobj(6, zlib.DEFLATED, -15, 8, strategy)
        assert deflate64(c.compress(data) + c.flush(), len(data)) == data
    with pytest.raises(ContainerError):
        deflate64(b"\xff\xff", 10)


@pytest.mark.skipif(not shutil.which("lz4"), reason="lz4 is an optional writer")
def test_lz4(tmp_path):
    data = b"".join(b"%d hello %d\n" % (i % 17, i) for i in range(20000)) + bytes(100000)
    coded = subprocess.run(["lz4", "-c"], input=data, capture_output=True).stdout
    assert decompress("lz4", coded) == data
    for damaged in (coded[:-9], coded + b"x"):
        with pytest.raises(ContainerError):
            decompress("lz4", damaged)
    rows, container = read(subprocess.run(["lz4", "-c"], input=write_container("tar", iter(MEMBERS)), capture_output=True).stdout)
    assert container["codec"] == "lz4" and len(rows) == 4


def test_branch_filters():
    import lzma
    import struct

    from holdfast.sources.decoders import arm64, branch

    code = bytes([0xE8, 1, 2, 0, 0, 0x90] * 500)
    plain = [{"id": lzma.FILTER_LZMA2, "preset": 0}]
    moved = lzma.decompress(lzma.compress(code, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, *plain]), lzma.FORMAT_RAW, filters=plain)
    assert moved != code and branch(moved, lzma.FILTER_X86) == code
    words = struct.pack("<4I", 0x94000010, 0xD503201F, 0x94000011, 0x14000001)
    assert struct.unpack("<4I", arm64(words)) == (0x94000010, 0xD503201F, 0x9400000F, 0x14000001)


def test_bcj2_of_its_parts():
    from holdfast.sources.decoders import bcj2

    # No branch opcode: nothing is asked of the range coder.
    assert bcj2(b"plain text", b"", b"", bytes(5), 10) == b"plain text"
    for bad in ((b"\xe8", b"\0\0\0\0", b"", b"\0\x80\0\0\0", 3), (b"plain", b"x", b"", bytes(5), 5), (b"plain", b"", b"", b"\0\xff\xff\xff\xff", 5), (b"plai", b"", b"", bytes(5), 5)):
        with pytest.raises(ContainerError):
            bcj2(*bad)
    # An E8 whose bit is zero stays in the main stream.
    assert bcj2(b"\xe8abcd", b"", b"", bytes(5), 5) == b"\xe8abcd"


@pytest.mark.parametrize("method", ["stored", "deflate", "zstd"])
def test_aes_members(method, tmp_path):
    data = write_container("zip", iter(MEMBERS), method=method, password="pä55")
    rows, container = read(data, password="pä55")
    assert [r["content"] or b"" for r in rows] == [d for _, d in MEMBERS] and rows[0]["zip"]["method"] == 99
    assert read(data)[0][0]["data_status"] == "PASSWORD_REQUIRED"
    assert read(data, password="no")[0][0]["data_status"] in ("PASSWORD_REJECTED", "CORRUPT")
    cut = bytearray(data)
    cut[70] ^= 1
    assert read(bytes(cut), password="pä55")[0][0]["data_status"] == "CORRUPT"
    if shutil.which("bsdtar") and method == "deflate":
        (tmp_path / "x.zip").write_bytes(data)
        assert subprocess.run(["bsdtar", "--passphrase", "pä55", "-xOf", str(tmp_path / "x.zip"), "a/b.txt"], capture_output=True).stdout == MEMBERS[0][1]


def zip_of(method, coded, plain, flags=0):
    """A zip of one member in a method that no writer here has."""
    import struct
    import zlib

    facts = struct.pack("<HHHHIII", flags, method, 0, 0x21, zlib.crc32(plain), len(coded), len(plain))
    local = b"PK\3\4" + struct.pack("<H", 20) + facts + struct.pack("<HH", 1, 0) + b"f" + coded
    central = b"PK\1\2" + struct.pack("<HH", 20, 20) + facts + struct.pack("<HHHHHII", 1, 0, 0, 0, 0, 0, 0) + b"f"
    return local + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


class Put:
    def __init__(self):
        self.value = self.n = 0

    def bits(self, value, n):
        self.value |= value << self.n
        self.n += n

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def check_legacy(method, coded, plain, tmp_path, flags=0):
    data = zip_of(method, coded, plain, flags)
    rows, container = read(data)
    assert (container["status"], rows[0]["data_status"], rows[0]["content"]) == ("END", "OK", plain)
    if shutil.which("unzip"):
        (tmp_path / "x.zip").write_bytes(data)
        got = subprocess.run(["unzip", "-p", str(tmp_path / "x.zip")], capture_output=True)
        assert got.returncode == 81 or got.stdout == plain  # 81: a method that this unzip lacks


def test_shrink(tmp_path):
    p, table, free, word, text, width = Put(), {bytes([i]): i for i in range(256)}, iter(range(257, 8192)), b"", b"abababababcabcabcabcabcabc" * 9, 9
    for b in text:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        p.bits(table[word], width)
        table[word + bytes([b])] = next(free)
        word = bytes([b])
    p.bits(table[word], width)
    assert max(table.values()) < 512
    check_legacy(1, p.bytes(), text, tmp_path)


def test_reduce(tmp_path):
    p, text = Put(), b"hello hello\x90!"
    for _ in range(256):
        p.bits(0, 6)
    for b in (*b"hello ", 144, 2 | 0 << 7, 5, *b"\x90\x00!"):  # a copy of 5 from 6 back; a literal 144
        p.bits(b, 8)
    check_legacy(2, p.bytes(), text, tmp_path)


def test_implode(tmp_path):
    p, text = Put(), b"abcabcabcabc"
    for _ in range(2):  # 64 codes of six bits
        p.bits(3, 8)
        for _ in range(4):
            p.bits(5 | 15 << 4, 8)
    for b in b"abc":
        p.bits(1, 1)
        p.bits(b, 8)
    p.bits(0, 1)
    p.bits(2, 6)  # low distance bits: three back

    def code(symbol):
        # Longest first from zero and higher symbols first: symbol s has the code 63 - s.
        p.bits(int(f"{63 - symbol:06b}"[::-1], 2), 6)

    code(0)
    code(7)  # nine bytes
    check_legacy(6, p.bytes(), text, tmp_path)


def test_raw_copies_decode_nothing():
    from holdfast.sources.zips import copy_raw

    data = write_container("zip", iter(MEMBERS), method="zstd", password="secret")
    copied = copy_raw(data, lambda n: b"in/" + n, lambda m: m["name"] != b"empty")
    rows, container = read(copied, password="secret")
    assert container["status"] == "END" and [(r["name"], r["content"]) for r in rows if r["type"] == "file"] == [(b"in/" + m["name"], d) for m, d in MEMBERS if d]
    mixed = copy_raw(write_container("zip", iter(MEMBERS), descriptors=True))
    assert zipfile.ZipFile(io.BytesIO(mixed)).testzip() is None and [r["content"] or b"" for r in read(mixed)[0]] == [d for _, d in MEMBERS]


@pytest.mark.skipif(not shutil.which("tar"), reason="tar is an optional writer")
def test_volumes_of_a_tar(tmp_path):
    from holdfast.sources.tar import join_volumes

    (tmp_path / "a").write_bytes(bytes(range(256)) * 100)
    (tmp_path / "b").write_bytes(b"small")
    done = subprocess.run(["tar", "-c", "-M", "-L", "11", *(x for i in range(6) for x in ("-f", f"v{i}")), "a", "b"], cwd=tmp_path, capture_output=True)
    if done.returncode:
        pytest.skip("another tar")
    parts = [(tmp_path / f"v{i}").read_bytes() for i in range(6) if (tmp_path / f"v{i}").exists()]
    assert len(parts) > 1
    rows, container = read(join_volumes(parts))
    assert container["status"] == "END" and [r["content"] for r in rows] == [bytes(range(256)) * 100, b"small"]
    with pytest.raises(ContainerError):
        join_volumes(parts[:1])
    with pytest.raises(ContainerError):
        join_volumes([parts[0], parts[0]])


def test_members_of_a_solid_7z_are_placed_in_one_pass():
    """60,000 members: by sums over all members before each, this took minutes."""
    import time

    began = time.process_time()
    rows, container = read(write_container("7z", (({"name": b"m%d" % i}, b"%d" % i) for i in range(60_000)), method="deflate", filter="delta", encode_header=True))
    assert container["status"] == "END" and [r["content"] for r in rows] == [b"%d" % i for i in range(60_000)]
    assert time.process_time() - began < 20


def test_names_of_a_7z_end_between_units():
    names = ["a", "Ā", "aĀ", "ĀĀ", "Āa" * 30, "\U0001f600"]  # a zero byte on either side of a unit
    rows, _ = read(write_container("7z", (({"name": n.encode()}, b"x") for n in names), method="copy"))
    assert [r["name"].decode() for r in rows] == names


def test_hand_made_tars_grow_with_their_members():
    """By adding to bytes, 16,000 members took 10 seconds and more."""
    import time

    from holdfast.plans import foreign

    began = time.process_time()
    rows = [{"name": b"m%d" % i, "content": b"abc", "n": 1, "form": i % 4} for i in range(16_000)]
    assert len(read(foreign._v7(rows))[0]) == len(read(foreign._sparse(rows))[0]) == 16_000
    assert time.process_time() - began < 12


def test_sparse_members_are_copied_without_their_holes():
    regions, data = [{"offset": 4096, "length": 3}, {"offset": 1 << 20, "length": 0}], bytes(4096) + b"abc" + bytes((1 << 20) - 4099)
    whole = write_container("tar", iter([({"name": b"holes", "sparse_map": regions}, data)]))
    rows, _ = read(whole, holes=False)
    assert rows[0]["content"] == b"abc" and rows[0]["size"] == 1 << 20
    assert write_container("tar", iter([({"name": b"holes", "sparse_map": regions, "real_size": 1 << 20}, b"abc")])) == whole
    with pytest.raises(ContainerError):
        write_container("tar", iter([({"name": b"holes", "sparse_map": regions, "real_size": 1 << 20}, b"ab")]))
