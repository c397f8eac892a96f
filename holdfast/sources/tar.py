"""tar: v7, ustar, GNU long names, pax records, base-256 numbers and the sparse forms."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions.status import ContainerError
from .member import Limits
from .streams import Source

BLOCK = 512
ZERO = bytes(BLOCK)
LOW = bytes(range(128))
#: Type flags and the header's fields (offset, length).
TYPES = {0: "file", 48: "file", 55: "file", 49: "hardlink", 50: "symlink", 51: "character device", 52: "block device", 53: "directory", 54: "fifo"}
FLAGS = {"file": b"0", "hardlink": b"1", "symlink": b"2", "character device": b"3", "block device": b"4", "directory": b"5", "fifo": b"6"}
FIELDS = {
    "name": (0, 100), "mode": (100, 8), "uid": (108, 8), "gid": (116, 8), "size": (124, 12), "mtime": (136, 12), "chksum": (148, 8), "linkname": (157, 100), "uname": (265, 32),
    "gname": (297, 32), "major": (329, 8), "minor": (337, 8), "prefix": (345, 155),
}
SPARSE_SIZE, SPARSE_MORE, SPARSE_FIRST = (483, 12), 482, 386


def field(block: bytes, name: str) -> bytes:
    at, n = FIELDS[name]
    return block[at : at + n]


def text(block: bytes, name: str) -> bytes:
    return field(block, name).split(b"\0", 1)[0]


def number(raw: bytes, signed: bool = False) -> int:
    """Octal, or base-256 if the first bit is set (two's complement)."""
    if raw[0] & 0x80:
        value = int.from_bytes(raw, "big") & ((1 << (8 * len(raw) - 1)) - 1)
        if value >> (8 * len(raw) - 2):
            value -= 1 << (8 * len(raw) - 1)
        if not -(1 << 63) <= value < 1 << 63 or (value < 0 and not signed):
            raise ContainerError("CORRUPT", "number out of range")
        return value
    digits = raw.strip(b" \0")
    head = raw.lstrip(b" \0")
    stop = next((i for i, b in enumerate(head) if not 48 <= b <= 55), len(head))
    if head[stop:].strip(b" \0") or digits != head[:stop]:
        raise ContainerError("CORRUPT", "not an octal number")
    return int(digits, 8) if digits else 0


def checksums(block: bytes) -> tuple[int, int]:
    """Unsigned and signed sums, the field itself as spaces."""
    rest = block[:148] + b" " * 8 + block[156:]
    plain = sum(rest)
    return plain, plain - 256 * len(rest.translate(None, LOW))


def identify(block: bytes) -> bool:
    if len(block) < BLOCK:
        return False
    if block == ZERO:
        return True
    try:
        return number(block[148:156], True) in checksums(block)
    except ContainerError:
        return False


def pax_records(data: bytes) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    while data:
        head, space, _ = data.partition(b" ")
        if not space or not head.isdigit() or len(head) > 10:
            raise ContainerError("CORRUPT", "pax length")
        n = int(head)
        record = data[len(head) + 1 : n]
        if n > len(data) or n <= len(head) + 1 or not record.endswith(b"\n") or b"=" not in record:
            raise ContainerError("CORRUPT", "pax record")
        key, _, value = record[:-1].partition(b"=")
        name = key.decode("utf-8", "replace")
        if name in ("GNU.sparse.offset", "GNU.sparse.numbytes"):  # the oldest sparse form repeats its keys
            out.setdefault("GNU.sparse.pairs", b"")
            out["GNU.sparse.pairs"] += value + b","
        else:
            out[name] = value
        data = data[n:]
    return out


def decimal(value: bytes, low: int = 0) -> int:
    try:
        got = int(value)
    except ValueError:
        raise ContainerError("CORRUPT", "pax number") from None
    if not low <= got < 1 << 63 or not value.lstrip(b"-").isdigit():
        raise ContainerError("CORRUPT", "pax number")
    return got


def pax_time(value: bytes) -> tuple[int, int]:
    sign, rest = (-1, value[1:]) if value.startswith(b"-") else (1, value)
    whole, _, part = rest.partition(b".")
    if not whole.isdigit() or (part and not part.isdigit()):
        raise ContainerError("CORRUPT", "pax time")
    seconds, ns = int(whole), int(part[:9].ljust(9, b"0") or 0)
    if sign < 0:
        seconds, ns = (-seconds - 1, 1_000_000_000 - ns) if ns else (-seconds, 0)
    if not -(1 << 63) <= seconds < 1 << 63:
        raise ContainerError("CORRUPT", "pax time")
    return seconds, ns


class TarWalk:
    def __init__(self, source: Source, limits: Limits, holes: bool = True):
        """holes: sparse members' data is read with its holes as zeros, else the regions' data end to end."""
        self.s, self.limits, self.left, self.globals, self.holes = source, limits, 0, {}, holes

    def _payload(self, size: int, cap: int, status: str) -> bytes:
        if cap and size > cap:
            raise ContainerError(status)
        data = self.s.exact(size)
        self.s.skip(-size % BLOCK)
        return data

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        long_name = long_link = None
        local: dict[str, bytes] | None = None
        carrier = None
        zeros = 0
        while True:
            at = self.s.at
            block = self.s.read(BLOCK)
            if not block and zeros:
                return
            if len(block) < BLOCK:
                raise ContainerError("CORRUPT", "no end marker")
            if block == ZERO:
                if local is not None or long_name is not None or long_link is not None:
                    raise ContainerError("CORRUPT", "extension without a member")
                zeros += 1
                if zeros == 2:
                    return
                continue
            zeros = 0
            plain, signed = checksums(block)
            stated = number(field(block, "chksum"), True)
            if stated not in (plain, signed):
                raise ContainerError("CORRUPT", "checksum")
            flag, size = block[156], number(field(block, "size"))
            carrier = at if carrier is None else carrier
            if flag in b"LK":
                data = self._payload(size, self.limits.max_name_bytes and self.limits.max_name_bytes + 1, "LIMIT_NAME_BYTES")
                value, nul, rest = data.partition(b"\0")
                if not value or rest.strip(b"\0") or (long_name if flag == 76 else long_link) is not None:
                    raise ContainerError("CORRUPT", "long name")
                long_name, long_link = (value, long_link) if flag == 76 else (long_name, value)
                continue
            if flag in b"xg":
                held = sum(len(k) + len(v) for k, v in self.globals.items()) if flag == 120 else 0
                records = pax_records(self._payload(size, max(1, self.limits.max_extra_bytes - held) if self.limits.max_extra_bytes else 0, "LIMIT_EXTRA_BYTES"))
                if flag == 103:
                    if any(k.startswith("GNU.sparse") for k in records):
                        raise ContainerError("UNSUPPORTED", "global sparse keys")
                    self.globals |= records
                    carrier = None if local is None and long_name is None else carrier
                else:
                    if local is not None:
                        raise ContainerError("CORRUPT", "two extended headers")
                    local = records
                continue
            if flag == 86:  # a volume label in front
                self.s.skip(size + -size % BLOCK)
                carrier = None
                continue
            if flag == 77:
                raise ContainerError("UNSUPPORTED", "the set begins inside a member")
            m, start = self._member(block, flag, size, carrier, local, long_name, long_link, stated != plain)
            yield m, self._reader(m, start)
            end = start + m["stored_size"] + (-m["stored_size"] % BLOCK)
            if m["data_carried"]:
                self._to(end)
            long_name = long_link = local = carrier = None

    def _to(self, end: int) -> None:
        self.s.skip(end - self.s.at) if end >= self.s.at else self.s.seek(end)

    def _member(self, block, flag, size, carrier, local, long_name, long_link, signed):
        magic = block[257:265]
        variant = "gnu" if magic == b"ustar  \0" else "ustar" if magic[:5] == b"ustar" else "v7"
        name = text(block, "name")
        if variant == "ustar" and (prefix := text(block, "prefix")):
            name = prefix + b"/" + name
        kind = TYPES.get(flag, "file" if flag == 83 else "other")
        m = {
            "name": long_name or name, "link_target": long_link or text(block, "linkname") or None, "type": kind, "size": size, "mtime_seconds": number(field(block, "mtime"), True), "mtime_ns": 0,
            "mtime_source": "tar octal", "mode": number(field(block, "mode"), True) & 0xFFFFFFFF, "uid": number(field(block, "uid"), True), "gid": number(field(block, "gid"), True), "header_offset": carrier,
        }
        if variant != "v7":
            m |= {"uname": text(block, "uname") or None, "gname": text(block, "gname") or None}
        if kind.endswith("device"):
            m |= {"device_major": number(field(block, "major")), "device_minor": number(field(block, "minor"))}
        if long_name or long_link:
            variant = "gnu"
        pax = {k: v for k, v in (self.globals | (local or {})).items() if v or k in (local or {})}
        stored = None
        if local is not None or self.globals:
            variant = "pax"
            if pax.get("hdrcharset", b"ISO-IR 10646 2000 UTF-8") in (b"ISO-IR 10646 2000 UTF-8", b""):
                m["name_encoding"] = "utf-8"
            for key, column in (("path", "name"), ("GNU.sparse.name", "name"), ("linkpath", "link_target"), ("uname", "uname"), ("gname", "gname")):
                if pax.get(key):
                    m[column] = pax[key]
            if pax.get("size"):
                m["size"] = decimal(pax["size"])
            for key in ("uid", "gid"):
                if pax.get(key):
                    m[key] = decimal(pax[key], -(1 << 63))
            if pax.get("mtime"):
                (m["mtime_seconds"], m["mtime_ns"]), m["mtime_source"] = pax_time(pax["mtime"]), "pax decimal"
        carried = kind in ("file", "other")
        stored = m["size"] if carried else 0
        m["data_carried"] = carried
        m["tar"] = {"variant": variant, "checksum_signed": signed}
        start = self.s.at
        sparse = {k: v for k, v in pax.items() if k.startswith("GNU.sparse.")}
        if flag == 83 or sparse:
            start, stored = self._sparse(m, block, flag, sparse, stored)
        elif not carried:
            m["size"] = 0
        m["stored_size"] = stored
        return m, start

    def _sparse(self, m, block, flag, sparse, stored):
        """Regions from whichever of the four forms, checked; answers where data starts and its length."""
        at = self.s.at
        regions: list[tuple[int, int]] = []
        if flag == 83:
            if sparse:
                raise ContainerError("CORRUPT", "two sparse forms")
            real, more, part = number(block[483:495]), block[SPARSE_MORE], block[SPARSE_FIRST : SPARSE_FIRST + 96]
            while True:
                for i in range(0, len(part), 24):
                    if part[i : i + 24].strip(b"\0"):
                        regions.append((number(part[i : i + 12]), number(part[i + 12 : i + 24])))
                if not more:
                    break
                ext = self.s.exact(BLOCK)
                at, part, more = at + BLOCK, ext[:504], ext[504]
        elif "GNU.sparse.major" in sparse:
            if (sparse["GNU.sparse.major"], sparse.get("GNU.sparse.minor")) != (b"1", b"0"):
                raise ContainerError("UNSUPPORTED", "sparse version")
            real, used, values, want = decimal(sparse["GNU.sparse.realsize"]), 0, [], None
            buffer = b""
            while want is None or len(values) < 1 + 2 * want:
                while b"\n" not in buffer:
                    buffer += self.s.exact(BLOCK)
                    used += BLOCK
                    self._charge(used)
                line, _, buffer = buffer.partition(b"\n")
                values.append(decimal(line))
                want = values[0] if want is None else want
                self._charge(16 * want)
            regions = list(zip(values[1::2], values[2::2]))
            at, stored = at + used, stored - used
        else:
            real = decimal(sparse.get("GNU.sparse.size", sparse.get("GNU.sparse.realsize", b"")))
            listed = sparse.get("GNU.sparse.map", sparse.get("GNU.sparse.pairs", b"")).strip(b",")
            values = [decimal(x) for x in listed.split(b",")] if listed else []
            if len(values) % 2:
                raise ContainerError("CORRUPT", "sparse map")
            regions = list(zip(values[::2], values[1::2]))
        self._charge(16 * len(regions))
        last = 0
        for o, n in regions:
            if o < last or o + n > real:
                raise ContainerError("CORRUPT", "sparse regions")
            last = o + n
        if sum(n for _, n in regions) != stored:
            raise ContainerError("CORRUPT", "sparse sizes")
        m |= {"sparse": True, "sparse_map": [{"offset": o, "length": n} for o, n in regions], "size": real}
        return at, stored

    def _charge(self, n: int) -> None:
        if self.limits.max_extra_bytes and n > self.limits.max_extra_bytes:
            raise ContainerError("LIMIT_EXTRA_BYTES")

    def _reader(self, m, start):
        def data() -> bytes:
            self._to(start)
            stored = self.s.exact(m["stored_size"])
            return expanded(m, stored) if m.get("sparse") and self.holes else stored

        return data


def expanded(m: dict, stored: bytes) -> bytes:
    """A sparse member's data from that of its regions."""
    out, at = bytearray(m["size"]), 0
    for r in m["sparse_map"]:
        out[r["offset"] : r["offset"] + r["length"]] = stored[at : at + r["length"]]
        at += r["length"]
    return bytes(out)


def _octal(value: int, width: int) -> bytes | None:
    return b"%0*o\0" % (width - 1, value) if 0 <= value < 8 ** (width - 1) else None


def _base256(value: int, width: int) -> bytes:
    raw = (value & ((1 << (8 * width - 1)) - 1)).to_bytes(width, "big")
    return bytes([raw[0] | 0x80]) + raw[1:]


def _utf8(value: bytes) -> bool:
    try:
        value.decode()
        return True
    except UnicodeDecodeError:
        return False


def pax_record(key: str, value: bytes) -> bytes:
    body = len(key.encode()) + len(value) + 3
    n = body + len(str(body))
    n = body + len(str(n))
    return b"%d %s=%s\n" % (n, key.encode(), value)


def split_name(name: bytes) -> tuple[bytes, bytes] | None:
    if len(name) <= 100:
        return b"", name
    cut = name.rfind(b"/", 1, min(156, len(name) - 1))
    return (name[:cut], name[cut + 1 :]) if cut > 0 and len(name) - cut - 1 <= 100 else None


class TarWriter:
    """ustar where it suffices, else pax records in front (or a refusal if ``variant`` is ustar)."""

    def __init__(self, out, variant: str = "pax", blocking: int = 1):
        self.out, self.variant, self.blocking, self.n = out, variant, blocking, 0

    def _block(self, m, name, prefix, link, size, flag) -> bytes:
        def num(value, width):
            return _octal(value, width) or _base256(value, width)

        b = bytearray(BLOCK)
        b[0 : len(name)] = name
        b[100:108], b[108:116], b[116:124] = num(m.get("mode") if m.get("mode") is not None else 0o644, 8), num(m.get("uid") or 0, 8), num(m.get("gid") or 0, 8)
        b[124:136], b[136:148], b[148:156] = num(size, 12), num(m.get("mtime_seconds") or 0, 12), b" " * 8
        b[156:157], b[157 : 157 + len(link)], b[257:265] = flag, link, b"ustar\x0000"
        for key, at in (("uname", 265), ("gname", 297)):
            v = (m.get(key) or b"")[:32]
            b[at : at + len(v)] = v
        if m.get("device_major") is not None:
            b[329:337], b[337:345] = num(m["device_major"], 8), num(m.get("device_minor") or 0, 8)
        b[345 : 345 + len(prefix)] = prefix
        b[148:156] = b"%06o\0 " % sum(b)
        return bytes(b)

    def add(self, m: dict, data: bytes = b"") -> None:
        """data is whole, or that of the regions in sparse_map, end to end, where ``real_size`` says the whole's size."""
        kind, name, link = m.get("type") or "file", m["name"], m.get("link_target") or b""
        if not name or b"\0" in name or kind not in FLAGS:
            raise ContainerError("INVALID" if not name or b"\0" in name else "UNSUPPORTED")
        cut = m.get("real_size") is not None
        size = (m["real_size"] if cut else len(data)) if kind == "file" else 0
        records: list[tuple[str, bytes]] = []
        regions = [(r["offset"], r["length"]) for r in m.get("sparse_map") or ()]
        if kind == "file" and m.get("sparse_map") is not None:
            # The map stands in front of the regions' data, under a name of its own for readers that don't know the form.
            if any(a + n > b for (a, n), b in zip(regions, [*(o for o, _ in regions[1:]), size])) or cut and sum(n for _, n in regions) != len(data):
                raise ContainerError("INVALID", "sparse regions")
            listed = b"%d\n" % len(regions) + b"".join(b"%d\n%d\n" % r for r in regions)
            records += [("GNU.sparse.major", b"1"), ("GNU.sparse.minor", b"0"), ("GNU.sparse.name", name), ("GNU.sparse.realsize", b"%d" % size)]
            data = listed + bytes(-len(listed) % BLOCK) + (data if cut else b"".join(data[o : o + n] for o, n in regions))
            size, name = len(data), b"GNUSparseFile.0/" + name.rpartition(b"/")[2][:80]
        split = split_name(name)
        if split is None:
            records.append(("path", name))
            split = (b"", name[:100])
        if len(link) > 100:
            records.append(("linkpath", link))
        for key, cap in (("uname", 32), ("gname", 32)):
            if len(m.get(key) or b"") > cap:
                records.append((key, m[key]))
        if size >= 8**11:
            records.append(("size", b"%d" % size))
        ns = m.get("mtime_ns") or 0
        seconds = m.get("mtime_seconds") or 0
        if ns or not 0 <= seconds < 8**11 or m.get("mtime_source") == "pax decimal":
            whole, part = (seconds, ns) if seconds >= 0 or not ns else (seconds + 1, 1_000_000_000 - ns)
            sign = "-" if seconds < 0 and not whole else ""
            records.append(("mtime", (f"{sign}{whole}" + (f".{part:09d}".rstrip("0") if part else "")).encode()))
        for key in ("uid", "gid"):
            if not 0 <= (m.get(key) or 0) < 8**7:
                records.append((key, b"%d" % m[key]))
        if any(k in ("path", "linkpath", "uname", "gname", "GNU.sparse.name") and not _utf8(v) for k, v in records):
            records.insert(0, ("hdrcharset", b"BINARY"))
        if records and self.variant == "ustar":
            raise ContainerError("UNSUPPORTED", "needs pax records")
        if records:
            body = b"".join(pax_record(k, v) for k, v in records)
            self.out.write(self._block({"mode": 0, "mtime_seconds": 0}, b"././@PaxHeader", b"", b"", len(body), b"x") + body + bytes(-len(body) % BLOCK))
            self.n += BLOCK + len(body) + (-len(body) % BLOCK)
        self.out.write(self._block(m, split[1], split[0], link[:100], size, FLAGS[kind]))
        if size:
            self.out.write(data)
            self.out.write(bytes(-size % BLOCK))
        self.n += BLOCK + size + (-size % BLOCK)

    def finish(self) -> None:
        self.out.write(ZERO * 2)
        self.n += 2 * BLOCK
        self.out.write(bytes(-self.n % (BLOCK * self.blocking)))


def join_volumes(parts: list[bytes]) -> bytes:
    """One container from the volumes of a set: a member cut at a volume's end goes on behind the next one's header.

    The continuation must name the member, and its offset and rest must be what is owing.
    """
    out, owing = bytearray(), None
    for k, data in enumerate(parts):
        at = 0
        while at + BLOCK <= len(data):
            block = data[at : at + BLOCK]
            if block == ZERO:
                break
            if not identify(block):
                raise ContainerError("CORRUPT", "checksum")
            flag, size = block[156], number(field(block, "size"))
            if flag == 86:
                at += BLOCK + size + -size % BLOCK
                continue
            at += BLOCK
            if flag == 77:
                if not owing or (text(block, "name"), number(block[369:381]), size) != owing:
                    raise ContainerError("CORRUPT", "continuation")
            elif owing:
                raise ContainerError("CORRUPT", "a continuation is owing")
            else:
                out += block
            done = number(block[369:381]) if flag == 77 else 0
            carried = flag in b"\0" b"0" b"7" b"LKxgM" or TYPES.get(flag) is None
            have = min(size, len(data) - at) if carried else 0
            out += data[at : at + have]
            at += have + (-size % BLOCK if have == size and carried else 0)
            owing = (text(block, "name"), done + have, size - have) if carried and have < size else None
            if carried and have == size:
                out += bytes(-(done + size) % BLOCK)
            if owing and k == len(parts) - 1:
                raise ContainerError("CORRUPT", "the last volume ends inside a member")
    return bytes(out) + 2 * ZERO
