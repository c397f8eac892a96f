"""Directory trees: packing them to members, extracting members into them, and sets of volumes.

Extraction goes member by member and stops at the first refusal; files before it stay.  Every component is entered
without following links, links are off unless asked for, and nothing that existed before is written over.
"""

from __future__ import annotations

import errno
import os
import re
import stat
from collections.abc import Iterable, Iterator

from ..functions.names import BIT, ESCAPES, PORTABILITY
from ..functions.status import ContainerError

DEPTH = 64
DEVICES = {b"con", b"prn", b"aux", b"nul", *(d + b"%d" % i for d in (b"com", b"lpt") for i in range(1, 10))}


def _leaves(parts: list[bytes]) -> bool:
    depth = 0
    for p in parts:
        if p == b"..":
            if not depth:
                return True
            depth -= 1
        elif p not in (b"", b"."):
            depth += 1
    return False


def name_mask(name: bytes) -> int:
    """The findings of one name; the expression of the same name does this for columns."""
    if not name:
        return BIT["EMPTY"]
    parts = name.removesuffix(b"/").removeprefix(b"/").split(b"/")
    slashes = name.replace(b"\\", b"/")
    both = slashes.removesuffix(b"/").removeprefix(b"/").split(b"/")
    out = _leaves(parts)
    tests = {
        "ABSOLUTE": name[:1] == b"/", "TRAVERSAL": out, "PARENT_COMPONENT": b".." in parts, "CURRENT_COMPONENT": b"." in parts, "EMPTY_COMPONENT": b"" in parts, "NUL_BYTE": b"\0" in name,
        "CONTROL_BYTE": re.search(rb"[\x01-\x1f\x7f]", name), "BACKSLASH": b"\\" in name, "WINDOWS_TRAVERSAL": b"\\" in name and not out and _leaves(both), "DRIVE_LETTER": re.match(rb"[A-Za-z]:", name),
        "UNC": slashes[:2] == b"//", "WINDOWS_RESERVED": any(p.split(b".")[0].rstrip(b" ").lower() in DEVICES for p in parts), "TRAILING_DOT_OR_SPACE": any(p[-1:] in (b".", b" ") and p not in (b".", b"..") for p in parts),
    }
    mask = sum(BIT[k] for k, v in tests.items() if v)
    try:
        name.decode()
    except UnicodeDecodeError:
        mask |= BIT["NOT_UTF8"]
    return mask


def _runs(path: str, size: int) -> list[dict] | None:
    """Where a file's data lies between its holes; None where the file system doesn't say."""
    out, at = [], 0
    with open(path, "rb") as f:
        while at < size:
            try:
                begin = os.lseek(f.fileno(), at, os.SEEK_DATA)
                at = os.lseek(f.fileno(), begin, os.SEEK_HOLE)
            except OSError as e:
                if e.errno == errno.ENXIO:  # a hole to the end
                    break
                return None
            out.append({"offset": begin, "length": min(at, size) - begin})
    return None if len(out) == 1 and out[0] == {"offset": 0, "length": size} else out


def tree_members(root: str) -> Iterator[tuple[dict, str | None]]:
    """(member, path of its data or None) of all below root, names sorted.  Later links of a file refer to its first name."""
    seen: dict[tuple[int, int], bytes] = {}

    def walk(at: str, name: bytes, depth: int, above: tuple = ()):
        if depth > DEPTH:
            raise ContainerError("REFUSED", "too deep")
        own_place = os.stat(at)
        above = (*above, (own_place.st_dev, own_place.st_ino))
        if above[-1] in above[:-1]:
            raise ContainerError("REFUSED", "a folder within itself")
        for entry in sorted(os.scandir(at), key=lambda e: os.fsencode(e.name)):
            s = entry.stat(follow_symlinks=False)
            own = name + os.fsencode(entry.name)
            m = {"name": own, "mode": stat.S_IMODE(s.st_mode), "uid": s.st_uid, "gid": s.st_gid, "mtime_seconds": s.st_mtime_ns // 1_000_000_000, "mtime_ns": s.st_mtime_ns % 1_000_000_000}
            if stat.S_ISDIR(s.st_mode):
                yield m | {"name": own + b"/", "type": "directory"}, None
                yield from walk(entry.path, own + b"/", depth + 1, above)
            elif stat.S_ISLNK(s.st_mode):
                yield m | {"type": "symlink", "link_target": os.fsencode(os.readlink(entry.path))}, None
            elif stat.S_ISREG(s.st_mode):
                key = (s.st_dev, s.st_ino)
                if s.st_nlink > 1 and key in seen:
                    yield m | {"type": "hardlink", "link_target": seen[key]}, None
                else:
                    seen[key] = own
                    yield m | {"type": "file", "sparse_map": _runs(entry.path, s.st_size) if s.st_blocks * 512 < s.st_size else None}, entry.path
            else:
                yield m | {"type": "fifo" if stat.S_ISFIFO(s.st_mode) else "other"}, None

    yield from walk(root, b"", 0)


def extract(rows: Iterable[dict], root: str, portable: bool = True, links: bool = False) -> Iterator[tuple[int, str]]:
    """(idx, status) of each member written; the first refusal or error ends it."""
    os.makedirs(root, exist_ok=True)
    base = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    made: set[bytes] = set()
    bad = ESCAPES | BIT["NUL_BYTE"] | BIT["EMPTY"] | ((PORTABILITY & ~BIT["CURRENT_COMPONENT"]) if portable else 0)
    try:
        for m in rows:
            try:
                if name_mask(m["name"]) & bad or m["type"] not in ("file", "directory", *(("symlink", "hardlink") if links else ())):
                    raise ContainerError("REFUSED")
                if m.get("data_status", "OK") != "OK":
                    raise ContainerError(m["data_status"])
                _place(base, m, made)
            except FileExistsError:
                yield m["idx"], "REFUSED"
                return
            except PermissionError:
                yield m["idx"], "ACCESS"
                return
            except OSError:
                yield m["idx"], "IO"
                return
            except ContainerError as e:
                yield m["idx"], e.status
                return
            yield m["idx"], "OK"
    finally:
        os.close(base)


def _inside(name: bytes, target: bytes) -> bool:
    return not target.startswith(b"/") and not _leaves(name.split(b"/")[:-1] + target.split(b"/"))


def _place(base: int, m: dict, made: set[bytes]) -> None:
    *parents, last = [p for p in m["name"].removesuffix(b"/").split(b"/") if p not in (b"", b".")]
    at, path = os.dup(base), b""
    try:
        for p in parents:
            path += p + b"/"
            try:
                os.mkdir(p, 0o755, dir_fd=at)
                made.add(path)
            except FileExistsError:
                if path not in made:  # what was there before this extraction is left alone
                    raise
            below = os.open(p, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            os.close(at)
            at = below
        mode = (m["mode"] if m.get("mode") is not None else 0o644) & 0o777
        if m["type"] == "directory":
            path += last + b"/"
            if path not in made:
                os.mkdir(last, mode | 0o700, dir_fd=at)
                made.add(path)
        elif m["type"] == "symlink":
            if not _inside(m["name"], m["link_target"] or b""):
                raise ContainerError("REFUSED")
            os.symlink(m["link_target"], last, dir_fd=at)
        elif m["type"] == "hardlink":
            if (m["link_target"] or b"") not in made:
                raise ContainerError("REFUSED")
            os.link(m["link_target"], last, src_dir_fd=base, dst_dir_fd=at, follow_symlinks=False)
        else:
            f = os.open(last, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, mode, dir_fd=at)
            with os.fdopen(f, "wb") as out:
                _sparse_write(out, m.get("content") or b"")
            made.add(m["name"])
            if m.get("mtime_seconds") is not None:
                ns = m["mtime_seconds"] * 1_000_000_000 + (m.get("mtime_ns") or 0)
                os.utime(last, ns=(ns, ns), dir_fd=at, follow_symlinks=False)
    finally:
        os.close(at)


def _sparse_write(out, data: bytes) -> None:
    zero = bytes(4096)
    for i in range(0, len(data), 4096):
        part = data[i : i + 4096]
        if part == zero:
            out.seek(4096, os.SEEK_CUR)
        else:
            out.write(part)
    out.truncate(len(data))


def volume_set(names: Iterable[str]) -> dict[str, list[str]]:
    """Parts of split containers in order, by the set's name: x.001, x.002 ...; or x.z01, x.z02 ... x.zip."""
    out: dict[str, list[tuple[int, str]]] = {}
    names = list(names)
    for n in names:
        if m := re.fullmatch(r"(.+)\.(\d{3,5})", n):
            out.setdefault(m[1], []).append((int(m[2]), n))
        elif m := re.fullmatch(r"(.+)\.[zZ](\d{2,5})", n):
            out.setdefault(m[1] + ".zip", []).append((int(m[2]), n))
    for key, parts in out.items():
        if key in names:
            parts.append((1 << 20, key))
        parts.sort()
    return {k: [n for _, n in v] for k, v in out.items() if [i for i, _ in v if i < 1 << 20] == list(range(1, 1 + sum(i < 1 << 20 for i, _ in v)))}


def split(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, max(len(data), 1), size)]
