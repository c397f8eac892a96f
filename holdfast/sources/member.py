"""Members as rows: the schema, defaults, caps, and the loop that turns a walk into rows and a status."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..functions.status import ContainerError

MEMBER = (
    "path string, idx bigint, name binary, name_encoding string, link_target binary, type string, size bigint, stored_size bigint, size_unknown boolean, "
    "sparse boolean, sparse_map array<struct<offset:bigint,length:bigint>>, mtime_seconds bigint, mtime_ns int, mtime_source string, mode bigint, uid bigint, gid bigint, "
    "uname binary, gname binary, device_major bigint, device_minor bigint, header_offset bigint, tar struct<variant:string,checksum_signed:boolean>, "
    "zip struct<method:int,flags:int,compressed_size:bigint,crc32:bigint,version_made_by:int,external_attributes:bigint,encryption:string,extra_length:int,used_zip64:boolean>, "
    "sevenz struct<folder:int,encrypted:boolean,crc32:bigint>, data_status string, content binary"
)
CONTAINER = (
    "path string, format string, codec string, base_offset bigint, zip_declared_members bigint, zip_has_zip64_end boolean, zip_comment binary, "
    "member_count bigint, total_declared_bytes bigint, status string"
)
DEFAULTS = {
    "name": b"", "name_encoding": "undeclared", "link_target": None, "type": "file", "size": 0, "stored_size": None, "size_unknown": False, "sparse": False, "sparse_map": None,
    "mtime_seconds": None, "mtime_ns": None, "mtime_source": "none", "mode": None, "uid": None, "gid": None, "uname": None, "gname": None, "device_major": None, "device_minor": None,
    "header_offset": None, "tar": None, "zip": None, "sevenz": None, "data_status": "OK", "content": None,
}


@dataclass
class Limits:
    """Caps; 0 means none.  They fire before anything of a declared size is read."""

    max_members: int = 1 << 20
    max_member_bytes: int = 64 << 30
    max_total_bytes: int = 256 << 30
    max_name_bytes: int = 1 << 16
    max_extra_bytes: int = 1 << 16
    max_key_rounds: int = 1 << 26


class Account:
    """Counts members and declared bytes in the order in which the caps are asked."""

    def __init__(self, limits: Limits):
        self.limits, self.members, self.total = limits, 0, 0

    def add(self, m: dict) -> None:
        limits, size = self.limits, m["size"] or 0
        names = max(len(m["name"] or b""), len(m.get("link_target") or b""))
        if limits.max_name_bytes and names > limits.max_name_bytes:
            raise ContainerError("LIMIT_NAME_BYTES")
        if limits.max_member_bytes and size > limits.max_member_bytes:
            raise ContainerError("LIMIT_MEMBER_BYTES")
        if limits.max_members and self.members + 1 > limits.max_members:
            raise ContainerError("LIMIT_MEMBERS")
        if limits.max_total_bytes and self.total + size > limits.max_total_bytes:
            raise ContainerError("LIMIT_TOTAL_BYTES")
        self.members += 1
        self.total += size


Data = Callable[[], bytes]


def rows(path: str, walk: Iterator[tuple[dict, Data]], limits: Limits, with_content: bool, container: dict, only: int | None = None) -> Iterator[dict]:
    """Rows of a walk, with the data of all members or of one ordinal ``only``; ``container`` gets its terminal status.  Data that can't be read is refused by row."""
    account = Account(limits)
    status = "END"
    try:
        for m, data in walk:
            account.add(m)
            row = DEFAULTS | m | {"path": path, "idx": account.members - 1}
            if with_content and (only is None or row["idx"] == only) and row["data_status"] == "OK" and row["type"] in ("file", "other"):
                try:
                    row["content"] = data()
                except ContainerError as e:
                    row["data_status"] = e.status
            yield row
    except ContainerError as e:
        status = e.status
    container.update(path=path, member_count=account.members, total_declared_bytes=account.total, status=status)
