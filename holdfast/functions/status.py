"""The status vocabulary: how a walk ended, or why a member's data is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes and their text.
TEXT = {
    "OK": "No error",
    "END": "End of container",
    "IO": "I/O error",
    "FORMAT": "Not a container format this library reads",
    "UNSUPPORTED": "Unsupported feature",
    "CORRUPT": "Corrupt container",
    "OOM": "Out of memory",
    "INVALID": "Invalid argument",
    "INTERNAL": "Internal error",
    "NOT_SEEKABLE": "The source cannot seek, and this needs to",
    "LIMIT_MEMBERS": "Limit exceeded: too many members",
    "LIMIT_MEMBER_BYTES": "Limit exceeded: member too large",
    "LIMIT_TOTAL_BYTES": "Limit exceeded: members total too large",
    "LIMIT_NAME_BYTES": "Limit exceeded: member name too long",
    "LIMIT_EXTRA_BYTES": "Limit exceeded: member extra fields too large",
    "LIMIT_KEY_ROUNDS": "Limit exceeded: too much work deriving encryption keys",
    "LIMIT_CODEC_BYTES": "Limit exceeded: the codec's output cap, in its own options",
    "PASSWORD_REQUIRED": "The member is encrypted and no password was given",
    "PASSWORD_REJECTED": "Password rejected by the encryption header's check byte",
    "PASSWORD_OR_CORRUPT": "Wrong password or corrupt member; this cipher cannot tell them apart",
    "REFUSED": "Refused by the filesystem layer",
    "NOT_FOUND": "No such file or directory",
    "ACCESS": "Access denied",
}


class ContainerError(Exception):
    """A status other than OK and END, raised where an answer is impossible."""

    def __init__(self, status: str, detail: str = ""):
        super().__init__(f"{status}: {detail or TEXT[status]}")
        self.status = status

    def __reduce__(self):
        return type(self), (self.status, str(self))


def is_error(status: Column) -> Column:
    return ~status.isin("OK", "END")


def is_limit(status: Column) -> Column:
    return status.startswith("LIMIT_")


def status_text(status: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in TEXT.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, status), F.lit("Unknown error"))
