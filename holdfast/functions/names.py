"""Name safety as Catalyst expressions: a mask of 15 findings over a BINARY name.

Bytes are viewed as ISO-8859-1, which maps each to one character.  Components are walked by a fold that keeps the depth
below the root; a name escapes where the depth would fall under zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Findings by bit.
FINDINGS = (
    ("ABSOLUTE", "absolute path"),
    ("TRAVERSAL", "resolves outside the root"),
    ("PARENT_COMPONENT", "has a parent component"),
    ("CURRENT_COMPONENT", "has a current-directory component"),
    ("EMPTY_COMPONENT", "has an empty component"),
    ("EMPTY", "empty name"),
    ("NUL_BYTE", "contains a NUL byte"),
    ("CONTROL_BYTE", "contains a control byte"),
    ("BACKSLASH", "contains a backslash"),
    ("WINDOWS_TRAVERSAL", "resolves outside the root where a backslash separates"),
    ("DRIVE_LETTER", "begins with a drive letter"),
    ("UNC", "begins with two separators"),
    ("WINDOWS_RESERVED", "reserved device name on Windows"),
    ("TRAILING_DOT_OR_SPACE", "a component ends in a dot or a space"),
    ("NOT_UTF8", "not well-formed UTF-8"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(FINDINGS)}
ALL = (1 << len(FINDINGS)) - 1
ESCAPES = BIT["ABSOLUTE"] | BIT["TRAVERSAL"] | BIT["DRIVE_LETTER"] | BIT["UNC"]
PORTABILITY = sum(BIT[x] for x in ("PARENT_COMPONENT", "CURRENT_COMPONENT", "EMPTY_COMPONENT", "CONTROL_BYTE", "BACKSLASH", "WINDOWS_TRAVERSAL", "WINDOWS_RESERVED", "TRAILING_DOT_OR_SPACE", "NOT_UTF8"))
RESERVED = r"(?i)\A(con|prn|aux|nul|com[1-9]|lpt[1-9]) *(\..*)?\z"


def _escapes(parts: Column) -> Column:
    """Whether walking the components ever leaves the root."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def step(a: Column, p: Column) -> Column:
        up = p == ".."
        inside = F.when(up, F.greatest(a.depth - 1, F.lit(0))).when((p == "") | (p == "."), a.depth).otherwise(a.depth + 1)
        return F.struct(inside.alias("depth"), (a.out | (up & (a.depth == 0))).alias("out"))

    return F.aggregate(parts, start, step).out


def name_mask(name: Column) -> Column:
    """The findings' mask of a BINARY name; null for null."""
    raw = name.cast("binary")
    text = F.decode(raw, "ISO-8859-1")
    empty = F.octet_length(raw) == 0
    stripped = F.regexp_replace(F.regexp_replace(text, r"/\z", ""), r"\A/", "")
    parts = F.split(stripped, "/", -1)
    both = F.regexp_replace(F.regexp_replace(text, r"[/\\]\z", ""), r"\A[/\\]", "")
    back = F.contains(text, F.lit("\\"))
    posix = _escapes(parts)

    def bit(name: str, test: Column) -> Column:
        return F.when(test, F.lit(BIT[name])).otherwise(F.lit(0))

    bits = [
        bit("ABSOLUTE", text.startswith("/")),
        bit("TRAVERSAL", posix),
        bit("PARENT_COMPONENT", F.array_contains(parts, "..")),
        bit("CURRENT_COMPONENT", F.array_contains(parts, ".")),
        bit("EMPTY_COMPONENT", F.array_contains(parts, "")),
        bit("NUL_BYTE", F.contains(text, F.lit("\x00"))),
        bit("CONTROL_BYTE", text.rlike("[\\x01-\\x1f\\x7f]")),
        bit("BACKSLASH", back),
        bit("WINDOWS_TRAVERSAL", back & ~posix & _escapes(F.split(both, r"[/\\]", -1))),
        bit("DRIVE_LETTER", text.rlike(r"\A[A-Za-z]:")),
        bit("UNC", text.rlike(r"\A[/\\]{2}")),
        bit("WINDOWS_RESERVED", F.exists(parts, lambda p: p.rlike(RESERVED.replace("(?i)", "(?is)")))),
        bit("TRAILING_DOT_OR_SPACE", F.exists(parts, lambda p: p.rlike(r"(?s).*[. ]\z") & ~p.isin(".", ".."))),
        bit("NOT_UTF8", ~F.is_valid_utf8(raw.cast("string"))),
    ]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return F.when(raw.isNull(), F.lit(None).cast("int")).when(empty, F.lit(BIT["EMPTY"])).otherwise(mask)


def findings(mask: Column) -> Column:
    """The findings' texts, in the order of their bits."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(text)) for i, (_, text) in enumerate(FINDINGS))))


def refused(mask: Column, portable: bool = True, symlink_target: bool = False) -> Column:
    """Whether extraction refuses a name: it leaves the root, can't be stored, or (unless allowed) isn't portable."""
    bad = ESCAPES | BIT["NUL_BYTE"] | BIT["EMPTY"]
    if portable:
        bad |= PORTABILITY & ~BIT["CURRENT_COMPONENT"]
    if symlink_target:
        bad &= ~(BIT["TRAVERSAL"] | BIT["PARENT_COMPONENT"])
    return mask.bitwiseAND(F.lit(bad)) != 0


def escaped(name: Column) -> Column:
    """Printable ASCII as it is, a backslash doubled, every other byte as \\xHH."""
    text = F.decode(name.cast("binary"), "ISO-8859-1")
    each = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: F.when(c == "\\", F.lit("\\\\")).when(c.rlike(r"\A[\x20-\x7e]\z"), c).otherwise(F.concat(F.lit("\\x"), F.upper(F.lpad(F.hex(F.ascii(c)), 2, "0")))),
    )
    return F.array_join(each, "")
