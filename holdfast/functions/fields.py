"""Times, numbers and sizes that container headers hold, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILETIME_EPOCH = 11644473600
DOS_FIRST, DOS_LAST = 315532800, 4354819198  # 1980-01-01 00:00:00 and 2107-12-31 23:59:58
#: Texts of zip methods and encryptions.
ZIP_METHODS = {0: "stored", 1: "shrunk", 2: "reduced, factor 1", 3: "reduced, factor 2", 4: "reduced, factor 3", 5: "reduced, factor 4", 6: "imploded", 8: "deflate", 9: "enhanced deflate (deflate64)", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz", 98: "ppmd", 99: "WinZip AES"}


#: Where a zip member's sizes stand, by number.
ZIP_SIZES = {0: "auto", 1: "data descriptor", 2: "local header"}


def zip_sizes_text(sizes: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in ZIP_SIZES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, sizes.cast("int")), F.lit("unknown"))


def method_text(method: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in ZIP_METHODS.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, method.cast("int")), F.lit("unknown"))


def _days(y: Column, m: Column, d: Column) -> Column:
    return F.datediff(F.make_date(y, m, d), F.lit("1970-01-01").cast("date")).cast("bigint")


def dos_to_epoch(dos: Column) -> Column:
    """UTC seconds of a 32-bit DOS date and time; null where a field is out of its range."""
    def bits(shift: int, width: int) -> Column:
        return F.shiftright(dos.cast("bigint"), shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")

    year, month, day = bits(25, 7) + 1980, bits(21, 4), bits(16, 5)
    hour, minute, second = bits(11, 5), bits(5, 6), bits(0, 5) * 2
    fits = month.between(1, 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60)
    inside = fits & (day <= F.dayofmonth(F.last_day(F.make_date(year, F.when(fits, month).otherwise(1), F.lit(1)))))
    whole = _days(year, F.when(inside, month).otherwise(1), F.when(inside, day).otherwise(1)) * 86400 + hour * 3600 + minute * 60 + second
    return F.when(inside, whole)


def epoch_to_dos(seconds: Column) -> Column:
    """The DOS date and time at or before a time, clamped to what DOS can say, on an even second."""
    s = F.greatest(F.least(seconds.cast("bigint"), F.lit(DOS_LAST)), F.lit(DOS_FIRST))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))
    t = F.pmod(s, F.lit(86400))
    date = (F.year(day) - 1980) * 512 + F.month(day) * 32 + F.dayofmonth(day)
    time = F.floor(t / 3600) * 2048 + F.floor(F.pmod(t, F.lit(3600)) / 60) * 32 + F.floor(F.pmod(t, F.lit(60)) / 2)
    return date.cast("bigint") * 65536 + time


def filetime_to_epoch(ticks: Column) -> tuple[Column, Column]:
    """Seconds (floor) and nanoseconds of 100 ns ticks since 1601."""
    t = ticks.cast("bigint")
    # Whole numbers throughout: a double has too few digits for ticks.
    rest = F.pmod(t, F.lit(10_000_000))
    return F.call_function("div", t - rest, F.lit(10_000_000).cast("bigint")) - FILETIME_EPOCH, (rest * 100).cast("int")


def octal(field: Column) -> Column:
    """A tar number of octal digits between spaces and NULs; blank is 0, anything else null."""
    text = F.regexp_replace(field, "\\A[ \\x00]+|[ \\x00]+\\z", "")
    return F.when(text == "", F.lit(0).cast("bigint")).when(text.rlike(r"\A[0-7]{1,21}\z"), F.conv(text, 8, 10).cast("bigint"))


def format_octal(value: Column, digits: int) -> Column:
    """Digits in octal, zero-padded; null where they don't suffice."""
    return F.when((value >= 0) & (value < 8**digits), F.lpad(F.conv(value.cast("string"), 10, 8), digits, "0"))


def pax_time(text: Column) -> tuple[Column, Column]:
    """Seconds (floor) and nanoseconds of a pax decimal; null where it isn't one."""
    good = text.rlike(r"\A-?[0-9]{1,18}(\.[0-9]*)?\z")
    whole = F.when(good, F.regexp_extract(text, r"\A-?([0-9]+)", 1)).cast("bigint")
    part = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]*)\z", 1), 1, 9), 9, "0").cast("int")
    below = text.startswith("-")
    seconds = F.when(~below, whole).when(part > 0, -whole - 1).otherwise(-whole)
    return seconds, F.when(good, F.when(below & (part > 0), 1_000_000_000 - part).otherwise(part))


def pax_record_length(key: Column, value: Column) -> Column:
    """The self-counting length of a record ``length key=value LF``."""
    body = F.octet_length(key) + F.octet_length(value) + 3
    length = body + 1
    for _ in range(3):  # a fixed point: another digit can only be needed once
        length = body + F.length(length.cast("string"))
    return length


def ustar_split(name: Column) -> Column:
    """(prefix, name) of a path that ustar can hold, else null: the last usable slash, prefix to 155, name to 100 bytes."""
    n = F.octet_length(name)
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.substring(name, i, F.lit(1)) == "/") & (i > 1) & (i - 1 <= 155) & (n - i >= 1) & (n - i <= 100))
    at = F.array_max(cuts)
    whole = F.struct(F.lit("").alias("prefix"), name.alias("name"))
    return F.when(n <= 100, whole).when(at.isNotNull(), F.struct(F.substring(name, F.lit(1), at - 1).alias("prefix"), F.substring(name, at + 1, n).alias("name")))


def needs_zip64(size: Column, compressed: Column, offset: Column) -> Column:
    top = F.lit(0xFFFFFFFF)
    return (size >= top) | (compressed >= top) | (offset >= top)


def version_needed(method: Column, encrypted: Column, zip64: Column) -> Column:
    """The version a zip member needs: by encryption, then codec, then size."""
    return F.when(encrypted, 51).when(method.isin(14, 93, 95), 63).when(method == 12, 46).when(zip64, 45).when(method == 9, 21).otherwise(20)
