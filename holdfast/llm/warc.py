"""WARC records: reading, writing, and resolving not-modified revisits.

A revisit (type 'revisit', or status 304) refers to the latest full response (type 'response', status 200) of its canonical
url with a strictly earlier time; of several at that time, the greatest record_id.  Then validators are
compared, in the order ETag, Last-Modified, payload digest, the first that both sides have: equal gives ``resolved``, else
``mismatch``; without one ``unchecked``; without an earlier response ``missing``.  A resolved or unchecked revisit takes
the response's headers and payload; of its own headers those a 304 may update replace the response's.

The as-of join has two levels, so that a url with a third of all rows is split: time is cut into slices of about slice_rows
rows of all urls, the last full response of each (url, slice) is a partial maximum, one row a slice carries it forward,
and an ordered window only spans one slice of one url.  Payloads join at the end, by the response's id; of several
records of that id and time, always the same one by a hash of its headers and payload.

Null urls have a null canonical url and never match; null times are never earlier or later than another; null headers are
empty; repeated records are rows of their own; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

#: Header fields that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SLICE_ROWS, MAX_SLICES = 1 << 20, 10_000


def canonical_url(url: Column) -> Column:
    """Scheme, www, default ports, tracking parameters and fragment dropped; host in lower case; no last slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"([?&])utm_[a-z]+=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\?&+", "?"), r"[?&]+$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def slice_of(ts: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above ts: a binary search by a fold."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*map(F.lit, bounds)).cast("array<bigint>")

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a.low + a.high) / 2).cast("int")
        here = F.get(listed, middle) <= ts
        open_ = a.low < a.high
        return F.struct(F.when(open_ & here, middle + 1).otherwise(a.low).alias("low"), F.when(open_ & ~here, middle).otherwise(a.high).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step).low


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row a revisit: record_id, canonical, ts, refers_to, outcome, headers (merged), payload.

    records: record_id string, type string, url string, ts bigint, status int, headers map<string,string>
    (lower-case names), digest string, payload (any type).
    """
    rows = records.select(
        "record_id", "ts", canonical_url(F.col("url")).alias("key"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
        ((F.col("type") == "revisit") | (F.col("status") == 304)).alias("revisit"),
        ((F.col("type") == "response") & (F.col("status") == 200)).alias("full"),
    ).where("(revisit or full)")
    n = min(MAX_SLICES, pieces(records.count(), slice_rows))
    bounds = records.agg(F.percentile_approx("ts", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    rows = rows.withColumn("slice", slice_of(F.col("ts"), sorted(set(bounds or []))))
    full = F.when(F.col("full") & ~F.coalesce("revisit", F.lit(False)), F.struct("ts", "record_id", _validators().alias("v")))
    rows = rows.withColumn("own", full)
    usable = rows.where("key is not null and ts is not null")
    by_slice = usable.groupBy("key", "slice").agg(F.max("own").alias("last"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.select("key", "slice", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = usable.select("record_id", "key", "ts", "slice", "revisit", _validators().alias("mine"), "headers", F.max("own").over(inside).alias("near"))
    asof = seen.where("revisit").join(carried, ["key", "slice"]).select(
        "record_id", F.col("key").alias("canonical"), "ts", "mine", "headers", F.coalesce("near", "carried").alias("ref")
    )
    lost = rows.where("revisit and (key is null or ts is null)").select(
        "record_id", F.col("key").alias("canonical"), "ts", _validators().alias("mine"), "headers", F.lit(None).cast(asof.schema["ref"].dataType).alias("ref")
    )
    both = asof.unionByName(lost)

    def same(name: str) -> Column:
        return F.col(f"mine.{name}") == F.col(f"ref.v.{name}")

    checked = F.coalesce(same("etag"), same("modified"), same("digest"))
    outcome = F.when(F.col("ref").isNull(), "missing").when(checked.isNull(), "unchecked").when(checked, "resolved").otherwise("mismatch")
    both = both.withColumn("outcome", outcome).withColumn("refers_to", F.col("ref.record_id"))
    taken = F.when(F.col("outcome").isin("resolved", "unchecked"), F.col("refers_to"))
    source = records.where("type = 'response' and status = 200").select(
        F.col("record_id").alias("taken"), F.col("ts").alias("taken_ts"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("stored"), "payload"
    )
    which = F.struct(F.xxhash64(F.array_sort(F.map_entries("stored"))), F.xxhash64("payload"))
    source = source.groupBy("taken", "taken_ts").agg(F.min_by(F.struct("stored", "payload"), which).alias("x")).select("taken", "taken_ts", "x.*")
    joined = both.withColumn("taken", taken).withColumn("taken_ts", F.col("ref.ts")).join(source, ["taken", "taken_ts"], "left")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    return joined.select(
        "record_id", "canonical", "ts", "refers_to", "outcome", F.when(F.col("stored").isNull(), F.col("headers")).otherwise(merged).alias("headers"), "payload"
    )


def _validators() -> Column:
    return F.struct(F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), F.col("digest").alias("digest"))


def write_record(headers: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    """One WARC/1.1 record; Content-Length is set.  Compressed records are gzip members of their own."""
    lines = {k: v for k, v in headers.items() if k.lower() != "content-length"} | {"Content-Length": str(len(block))}
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file, compressed or not.  A cut record is an error."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        block = f.read(size)
        if len(block) < size:
            raise ValueError("the last record is cut")
        yield headers, block


def http_parts(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, header fields (lower-case names; repeats joined by a comma) and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("iso-8859-1").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    parts = first.split(" ", 2)
    return (int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None), fields, body


def records_of(files: DataFrame) -> DataFrame:
    """resolve_revisits' records from binaryFile rows (path, content).  ts: seconds of WARC-Date."""
    from datetime import datetime

    from .common import map_rows

    schema = "record_id string, type string, url string, ts bigint, status int, headers map<string,string>, digest string, payload binary"

    def run(batches):
        for b in batches:
            out = {k.split()[0]: [] for k in ("record_id", "type", "url", "ts", "status", "headers", "digest", "payload")}
            for content in b["content"]:
                for h, block in read_records(content or b""):
                    status, fields, body = http_parts(block) if "application/http" in h.get("content-type", "") else (None, {}, block)
                    date = h.get("warc-date")
                    row = (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), int(datetime.fromisoformat(date).timestamp()) if date else None, status, list(fields.items()), h.get("warc-payload-digest"), body)
                    for k, v in zip(out, row):
                        out[k].append(v)
            yield out

    return map_rows(files.select("content"), run, schema, rows=1)
