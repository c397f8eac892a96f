"""Secrets in text: fixed patterns, and random strings told by a battery of randomness tests under false-discovery control.

A candidate is a maximal run of ``[A-Za-z0-9+/_-]`` of MIN_LENGTH or more characters.  Its encoding is the smallest
listed alphabet that holds it.  The null is that it is a uniform draw from that alphabet, as keys and tokens are.  Four tests
ask for departures that text has: chi-squared uniformity over the alphabet's symbols, the same over classes of them (digits,
small and capital letters, others), Wald-Wolfowitz runs about the median symbol, and lag-one serial correlation.  Their
least p-value times their number (Bonferroni) is the candidate's.

Which candidates are dismissed as ordinary is decided over all of the corpus, within strata of length, since the tests say
more of longer strings: Benjamini-Hochberg with Storey's estimate of the share of random strings, so that of the
strings dismissed at most a share q is random in expectation.  Counts of p-values by stratum and bin (at most
STRATA x BINS numbers; bins round p up) are all that the driver sees.  The others are reported as ``random``.  Base spans stay
whatever the method says.

Nulls and empty texts have no spans.  Rows are judged one by one, so repeated ids or rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, settled, small_batches

#: Fixed patterns.  They run over UTF-8 bytes, so ignoring case concerns ASCII letters alone.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal: the same as [0-9a-f]+ of 24 or more
RUN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Alphabets in the order in which they are tried.
ALPHABETS = {
    "decimal": b"0123456789",
    "hex": b"0123456789abcdef",
    "HEX": b"0123456789ABCDEF",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": b"0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
#: Spans, some 40 bytes each, are broadcast up to this number.
BROADCAST_SPANS = 1 << 20
BINS, STRATA = 200, 8  # log p-values in steps of a quarter; lengths by powers of two
#: Bins of p-values above e^-0.75, which are nearly all of random strings.
UPPER, LAMBDA = 3, math.exp(-0.75)
#: Each alphabet's symbols as numbers, and their classes.
CODES = {k: np.array([v.find(bytes([b])) for b in range(256)]) for k, v in ALPHABETS.items()}
CLASSES = np.array([0 if 48 <= b <= 57 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 for b in range(256)])


def encoding(token: bytes) -> str:
    used = set(token)
    return next(k for k, v in SETS.items() if used <= v)


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _uneven_p(counts: np.ndarray, shares: np.ndarray) -> float:
    """Upper tail of chi-squared for counts more uneven than their shares, by Wilson and Hilferty's cube root."""
    n, k = counts.sum(), len(counts)
    if k < 2:
        return 1.0
    chi = float(((counts - n * shares) ** 2 / (n * shares)).sum())
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: bytes) -> list[float]:
    """p-values of the four tests that the token is a uniform draw from its alphabet."""
    name, raw = encoding(token), np.frombuffer(token, np.uint8)
    alphabet = np.frombuffer(ALPHABETS[name], np.uint8)
    k, n, x = len(alphabet), len(token), CODES[name][raw]
    symbols = _uneven_p(np.bincount(x, minlength=k), np.full(k, 1 / k))
    shares = np.bincount(CLASSES[alphabet], minlength=4) / k
    classes = _uneven_p(np.bincount(CLASSES[raw], minlength=4)[shares > 0], shares[shares > 0])
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = _normal_p((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - min(n, 1000))
    d = x - x.mean()
    s = float((d * d).sum())
    p_serial = _normal_p(float((d[1:] * d[:-1]).sum()) / s * math.sqrt(n)) if s else 0.0
    return [symbols, classes, p_runs, p_serial]


def randomness_p(token: bytes) -> float:
    """The battery's p-values combined."""
    p = battery(token)
    return min(1.0, len(p) * min(p))


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes."""
    out = []
    low = data.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(data)]


def code_points(data: bytes, spans: list[tuple]) -> list[tuple]:
    """Byte offsets to code points, by one pass over the marks."""
    if not spans or data.isascii():
        return spans
    at, seen, where = 0, 0, {}
    for m in sorted({x for s in spans for x in s[:2]}):
        seen += sum((b & 0xC0) != 0x80 for b in data[at:m]) if m - at < 64 else len(data[at:m].decode("utf-8", "replace"))
        at = m
        where[m] = seen
    return [(where[s[0]], where[s[1]], *s[2:]) for s in spans]


def _scan(batches):
    for b in batches:
        out = {"doc_id": b["doc_id"], "spans": [], "candidates": []}
        for t in b["text"]:
            d = (t or "").encode("utf-8", "surrogatepass")
            base = base_spans(d)
            runs = [(m.start(), m.end()) for m in RUN.finditer(d)]
            both = code_points(d, base + [(s, e, -1) for s, e in runs])
            out["spans"].append([{"start": s, "end": e, "kind": k} for s, e, k in both[: len(base)]])
            out["candidates"].append(
                [{"start": s, "end": e, "stratum": stratum(y - x), "bin": bin_of(randomness_p(d[x:y]))} for (s, e, _), (x, y) in zip(both[len(base) :], runs)]
            )
        yield out


SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"
SCANNED = f"doc_id bigint, spans {SPANS}, candidates array<struct<start:bigint,end:bigint,stratum:int,bin:int>>"


def stratum(length: int) -> int:
    return min(STRATA - 1, max(0, length.bit_length() - 5))


def bin_of(p: float) -> int:
    """The bin's upper edge is e^(-bin/4): p-values are rounded up."""
    return min(BINS - 1, int(-4 * math.log(p))) if p > 0 else BINS - 1


def dismissal_floors(histogram: dict[tuple[int, int], int], q: float) -> list[int]:
    """The lowest bin that is dismissed in each stratum (BINS: none)."""
    floors = []
    for s in range(STRATA):
        counts = [histogram.get((s, b), 0) for b in range(BINS)]
        m, below, floor = sum(counts), 0, BINS
        random = min(1.0, (1 + sum(counts[:UPPER])) / ((1 - LAMBDA) * m)) if m else 1.0
        for b in range(BINS - 1, UPPER - 1, -1):
            below += counts[b]
            if counts[b] and random * m * math.exp(-b / 4) <= q * below:
                floor = b
        floors.append(floor)
    return floors


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def scan_secrets(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """doc_id, base and found spans (code points, end exclusive) as an array of (start, end, kind) structs.

    q: the share of random strings among those dismissed as ordinary, in each stratum of lengths.
    """
    scanned = settled(map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), _scan, SCANNED))
    counted = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    floors = F.array(*map(F.lit, dismissal_floors({(r[0], r[1]): r[2] for r in counted}, q)))
    random = F.filter("candidates", lambda c: c.bin < F.element_at(floors, c.stratum + 1))
    found = F.transform(random, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), F.lit(KINDS.index("random")).alias("kind")))
    return scanned.select("doc_id", F.array_sort(F.concat("spans", found)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of scan_secrets' spans."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for row in b["spans"]:
                spans = [(x["start"], x["end"], x["kind"]) for x in row]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[2] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined([x for x in spans if x[2] < 3]).encode()).hexdigest())
                out["spans"].append(joined(spans))
            yield {"doc_id": b["doc_id"]} | out

    return map_rows(
        found,
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )


def redact(docs: DataFrame, placeholder: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span replaced; overlapping spans give one placeholder.  n_chars, if there, follows the text.

    Spans are joined by a hash of id and text, so that rows of one id keep their own.
    """
    key = F.xxhash64("doc_id", "text")
    named = docs.select(key.alias("doc_id"), "text")
    spans = scan_secrets(named, **options).where(F.size("spans") > 0).groupBy("doc_id").agg(F.min("spans")).toDF("_key", "_spans")
    spans = settled(spans)
    if (spans.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    marked = docs.withColumn("_key", key).join(spans, "_key", "left")
    target = StructType([f for f in docs.schema.fields])

    def run(batches):
        for b in batches:
            found, texts = b.column("_spans").to_pylist(), b.column("text").to_pylist()
            changed = [i for i, x in enumerate(found) if x]
            for i in changed:
                out, at, text = [], 0, texts[i]
                for s in found[i]:
                    if s["start"] >= at:
                        out += [text[at : s["start"]], placeholder]
                    at = max(at, s["end"])
                texts[i] = "".join(out) + text[at:]
            columns = {n: b.column(n) for n in target.names}
            columns["text"] = pa.array(texts, b.column("text").type)
            if "n_chars" in columns:
                n = columns["n_chars"].to_pylist()
                for i in changed:
                    n[i] = len(texts[i])
                columns["n_chars"] = pa.array(n, b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=target.names)

    return small_batches(marked).mapInArrow(run, target)
