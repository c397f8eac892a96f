"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose document frequency, over all documents, lies within a band of shares of them
(LEAST_SHARE to MOST_SHARE; idf between log(1/MOST_SHARE) and log(1/LEAST_SHARE)).  It has at most
(mean distinct terms a document) / LEAST_SHARE terms whatever the corpus, which bounds its broadcast; the number is checked.
A text keeps its distinct terms in the band, sorted (one without any such term keeps all its terms).  Its fingerprint is the
64-bit hash of that whole list, then 32-bit hashes of what each of SUBSETS random sub-lexicons at each rate of RATES selects from it
(0: nothing).  Sub-lexicons that keep much of the lexicon only agree for texts that are nearly equal; the sparse ones, which select
few terms of a text, still agree for texts that share half of theirs.

Likeness of two fingerprints: at each rate the share of equal hashes among the sub-lexicons that select something from
either text, with two added to their number so that few selections count for less; the greatest over the
rates.  Equal fingerprints: 1.

The next document, ascending id, comes from range buckets with explicit bounds: rows are sorted within a bucket (by Spark, which
spills) and streamed, and the few bucket edges are paired apart.  Texts are shuffled once.

Null texts are empty; a text without terms has the fingerprint of zeros; ties of ids are ordered by text, null first; of
one row alone the next is itself; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FLAT, alnum_words, map_rows, pieces, settled, small_batches, text_bytes, tidy

LEAST_SHARE, MOST_SHARE, MAX_LEXICON = 0.0005, 0.1, 1 << 24
RATES, SUBSETS = (1 / 4, 1 / 16, 1 / 64, 1 / 256), 32
#: Beyond so many buckets they grow instead.
MAX_BUCKETS = 20_000
BUCKET_BYTES, CACHE, CACHE_BYTES = 4 << 20, 200_000, 16 << 20
SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, len(RATES) * SUBSETS, dtype=np.uint64) | np.uint64(1)
LIMITS = np.repeat(np.array([int(r * (1 << 32)) for r in RATES], np.uint64), SUBSETS)
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    total = docs.count()

    def run(batches):
        n: dict[bytes, int] = defaultdict(int)
        size = 0
        for b in batches:
            for text in b["text"]:
                for w in set(alnum_words(text)):
                    if w not in n:
                        size += len(w)
                    n[w] += 1
            if len(n) > CACHE or size > CACHE_BYTES:
                yield from _rows(n)
                n.clear()
                size = 0
        yield from _rows(n)

    df = map_rows(docs.select("text"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    chosen = settled(df.where((F.col("n") >= least * total) & (F.col("n") <= most * total)).select("term"))
    if (size := chosen.count()) > MAX_LEXICON:
        raise ValueError(f"{size} terms in the band; a greater least share keeps fewer")
    band = chosen.toPandas()
    return np.sort(band.term.to_numpy(np.int64).view(np.uint64))


def _rows(n: dict):
    items = list(n.items())
    for at in range(0, len(items), 50_000):
        part = items[at : at + 50_000]
        yield {"term": np.array([term(w) for w, _ in part], np.uint64).view(np.int64).tolist(), "n": [k for _, k in part]}


class Fingerprinter:
    def __init__(self, band: np.ndarray):
        self.band, self.known, self.size = band, {}, 0

    def terms(self, text: str) -> np.ndarray:
        """Sorted hashes of the terms that a text keeps."""
        words, known = set(alnum_words(text)), self.known
        if len(known) > CACHE or self.size > CACHE_BYTES:
            known.clear()
            self.size = 0
        for w in words.difference(known):
            known[w] = term(w)
            self.size += len(w)
        h = np.sort(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        if len(self.band) and len(h):
            at = np.minimum(np.searchsorted(self.band, h), len(self.band) - 1)
            kept = h[self.band[at] == h]
            if len(kept):
                return kept
        return h

    def __call__(self, text: str) -> np.ndarray:
        h, out = self.terms(text), np.zeros(len(SEEDS) + 2, np.uint32)
        if not len(h):
            return out
        whole = xxhash.xxh3_64_intdigest(h.tobytes())
        out[:2] = whole >> 32 or 1, whole & 0xFFFFFFFF or 1
        with np.errstate(over="ignore"):
            x = (h[None, :] ^ (h[None, :] >> np.uint64(31))) * SEEDS[:, None]
        chosen = (x >> np.uint64(32)) < LIMITS[:, None]
        for j in np.nonzero(chosen.any(axis=1))[0].tolist():
            out[j + 2] = xxhash.xxh3_64_intdigest(h[chosen[j]].tobytes()) >> 32 or 1
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if (a == b).all():
        return 1.0
    a, b = (x[2:].reshape(len(RATES), SUBSETS) for x in (a, b))
    used, equal = ((a > 0) | (b > 0)).sum(axis=1), ((a == b) & (a > 0)).sum(axis=1)
    return float((equal / (used + 2)).max())


def hexed(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucketed(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, bucket: ascending ranges of ids, of about as many bytes each.  Null ids are in the first."""
    n = min(MAX_BUCKETS, pieces(text_bytes(docs)[1], bucket_bytes))
    shares = [i / n for i in range(1, n)]
    bounds = np.unique(np.array((docs.agg(F.percentile_approx("doc_id", shares, min(100 * n, 100_000))).first()[0] if shares else None) or [], np.int64))
    schema = "doc_id bigint, text string, bucket int"

    def run(batches):
        for b in batches:
            ids = np.array(b.column("doc_id").fill_null(np.iinfo(np.int64).min), np.int64)
            at = np.searchsorted(bounds, ids, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(at)], names=["doc_id", "text", "bucket"])

    return small_batches(docs).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """RESULT's rows."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs))
    dealt = bucketed(docs, bucket_bytes)
    target = pa.schema([(n, FLAT[t]) for n, t in map(str.split, RESULT.split(","))])

    def pairs(rows):
        """Judges (doc_id, text, next text)."""
        f, last = Fingerprinter(sent.value), (None, None)
        out = {n: [] for n in target.names}
        for i, text, following in rows:
            own = last[1] if last[0] == text else f(text)
            then, new = f(following), edited(text, following)
            last, changed = (following, then), f(new)
            for n, x in zip(out, (i, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own), hexed(changed), likeness(own, changed), likeness(own, then))):
                out[n].append(x)
            if len(out["doc_id"]) >= 2000:
                yield pa.RecordBatch.from_pydict(out, schema=target)
                out = {n: [] for n in target.names}
        yield pa.RecordBatch.from_pydict(out, schema=target)
        tidy()

    def inside(batches):
        """All but each bucket's last row, from sorted partitions of whole buckets."""

        def rows():
            before = None
            for b in batches:
                for bucket, i, text in zip(*(b.column(n).to_pylist() for n in ("bucket", "doc_id", "text"))):
                    if before and before[0] == bucket:
                        yield before[1], before[2], text or ""
                    before = (bucket, i, text or "")

        yield from pairs(rows())

    def given(batches):
        def rows():
            for b in batches:
                for i, text, following in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "following"))):
                    yield i, text or "", following or ""

        yield from pairs(rows())

    within = dealt.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text").mapInArrow(inside, RESULT)
    row = F.struct("doc_id", "text")
    # Partial minima and maxima before any shuffle: two rows a bucket and task travel.
    edges = settled(dealt.groupBy("bucket").agg(F.min(row).alias("head"), F.max(row).alias("tail")))
    # Which bucket follows is settled on their numbers alone, which are narrow; the texts join by them.
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = edges.select("bucket").select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(everything)).alias("after"))
    tails = edges.select("bucket", F.col("tail.doc_id").alias("doc_id"), F.col("tail.text").alias("text")).join(numbers, "bucket")
    joints = tails.join(edges.select(F.col("bucket").alias("after"), F.col("head.text").alias("following")), "after").select("doc_id", "text", "following")
    return within.unionByName(joints.mapInArrow(given, RESULT))
