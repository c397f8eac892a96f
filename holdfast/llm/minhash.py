"""Near-duplicate classes by one-permutation MinHash and banded buckets.

A document's set holds the distinct ``shingle``-word shingles of its text (the whole of a shorter one).

1. Documents of equal sets are one class from the start; the rest works on one representative each.
2. A set's signature takes BINS minima of one hash; empty bins borrow from random others until they meet a full
   one (optimal densification).  BANDS buckets of ROWS bins each give candidates: a pair at similarity 0.8
   misses all of them with probability (1 - 0.8^5)^40, about 1e-7.
3. In each bucket the member that meets most others in all buckets is the centre of a star: candidate edges
   are bounded by members.  Edges pass a bound on sizes, then the exact test on full sets.
4. What stars can't say is settled exactly.  In buckets of three or more that still hold several components, members
   outside the bucket's largest component meet each other, and once, not bucket by bucket, all members of that
   component.  They meet in blocks of about BLOCK rows a side, with their full sets; only links leave a block.
5. Components come from alternating large and small stars over the verified links, each round checkpointed.

Copies never multiply: equal sets meet in a partial minimum, groups of near copies in their stars.  Links between
different sets are lost only by step 2's probability.

Null and empty texts, and those without words, have no set and link with nothing.  A row of null id has a null
component and is not kept.  Repeated ids: each row takes the class of its own set.  Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_table, map_rows, settled

BINS, BANDS, ROWS = 200, 40, 5
BLOCK, BROADCAST_ROWS, CACHE, CACHE_BYTES = 512, 1 << 21, 200_000, 16 << 20
SETS = "doc_id bigint, n bigint, h1 bigint, h2 bigint, signature binary"
_rng = np.random.default_rng(977)
#: For each bin a random order of all bins: where it borrows from when it is empty.
PROBES = np.stack([_rng.permutation(BINS) for _ in range(BINS)], axis=1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, shingle: int):
        self.shingle, self.known, self.size = shingle, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > CACHE or self.size > CACHE_BYTES:
            known.clear()
            self.size = 0
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
            self.size += len(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.shingle, len(h))
        with np.errstate(over="ignore"):
            x = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                x = (x ^ h[i : len(h) - k + 1 + i]) * C1
                x ^= x >> np.uint64(29)
            x *= C3
            x ^= x >> np.uint64(32)
        return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(BINS, 1 << 32, np.uint64)
    np.minimum.at(out, (((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64), s & np.uint64(0xFFFFFFFF))
    full = out < 1 << 32
    if not full.all():
        value, empty = out.copy(), ~full
        for probe in PROBES:
            take = empty & full[probe]
            out[take] = value[probe[take]]
            empty &= ~take
            if not empty.any():
                break
    return out.astype(np.uint32)


def band_keys():
    """Keys of a signature's bands: hashes of ROWS bins of 16 bits each, and of the band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring(F.col("signature"), k * (2 * ROWS) + 1, F.lit(2 * ROWS)), k))


def described(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        f = Shingler(shingle)
        for b in batches:
            out = {k: [] for k in ("doc_id", "n", "h1", "h2", "signature")}
            for i, text in zip(b["doc_id"], b["text"]):
                s = f(text)
                out["doc_id"].append(i)
                out["n"].append(len(s))
                if len(s) and i is not None:
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    out["h1"].append(int.from_bytes(d[:8], "little", signed=True))
                    out["h2"].append(int.from_bytes(d[8:], "little", signed=True))
                    out["signature"].append(signature(s).astype("<u2").tobytes())
                else:
                    for k in ("h1", "h2", "signature"):
                        out[k].append(None)
            yield out

    return map_rows(docs.select("doc_id", "text"), run, SETS)


def of_like_size(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold."""
    n = reps.select("doc_id", "n")
    both = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id, s (the sorted set's bytes) of the documents of the given ids."""
    some = ids.distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    texts = docs.select("doc_id", "text").join(some, "doc_id", "left_semi")

    def sets(batches):
        f = Shingler(shingle)
        for b in batches:
            yield {"doc_id": b["doc_id"], "s": [f(t).astype("<u8").tobytes() for t in b["text"]]}

    return map_rows(texts, sets, "doc_id bigint, s binary", rows=256).where(F.octet_length("s") > 0)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    full = full_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), shingle)
    both = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")

    def run(batches):
        for b in batches:
            keep = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(b["sa"], b["sb"])]
            yield {k: [x for x, ok in zip(b[k], keep) if ok] for k in "ab"}

    return map_rows(both, run, "a bigint, b bigint", rows=512).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of all nodes of links (a, b)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before = settled(edges), None
    while True:  # the number of rounds grows as the logarithm of the nodes
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == before or not now[0]:
            break
        before = now
        # Large star: each node's greater neighbours move to its least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lesser neighbours move to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least)
        edges = settled(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (key, doc_id, component) of two sides, dealt so that any left and right row of a key meet in one (key, i, j).

    A side is split by a hash into parts of about BLOCK rows and copied once for each part of the other.
    """

    def parts(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    n = parts(left, "n_left").join(parts(right, "n_right"), "key")
    own = F.xxhash64("doc_id")

    def deal(x: DataFrame, side: int, mine: str, other: str) -> DataFrame:
        part, copy = F.pmod(own, F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        i, j = (part, copy) if side == 0 else (copy, part)
        return x.join(n, "key").select("key", "doc_id", "component", F.lit(side).alias("side"), i.alias("i"), j.alias("j"))

    return deal(left, 0, "n_left", "n_right").unionByName(deal(right, 1, "n_right", "n_left"))


def remaining(rows: DataFrame, found: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket of three or more."""
    labelled = rows.where("members > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", F.negative("component").alias("c"))).alias("top"), F.count(F.lit(1)).alias("kinds"))
    mixed = settled(mixed.where("kinds > 1").select("key", F.negative("top.c").alias("top"), F.col("top.size").alias("size")))
    dealt = settled(labelled.join(mixed, "key"))
    # Outsiders meet each other bucket by bucket, and all of the component that fills most of their bucket once.
    outside = dealt.where("component != top or size = 1").select("key", "doc_id", "component")
    meets = dealt.where("component != top and size > 1").select(F.col("top").alias("key"), "doc_id", "component").distinct()
    whole = found.select(F.col("component").alias("key"), F.col("node").alias("doc_id")).union(meets.select("key", F.col("key").alias("doc_id")).distinct())
    whole = whole.join(meets.select("key").distinct(), "key", "left_semi").select("key", "doc_id", F.col("key").alias("component"))
    each = blocks(outside, outside).withColumn("kind", F.lit(0)).unionByName(blocks(meets, whole).withColumn("kind", F.lit(1)))
    each = settled(each)
    full = full_sets(docs, each.select("doc_id"), shingle)

    def meet(t: pa.Table) -> pa.Table:
        side, ids, comp = (t[c].to_numpy() for c in ("side", "doc_id", "component"))
        sets = [np.frombuffer(x, "<u8") for x in t["s"].to_pylist()]
        n = np.array([len(x) for x in sets])
        both_ways = t["kind"][0].as_py() == 0
        out = {"a": [], "b": []}
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        if len(left) and len(right):
            # Shingles by number: one left set is marked, and each right set counts its marked ones.
            values, flat = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
            starts, marked = np.cumsum(n[right]) - n[right], np.zeros(len(values), np.int32)
            for x in left.tolist():
                at = np.minimum(np.searchsorted(values, sets[x]), len(values) - 1)
                at = at[values[at] == sets[x]]
                marked[at] = 1
                shared = np.add.reduceat(marked[flat], starts)
                marked[at] = 0
                linked = (comp[right] != comp[x]) & (100 * shared >= percent * (n[x] + n[right] - shared))
                if both_ways:
                    linked &= ids[right] > ids[x]
                for z in right[linked].tolist():
                    out["a"].append(min(ids[x], ids[z]))
                    out["b"].append(max(ids[x], ids[z]))
        return flat_table(out, "a bigint, b bigint")

    return each.join(full, "doc_id").groupBy("kind", "key", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    sets = settled(described(docs, shingle))
    # One row a set: equal sets meet in partial minima, so a set that many documents have costs a row a task.
    least = sets.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "signature")).alias("x"))
    reps = settled(least.select("h1", "h2", "x.*"))
    classes = reps.select("h1", "h2", F.col("doc_id").alias("rep"))
    reps = reps.select("doc_id", "n", "signature")
    banded = reps.select("doc_id", F.explode(band_keys()).alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = settled(shared)  # apart from its join, which Spark can then split where a bucket is large
    rows = settled(banded.join(shared, "key"))
    met = rows.groupBy("doc_id").agg(F.sum("members").alias("met"))
    centres = rows.join(met, "doc_id").groupBy("key").agg(F.max(F.struct("met", F.negative("doc_id").alias("c"))).alias("top"))
    centres = settled(centres.select("key", F.negative("top.c").alias("centre")))
    stars = rows.join(centres, "key").where("doc_id != centre")
    stars = stars.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    links = settled(verified(settled(of_like_size(stars, reps, percent)), docs, shingle, percent))
    found = components(links)
    more = settled(remaining(rows, found, docs, shingle, percent))
    if not more.isEmpty():
        found = components(links.union(more))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component_id")
    )
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
