"""Exact removal of repeated passages behind a count-min prefilter.

A window is ``window`` consecutive words of a document; a word goes if a window over it has the word
sequence of a window that starts anywhere else.  Documents are dealt into chunks of bounded bytes by a
hash of their row; each chunk works with windows' hashes, rolled over all its words at once.

1. Every chunk sketches its windows: DEPTH rows of saturating counters.  The sketch is cut into shards, each
   with 2^WIDTH_BITS counters for about 2^COARSE x LOAD windows of the corpus, so its size follows the input
   and no task ever holds the whole.  A partition sketch is sparse: sorted distinct counters as gaps.  Shards are
   large, since each chunk sends a row to each.
2. Shards merge: one group adds up its partition sketches and answers each chunk with a bit a counter: two or more.
   Counters only overestimate, so a window whose least counter is one is unique: none is lost.
3. The windows estimated repeated are grouped exactly by 128-bit hashes of their words, distinct within a chunk
   before they travel, and answered alike.
4. Chunks mark the repeated windows' words and join the rest.

Chunk and shard groups have bounded sizes whatever is common: a window in a third of all rows sends one counter
from each chunk.  The documents' shuffle is planned once and read by all three passes over the chunks.

Null and empty texts have no words; texts shorter than a window keep all; equal rows are different places, so
their windows repeat; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_table, pieces, small_batches, space_words, text_bytes

WIDTH_BITS, DEPTH = 25, 2
#: Windows that an exact group takes, before those that are estimated unique go; a shard of the sketch takes 2^COARSE times as many.
LOAD, COARSE = 1 << 20, 3
CHUNK_BYTES = 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: powers have inverses modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

SKETCH = "shard int, row int, chunk bigint, counters binary, twice binary"
ANSWER = "chunk bigint, stage int, shard int, row int, bits binary"
EXACT = "shard int, chunk bigint, digests binary, twice binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


class Chunk:
    """Words and window hashes of a chunk's documents."""

    def __init__(self, texts, window: int, hashes: int):
        self.words = [space_words(t) for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        total = int(self.lengths.sum())
        ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        flat = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(self.words)), np.int64, total)
        ends = np.cumsum(self.lengths)
        # Starts of windows: all places but the last window - 1 of each document.
        left = np.repeat(ends, self.lengths) - np.arange(total)
        self.starts = np.nonzero(left >= window)[0]
        self.total, self.window, self.hash = total, window, []
        if len(self.starts):
            digests = [xxhash.xxh3_128_intdigest(w) for w in ids]
            with np.errstate(over="ignore"):
                up = np.cumprod(np.full(total, BASE, np.uint64))
                down = np.cumprod(np.full(total, INVERSE, np.uint64))
                for k in range(hashes):
                    word = np.array([(d >> (64 * k)) & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word[flat] * up)))
                    h = (sums[self.starts + window] - sums[self.starts]) * down[self.starts]
                    h ^= h >> np.uint64(32)
                    h *= MIX[k]
                    self.hash.append(h ^ (h >> np.uint64(29)))
        else:
            self.hash = [np.zeros(0, np.uint64)] * hashes

    def counters(self, bits: int, row: int) -> np.ndarray:
        """shard << WIDTH_BITS | counter of each window in a row of the sketch.  bits: those of exact groups."""
        h, bits = self.hash[0], max(0, bits - COARSE)
        shard = (h >> np.uint64(64 - bits)) if bits else np.zeros_like(h)
        with np.errstate(over="ignore"):
            own = h >> np.uint64(4) if row == 0 else (h * MIX[1]) >> np.uint64(32)
        return ((shard << np.uint64(WIDTH_BITS)) | (own & np.uint64((1 << WIDTH_BITS) - 1))).astype(np.int64)


def gaps(sorted_values: np.ndarray) -> bytes:
    d = np.diff(sorted_values, prepend=0)
    return b"\x02" + d.astype("<u2").tobytes() if d.max(initial=0) < 1 << 16 else b"\x04" + d.astype("<u4").tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)


def _unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n)


def _cut(keys: np.ndarray, shards: int, shift: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(shards + 1, dtype=np.int64) << shift)


def _order(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both hashes, and where a new pair begins in it."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def sketch_chunk(chunk_id: int, chunk: Chunk, bits: int) -> dict:
    out = {k: [] for k in ("shard", "row", "chunk", "counters", "twice")}
    for row in range(DEPTH):
        keys, n = np.unique(chunk.counters(bits, row), return_counts=True)
        edges = _cut(keys, 1 << max(0, bits - COARSE), WIDTH_BITS)
        for s in np.nonzero(np.diff(edges))[0].tolist():
            a, b = edges[s], edges[s + 1]
            out["shard"].append(s)
            out["row"].append(row)
            out["chunk"].append(chunk_id)
            out["counters"].append(gaps(keys[a:b] - (s << WIDTH_BITS)))
            out["twice"].append(np.packbits(n[a:b] > 1).tobytes())
    return out


def merge_shard(group: pa.Table) -> pa.Table:
    """Adds up a shard's partition sketches (saturating at two) and answers each."""
    counts = np.zeros(1 << WIDTH_BITS, np.uint8)
    rows = group.select(["shard", "row", "chunk", "counters", "twice"]).to_pydict()
    for c, t in zip(rows["counters"], rows["twice"]):
        at = from_gaps(c)
        counts[at] = np.minimum(2, counts[at] + 1 + _unpack(t, len(at)))
    bits = [np.packbits(counts[from_gaps(c)] >= 2).tobytes() for c in rows["counters"]]
    return flat_table({k: rows[k] for k in ("chunk", "shard", "row")} | {"stage": [0] * len(bits), "bits": bits}, ANSWER)


def estimated(chunk: Chunk, bits: int, answers: dict) -> np.ndarray:
    """Indices of the windows whose counters are all two or more."""
    found = np.ones(len(chunk.starts), bool)
    for row in range(DEPTH):
        keys, back = np.unique(chunk.counters(bits, row), return_inverse=True)
        flags = np.zeros(len(keys), np.uint8)
        edges = _cut(keys, 1 << max(0, bits - COARSE), WIDTH_BITS)
        for s in np.nonzero(np.diff(edges))[0].tolist():
            flags[edges[s] : edges[s + 1]] = _unpack(answers[0, s, row], edges[s + 1] - edges[s])
        found &= flags[back] > 0
    return np.nonzero(found)[0]


def _distinct(chunk: Chunk, at: np.ndarray):
    h1, h2 = chunk.hash[0][at], chunk.hash[1][at]
    order, new = _order(h1, h2)
    return h1, h2, order, np.nonzero(new)[0], np.cumsum(new) - 1


def _shards(h1: np.ndarray, bits: int) -> np.ndarray:
    s = (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
    return np.searchsorted(s, np.arange((1 << bits) + 1))


def exact_rows(chunk_id: int, chunk: Chunk, bits: int, answers: dict) -> dict:
    out = {k: [] for k in ("shard", "chunk", "digests", "twice")}
    at = estimated(chunk, bits, answers)
    h1, h2, order, first, _ = _distinct(chunk, at)
    n = np.diff(np.append(first, len(at)))
    pairs = np.column_stack((h1[order][first], h2[order][first]))
    edges = _shards(pairs[:, 0], bits)
    for s in np.nonzero(np.diff(edges))[0].tolist():
        a, b = edges[s], edges[s + 1]
        out["shard"].append(s)
        out["chunk"].append(chunk_id)
        out["digests"].append(pairs[a:b].astype("<u8").tobytes())
        out["twice"].append(np.packbits(n[a:b] > 1).tobytes())
    return out


def group_exactly(group: pa.Table) -> pa.Table:
    rows = group.select(["shard", "chunk", "digests", "twice"]).to_pydict()
    sizes = [len(d) // 16 for d in rows["digests"]]
    pairs = np.frombuffer(b"".join(rows["digests"]), "<u8").reshape(-1, 2)
    n = 1 + np.concatenate([_unpack(t, k) for t, k in zip(rows["twice"], sizes)]).astype(np.int64)
    order, new = _order(pairs[:, 0], pairs[:, 1])
    which = np.cumsum(new) - 1
    repeated = np.zeros(len(order), bool)
    repeated[order] = (np.bincount(which, weights=n[order]) >= 2)[which]
    ends = np.cumsum(sizes)
    bits = [np.packbits(repeated[e - k : e]).tobytes() for e, k in zip(ends.tolist(), sizes)]
    return flat_table({"chunk": rows["chunk"], "stage": [1] * len(bits), "shard": rows["shard"], "row": [0] * len(bits), "bits": bits}, ANSWER)


def remove_repeats(chunk: Chunk, bits: int, answers: dict, doc_ids: list) -> dict:
    at = estimated(chunk, bits, answers)
    h1, _, order, first, which = _distinct(chunk, at)
    firsts = h1[order][first]
    flags = np.zeros(len(first), np.uint8)
    edges = _shards(firsts, bits)
    for s in np.nonzero(np.diff(edges))[0].tolist():
        flags[edges[s] : edges[s + 1]] = _unpack(answers[1, s, 0], edges[s + 1] - edges[s])
    starts = chunk.starts[at[order][flags[which] > 0]]
    change = np.zeros(chunk.total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + chunk.window, -1)
    gone = np.cumsum(change)[:-1] > 0
    out, end = {"doc_id": doc_ids, "n_words": chunk.lengths.tolist(), "n_removed": [], "kept": []}, 0
    for words in chunk.words:
        own = gone[end : end + len(words)]
        end += len(words)
        removed = int(own.sum())
        out["n_removed"].append(removed)
        kept = words if not removed else itertools.compress(words, (~own).tolist())
        out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
    return out


def _answers(table: pa.Table) -> dict:
    r = table.to_pydict()
    return {(st, s, w): b for st, s, w, b in zip(r["stage"], r["shard"], r["row"], r["bits"])}


def remove_repeated_passages(docs: DataFrame, window: int = 35, chunk_bytes: int = CHUNK_BYTES, load: int = LOAD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space) of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    _, size = text_bytes(docs)
    chunks = pieces(size, chunk_bytes)
    bits = max(0, (pieces(size // 6, load) - 1).bit_length())
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    by_chunk = small_batches(dealt).groupBy("chunk")

    def sketch(t: pa.Table) -> pa.Table:
        return flat_table(sketch_chunk(t["chunk"][0].as_py(), Chunk(t["text"].to_pylist(), window, 1), bits), SKETCH)

    counted = by_chunk.applyInArrow(sketch, SKETCH).groupBy("shard", "row").applyInArrow(merge_shard, ANSWER)

    def candidates(t: pa.Table, a: pa.Table) -> pa.Table:
        return flat_table(exact_rows(t["chunk"][0].as_py(), Chunk(t["text"].to_pylist(), window, 2), bits, _answers(a)), EXACT)

    exact = by_chunk.cogroup(counted.groupBy("chunk")).applyInArrow(candidates, EXACT).groupBy("shard").applyInArrow(group_exactly, ANSWER)

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        return flat_table(remove_repeats(Chunk(t["text"].to_pylist(), window, 2), bits, _answers(a), t["doc_id"].to_pylist()), RESULT)

    return by_chunk.cogroup(counted.unionByName(exact).groupBy("chunk")).applyInArrow(finish, RESULT)
