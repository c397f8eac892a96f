"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document's ids end with END_ID; only documents longer than ``capacity`` are cut, into full pieces and a rest.  Full
pieces are sequences of their own.  The others are placed, longest first, where the sum of the squared counts of
open bins per residual gap becomes smallest; an exactly filled bin leaves the count, a new bin joins it.
Ties go to the smallest gap left, then to the bin opened first.

Places are chosen within groups: pieces are dealt by a hash of their document into groups of about GROUP documents, whose
number follows the input.  A group's waste is a few part-filled sequences against the thousands that it fills.  A group's pieces
are sorted by Spark and streamed, so that it is never held by a Python worker.
Where ids go along, they are kept as little-endian unsigned 32-bit numbers.

Null texts count as empty: one piece, END_ID alone.  Repeated rows are packed as often as they stand (equal rows are
told apart by their order in the group); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pieces, small_batches, tidy
from .word_bpe import CACHE, WordTokenizer

CAPACITY, END_ID, GROUP = 4096, 1, 1 << 16
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    return [ids[at : at + capacity] for at in range(0, len(ids), capacity)]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, remember: int = CACHE) -> DataFrame:
    """PIECES' rows (and ids) of every document.  tokenizer: the path of its file, as workers see it."""

    def run(batches):
        t = WordTokenizer.shared(tokenizer, remember)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | ({"ids": []} if with_ids else {})
            for i, ids in zip(b["doc_id"], t.ids(b["text"])):
                ids, start = np.append(ids, np.array([END_ID], "<u4")), 0
                for k, piece in enumerate(cut(ids, capacity)):
                    data = piece.astype("<u4").tobytes()
                    for name, x in (("doc_id", i), ("piece", k), ("start", start), ("length", len(piece)), ("ids_crc32", zlib.crc32(data)), ("ids", data)):
                        if name in out:
                            out[name].append(x)
                    start += len(piece)
            yield out

    return map_rows(docs, run, PIECES + (", ids binary" if with_ids else ""), rows=512)


class Packer:
    """Open bins of one group, by the gap that they still have."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.opened = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)  # gap 0 stays 0
        self.bins: dict[int, deque] = defaultdict(deque)
        self.gaps = np.arange(capacity + 1)

    def place(self, s: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        capacity, counts = self.capacity, self.counts
        if s >= capacity:
            self.opened += 1
            return self.opened - 1, 0
        # Moving a bin from gap g to g - s changes the sum of squares by 2 (N(g - s) - N(g)) + 2; closing it by -2 N(g) + 1;
        # opening one by 2 N(capacity - s) + 1.
        rest = self.gaps[: capacity - s + 1]
        change = 2 * (counts[rest] - counts[rest + s]) + 2
        change[0] = 1 - 2 * counts[s]
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if change[best] <= 2 * counts[capacity - s] + 1:
            gap = best + s
            counts[gap] -= 1
            b = self.bins[gap].popleft()
        else:
            gap, b, self.opened = capacity, self.opened, self.opened + 1
        if gap > s:
            counts[gap - s] += 1
            self.bins[gap - s].append(b)
        return b, capacity - gap


def pack_sizes(sizes, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in the order given, by the sum-of-squares rule."""
    packer = Packer(capacity)
    return [packer.place(int(s)) for s in sizes]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = True, remember: int = CACHE) -> DataFrame:
    """PLACED's rows, and each piece's ids if asked for."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    groups = pieces(docs.count(), group)
    done = tokenized(docs, tokenizer, capacity, with_ids, remember).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "length", "ids_crc32"), F.lit(groups))
    )
    # Spark sorts, and spills if it must; a task sees a group's pieces go by and keeps its bins alone.
    dealt = done.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    schema = PLACED + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(",")]

    def place(batches):
        now = packer = None
        for b in batches:
            where = []
            for g, s in zip(b.column("group").to_pylist(), b.column("length").to_pylist()):
                if g != now:
                    now, packer = g, Packer(capacity)
                k, offset = packer.place(s)
                where.append((k * groups + g, offset))
            columns = {n: b.column(n) for n in names if n in b.schema.names}
            columns["sequence_id"], columns["offset"] = (pa.array([x[i] for x in where], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
        tidy()

    return small_batches(dealt).mapInArrow(place, schema)
