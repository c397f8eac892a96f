"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item's windows (``window`` consecutive words; a shorter item is one window) are sets of
positioned shingles of ``shingle`` words.  All of a window's shingles must occur, so by the prefix
filter the one that is rarest in the documents is enough as its signature: documents are probed for those
alone.  A probe at word p for a shingle at offset o of a window of n words is kept if p - o >= 0
and p - o + n <= words of the document (positional and length bounds), then verified word by word.

Two passes over the documents, neither of which shuffles them: one counts the benchmark's own shingles
in all documents (partial counts per task, then a sum of at most the benchmark's shingles), one joins.
The benchmark's windows are broadcast in blocks of ``block_bytes``, a measured bound; a larger benchmark is a
stated query set taken block by block, and the blocks' hits are merged by document.

Nulls and texts without words have no hits and no windows; an item of null id hits words as any other, but can't be listed or
counted in n_items; repeated items of one id count once in n_items; repeated document rows give a row each (they are told apart by an internal row key when blocks merge);
an empty benchmark contaminates nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_rows

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, hits array<struct<start:int,end:int>>"
#: Python takes about this many bytes for each byte of a window's words in the index.
INDEX_FACTOR = 8


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def shingles(words, n: int) -> list[bytes]:
    """Shingles of n words, or the whole of a shorter window, as strings with a mark of their width."""
    n = min(n, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def count_shingles(docs: DataFrame, blocks: list[dict], shingle: int) -> list[dict[bytes, int]]:
    """Occurrences in all documents of each block's shingles; of widths 1 to shingle, as windows need them."""
    spark, out = docs.sparkSession, []
    for block in blocks:
        wanted = {s for w in block for s in shingles(w, shingle)}
        widths = sorted({s.count(b" ") + 1 for s in wanted})
        first = {s.split(b" ")[0] for s in wanted}
        sent = spark.sparkContext.broadcast((wanted, widths, first))

        def run(batches, sent=sent):
            wanted, widths, first = sent.value
            n: dict[bytes, int] = defaultdict(int)
            for b in batches:
                for text in b["text"]:
                    words = alnum_words(text)
                    for i in [i for i, w in enumerate(words) if w in first]:
                        for k in widths:
                            s = b" ".join(words[i : i + k])
                            if s in wanted:
                                n[s] += 1
            yield {"shingle": list(n), "n": list(n.values())}

        counted = map_rows(docs.select("text").where("text is not null"), run, "shingle binary, n bigint")
        out.append({bytes(r[0]): r[1] for r in counted.groupBy("shingle").agg(F.sum("n")).collect()})
    return out


def prefix_index(block: dict, counts: dict[bytes, int], shingle: int) -> dict:
    """Rarest shingle -> [(offset, window, item ids)].  Ties: the smaller shingle, then the earlier place."""
    index = defaultdict(list)
    for w, items in block.items():
        _, rare, at = min((counts.get(s, 0), s, i) for i, s in enumerate(shingles(w, shingle)))
        if counts.get(rare, 0):  # else the window occurs nowhere
            index[rare].append((at, list(w), items))
    return dict(index)


def probe(words: list[bytes], index: dict, widths: list[int], first: set[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Verified (start, end) hits, ends exclusive and merged, and the items they come from."""
    hits, items = [], set()
    for i in [i for i, w in enumerate(words) if w in first]:
        for k in widths:
            for at, w, ids in index.get(b" ".join(words[i : i + k]), ()) if i + k <= len(words) else ():
                start = i - at
                if start >= 0 and start + len(w) <= len(words) and words[start : start + len(w)] == w:
                    hits.append((start, start + len(w)))
                    items.update(ids)
    return merged(hits), items


def merged(hits) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def window_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[dict]:
    """The benchmark's distinct windows with their item ids, in blocks of bounded memory.

    Read item by item to the driver (toLocalIterator), which holds one stated query set.
    """
    blocks, size = [{}], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        for w in item_windows(alnum_words(r.text), window):
            if size > block_bytes:
                blocks.append({})
                size = 0
            if w not in blocks[-1]:
                size += INDEX_FACTOR * (sum(map(len, w)) + 16 * len(w))
            blocks[-1].setdefault(w, set()).update([] if r.item_id is None else [str(r.item_id)])
    return blocks


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 64 << 20
) -> DataFrame:
    """One row a document: RESULT's columns; items sorted as strings; hits are merged word ranges."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    blocks = window_blocks(benchmark, window, block_bytes)
    counts = count_shingles(docs, blocks, shingle)
    if len(blocks) > 1:
        docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    parts = []
    for block, n in zip(blocks, counts):
        index = prefix_index(block, n, shingle)
        sent = spark.sparkContext.broadcast(
            (index, sorted({s.count(b" ") + 1 for s in index}), {s.split(b" ")[0] for s in index})
        )

        def run(batches, sent=sent):
            for b in batches:
                out = {"doc_id": b["doc_id"], "n_words": [], "n_hit": [], "n_items": [], "items": [], "hits": []}
                for text in b["text"]:
                    words = alnum_words(text)
                    hits, items = probe(words, *sent.value)
                    out["n_words"].append(len(words))
                    out["n_hit"].append(sum(e - s for s, e in hits))
                    out["n_items"].append(len(items))
                    out["items"].append(sorted(items))
                    out["hits"].append([{"start": s, "end": e} for s, e in hits])
                yield out | ({"key": b["key"]} if "key" in b else {})

        parts.append(map_rows(docs, run, RESULT + (", key bigint" if len(blocks) > 1 else "")))
    if len(parts) == 1:
        return parts[0]
    return _merge(parts)


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Hits of a document in all blocks.  A row is told from its equals by its number among them."""
    from pyspark.sql import Window

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    copies = every.groupBy("key", "doc_id").agg(
        F.first("n_words").alias("n_words"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
    )

    def run(batches):
        for b in batches:
            b["hits"] = [merged((x["start"], x["end"]) for x in h) for h in b["hits"]]
            b["n_hit"] = [sum(e - s for s, e in h) for h in b["hits"]]
            b["hits"] = [[{"start": s, "end": e} for s, e in h] for h in b["hits"]]
            b["n_items"] = [len(x) for x in b["items"]]
            yield {k: b[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items", "hits", "copies")}

    out = map_rows(copies, run, RESULT + ", copies int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
