"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

A word, lower-cased and closed by a space, is predicted byte by byte to its end, each byte from the ORDER - 1 bytes before it, or
from the word's whole beginning where that is shorter.  Each class k in (ordinary, toxic) has counts n_k(p) of such
strings p in documents' distinct words, over *all* labelled training rows; a byte c after p has

    P_k(c|p) = (max(n_k(pc) - D, 0) + D t_k(p) P(c|last two bytes of p)) / n_k(p),

t_k(p) the number of bytes that class saw after p.  The lower order is shared: P comes from continuation counts
(distinct strings that end so) over both classes together.  After a beginning that one class never showed, that class can only
back off to what both know, and so does the other: the two predictions are the same there and cancel.  So an expression is
judged where its beginning leaves what both classes say, once, and not again by each later byte of a rare word.  A word's
evidence is the sum of log P_toxic - log P_ordinary over its bytes; per-word means of it, which are length-normalised
log-likelihood differences, are taken over the best word, the best SPAN consecutive words and the whole text.
A logistic regression turns these three and the logarithm of the text's length, since a maximum grows with it, into a score.

Fitting uses labelled rows whose crc32(doc_id) mod 4 isn't 2.  The regression is fitted on a sample of at most
``calibration_rows`` of those with remainder 3, by evidence from counts of remainders 0 and 1 alone, so that it meets words as
unseen as the scored ones; the counts that score are over all three.  If the rows of remainder 3 lack a class, it is
fitted on all training rows by their own evidence.

The model is a distributed table of every string (a node) whose beginning both classes showed.  Documents are dealt, as numbers
of words beside compressed lists of words, to chunks of about CHUNK_BYTES of text; each chunk asks for the nodes its own words
have, and gets their part of the model by a join.  Texts don't travel.  A node (at most eight bytes, none of them zero, and shorter than eight only at a word's beginning) is
one number, exactly; a beginning followed by byte zero stands for all bytes unseen after it.  Labels are broadcast if their
measured size allows and joined by a shuffle if not.

Null and empty texts, and texts without words, have all evidence zero; rows with null id are scored, never
learnt; several labels of a row each count; if a class has no row, every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import gc
import math
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, map_rows, pieces, settled, small_batches, text_bytes, tidy

ORDER, SPAN, DISCOUNT = 8, 20, 0.75
BROADCAST_BYTES, LABEL_BYTES, CACHE, CACHE_BYTES, CHUNK_BYTES, BLOCK_BYTES, SLICE = 64 << 20, 32, 200_000, 16 << 20, 64 << 20, 4 << 20, 20_000
THRESHOLD = 0.3


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def words_of(text: str | None) -> list[bytes]:
    return alnum_words(text.lower()) if text else []


def _labelled(docs: DataFrame, labels: DataFrame, remainders: list[int]) -> DataFrame:
    labels = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    labels = labels.where(remainder().isin(remainders))
    if labels.count() * LABEL_BYTES <= BROADCAST_BYTES:
        labels = F.broadcast(labels)
    return docs.select(F.col("doc_id").cast("bigint"), "text").join(labels, "doc_id").select("doc_id", "text", "toxic")


def _packed(words: list[bytes]):
    """The nodes of words, one for each byte and the closing space, one after another, and the number that each word has."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    nodes = flat.copy()
    for j in range(1, ORDER):
        nodes[j:] |= np.where(place[j:] >= j, flat[:-j] << np.uint64(8 * j), np.uint64(0))
    return nodes.view(np.int64), lengths


def _count(batches):
    """Node counts of a partition by class and fold: words are counted first, so that nodes are cut once a word."""
    words: dict[bytes, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    size = 0
    for b in batches:
        for text, toxic, held in zip(b["text"], b["toxic"], b["held"]):
            slot = (toxic > 0) + 2 * held
            for w in set(words_of(text)):
                if w not in words:
                    size += len(w)
                words[w][slot] += 1
            if len(words) > CACHE or size > CACHE_BYTES:
                yield from _nodes(words)
                words.clear()
                size = 0
    yield from _nodes(words)


def _nodes(words):
    if not words:
        return
    nodes, lengths = _packed(list(words))
    keys, at = np.unique(nodes, return_inverse=True)
    counts = np.array(list(words.values()))
    sums = [np.bincount(at, np.repeat(counts[:, k], lengths), len(keys)).astype(np.int64) for k in range(4)]
    for i in range(0, len(keys), 50_000):
        yield {"node": keys[i : i + 50_000]} | {c: n[i : i + 50_000] for c, n in zip(("o", "t", "held_o", "held_t"), sums)}


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int = 20_000, seed: int = 7) -> dict:
    """A model: log ratios by node, as a table, and the regression's weights."""
    try:
        return _fitted(docs, labels, calibration_rows, seed)
    finally:  # its frames refer to its tables, whose shuffle files go only now, before documents are scored
        _release(docs)


def _fitted(docs: DataFrame, labels: DataFrame, calibration_rows: int, seed: int) -> dict:
    seen = _labelled(docs, labels, [0, 1, 3]).select("text", "toxic", (remainder() == 3).cast("int").alias("held"))
    counted = map_rows(seen, _count, "node bigint, o bigint, t bigint, held_o bigint, held_t bigint")
    # One shuffle, by context: a context's nodes are summed up and compared where they lie.
    laid = counted.withColumn("context", F.shiftrightunsigned("node", 8)).repartition("context").groupBy("context", "node")
    counts = ("o", "t", "all_o", "all_t")
    nodes = laid.agg(
        F.sum("o").alias("o"), F.sum("t").alias("t"), F.sum(F.col("o") + F.col("held_o")).alias("all_o"), F.sum(F.col("t") + F.col("held_t")).alias("all_t")
    )
    w = Window.partitionBy("context")
    kept = nodes.select(
        "node", "context", F.col("node").bitwiseAND(F.lit(0xFFFFFF)).alias("tail"), (F.col("node") == F.min("node").over(w)).alias("first"), *counts,
        *(F.sum(k).over(w).alias(f"n_{k}") for k in counts), *(F.sum((F.col(k) > 0).cast("int")).over(w).alias(f"t_{k}") for k in counts)
    ).persist()
    try:
        # Shared continuation counts: distinct nodes by their last three bytes, a table of the alphabet's size.
        tails = {r[0]: r[1] for r in kept.groupBy("tail").count().collect()}
        if not tails:
            return {"nodes": None, "weights": None}
        rows = kept.join(F.broadcast(docs.sparkSession.createDataFrame(_shared(tails), "tail bigint, p double")), "tail")
        model = settled(_ratios(rows, "all_"))
        weights = _calibrate(_labelled(docs, labels, [3]), _ratios(rows, ""), calibration_rows, seed)
        if weights is None:
            weights = _calibrate(_labelled(docs, labels, [0, 1, 3]), model, calibration_rows, seed)
    finally:
        kept.unpersist()
    return {"nodes": model, "weights": weights}


def _release(docs: DataFrame) -> None:
    """Shuffle files of finished steps go when neither Python nor the driver's JVM refers to them.

    A thread of py4j's tells the JVM, some time later, which objects Python has dropped: the JVM's collection waits for it.
    """
    gc.collect()
    sc = docs.sparkSession.sparkContext
    told, until = getattr(sc._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + 20
    while told and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.1)  # the last one may be on its way
    sc._jvm.System.gc()


def _shared(tails: dict[int, int]) -> list[tuple[int, float]]:
    """P(last byte | the two before it) by the last three bytes."""
    context: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    unigram: dict[int, int] = defaultdict(int)
    for t, n in tails.items():
        context[t >> 8][0] += n
        context[t >> 8][1] += 1
        unigram[t & 255] += n
    total = sum(unigram.values())
    return [(t, (n - DISCOUNT + DISCOUNT * context[t >> 8][1] * unigram[t & 255] / total) / context[t >> 8][0]) for t, n in tails.items()]


def _ratios(rows: DataFrame, fold: str) -> DataFrame:
    """(node, step): the log ratio of each node whose context both classes showed, and under byte zero that of the bytes unseen there."""

    def of(k: str):
        k, n, kinds = (F.col(f"{a}{fold}{k}") for a in ("", "n_", "t_"))
        return n, (F.greatest(k - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("p")) / n, DISCOUNT * kinds / n

    (n_t, p_t, below_t), (n_o, p_o, below_o) = of("t"), of("o")

    def row(node, ratio):
        return F.struct(node.alias("node"), F.log(ratio).cast("float").alias("step"))

    own, unseen = row(F.col("node"), p_t / p_o), row(F.shiftleft("context", 8), below_t / below_o)
    return rows.where((n_t > 0) & (n_o > 0)).select(F.inline(F.when(F.col("first"), F.array(own, unseen)).otherwise(F.array(own))))


class Scorer:
    """Evidence of words by a part of the model that has all their nodes."""

    def __init__(self, nodes, step):
        order = np.argsort(nodes)
        self.nodes, self.step = nodes[order], step[order]

    def _step(self, nodes):
        if not len(self.nodes):
            return np.zeros(len(nodes)), np.zeros(len(nodes), bool)
        at = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        return self.step[at], self.nodes[at] == nodes

    def evidence(self, words: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(words), SLICE):
            nodes, lengths = _packed(words[i : i + SLICE])
            step, seen = self._step(nodes)
            below, known = self._step(nodes & ~np.int64(255))
            out.append(np.add.reduceat(np.where(seen, step, np.where(known, below, 0)).astype(np.float64), np.cumsum(lengths) - lengths))
        return np.concatenate(out)


def features(evidence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The four features of documents, whose words' evidence stands end to end."""
    out = np.zeros((len(lengths), 4))
    some = lengths > 0
    n = lengths[some]
    if len(n):
        ends = np.cumsum(n)
        starts, total = ends - n, np.concatenate(([0.0], np.cumsum(evidence)))
        place, end = np.arange(len(evidence)), np.repeat(ends, n)
        # A document's spans begin at each of its words but the last SPAN - 1; a shorter document is one span.
        spans = np.where((place + SPAN <= end) | (place == np.repeat(starts, n)), total[np.minimum(place + SPAN, end)] - total[:-1], -np.inf)
        out[some] = np.column_stack([np.maximum.reduceat(evidence, starts), np.maximum.reduceat(spans, starts) / SPAN, (total[ends] - total[starts]) / n, np.log1p(n)])
    return out


def _features(docs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """All columns of docs but the text, and the four features under the name ``column``."""
    import itertools

    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField(column, ArrayType(DoubleType()))])
    names = [f.name for f in others]
    chunks = pieces(text_bytes(docs)[1], CHUNK_BYTES)

    def deal(batches):
        """Blocks of documents as numbers of their words, beside the words, the most frequent first."""
        at = TaskContext.get().partitionId()
        rows, index, size, ids = [], [], 0, defaultdict(itertools.count().__next__)
        for b in batches:
            texts, rest = b.column("text"), b.select(names)
            for i in range(0, b.num_rows, 100):
                for text in texts.slice(i, 100).to_pylist():
                    words = words_of(text)
                    index.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                    size += len(text or "")
                rows.append(rest.slice(i, 100))
                if size > BLOCK_BYTES:
                    yield block(rows, index, ids, at % chunks)
                    rows, index, size, at = [], [], 0, at + 1
                    ids = defaultdict(itertools.count().__next__)
        if rows:
            yield block(rows, index, ids, at % chunks)
        tidy()

    def block(rows, index, ids, chunk):
        flat = np.concatenate(index)
        order = np.argsort(-np.bincount(flat, minlength=len(ids)), kind="stable")
        rank = np.empty(len(ids), "<i4")
        rank[order] = np.arange(len(ids))
        # All lowest bytes, then all second ones, and so on: those of high order are mostly zero.
        numbers = np.ascontiguousarray(rank[flat].view(np.uint8).reshape(-1, 4).T)
        t = pa.Table.from_batches(rows).append_column("_n", pa.array([len(x) for x in index], pa.int64())).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(t)
        listed = list(ids)
        words = b" ".join([listed[i] for i in order.tolist()])
        coded = [[pa.Codec("zstd", 3).compress(x, asbytes=True)] for x in (numbers.tobytes(), words)]
        columns = [[chunk], [sink.getvalue().to_pybytes()], *coded, [len(words)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 3, pa.int64()))], names=["chunk", "block", "numbers", "words", "size"])

    def vocabularies(t):
        for words, size in zip(t.column("words"), t.column("size").to_pylist()):
            yield pa.Codec("zstd").decompress(words.as_buffer(), size, asbytes=True).split()

    def asked(key, t):
        found = [np.zeros(0, np.uint64)]
        for words in vocabularies(t):
            if words:
                found.append(np.unique(_packed(words)[0].view(np.uint64)))
        wanted = np.unique(np.concatenate(found))
        # The numbers of one context lie side by side.
        contexts, first = np.unique(wanted >> np.uint64(8), return_index=True)
        last = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(wanted)], pa.int32()), pa.array((wanted & np.uint64(255)).astype(np.int16)))
        out = pa.table({"chunk": pa.array(np.full(len(contexts), key[0].as_py(), np.int32)), "context": contexts.view(np.int64), "wanted": last})
        tidy()
        return out

    def run(t, part):
        s = Scorer(*(part.column(c).to_numpy() for c in ("node", "step")))
        out = []
        for words, x, numbers in zip(vocabularies(t), t.column("block"), t.column("numbers")):
            rows = pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
            lengths = rows.column("_n").to_numpy()
            index = np.zeros(0, np.int32)
            if total := int(lengths.sum()):
                planes = np.frombuffer(pa.Codec("zstd").decompress(numbers.as_buffer(), 4 * total, asbytes=True), np.uint8).reshape(4, total)
                index = np.ascontiguousarray(planes.T).view("<i4").ravel()
            got = features(s.evidence(words)[index], lengths)
            out.append(rows.select(names).append_column(column, pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1]).cast(pa.list_(pa.float64()))))
        tidy()
        return pa.concat_tables(out)

    dealt = small_batches(docs).mapInArrow(deal, "chunk int, block binary, numbers binary, words binary, size bigint")
    asks = dealt.groupBy("chunk").applyInArrow(asked, "chunk int, context bigint, wanted array<smallint>")
    own = nodes.select("node", "step", F.shiftrightunsigned("node", 8).alias("context"), F.col("node").bitwiseAND(F.lit(255)).cast("smallint").alias("last"))
    parts = asks.join(own, "context").where((F.col("last") == 0) | F.array_contains("wanted", F.col("last"))).select("chunk", "node", "step")
    return dealt.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(run, schema)


def _calibrate(held: DataFrame, nodes: DataFrame, rows: int, seed: int):
    """Newton's method on a bounded sample (by hash of the id) of labelled rows; None if it lacks a class."""
    if (n := held.count()) > rows:
        held = held.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    got = _features(held, nodes, "x").select("x", F.col("toxic").alias("y")).toPandas()
    y = (got.y.to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.column_stack([np.ones(len(y)), np.array(got.x.tolist())])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.01 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return (w / scale).tolist()


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """All columns of docs but the text, and the score under the name ``column`` (replacing one of that name)."""
    weights = model["weights"]
    if column in docs.columns:
        docs = docs.drop(column)
    if weights is None:
        return docs.drop("text").withColumn(column, F.lit(0.0))
    z = sum((F.lit(a) * F.col("_x")[i] for i, a in enumerate(weights[1:])), F.lit(weights[0]))
    return _features(docs, model["nodes"], "_x").withColumn(column, F.when(z > -60, 1 / (1 + F.exp(-z))).otherwise(0.0)).drop("_x")


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    model = fit(docs, labels, **options)
    scored = score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
