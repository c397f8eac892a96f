"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents.  Decisions are made about rows, not ids: rows of null or repeated ids are judged as any others.
Null and empty texts have nothing against them and pass every filter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, minhash, packing, secret_scan, toxicity
from holdfast.llm.common import settled, shared_folder, table
from holdfast.llm.queries import tokenizer_path

#: Keys of dropped rows, eight bytes each, are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_ROWS = 1 << 21
#: Words that a packing worker remembers: fewer than alone, since its neighbours of earlier stages may still wait.
REMEMBER = 250_000


def _row():
    """The key of a row, by which decisions come back: rows of one id, or of none, keep their own."""
    return F.xxhash64("doc_id", "text")


def _keys(rows: DataFrame) -> tuple[DataFrame, int]:
    """Keys, settled, and their number, which decides how they are joined."""
    rows = settled(rows)
    n = rows.count()
    return (F.broadcast(rows) if n <= BROADCAST_ROWS else rows), n


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose keys are the ids in ``dropped``."""
    dropped, _ = _keys(dropped.select(F.col("doc_id").alias("_row")).distinct())
    return docs.withColumn("_row", _row()).join(dropped, "_row", "left_anti").select(docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """Rows of equal id and text once: the one whose other columns are least.  Only keys travel unless there are such rows."""
    keyed = docs.withColumn("_row", _row())
    repeated, n = _keys(keyed.groupBy("_row").count().where("count > 1").select("_row"))
    if not n:
        return docs
    least = keyed.join(repeated, "_row", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return keyed.join(repeated, "_row", "left_anti").select(docs.columns).unionByName(least)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(_row().alias("doc_id"), "text"), model)
    return _without(docs, scored.where(F.col("score") >= toxicity.THRESHOLD))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of least id: five-word shingles, similarity 0.8 or more; equal rows once."""
    named = docs.select(_row().alias("doc_id"), "text")
    moved = settled(minhash.near_duplicates(named, shingle=5, percent=80).where("not kept").select("doc_id", "component_id").distinct())
    members = moved.union(moved.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    # Keys have no order of their own: a group keeps its least id, and a row of no id only where it has no other.
    ids = docs.select(_row().alias("doc_id"), F.col("doc_id").alias("id")).distinct()
    least = members.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("x"))
    return _without(_once(docs), members.join(least.select("x.doc_id"), "doc_id", "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    named = docs.select(_row().alias("doc_id"), "text")
    found = decontaminate.find_contamination(named, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0"))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a placeholder; n_chars follows the text."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, placed in sequences."""
    return packing.pack(docs, tokenizer_path(), with_ids=True, remember=REMEMBER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order.  Each result but the last is written as Parquet below the shared folder and read again; one
    stage's files go when the next one's are there."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
