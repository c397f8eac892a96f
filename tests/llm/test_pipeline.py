"""The pipeline's stages against brute force on their own inputs, and the queries that have SQL twins."""

import os

import duckdb
import pytest

import corpus_pipeline
from holdfast.llm import decontaminate, queries

from .test_operators import brute_near

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "the and of in the and that the", None, None, None), (10_000_001, None, "en", "x", 0), (10_000_002, "", "en", "x", 0), (10_000_003, "é password=abcdefgh123 z", "en", "x", 24)], docs.schema)
    docs = docs.union(extra)
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        seen[name] = (before, after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert {None, 10_000_001, 10_000_002} <= {r["doc_id"] for r in after}
    before, after = seen["near_dedup"]
    want = {i for i, _, _, kept in brute_near([(r["doc_id"], r["text"]) for r in before], 5, 80) if kept or i is None}
    assert {r["doc_id"] for r in after} == want
    before, after = seen["secret_scan"]
    assert [r["doc_id"] for r in sorted(before, key=lambda r: repr(r["doc_id"]))] == [r["doc_id"] for r in sorted(after, key=lambda r: repr(r["doc_id"]))]
    assert {r["doc_id"]: r["text"] for r in after}[10_000_003] == "é [SECRET] z"
    assert all(r["text"] is None or r["doc_id"] is None or r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} and all(len(r["ids"]) == 4 * r["length"] for r in after)
    before, after = seen["decontamination"]
    assert len(after) < len(before)


def test_rows_of_no_id_or_one_id(spark):
    """Decisions hold for rows: null ids are judged too, and a rejected text takes no other row of its id along."""
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean, other = (" ".join(f"{w}{k}" for k in range(60)) for w in "xy")
    rows = [(None, item), (7, item), (7, clean), (None, other), (9, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.decontamination_stage(spark, docs, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [r for r in rows if r[1] != item]))
    got = corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(7, item), (7, clean), (9, other)]))


def test_run_on_odd_tables(spark, tmp_path):
    """run() over a tenth of null ids, repeated ids and repeated rows, and over an empty table: what it keeps, by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").limit(60).collect()]
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    for k, r in enumerate(rows):
        r["doc_id"] = None if k % 10 == 3 else 7 if k % 10 == 5 else r["doc_id"]
    rows += [dict(rows[0]), dict(rows[3]), dict(rows[3]), rows[1] | {"doc_id": None, "text": item}, rows[1] | {"doc_id": 7, "text": None}]
    for name, data in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in data], docs.schema).write.parquet(str(folder / "documents.parquet"))
        for table in ("benchmark", "labels"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(folder / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if not data:
            assert not got
            continue
        source = spark.read.parquet(str(folder / "documents.parquet"))
        judged = corpus_pipeline.toxicity_stage(spark, source, str(folder)).collect()
        clean = [(r.doc_id, r.text) for r in judged]
        assert (None, item) in clean and (7, None) in clean
        kept = {i: t for i, t in enumerate(dict.fromkeys(clean))}  # equal rows once
        groups = {}
        for i, _, root, _ in brute_near([(i, t) for i, (_, t) in kept.items()], 5, 80):
            groups.setdefault(root, []).append(i)
        kept = [kept[min(g, key=lambda i: (kept[i][0] is None, kept[i][0] or 0))] for g in groups.values()]
        named = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(kept)], "doc_id bigint, text string")
        hit = {r.doc_id for r in decontaminate.find_contamination(named, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
        assert any(kept[k][1] == item for k in hit)
        left = [x for k, x in enumerate(kept) if k not in hit]
        assert sorted(map(repr, (i for i, _ in left))) == sorted(repr(r.doc_id) for r in got if r.piece == 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))


def test_ten_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
