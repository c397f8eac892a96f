"""Operators and queries on Spark; names against a fold in Python."""

import os
import subprocess
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from holdfast.functions import names
from holdfast.operators import containers as ops
from holdfast.plans import queries as q
from holdfast.sources.datasource import ContainerDataSource
from holdfast.sources.member import Limits

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def escapes(parts):
    depth = 0
    for p in parts:
        depth += -1 if p == b".." else p not in (b"", b".")
        if depth < 0:
            return True
    return False


def mask(name: bytes) -> int:
    """The findings by plain loops over bytes."""
    if not name:
        return names.BIT["EMPTY"]
    got = set()
    p = name.removesuffix(b"/").removeprefix(b"/").split(b"/")
    w = name[:-1] if name[-1:] in b"/\\" else name
    w = (w[1:] if w[:1] and w[:1] in b"/\\" else w).replace(b"\\", b"/").split(b"/")
    for test, found in (
        (name.startswith(b"/"), "ABSOLUTE"), (escapes(p), "TRAVERSAL"), (b".." in p, "PARENT_COMPONENT"), (b"." in p, "CURRENT_COMPONENT"), (b"" in p, "EMPTY_COMPONENT"), (b"\0" in name, "NUL_BYTE"),
        (any(0 < c < 32 or c == 127 for c in name), "CONTROL_BYTE"), (b"\\" in name, "BACKSLASH"), (b"\\" in name and not escapes(p) and escapes(w), "WINDOWS_TRAVERSAL"),
        (name[:1].isalpha() and name[1:2] == b":", "DRIVE_LETTER"), (len(name) > 1 and name[0] in b"/\\" and name[1] in b"/\\", "UNC"),
        (any(x.split(b".")[0].rstrip(b" ").lower() in {b"con", b"prn", b"aux", b"nul", *(t + b"%d" % i for t in (b"com", b"lpt") for i in range(1, 10))} for x in p), "WINDOWS_RESERVED"),
        (any(x[-1:] in (b".", b" ") and x not in (b".", b"..") for x in p), "TRAILING_DOT_OR_SPACE"),
    ):
        if test:
            got.add(found)
    try:
        name.decode()
    except UnicodeDecodeError:
        got.add("NOT_UTF8")
    return sum(names.BIT[x] for x in got)


ALPHABET = st.sampled_from([b"..", b".", b"/", b"\\", b"a", b" ", b"aux", b"COM1", b":", b"\n", b"\0", b"\xff", "é".encode(), b"C"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=7).map(b"".join), min_size=40, max_size=40))
def test_name_masks(spark, batch):
    rows = spark.createDataFrame([(bytearray(n),) for n in batch], "name binary").select("name", names.name_mask(F.col("name")).alias("m")).collect()
    for r in rows:
        assert r.m == mask(bytes(r.name)), bytes(r.name)


def test_masks_of_null_and_findings(spark):
    row = spark.createDataFrame([(None,)], "name binary").select(names.name_mask(F.col("name")).alias("m")).first()
    assert row.m is None
    found = spark.range(1).select(names.findings(F.lit(names.BIT["UNC"] | names.BIT["ABSOLUTE"])).alias("f")).first().f
    assert found == ["absolute path", "begins with two separators"]


def test_every_query_has_a_twin_and_they_agree(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    assert set(q.QUERIES) == set(q.ORACLE_SQL)
    for name in ("tar_pax_summary", "zip_deflate_scan", "sevenz_lzma2_solid_scan", "name_check_hostile", "caps_prefix", "extract_plan", "ustar_split", "dos_time", "shar_text", "status_texts"):
        got = q.QUERIES[name](spark, sf)
        columns = sorted(got.columns)
        want = c.execute(f"SELECT {', '.join(columns)} FROM ({q.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want)), name


def test_members_permissive_and_failfast(spark):
    rows = spark.createDataFrame([("p", bytearray(b"a"), bytearray(b"1")), ("p", bytearray(b"b"), bytearray(b"22"))], "path string, name binary, content binary")
    packed = ops.pack(rows, "tar")
    cut = packed.select("path", F.substring("content", 1, 1024 + 300).cast("binary").alias("content"))
    assert ops.members(cut).count() == 1 and ops.walks(cut).first().status == "CORRUPT"
    try:
        ops.members(cut, mode="failfast").collect()
        raise AssertionError("a cut container must raise")
    except Exception as e:
        assert "CORRUPT" in str(e)
    assert ops.walks(packed, Limits(max_members=1)).first().status == "LIMIT_MEMBERS"
    assert ops.members(packed.limit(0)).count() == 0


def test_data_source_and_stream(spark, tmp_path):
    from holdfast.streaming.arrivals import arriving_members

    spark.dataSource.register(ContainerDataSource)
    rows = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"b"), bytearray(b"22"))], "name binary, content binary").coalesce(1)
    rows.write.format("container").option("container", "zip").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("container").load(str(tmp_path / "out"))
    assert sorted((bytes(r.name), bytes(r.content)) for r in back.collect()) == [(b"a", b"1"), (b"b", b"22")]
    rows.write.format("container").option("container", "zip").mode("append").save(str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 2 and spark.read.format("container").load(str(tmp_path / "out")).count() == 4  # an append leaves the first container alone
    rows.write.format("container").option("container", "zip").mode("overwrite").save(str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 1 and spark.read.format("container").load(str(tmp_path / "out")).count() == 2
    for options in ({"container": "rar"}, {"unknown": "1"}):
        try:
            rows.write.format("container").options(**options).mode("append").save(str(tmp_path / "bad"))
            raise AssertionError("must be refused")
        except Exception as e:
            assert "UNSUPPORTED" in str(e) or "INVALID" in str(e)
    stream = arriving_members(spark, str(tmp_path / "out")).select("name", "size").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("arrived").count() == 2


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_works_without_the_training_data_subpackage(tmp_path):
    import shutil

    for name in ("holdfast", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tar_pax_scan' in q and not any(k.startswith('op') for k in q), list(q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_copies_fail_or_skip(spark):
    from holdfast.sources.containers import write_container

    members = [({"name": b"a", "uname": b"me", "gname": b"us"}, b"1" * 40), ({"name": b"b"}, b"22")]
    cut = write_container("tar", iter(members))[: 1024 + 512]
    broken = bytearray(write_container("zip", iter(members), method="stored"))
    broken[32] ^= 1
    for kind, data, kept in (("tar", cut, [b"a"]), ("zip", bytes(broken), [b"b"])):
        files = spark.createDataFrame([("p", bytearray(data))], "path string, content binary")
        try:
            ops.copy(files, "cpio").collect()
            raise AssertionError("damage must raise")
        except Exception as e:
            assert "CORRUPT" in str(e)
        assert [bytes(r.name) for r in ops.members(ops.copy(files, "cpio", on_error="skip")).collect()] == kept
    whole = spark.createDataFrame([("p", bytearray(write_container("tar", iter(members))))], "path string, content binary")
    first = ops.members(ops.copy(whole, "tar")).first()
    assert (bytes(first.uname), bytes(first.gname)) == (b"me", b"us")


def test_volumes_dump_and_extraction(spark, tmp_path):
    from holdfast.sources import tree
    from holdfast.sources.containers import write_container

    data = write_container("zip", iter([({"name": b"a\n", "type": "file"}, b"x" * 9000), ({"name": b"d/b"}, b"y" + bytes(9000))]))
    parts = [(f"s/x.zip.{i + 1:03d}", bytearray(p)) for i, p in enumerate(tree.split(data, 100))] + [("s/y.002", bytearray(b"gap")), ("s/z.zip", bytearray(data))]
    files = spark.createDataFrame(parts, "path string, content binary")
    joined = {r.path: bytes(r.content) for r in ops.joined_volumes(files).collect()}
    assert {r.path: len(r.lengths) for r in ops.joined_volumes(files).collect()} == {"s/x.zip": -(-len(data) // 100), "s/y.002": 1, "s/z.zip": 1}
    assert joined == {"s/x.zip": data, "s/y.002": b"gap", "s/z.zip": data}
    containers = ops.joined_volumes(files).where("path = 's/x.zip'")
    assert [r.line for r in ops.dump(ops.members(containers)).collect()] == ["0 file 9000 a\\x0A", "1 file 9001 d/b"]
    got = [(r.idx, r.status) for r in ops.extract(containers, str(tmp_path / "out")).collect()]
    assert got == [(0, "REFUSED")]
    got = [(r.idx, r.status) for r in ops.extract(containers, str(tmp_path / "out2"), portable=False).collect()]
    assert got == [(0, "OK"), (1, "OK")]
    (own,) = (p for p in (tmp_path / "out2").iterdir() if not p.name.startswith("."))
    assert (own / "d" / "b").read_bytes() == b"y" + bytes(9000)
    again = [r.status for r in ops.extract(containers, str(tmp_path / "out2"), portable=False).collect()]  # as a retried task
    assert [n for n in os.listdir(tmp_path / "out2") if not n.startswith(".")] == [own.name]
    other = containers.withColumn("content", F.lit(write_container("tar", iter([({"name": b"other"}, b"")]))))
    assert [r.status for r in ops.extract(other, str(tmp_path / "out2")).collect()] == ["REFUSED"] and not (own / "other").exists()
    assert again == ["OK", "OK"]
    assert tree.volume_set(["x.001", "x.002", "y.z01", "y.zip", "g.002"]) == {"x": ["x.001", "x.002"], "y.zip": ["y.z01", "y.zip"]}


def test_tree_round_trip(tmp_path):
    from holdfast.sources import tree
    from holdfast.sources.containers import read_container, write_container

    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/f").write_bytes(b"data")
    os.link(tmp_path / "in/d/f", tmp_path / "in/d/g")
    os.symlink("f", tmp_path / "in/d/s")
    members = [(m, open(p, "rb").read() if p else b"") for m, p in tree.tree_members(str(tmp_path / "in"))]
    data = write_container("tar", iter(members))
    assert [s for _, s in tree.extract(read_container("p", data, {}), str(tmp_path / "no"))] == ["OK", "OK", "REFUSED"]
    assert {s for _, s in tree.extract(read_container("p", data, {}), str(tmp_path / "out"), links=True)} == {"OK"}
    assert (tmp_path / "out/d/g").read_bytes() == b"data" and os.readlink(tmp_path / "out/d/s") == "f"
    assert os.stat(tmp_path / "out/d/f").st_ino == os.stat(tmp_path / "out/d/g").st_ino
    hostile = write_container("tar", iter([({"name": b"l", "type": "symlink", "link_target": b"../.."}, b"")]))
    assert [s for _, s in tree.extract(read_container("p", hostile, {}), str(tmp_path / "x"), links=True)] == ["REFUSED"]


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=8).map(b"".join))
def test_masks_agree_with_the_plain_loops(name):
    from holdfast.sources.tree import name_mask

    assert name_mask(name) == mask(name)
    if mask(name) & names.ESCAPES & ~names.BIT["DRIVE_LETTER"] and not name.startswith((b"/", b"\\")):
        assert mask(b"safe/../" + name) & names.ESCAPES


def test_trees_with_holes(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    with open(tmp_path / "in/d/holes", "wb") as f:
        f.write(b"a" * 5000)
        f.seek(1 << 20)
        f.write(b"b" * 10)
        f.truncate(1 << 21)
    roots = spark.createDataFrame([("t", str(tmp_path / "in"))], "path string, root string")
    rows = {bytes(r.name): r for r in ops.members(ops.packed_trees(roots, "tar")).collect()}
    assert set(rows) == {b"d/", b"d/holes"} and bytes(rows[b"d/holes"].content) == (tmp_path / "in/d/holes").read_bytes()
    if os.stat(tmp_path / "in/d/holes").st_blocks * 512 < 1 << 21:
        assert rows[b"d/holes"].sparse and rows[b"d/holes"].stored_size < 1 << 20


def test_table_functions(spark):
    from holdfast.operators import sql
    from holdfast.sources.containers import write_container

    sql.register(spark)
    data = write_container("tar", iter([({"name": b"a"}, b"1"), ({"name": b"b"}, b"22")]))
    spark.createDataFrame([("p", bytearray(data))], "path string, content binary").createOrReplaceTempView("files")
    rows = spark.sql("SELECT m.idx, m.size FROM files, LATERAL container_members(path, content) m ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(0, 1), (1, 2)]
    assert bytes(spark.sql("SELECT r.content FROM files, LATERAL container_read(content, 1) r").first().content) == b"22"


def test_parts_are_bounded_by_members_too(spark):
    rows = spark.range(200_000).selectExpr("CAST('m' || id AS BINARY) AS name", "CAST('' AS BINARY) AS content")
    counts = ops.parted(rows, F.lit("k"), F.col("name"), F.col("content")).groupBy("path").count().collect()
    assert len(counts) > 4 and max(r["count"] for r in counts) < 60_000


def test_sparse_members_in_copies(spark):
    from holdfast.sources.containers import write_container

    regions, data = [{"offset": 512, "length": 3}], bytes(512) + b"abc" + bytes(1000)
    files = spark.createDataFrame([("a", bytearray(write_container("tar", iter([({"name": b"n", "sparse_map": regions}, data)]))))], "path string, content binary")
    for kind in ("tar", "zip", "cpio"):
        row = ops.members(ops.copy(files, kind)).first()
        assert bytes(row.content) == data and row.size == len(data) and row.sparse == (kind == "tar")
    seen = ops.members(files, seen=("n int", lambda r: {"n": len(r["content"])}))
    assert seen.first().n == len(data) and "content" not in seen.columns
