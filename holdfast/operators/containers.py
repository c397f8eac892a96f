"""DataFrame operators over containers: scanning, packing, copying, and the relations between members.

Scans read ``path, content`` rows, such as Spark's binaryFile source gives from any store it can read; a task takes one
container at a time.  Whatever only needs members' columns is an expression or a window and stays in the JVM.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.names import escaped, name_mask, refused
from ..functions.status import ContainerError
from ..sources import tar, tree, zips
from ..sources.containers import read_container, write_container
from ..sources.member import CONTAINER, MEMBER, Limits

#: A part's bytes, and those that a member costs beside its content: headers, and what a task keeps of it.
PART_BYTES, MEMBER_BYTES = 32 << 20, 1 << 10


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content of the files below a path in any store that Spark reads."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def members(containers: DataFrame, limits: Limits | None = None, mode: str = "permissive", seen=None, **options) -> DataFrame:
    """Member rows of (path, content) containers.  failfast: a walk's error raises; permissive: rows before it stand.

    seen: (DDL, f) of columns in content's place: f gives them as a dictionary from a row where it is read, so that contents, whose
    holes may be far larger than the container, don't leave the task.
    """
    schema = MEMBER if seen is None else MEMBER.removesuffix("content binary") + seen[0]
    target = to_arrow_schema(StructType.fromDDL(schema))
    columns = ["path", "content", *(["lengths"] if "lengths" in containers.columns else [])]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, data, container, out = b.column("path")[i].as_py(), b.column("content")[i].as_py(), {}, []
                held, disks = 0, b.column("lengths")[i].as_py() if len(columns) > 2 else None
                for row in read_container(path, data or b"", container, limits, disks=disks, **options):
                    if seen is not None:
                        row |= seen[1](row) | {"content": None}
                    out.append(row)
                    held += len(row["content"] or b"")
                    if len(out) >= 1000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=target)
                        out, held = [], 0
                if mode == "failfast" and container["status"] != "END":
                    raise ContainerError(container["status"], path)
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return containers.select(*columns).mapInArrow(run, schema)


def walks(containers: DataFrame, limits: Limits | None = None, **options) -> DataFrame:
    """A row a container: format, counts and the status in which its walk ends."""
    target = to_arrow_schema(StructType.fromDDL(CONTAINER))
    names = target.names

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):  # one container's bytes at a time
                container: dict = {}
                for _ in read_container(b.column("path")[i].as_py(), b.column("content")[i].as_py() or b"", container, limits, with_content=False, **options):
                    pass
                out.append({k: container.get(k) for k in names})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return containers.select("path", "content").mapInArrow(run, CONTAINER)


def parted(rows: DataFrame, key: Column, name: Column, content: Column, part_bytes: int = PART_BYTES) -> DataFrame:
    """rows with ``path``: a key's container, cut by a hash of the name into as many parts as its bytes ask for.

    However many rows a key has, a part's bytes and members are bounded, so that one task can write it.
    """
    sized = rows.withColumn("_key", key)
    parts = sized.groupBy("_key").agg(F.greatest(F.ceil(F.sum(F.octet_length(content) + MEMBER_BYTES) / part_bytes), F.lit(1)).alias("_parts"))
    spread = sized.join(F.broadcast(parts) if parts.limit(100_001).count() <= 100_000 else parts, sized["_key"].eqNullSafe(parts["_key"])).drop(parts["_key"])
    part = F.pmod(F.xxhash64(name), F.col("_parts"))
    return spread.withColumn("path", F.concat(F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.lit("-"), part)).drop("_key", "_parts")


def pack(rows: DataFrame, format: str, codec: str | None = None, **options) -> DataFrame:
    """(path, content) containers from rows of path, name BINARY, content BINARY and any of the members' columns.

    Members are ordered by idx where the rows have one (nulls last) and then by name within a container, so equal rows give equal
    bytes, a link follows what it names, and the last of equal names stays the last.  With a column ``stored``, the content of members that have
    a sparse_map is that of its regions, and size says the whole's.
    """
    schema = "path string, content binary"
    columns = [c for c in rows.columns if c != "content"]
    order = [(c, "ascending") for c in ("idx", "name") if c in columns]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        data = t["content"]

        def pair(m: dict, own: bytes) -> tuple[dict, bytes]:
            if not m.pop("stored", False) or m["sparse_map"] is None:
                return m, own
            return (m | {"real_size": m["size"]}, own) if format == "tar" else (m, tar.expanded(m, own))

        pairs = (pair(m, data[i].as_py() or b"") for i, m in enumerate(t.select(columns).to_pylist()))
        return pa.table({"path": [t["path"][0].as_py()], "content": [write_container(format, pairs, codec, **options)]})

    return rows.groupBy("path").applyInArrow(run, schema)


def capped(rows: DataFrame, limits: Limits) -> DataFrame:
    """Members before the first that breaks a cap, and the cap's status on each container: all by windows.

    Columns added: status (END, or the cap that ends the container).  Asked in the order name, size, count, total.
    """
    order = Window.partitionBy("path").orderBy("idx")
    total = F.sum(F.coalesce("size", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))

    def over(cap: int, value: Column) -> Column:
        return (value > cap) if cap else F.lit(False)

    status = (
        F.when(over(limits.max_name_bytes, F.octet_length("name")), "LIMIT_NAME_BYTES")
        .when(over(limits.max_member_bytes, F.col("size")), "LIMIT_MEMBER_BYTES")
        .when(over(limits.max_members, F.row_number().over(order)), "LIMIT_MEMBERS")
        .when(over(limits.max_total_bytes, total), "LIMIT_TOTAL_BYTES")
    )
    first = F.first("_broken", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = F.first("_broken", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_broken", status).withColumn("status", F.coalesce(first, F.lit("END"))).withColumn("_seen", seen)
    return marked.where("_seen is null").drop("_broken", "_seen")


def find(rows: DataFrame, name: bytes) -> DataFrame:
    """The first member of a name in each container."""
    hit = rows.where(F.col("name") == F.lit(name))
    return hit.groupBy("path").agg(F.min_by(F.struct(*rows.columns), "idx").alias("first")).select("first.*")


def duplicates(rows: DataFrame) -> DataFrame:
    """Names that a container holds more than once."""
    return rows.groupBy("path", "name").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def collisions(rows: DataFrame) -> DataFrame:
    """Names that differ, but not where case is ignored.  One that isn't UTF-8 only equals itself: \\x and its bytes."""
    text = F.col("name").cast("string")
    lower = F.when(F.is_valid_utf8(text), F.lower(text)).otherwise(F.concat(F.lit("\\x"), F.hex("name")))
    return rows.groupBy("path", lower.alias("folded")).agg(F.count_distinct("name").alias("names")).where("names > 1")


def update(old: DataFrame, deletes: DataFrame | None = None, adds: DataFrame | None = None) -> DataFrame:
    """A container's members without some names, and with others in place of equal ones or behind the last."""
    out = old
    if deletes is not None:
        out = out.join(deletes.select("path", "name").distinct(), ["path", "name"], "left_anti")
    if adds is not None:
        out = out.join(adds.select("path", "name").distinct(), ["path", "name"], "left_anti").unionByName(adds, allowMissingColumns=True)
    return out


def copy(containers: DataFrame, format: str, rename: Column | None = None, codec: str | None = None, on_error: str = "fail", **options) -> DataFrame:
    """Containers of another format from the same members, in their order; rename is an expression over member columns.

    A walk that doesn't end well and a member whose data can't be read raise; with on_error="skip" the members that can be
    read are copied without them.
    """
    rows = members(containers, mode="failfast" if on_error == "fail" else "permissive", holes=False)
    if rename is not None:
        rows = rows.withColumn("name", rename.cast("binary"))
    if on_error == "fail":
        lost = F.raise_error(F.concat(F.col("data_status"), F.lit(": "), F.col("path"), F.lit(" "), F.col("idx")))
        rows = rows.withColumn("content", F.when(F.col("data_status") == "OK", F.col("content")).otherwise(lost.cast("binary")))
    else:
        rows = rows.where("data_status = 'OK'")
    kept = ("path", "idx", "name", "type", "link_target", "mtime_seconds", "mtime_ns", "mtime_source", "mode", "uid", "gid", "uname", "gname", "device_major", "device_minor", "size", "sparse_map", "content")
    return pack(rows.select(*kept, F.lit(True).alias("stored")), format, codec, **options)


def copy_raw(containers: DataFrame, prefix: bytes = b"") -> DataFrame:
    """zip containers of the same stored bytes: nothing is decoded or decrypted.  Names may get a prefix."""
    schema = "path string, content binary"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("content")[i].as_py() or b""
                yield pa.RecordBatch.from_pydict({"path": [b.column("path")[i].as_py()], "content": [zips.copy_raw(data, lambda n: prefix + n)]})

    return containers.select("path", "content").mapInArrow(run, schema)


def volumes(containers: DataFrame, size: int) -> DataFrame:
    """(path.NNN, content) parts of ``size`` bytes each, numbered from 001."""
    n = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    parts = containers.select("path", "content", F.explode(F.sequence(F.lit(1), n)).alias("part"))
    return parts.select(
        F.concat("path", F.lit("."), F.lpad(F.col("part").cast("string"), 3, "0")).alias("path"), F.substring("content", (F.col("part") - 1) * size + 1, F.lit(size)).alias("content")
    )


def zip_volumes(rows: DataFrame, size: int, **options) -> DataFrame:
    """(path, content) of split zips from pack's rows: path.z01, path.z02 ... and path.zip, no record cut at a volume's end."""
    schema = "path string, content binary"
    columns = [c for c in rows.columns if c != "content"]
    order = [(c, "ascending") for c in ("idx", "name") if c in columns]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        data = t["content"]
        out = io.BytesIO()
        writer = zips.ZipWriter(out, volume=size, **options)
        for i, m in enumerate(t.select(columns).to_pylist()):
            writer.add(m, data[i].as_py() or b"")
        writer.finish()
        whole, cuts, path = out.getvalue(), [*writer.disks, out.tell()], t["path"][0].as_py()
        names = [f"{path}.z{k + 1:02d}" for k in range(len(cuts) - 2)] + [f"{path}.zip"]
        return pa.table({"path": names, "content": pa.array([whole[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return rows.groupBy("path").applyInArrow(run, schema)


def crc_verdicts(rows: DataFrame) -> DataFrame:
    """path, idx and whether the content's CRC-32 is the declared one."""
    declared = F.coalesce(F.col("zip.crc32"), F.col("sevenz.crc32"))
    return rows.where(declared.isNotNull() & F.col("content").isNotNull()).select("path", "idx", (F.crc32("content") == declared).alias("intact"))


def volume_offsets(parts: DataFrame) -> DataFrame:
    """set, part_no, length and the offset at which each part of a split container begins."""
    before = Window.partitionBy("set").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def hardlinks(tree: DataFrame) -> DataFrame:
    """Files of one (device, inode): the first keeps the data, later ones link to it; more links than seen are refused."""
    same = Window.partitionBy("device", "inode")
    order = same.orderBy("idx")
    first, seen = F.first("name").over(order), F.count(F.lit(1)).over(same)
    return tree.withColumn("link_target", F.when(F.row_number().over(order) > 1, first)).withColumn("refused", F.col("links") > seen)


def sparse_regions(blocks: DataFrame) -> DataFrame:
    """Runs of full blocks (path, block_no) as regions: gaps and islands."""
    order = Window.partitionBy("path").orderBy("block_no")
    island = F.col("block_no") - F.row_number().over(order)
    return blocks.distinct().withColumn("island", island).groupBy("path", "island").agg(F.min("block_no").alias("first_block"), F.count(F.lit(1)).alias("blocks")).drop("island")


def disagreements(local: DataFrame, central: DataFrame) -> DataFrame:
    """Members on which a zip's local headers and its directory differ, by ordinal."""
    keys, facts = ["path", "idx"], ["name", "method", "crc32", "compressed_size", "size"]
    both = local.select(*keys, F.struct(*facts).alias("l")).join(central.select(*keys, F.struct(*facts).alias("c")), keys, "full")
    return both.where(~F.col("l").eqNullSafe(F.col("c"))).select(*keys)


def extract_plan(rows: DataFrame, allow_links: bool = False, portable: bool = True) -> DataFrame:
    """What extraction would do with each member, in order: extract up to a container's first refusal, nothing behind.

    A member is refused for its name, its type (links need leave), or because its place is already taken.
    """
    folded = F.regexp_replace(F.decode("name", "ISO-8859-1"), r"/\z", "")
    taken = F.row_number().over(Window.partitionBy("path", folded, F.col("type") == "directory").orderBy("idx"))
    types = ["file", "directory"] + (["symlink", "hardlink"] if allow_links else [])
    refusal = (
        F.when(refused(name_mask(F.col("name")), portable), "name").when(~F.col("type").isin(*types), "type").when((taken > 1) & (F.col("type") != "directory"), "exists")
    )
    order = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    planned = rows.withColumn("refusal", refusal).withColumn("stopped", F.coalesce(F.max(F.col("refusal").isNotNull()).over(order), F.lit(False)))
    action = F.when(F.col("stopped"), "skip").when(F.col("refusal").isNotNull(), "refuse").otherwise("extract")
    return planned.select("path", "idx", "name", "refusal", action.alias("action"))



def joined_volumes(parts: DataFrame) -> DataFrame:
    """(path, content, lengths) containers from (path, content) files: parts of split sets end to end, other files as they are.

    lengths: the parts' bytes, by which a split zip's disks are found again.

    Sets are told by their names: x.001, x.002 ... and x.z01, x.z02 ... x.zip.  A set with a gap isn't joined.
    """
    numbered = F.regexp_extract("path", r"\A(?s)(.+)\.(\d{3,5})\z", 1)
    zipped = F.regexp_extract("path", r"\A(?s)(.+)\.[zZ](\d{2,5})\z", 1)
    number = F.regexp_extract("path", r"\.[zZ]?(\d{2,5})\z", 1)
    key = F.when(numbered != "", numbered).when(zipped != "", F.concat(zipped, F.lit(".zip"))).otherwise(F.col("path"))
    part = F.when(number != "", number.cast("bigint")).otherwise(F.lit(1 << 20))
    rows = parts.select(key.alias("set"), part.alias("part"), "path", "content")
    parts = rows.groupBy("set").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    numbers = F.filter("parts", lambda n: n < 1 << 20)
    whole = numbers == F.when(F.size(numbers) > 0, F.sequence(F.lit(1).cast("bigint"), F.size(numbers).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    judged = rows.join(parts.select("set", whole.alias("whole")), "set")
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("part", F.octet_length("content").cast("bigint").alias("n")))), lambda x: x.n)
    joined = judged.where("whole").groupBy(F.col("set").alias("path")).agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY part)").alias("content"), lengths.alias("lengths"))
    return joined.unionByName(judged.where("not whole").select("path", "content", F.array(F.octet_length("content").cast("bigint")).alias("lengths")))


def dump(rows: DataFrame) -> DataFrame:
    """A line of text a member: index, type, size, escaped name and, for links, the target."""
    target = F.when(F.col("link_target").isNotNull(), F.concat(F.lit(" -> "), escaped(F.col("link_target")))).otherwise(F.lit(""))
    size = F.when(F.col("size_unknown"), F.lit("?")).otherwise(F.coalesce(F.col("size").cast("string"), F.lit("?")))
    return rows.select("path", "idx", F.concat(F.col("idx"), F.lit(" "), F.col("type"), F.lit(" "), size, F.lit(" "), escaped(F.col("name")), target).alias("line"))


def dump_walks(rows: DataFrame) -> DataFrame:
    """A line of text a container, from walks: format (and codec), members, declared bytes, how the walk ended."""
    codec = F.when(F.col("codec").isNotNull(), F.concat(F.lit(" in "), "codec")).otherwise(F.lit(""))
    comment = F.when(F.octet_length("zip_comment") > 0, F.concat(F.lit(" # "), escaped(F.col("zip_comment")))).otherwise(F.lit(""))
    return rows.select(
        "path", F.concat(F.col("format"), codec, F.lit(": "), F.col("member_count"), F.lit(" members, "), F.col("total_declared_bytes"), F.lit(" bytes, "), F.col("status"), comment).alias("line")
    )


def packed_trees(roots: DataFrame, format: str, codec: str | None = None, **options) -> DataFrame:
    """(path, content) containers of directory trees, from rows (path, root).  A root is a folder that all executors see."""
    schema = "path string, content binary"

    def run(batches):
        for b in batches:
            for path, root in zip(b.column("path").to_pylist(), b.column("root").to_pylist()):

                def data(found):
                    for m, place in found:
                        if place is None:
                            yield m, b""
                        else:
                            with open(place, "rb") as f:
                                yield m, f.read()

                yield pa.RecordBatch.from_pydict({"path": [path], "content": [write_container(format, data(tree.tree_members(root)), codec, **options)]})

    return roots.select("path", "root").mapInArrow(run, schema)


def joined_tar_volumes(parts: DataFrame) -> DataFrame:
    """(path, content) tars from rows (path, part, content) of volume sets: members cut at a volume's end are made whole."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"path": t["path"].slice(0, 1).combine_chunks(), "content": pa.array([tar.join_volumes(t["content"].to_pylist())], pa.binary())})

    return parts.select("path", "part", "content").groupBy("path").applyInArrow(run, "path string, content binary")


def extract(containers: DataFrame, root: str, portable: bool = True, links: bool = False, **options) -> DataFrame:
    """Writes each container's members below root, a folder that all executors share, in a folder of its own.

    A task takes a whole container, since order decides what is refused.  Rows: path, idx, status.  Members are written apart
    and moved to the container's folder in one step, so a lost task leaves nothing there; the same extraction again, as by a retried
    task, finds its own work (a mark beside the folder says whose it is) and answers as the first.  A folder of
    other origin isn't touched: REFUSED at the first member.
    """
    import hashlib
    import os
    import shutil
    import uuid

    schema = "path string, idx bigint, status string"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, data = b.column("path")[i].as_py(), b.column("content")[i].as_py() or b""
                name = hashlib.sha256(path.encode()).hexdigest()[:16]
                own, mark, apart = (os.path.join(root, x) for x in (name, f".{name}.mark", f".{name}.{uuid.uuid4().hex}"))
                said = hashlib.sha256(repr((hashlib.sha256(data).digest(), portable, links, sorted(options.items()))).encode()).hexdigest()
                done = list(tree.extract(read_container(path, data, {}, **options), apart, portable, links))
                try:
                    if not os.path.exists(own):
                        with open(f"{apart}.mark", "w") as f:
                            f.write(said)
                        os.replace(f"{apart}.mark", mark)
                        os.rename(apart, own)
                    elif not os.path.exists(mark) or open(mark).read() != said:
                        done = [(0, "REFUSED")]
                finally:
                    shutil.rmtree(apart, ignore_errors=True)
                yield pa.RecordBatch.from_pydict({"path": [path] * len(done), "idx": [i for i, _ in done], "status": [s for _, s in done]}, schema=target)

    return containers.select("path", "content").mapInArrow(run, schema)


def touched_parts(ranges: DataFrame, parts: DataFrame, step: int = 1 << 20) -> DataFrame:
    """set, idx, part_no of every part (set, part_no, offset, length) that a range (set, idx, first, length) overlaps.

    A range join by an equality: both sides are cut at multiples of ``step`` bytes, and a pair is kept in the first piece that it shares.
    """

    def cut(rows: DataFrame, begin: str, *columns: str) -> DataFrame:
        last = F.col(begin) + F.col("length") - 1
        return rows.where("length > 0").select("set", *columns, F.col(begin).alias(f"{begin}_at"), (last + 1).alias(f"{begin}_end"), F.explode(F.sequence(F.floor(F.col(begin) / step), F.floor(last / step))).alias("piece"))

    both = cut(ranges, "first", "idx").join(cut(parts, "offset", "part_no"), ["set", "piece"]).where("first_at < offset_end and offset_at < first_end")
    return both.where(F.col("piece") == F.floor(F.greatest("first_at", "offset_at") / step)).select("set", "idx", "part_no")


def in_force(rows: DataFrame, records: DataFrame, value: str) -> DataFrame:
    """rows (path, idx) with the value of the latest record (path, idx, value) before each: an as-of join by one window."""
    both = rows.withColumn("_member", F.lit(True)).unionByName(records.select("path", "idx", value).withColumn("_member", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("path").orderBy("idx", F.col("_member").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last(F.when(~F.col("_member"), F.col(value)), ignorenulls=True).over(before)).where("_member").drop("_member")
