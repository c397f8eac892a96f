"""Queries over the driver's tables, each with its SQL twin.

The tables hold no containers, so the byte queries pack a table, read it back and must find the table again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, names, status
from ..operators import containers as ops
from ..sources.member import Limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of one container a language and part."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "lang", F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).cast("binary").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
        F.lit("file").alias("type"), (F.col("doc_id") * 2 + 1000000000).alias("mtime_seconds"),
    )
    return ops.parted(rows, F.col("lang"), F.col("name"), F.col("content")).drop("lang")


DOCUMENTS_SQL = """
SELECT source || '/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size,
  sha256(coalesce(text, '')) AS sha256, doc_id * 2 + 1000000000 AS mtime
FROM documents
"""


def round_trip(format: str, codec: str | None = None, access: str = "random", **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ops.members(ops.pack(documents(spark, sf_dir), format, codec, **options), access=access)
        return rows.select(F.decode("name", "UTF-8").alias("name"), "size", F.sha2("content", 256).alias("sha256"), F.col("mtime_seconds").alias("mtime"))

    return run


for _name, _how in {
    "tar_pax_scan": ("tar",),
    **{f"tar_{c}_scan": ("tar", c) for c in ("gzip", "bzip2", "xz", "zstd")},
    "ar_scan": ("ar",),
    "cpio_newc_scan": ("cpio",),
}.items():
    query(DOCUMENTS_SQL, _name)(round_trip(*_how))
query(DOCUMENTS_SQL, "tar_ustar_scan")(round_trip("tar", variant="ustar"))
query(DOCUMENTS_SQL, "tar_sequential_scan")(round_trip("tar", access="sequential"))
query(DOCUMENTS_SQL, "cpio_odc_scan")(round_trip("cpio", variant="odc"))
for _method in ("stored", "deflate", "bzip2", "lzma", "zstd", "xz"):
    query(DOCUMENTS_SQL, f"zip_{_method}_scan")(round_trip("zip", method=_method))
query(DOCUMENTS_SQL, "zip_sequential_scan")(round_trip("zip", access="sequential", descriptors=True))
for _method in ("copy", "lzma", "lzma2", "bzip2", "deflate"):
    for _solid in (True, False):
        query(DOCUMENTS_SQL, f"sevenz_{_method}_{'solid' if _solid else 'separate'}_scan")(round_trip("7z", method=_method, solid=_solid))


@query("SELECT lang, count(*) AS members, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY lang")
def tar_pax_summary(spark, sf_dir):
    """The flagship: pack, scan, sum up."""
    rows = ops.members(ops.pack(documents(spark, sf_dir), "tar"), with_content=False)
    return rows.groupBy(F.substring_index("path", "-", 1).alias("lang")).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))


@query("SELECT lang, count(*) AS members, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, 'zip' AS format, true AS ended FROM documents GROUP BY lang")
def container_walks(spark, sf_dir):
    walks = ops.walks(ops.pack(documents(spark, sf_dir), "zip"))
    return walks.groupBy(F.substring_index("path", "-", 1).alias("lang"), "format").agg(
        F.sum("member_count").alias("members"), F.sum("total_declared_bytes").alias("bytes"), F.min(F.col("status") == "END").alias("ended")
    )


@query("SELECT count(*) AS members, count(*) AS intact FROM documents")
def crc_verdict(spark, sf_dir):
    verdicts = ops.crc_verdicts(ops.members(ops.pack(documents(spark, sf_dir), "zip")))
    return verdicts.agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("intact").cast("bigint")).alias("intact"))


@query(DOCUMENTS_SQL.replace("source || '/'", "'copied/' || source || '/'"))
def copy_tar_to_zip(spark, sf_dir):
    packed = ops.pack(documents(spark, sf_dir), "tar")
    rows = ops.members(ops.copy(packed, "zip", F.concat(F.lit("copied/"), F.decode("name", "UTF-8")), method="zstd"))
    return rows.select(F.decode("name", "UTF-8").alias("name"), "size", F.sha2("content", 256).alias("sha256"), F.col("mtime_seconds").alias("mtime"))


@query(
    """
SELECT lang AS path, source || '/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size FROM documents WHERE NOT contains(coalesce(text, ''), 'password')
UNION ALL SELECT DISTINCT lang, 'added.txt', 5 FROM documents
"""
)
def update_delete_add(spark, sf_dir):
    """Documents that hold a password go, one member comes; the containers are read back."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("lang").alias("path"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).cast("binary").alias("name"), F.col("text").cast("binary").alias("content"))
    deletes = rows.where(F.contains(F.col("content"), F.lit(b"password")))
    adds = rows.select("path").distinct().select("path", F.lit(b"added.txt").alias("name"), F.lit(b"added").alias("content"))
    kept = ops.parted(ops.update(rows, deletes, adds).withColumnRenamed("path", "key"), F.col("key"), F.col("name"), F.col("content")).drop("key")
    back = ops.members(ops.pack(kept, "tar"), with_content=False)
    return back.select(F.substring_index("path", "-", 1).alias("path"), F.decode("name", "UTF-8").alias("name"), "size")


@query(DOCUMENTS_SQL.replace("source || '/'", "'raw/' || source || '/'"))
def zip_raw_copy(spark, sf_dir):
    rows = ops.members(ops.copy_raw(ops.pack(documents(spark, sf_dir), "zip", method="bzip2"), b"raw/"))
    return rows.select(F.decode("name", "UTF-8").alias("name"), "size", F.sha2("content", 256).alias("sha256"), F.col("mtime_seconds").alias("mtime"))


@query(DOCUMENTS_SQL)
def volumes_scan(spark, sf_dir):
    """Containers cut into numbered volumes, joined by name and read."""
    parts = ops.volumes(ops.pack(documents(spark, sf_dir), "zip"), 100_000)
    rows = ops.members(ops.joined_volumes(parts))
    return rows.select(F.decode("name", "UTF-8").alias("name"), "size", F.sha2("content", 256).alias("sha256"), F.col("mtime_seconds").alias("mtime"))


@query("SELECT source || '/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def sql_members(spark, sf_dir):
    """The table function, from SQL."""
    from ..operators import sql

    sql.register(spark)
    packed = ops.pack(documents(spark, sf_dir), "cpio")
    return spark.sql("SELECT decode(m.name, 'UTF-8') AS name, m.size FROM {packed} p, LATERAL container_members(p.path, p.content) m", packed=packed)


@query("SELECT 0::BIGINT AS differences, count(*) AS members FROM documents")
def central_vs_local(spark, sf_dir):
    """A zip by its local headers and by its directory, joined on ordinals."""
    packed = ops.pack(documents(spark, sf_dir), "zip", method="deflate")

    def facts(access):
        rows = ops.members(packed, access=access, with_content=False)
        return rows.select("path", "idx", "name", F.col("zip.method").alias("method"), F.col("zip.crc32").alias("crc32"), F.col("zip.compressed_size").alias("compressed_size"), "size")

    local, central = facts("sequential"), facts("random")
    n = central.agg(F.count(F.lit(1)).alias("members"))
    return ops.disagreements(local, central).agg(F.count(F.lit(1)).alias("differences")).join(n)


# Names --------------------------------------------------------------------------------------------------------------

#: Hostile forms of a name, in SQL both engines read alike; E is the escape character, B the backslash.
HOSTILE = (
    "n", "'/' || n", "'../' || n", "'a/../../' || n", "'a/..'", "'./' || n", "n || '//' || n", "n || '/'", "n || '.'", "n || ' '", "'aux.' || n", "'dir/COM1'", "'C:' || n", "'//' || n",
    "'a' || chr(92) || '..' || chr(92) || '..' || chr(92) || n", "chr(92) || chr(92) || n", "n || chr(10)", "n || chr(127)", "'é/' || n", "'/'", "'lpt9 .x'",
)
_FORMS = ", ".join(f"({i}, {e})" for i, e in enumerate(HOSTILE))
MASK_SQL = r"""
, bare AS (
  SELECT *, regexp_replace(regexp_replace(name, '/$', ''), '^/', '') AS p, regexp_replace(regexp_replace(name, '[/\\]$', ''), '^[/\\]', '') AS w FROM forms
), parts AS (
  SELECT *, string_split(p, '/') AS ps, string_split(replace(w, chr(92), '/'), '/') AS ws FROM bare
), walked AS (
  SELECT *,
    len(list_filter(range(1, len(ps) + 1), lambda i: len(list_filter(ps[1:i], lambda x: x = '..')) > len(list_filter(ps[1:i], lambda x: x NOT IN ('..', '.', ''))))) > 0 AS out_p,
    len(list_filter(range(1, len(ws) + 1), lambda i: len(list_filter(ws[1:i], lambda x: x = '..')) > len(list_filter(ws[1:i], lambda x: x NOT IN ('..', '.', ''))))) > 0 AS out_w
  FROM parts
)
SELECT id, form, CASE WHEN name = '' THEN 32 ELSE
    (CASE WHEN starts_with(name, '/') THEN 1 ELSE 0 END) + (CASE WHEN out_p THEN 2 ELSE 0 END)
  + (CASE WHEN list_contains(ps, '..') THEN 4 ELSE 0 END) + (CASE WHEN list_contains(ps, '.') THEN 8 ELSE 0 END) + (CASE WHEN list_contains(ps, '') THEN 16 ELSE 0 END)
  + (CASE WHEN regexp_matches(name, '[\x01-\x1f\x7f]') THEN 128 ELSE 0 END) + (CASE WHEN contains(name, chr(92)) THEN 256 ELSE 0 END)
  + (CASE WHEN contains(name, chr(92)) AND NOT out_p AND out_w THEN 512 ELSE 0 END)
  + (CASE WHEN regexp_matches(name, '^[A-Za-z]:') THEN 1024 ELSE 0 END) + (CASE WHEN regexp_matches(name, '^[/\\][/\\]') THEN 2048 ELSE 0 END)
  + (CASE WHEN len(list_filter(ps, lambda x: regexp_full_match(x, '(?is)(con|prn|aux|nul|com[1-9]|lpt[1-9]) *(\..*)?'))) > 0 THEN 4096 ELSE 0 END)
  + (CASE WHEN len(list_filter(ps, lambda x: regexp_matches(x, '[. ]$') AND x NOT IN ('.', '..'))) > 0 THEN 8192 ELSE 0 END)
  END::INTEGER AS mask
FROM walked
"""


@query("WITH forms AS (SELECT page_id AS id, 0 AS form, coalesce(url, '') AS name FROM pages)" + MASK_SQL)
def name_check_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("id"), F.lit(0).alias("form"), names.name_mask(F.coalesce("url", F.lit("")).cast("binary")).alias("mask"))


@query(f"WITH forms AS (SELECT id, f.form, f.name FROM (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS n FROM part) s, LATERAL (SELECT * FROM (VALUES {_FORMS}) v(form, name)) f)" + MASK_SQL)
def name_check_hostile(spark, sf_dir):
    named = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "replace(p_name, ' ', '_') AS n")
    forms = named.selectExpr("id", "posexplode(array(" + ", ".join(HOSTILE) + ")) AS (form, name)")
    return forms.select("id", "form", names.name_mask(F.col("name").cast("binary")).alias("mask"))


_ESC = "CASE WHEN c = chr(92) THEN chr(92) || chr(92) WHEN c >= ' ' AND c <= '~' THEN c ELSE chr(92) || 'x' || upper(lpad(to_base(ascii(c), 16), 2, '0')) END"


@query(f"SELECT p_partkey AS id, list_aggregate(list_transform(list_filter(string_split(p_name || chr(9) || chr(92) || p_type, ''), lambda c: c <> ''), lambda c: {_ESC}), 'string_agg', '') AS shown FROM part")
def escaped_names(spark, sf_dir):
    odd = F.concat(F.col("p_name"), F.lit("\t\\"), F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.escaped(odd.cast("binary")).alias("shown"))


@query(
    """
WITH n AS (SELECT o_orderkey AS idx, o_custkey % 7 AS path, CASE o_orderkey % 5 WHEN 0 THEN '../x' ELSE 'd/' || o_orderkey END AS name FROM orders),
m AS (SELECT *, min(CASE WHEN starts_with(name, '../') THEN idx END) OVER (PARTITION BY path) AS stop FROM n)
SELECT path::VARCHAR AS path, idx, CASE WHEN idx < coalesce(stop, idx + 1) THEN 'extract' WHEN idx = stop THEN 'refuse' ELSE 'skip' END AS action FROM m
"""
)
def extract_plan(spark, sf_dir):
    named = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 7 AS STRING) AS path", "o_orderkey AS idx", "CAST(CASE o_orderkey % 5 WHEN 0 THEN '../x' ELSE concat('d/', o_orderkey) END AS BINARY) AS name", "'file' AS type"
    )
    return ops.extract_plan(named).select("path", "idx", "action")


# Counts, caps, lookups ----------------------------------------------------------------------------------------------


def order_members(spark, sf_dir):
    """Line items as members of one container a ship month."""
    items = table(spark, sf_dir, "lineitem")
    keyed = items.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), (F.col("l_partkey") % 50).alias("part"), (F.col("l_quantity") * 1000).cast("bigint").alias("size")
    )
    once = keyed.groupBy("path", "idx").agg(F.min("part").alias("part"), F.sum("size").alias("size"))
    return once.select("path", "idx", F.concat(F.lit("Part"), "part").cast("binary").alias("name"), "size")


ITEMS = (
    "SELECT strftime(l_shipdate, '%Y-%m') AS path, l_orderkey * 8 + l_linenumber AS idx, 'Part' || min(l_partkey % 50) AS name, sum((l_quantity * 1000)::BIGINT)::BIGINT AS size FROM lineitem GROUP BY 1, 2"
)


@query(
    f"""
WITH m AS ({ITEMS}), w AS (SELECT *, row_number() OVER o AS n, sum(size) OVER o AS total FROM m WINDOW o AS (PARTITION BY path ORDER BY idx)),
b AS (SELECT *, CASE WHEN size > 49000 THEN 'LIMIT_MEMBER_BYTES' WHEN n > 60 THEN 'LIMIT_MEMBERS' WHEN total > 1000000 THEN 'LIMIT_TOTAL_BYTES' END AS broken FROM w),
s AS (SELECT path, min(n) FILTER (broken IS NOT NULL) AS stop, arg_min(broken, n) FILTER (broken IS NOT NULL) AS status FROM b GROUP BY path)
SELECT b.path, idx, coalesce(status, 'END') AS status FROM b JOIN s USING (path) WHERE n < coalesce(stop, n + 1)
"""
)
def caps_prefix(spark, sf_dir):
    limits = Limits(max_members=60, max_member_bytes=49000, max_total_bytes=1000000)
    return ops.capped(order_members(spark, sf_dir), limits).select("path", "idx", "status")


@query(f"SELECT path, min(idx) AS idx FROM ({ITEMS}) WHERE name = 'Part7' GROUP BY path")
def find_first(spark, sf_dir):
    return ops.find(order_members(spark, sf_dir), b"Part7").select("path", "idx")


@query(f"SELECT path, name, count(*) AS copies FROM ({ITEMS}) GROUP BY path, name HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return ops.duplicates(order_members(spark, sf_dir)).select("path", F.decode("name", "UTF-8").alias("name"), "copies")


@query("SELECT 'p' || (p_size % 5) AS path, lower(n) AS folded, count(DISTINCT n) AS names FROM (SELECT p_size, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE lower(p_type) END AS n FROM part) GROUP BY 1, 2 HAVING count(DISTINCT n) > 1")
def case_collisions(spark, sf_dir):
    named = table(spark, sf_dir, "part").selectExpr("concat('p', p_size % 5) AS path", "CAST(CASE p_partkey % 2 WHEN 0 THEN p_type ELSE lower(p_type) END AS BINARY) AS name")
    return ops.collisions(named)


@query("SELECT path, name, count(*) AS members, sum(size)::BIGINT AS bytes, grouping(path, name)::BIGINT AS level FROM (" + ITEMS + ") GROUP BY ROLLUP (path, name)")
def container_rollup(spark, sf_dir):
    rows = order_members(spark, sf_dir).select("path", F.decode("name", "UTF-8").alias("name"), "size")
    return rows.rollup("path", "name").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.grouping_id().alias("level"))


@query("SELECT o_custkey AS set, o_orderkey AS part_no, coalesce(sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM orders")
def volume_offsets(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").selectExpr("o_custkey AS set", "o_orderkey AS part_no", "CAST(length(o_orderpriority) AS BIGINT) AS length")
    return ops.volume_offsets(parts).select("set", "part_no", F.col("offset").alias("byte_offset"))


@query(
    """
WITH t AS (SELECT c_custkey AS idx, c_name AS name, c_nationkey AS device, c_custkey % 40 AS inode, 3 AS links FROM customer)
SELECT idx, CASE WHEN row_number() OVER w > 1 THEN first_value(name) OVER w END AS link_target, links > count(*) OVER (PARTITION BY device, inode) AS refused FROM t WINDOW w AS (PARTITION BY device, inode ORDER BY idx)
"""
)
def hardlink_first(spark, sf_dir):
    tree = table(spark, sf_dir, "customer").selectExpr("c_custkey AS idx", "c_name AS name", "c_nationkey AS device", "c_custkey % 40 AS inode", "3 AS links")
    return ops.hardlinks(tree).select("idx", "link_target", "refused")


@query(
    """
WITH b AS (SELECT DISTINCT user_id AS path, floor(event_id / 3)::BIGINT AS block_no FROM events),
i AS (SELECT *, block_no - row_number() OVER (PARTITION BY path ORDER BY block_no) AS island FROM b)
SELECT path, min(block_no) AS first_block, count(*) AS blocks FROM i GROUP BY path, island
"""
)
def sparse_map(spark, sf_dir):
    full = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.floor(F.col("event_id") / 3).alias("block_no"))
    return ops.sparse_regions(full)


# Scalars ------------------------------------------------------------------------------------------------------------

_DAY = "epoch(o_orderdate)::BIGINT + o_orderkey % 86400"


@query(
    f"""
WITH t AS (SELECT o_orderkey, {_DAY} AS s FROM orders), d AS (SELECT *, make_timestamp(s * 1000000) AS ts FROM t)
SELECT o_orderkey, (((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts)) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::BIGINT AS dos, s - s % 2 AS back FROM d
"""
)
def dos_time(spark, sf_dir):
    s = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("bigint") * 86400 + F.col("o_orderkey") % 86400
    dos = table(spark, sf_dir, "orders").select("o_orderkey", fields.epoch_to_dos(s).alias("dos"))
    return dos.select("o_orderkey", "dos", fields.dos_to_epoch(F.col("dos")).alias("back"))


@query("SELECT o_orderkey, " + _DAY + " AS seconds, ((o_orderkey % 100) * 100)::INTEGER AS ns FROM orders")
def filetime(spark, sf_dir):
    s = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("bigint") * 86400 + F.col("o_orderkey") % 86400
    ticks = (s + fields.FILETIME_EPOCH) * 10_000_000 + F.col("o_orderkey") % 100
    seconds, ns = fields.filetime_to_epoch(ticks)
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), ns.alias("ns"))


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 100 > 0 THEN -o_custkey - 1 ELSE -o_custkey END ELSE o_custkey END AS seconds,
  (CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 100 > 0 THEN 1000000000 - (o_orderkey % 100) * 10000000 ELSE (o_orderkey % 100) * 10000000 END)::INTEGER AS ns FROM orders
"""
)
def pax_mtime(spark, sf_dir):
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), "o_custkey", F.lit("."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    seconds, ns = fields.pax_time(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), ns.alias("ns"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 2097152 THEN lpad(to_base(o_orderkey, 8), 7, '0') END AS written, CASE WHEN o_orderkey < 2097152 THEN o_orderkey END AS back FROM orders")
def octal_fields(spark, sf_dir):
    written = table(spark, sf_dir, "orders").select("o_orderkey", fields.format_octal(F.col("o_orderkey"), 7).alias("written"))
    return written.select("o_orderkey", "written", fields.octal(F.concat(F.lit(" "), "written", F.lit("\x00"))).alias("back"))


@query(
    """
WITH n AS (SELECT page_id, 'mirror/' || repeat(replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '//', '/') || '/', 1 + (page_id % 4)::INTEGER) || 'index' AS name FROM pages),
c AS (SELECT *, list_max(list_filter(range(2, strlen(name) + 1), lambda i: substring(name, i, 1) = '/' AND i - 1 <= 155 AND strlen(name) - i BETWEEN 1 AND 100)) AS cut FROM n)
SELECT page_id, CASE WHEN strlen(name) <= 100 THEN '' ELSE substring(name, 1, cut - 1) END AS prefix, CASE WHEN strlen(name) <= 100 THEN name ELSE substring(name, cut + 1) END AS rest FROM c
"""
)
def ustar_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('mirror/', repeat(concat(replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '//', '/'), '/'), CAST(1 + page_id % 4 AS INT)), 'index') AS name"
    )
    split = fields.ustar_split(F.col("name"))
    return pages.select("page_id", split.prefix.alias("prefix"), split["name"].alias("rest"))


@query(
    """
WITH b AS (SELECT page_id, strlen(coalesce(url, '')) + 4 + 3 AS body FROM pages), a AS (SELECT *, body + length(body::VARCHAR) AS one FROM b)
SELECT page_id, (body + length(one::VARCHAR))::INTEGER AS record FROM a
"""
)
def pax_record_length(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fields.pax_record_length(F.lit("path"), F.coalesce("url", F.lit(""))).alias("record"))


@query(
    """
WITH t AS (SELECT p_partkey, [0, 8, 9, 12, 14, 93, 95][1 + p_partkey % 7] AS method, p_partkey % 11 = 0 AS locked, (p_retailprice * 4000000)::BIGINT AS size FROM part)
SELECT p_partkey, size >= 4294967295 AS zip64, (CASE WHEN locked THEN 51 WHEN method IN (14, 93, 95) THEN 63 WHEN method = 12 THEN 46 WHEN size >= 4294967295 THEN 45 WHEN method = 9 THEN 21 ELSE 20 END)::INTEGER AS version,
  CASE method WHEN 0 THEN 'stored' WHEN 8 THEN 'deflate' WHEN 9 THEN 'enhanced deflate (deflate64)' WHEN 12 THEN 'bzip2' WHEN 14 THEN 'lzma' WHEN 93 THEN 'zstd' ELSE 'xz' END AS method_text FROM t
"""
)
def zip_versions(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", "element_at(array(0, 8, 9, 12, 14, 93, 95), CAST(1 + p_partkey % 7 AS INT)) AS method", "p_partkey % 11 = 0 AS locked", "CAST(round(p_retailprice * 4000000) AS BIGINT) AS size")
    large = fields.needs_zip64(F.col("size"), F.lit(0), F.lit(0))
    return t.select("p_partkey", large.alias("zip64"), fields.version_needed(F.col("method"), F.col("locked"), large).alias("version"), fields.method_text(F.col("method")).alias("method_text"))


_STATUSES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in status.TEXT.items())


@query(f"SELECT code, text AS message, code NOT IN ('OK', 'END') AS is_error, starts_with(code, 'LIMIT_') AS is_limit, count(*) AS n FROM (VALUES {_STATUSES}) v(code, text), region GROUP BY ALL")
def status_texts(spark, sf_dir):
    codes = table(spark, sf_dir, "region").select(F.explode(F.array(*map(F.lit, status.TEXT))).alias("code"))
    c = F.col("code")
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", status.status_text(c).alias("message"), status.is_error(c).alias("is_error"), status.is_limit(c).alias("is_limit"), "n")


@query(
    """
SELECT conv_id, sha256('#!/bin/sh' || chr(10) || '# This is a shell archive; run it with sh to extract.' || chr(10)
  || string_agg('echo x ''' || f || '''' || chr(10) || 'sed ''s/^X//'' > ''' || f || ''' << ''SHAR_END''' || chr(10)
  || 'X' || replace(coalesce(text, ''), chr(10), chr(10) || 'X') || chr(10) || 'SHAR_END' || chr(10), '' ORDER BY f) || 'exit 0' || chr(10)) AS sha256
FROM (SELECT conv_id, text, lpad(turn::VARCHAR, 6, '0') || '.txt' AS f FROM conversations) GROUP BY conv_id
"""
)
def shar_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit(".txt")).cast("binary").alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content")
    )
    return ops.pack(rows, "shar").select(F.col("path").cast("bigint").alias("conv_id"), F.sha2("content", 256).alias("sha256"))
