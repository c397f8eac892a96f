"""The queries opN_<name>: each applies its operator to whole tables; oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, find_contamination

    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import predictions

    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest, formatted

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    added = spark.range(2).select(said.alias("s"), F.col("id").alias("turn")).select(
        "s.conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), "s.text"
    )
    return digest(formatted(rows.unionByName(added)))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeated_passages

    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a full response at twice its id, and is asked for again 2001 later with its own ETag."""
    from .warc import resolve_revisits

    pages = table(spark, sf_dir, "pages")
    etag = F.md5(F.coalesce("html", F.lit("")))
    first = pages.select(
        F.col("page_id").cast("string").alias("record_id"), F.lit("response").alias("type"), "url", (F.col("page_id") * 2).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (F.col("page_id") * 2).cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.col("html").alias("payload"),
    )
    again = pages.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), F.lit("revisit").alias("type"), "url", (F.col("page_id") * 2 + 2001).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("none"), F.lit("date"), (F.col("page_id") * 2 + 2001).cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("payload"),
    )
    out = resolve_revisits(first.unionByName(again))
    return out.select(
        "record_id", "canonical", "ts", "refers_to", "outcome", F.col("headers")["content-type"].alias("content_type"), F.col("headers")["date"].alias("date"), F.sha2("payload", 256).alias("payload_sha256")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages")).drop("score")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, scan_secrets

    return digest(scan_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_best_fit_packing, op3_toxicity, op4_chat_formatting, op5_document_fingerprints, op6_substring_dedup, op7_warc_revisits, op8_url_filters, op9_minhash_near_dedup, op10_secret_scan)
}

#: A native twin of op4: turns and masked texts are the table's own; formatted_chars from the marks' lengths.
OP4_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + {text}
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 14 + length(role) + {role} + length(role) - length(replace(role, '>', '')) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  coalesce(regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
    ORDER BY turn, role, text), 's?u(au)*a?'), false) AS valid
FROM sized GROUP BY conv_id
"""
#: Characters that escaping adds: one for each escape character, two for each control string.
_ADDED = " + ".join(
    ["length({0}) - length(replace({0}, chr(27), ''))"]
    + [f"2 * (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("<<SYS>>", "[INST]", "<s>", "<</SYS>>", "[/INST]", "</s>", "<role ", "</role>")]
)
OP4_SQL = OP4_SQL.format(text=_ADDED.format("text"), role=_ADDED.format("role"))

OP7_SQL = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
    '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') AS bare
  FROM pages
), parts AS (
  SELECT page_id, html, lower(regexp_extract(bare, '^([^/?]*)', 1)) AS host, bare FROM bare
), keyed AS (
  SELECT page_id, html, md5(coalesce(html, '')) AS etag,
    regexp_replace(regexp_replace(host, '^www[0-9]*\.', ''), ':(80|443)$', '')
      || regexp_replace(substring(bare, length(host) + 1), '/+$', '') AS canonical
  FROM parts
), refs AS (
  SELECT r.page_id, max(f.page_id) AS ref FROM keyed r
  LEFT JOIN keyed f ON f.canonical = r.canonical AND f.page_id * 2 < r.page_id * 2 + 2001 GROUP BY r.page_id
)
SELECT 'r' || r.page_id AS record_id, r.canonical, r.page_id * 2 + 2001 AS ts, f.page_id::VARCHAR AS refers_to,
  CASE WHEN f.page_id IS NULL THEN 'missing' WHEN f.etag = r.etag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN f.etag = r.etag THEN 'text/html' ELSE 'none' END AS content_type,
  (r.page_id * 2 + 2001)::VARCHAR AS date,
  CASE WHEN f.etag = r.etag THEN sha256(f.html) END AS payload_sha256
FROM keyed r LEFT JOIN refs ON refs.page_id = r.page_id LEFT JOIN keyed f ON f.page_id = refs.ref
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows by plain search: every run of a document's words, as long as some window, against all windows.
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), found AS (SELECT r, i, n, item_id FROM runs JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (g)) GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN (SELECT r, unnest(ps) AS p FROM gone) USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

#: Similarities of all pairs that share a shingle, and the least id reachable over the links.
OP9_SQL = (
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all("""
    + _LOWER.format("coalesce(text, '')")
    + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingles a JOIN shingles b USING (g) WHERE a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(r, y) AS (SELECT r, r FROM d UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN least USING (r) LEFT JOIN sizes USING (r)
"""
)

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_warc_revisits": OP7_SQL, "op9_minhash_near_dedup": OP9_SQL}
