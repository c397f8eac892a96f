"""URL filters: host and path rules first, else logistic regression on hashed character n-grams.

Everything on the way is a DataFrame expression.  A rule ``host/path`` fits its host and all subdomains of it if the
url's path starts with the rule's; the longest rule wins (equal lengths: the smaller string).  The model hashes the
n-grams of ``host + path`` into DIMENSIONS buckets; its weights are learnt by nested ``aggregate`` calls over the labelled
examples, a small table (its row count is checked), and reach the scoring side as a constant array.  The labelled table is built
by rule from words of both kinds and from invented hosts; a quarter of it is held out and never learnt.

A null url, or one without ``://``, has an empty host and path; no rule fits an empty host, and the
method gives its verdict.  Null labels are left out; without examples of both classes every weight is 0 and the verdict is allow.
Rows are judged one by one: repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, SIZES, EPOCHS, RATE, DECAY = 16384, (3, 4), 25, 0.45, 0.002
MAX_EXAMPLES, MAX_RULES = 2000, 1000

#: Rules of the query: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The words from which the small labelled table is built: unwanted, wanted, and wanted ones that look like unwanted.
UNWANTED = (
    "casino poker roulette jackpot slots betting bets gambling lottery viagra cialis pills pharmacy steroids xxx porn sex adult escort nude webcam hookup torrent warez crack keygen "
    "serial nulled malware phishing trojan spam scam adserver ads tracker popunder clickbait cheap free-money payday-loan get-rich win-prize replica fake-id login-verify"
).split()
WANTED = (
    "news blog docs wiki library science school museum article research history music garden recipes weather travel books forum city university hospital theatre museumshop council almanac "
    "journal physics biology chemistry geography language grammar poetry novel gallery photography cooking bakery farm forest river mountain harbour railway station market kitchen football"
).split()
LOOKALIKE = "essex sussex middlesex sextant adulthood cockpit grape therapist spamalot pillow pillar adsorption freedom cheapside windows winter betony betws alphabet crackle scampi serialism trackbed".split()
#: Syllables and endings from which invented hosts are built by rule.
SYLLABLES, ENDINGS, LANGUAGES = ("ba", "ko", "ri", "tel", "mun", "sha", "ver", "lin", "dor", "pes", "gan", "tho"), ("com", "org", "net", "example.com", "co.uk", "de"), ("en", "de", "fr", "es")
INVENTED = 80


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def invented_host(i: Column) -> Column:
    """The i-th host of three syllables and an ending."""
    return F.concat(_pick(SYLLABLES, i), _pick(SYLLABLES, i * 5 + F.floor(i / 12) + 1), _pick(SYLLABLES, i * 7 + F.floor(i / 5) + 3), F.lit("."), _pick(ENDINGS, i * 11 + F.floor(i / 7)))


def labelled_urls(spark: SparkSession, held_out: bool | None = False) -> DataFrame:
    """The small labelled table (url, label, held_out): words of both kinds in hosts and in paths, and invented hosts, which are wanted.

    Each word is in four urls: as a host of its own, with a neighbour of its kind, behind an invented name, and in the path of an
    invented host.  A quarter of the rows, by a hash of the url, is held out.  held_out: which rows, or None for all.
    """
    kinds = ((1, UNWANTED), (0, [*WANTED, *LOOKALIKE]))
    listed = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(ws[(k + 7) % len(ws)]).alias("other"), F.lit(y).alias("label"), F.lit(k).alias("k")) for y, ws in kinds for k, w in enumerate(ws)))
    words = spark.range(1).select(F.explode(listed).alias("w")).select("w.*")
    k, end, lang = F.col("k"), _pick(ENDINGS, F.col("k")), _pick(LANGUAGES, F.col("k") + 1)
    shapes = F.array(
        F.concat(F.lit("http://www."), "word", F.lit("."), end, F.lit("/")),
        F.concat(F.lit("https://"), "word", F.lit("-"), "other", F.lit("."), end, F.lit("/"), lang, F.lit("/"), (k * 37 + 100).cast("string")),
        F.concat(F.lit("https://m."), _pick(SYLLABLES, k), "word", F.lit(".example."), _pick(("com", "net", "org"), k), F.lit("/"), lang, F.lit("/index.html")),
        F.concat(F.lit("https://"), invented_host(k * 3), F.lit("/"), lang, F.lit("/"), "word", F.lit("/"), (k * 53 + 7).cast("string"), F.lit(".html")),
    )
    named = words.select(F.explode(shapes).alias("url"), "label")
    i = F.col("id")
    hosts = spark.range(INVENTED).select(
        F.concat(F.lit("https://"), _pick(("", "www.", "blog.", "m."), i), invented_host(i), F.lit("/"), _pick(LANGUAGES, i), F.lit("/"), (i * 41 + 3).cast("string"), _pick(("", "/", ".html"), i)).alias("url"), F.lit(0).alias("label")
    )
    rows = named.unionByName(hosts).withColumn("held_out", F.crc32(F.col("url").cast("binary")) % 4 == 0)
    return rows if held_out is None else rows.where(F.col("held_out") == F.lit(held_out))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)\A([^/]*)", 1)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: keep them in a table and join by host suffix")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(text: Column) -> Column:
    """Distinct buckets of a text's character n-grams."""

    def grams(n: int) -> Column:
        def bucket(i: Column) -> Column:  # of one argument: a second one would be given the index
            return F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int")

        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(places, bucket)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*map(grams, SIZES)))


def _constant(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _total(values: Column, buckets: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda t, b: t + F.element_at(values, b + 1))


def margin(model: dict, buckets: Column) -> Column:
    """The log odds: bias and weights of the buckets, each by its rarity, over the length of that vector."""
    norm = F.sqrt(F.greatest(_total(_constant(model["squares"]), buckets), F.lit(1e-9)))
    return F.lit(model["bias"]) + _total(_constant(model["weights"]), buckets) / norm


def train(examples: DataFrame) -> dict:
    """Bias, weights and squared rarities (log of examples to those with the bucket) of a regularised logistic regression.

    Full-batch gradient descent, both classes of equal weight.  Weights move within the span of the examples, so the descent runs on
    one coefficient an example, over their kernel (shared buckets' squared rarities over both lengths); the buckets' weights
    follow at the end.
    """
    host, path = host_path(F.col("url"))
    rows = examples.where("label is not null").select("url", F.col("label").cast("double").alias("label"), features(F.concat(host, path)).alias("f"))
    n, unwanted = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if n > MAX_EXAMPLES:
        raise ValueError(f"{n} labelled urls; the small table may have {MAX_EXAMPLES}")
    squares = [math.log(n + 1) ** 2] * DIMENSIONS
    for bucket, k in rows.select(F.explode("f").alias("b")).groupBy("b").count().collect():  # DIMENSIONS rows at most
        squares[bucket] = math.log((n + 1) / (k + 1)) ** 2
    if not n or not 0 < unwanted < n:
        return {"bias": 0.0, "weights": [0.0] * DIMENSIONS, "squares": squares}
    rare = _constant(squares)
    weight = F.when(F.col("label") > 0, n / 2 / unwanted).otherwise(n / 2 / (n - unwanted))
    x = F.struct("url", "label", "f", F.sqrt(F.greatest(_total(rare, F.col("f")), F.lit(1e-9))).alias("norm"), weight.alias("weight"))
    listed = rows.select(x.alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    kernel = F.transform("xs", lambda a: F.transform("xs", lambda b: _total(rare, F.array_intersect(a.f, b.f)) / (a.norm * b.norm)))
    # The aggregates are barriers: without them the optimizer would put the kernel into every step.
    held = listed.select("xs", kernel.alias("k")).agg(F.first("xs").alias("xs"), F.first("k").alias("k"))
    start = F.struct(F.transform("xs", lambda _: F.lit(0.0)).alias("a"), F.lit(0.0).alias("b"))

    def step(s: Column, _: Column) -> Column:
        def residual(row: Column, i: Column) -> Column:
            z = s.b + F.aggregate(F.zip_with(row, s.a, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
            own = F.get(F.col("xs"), i)
            return own.weight * (own.label - 1 / (1 + F.exp(-z)))

        g = F.transform("k", residual)
        new = F.zip_with(s.a, g, lambda v, r: v * (1 - DECAY) + r * RATE)
        mean = F.aggregate(g, F.lit(0.0), lambda t, v: t + v) / F.size("xs")
        return F.struct(new.alias("a"), (s.b + mean * RATE).alias("b"))

    learnt = held.select("xs", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, step).alias("s"))
    learnt = learnt.agg(F.first("xs").alias("xs"), F.first("s").alias("s"))
    spread = learnt.select(F.col("s.b").alias("bias"), F.explode(F.arrays_zip(F.col("s.a").alias("a"), F.col("xs").alias("x"))).alias("e"))
    found = spread.select("bias", F.explode("e.x.f").alias("bucket"), (F.col("e.a") / F.col("e.x.norm")).alias("w")).groupBy("bucket").agg(F.sum("w").alias("w"), F.first("bias").alias("bias"))
    weights, bias = [0.0] * DIMENSIONS, 0.0
    for bucket, w, bias in found.collect():
        weights[bucket] = w * squares[bucket]
    return {"bias": bias, "weights": weights, "squares": squares}


def judged(pages: DataFrame, examples: DataFrame | None = None, rules=RULES, threshold: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the margin, that is the log odds; over the threshold: block) of every row."""
    learnt = train(labelled_urls(pages.sparkSession) if examples is None else examples)
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = parts.withColumn("score", margin(learnt, features(F.concat("host", "path"))))
    scored = scored.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
