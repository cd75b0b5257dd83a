"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact
hash join, which removes the false positives. DataFrame expressions only.

A listed URL is a host and a path prefix with a verdict. It fits its host and every
subdomain; of the entries that fit a URL the longest (host and path together, then the
longer host) decides. A URL's candidate keys are its host suffixes times its path prefixes of
the lengths that occur in the list, so a lookup is an equality test however long the list is.

Defined results: a null URL, or one without `://`, has an empty host and path and no rule; an
empty list gives every URL the default verdict; repeated rows are kept; repeated list entries
with one key count once (the smallest verdict text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def judge_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """pages (key, url), listed (host, path, verdict) -> (key, host, path, rule, verdict).

    `default` is the verdict of URLs that no entry fits. The list is broadcast only if it has
    at most `broadcast_rows` rows; otherwise it is joined by hash, with the candidates of one
    key (`net/` may be in a third of them) dealt over `salts` copies of the list's rows.
    """
    entries = listed.where("host <> '' and path is not null").groupBy(F.concat("host", "path").alias("rule")).agg(F.min(F.struct("verdict", F.length("host").alias("host_chars"))).alias("e"))
    entries = entries.select("rule", "e.verdict", "e.host_chars")
    n = entries.count()
    out = pages.select(F.col(key).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not n:
        return out.select(F.col("id").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    blocks = bloom.block_count(n)
    sizes = listed.where("host <> '' and path is not null").agg(F.collect_set(F.length("path")).alias("n")).scalar()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = out.where("host <> ''").withColumn("hosts", hosts).withColumn("sizes", sizes)
    prefixes = F.transform(F.filter("sizes", lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    tried = tried.withColumn("prefixes", prefixes).withColumn("tail", F.explode("hosts"))
    tried = tried.withColumn("prefix", F.explode("prefixes")).withColumn("rule", F.concat("tail", "prefix"))
    tried = tried.select("id", "host", "path", "rule")
    tried = bloom.passing(tried, F.col("rule"), bloom.build(entries, F.col("rule"), blocks), blocks)
    if n <= broadcast_rows:
        hits = tried.join(F.broadcast(entries), "rule")
    else:
        dealt = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = tried.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(salts)).cast("int")).join(dealt.hint("shuffle_hash"), ["rule", "salt"])
    best = hits.groupBy("id", "host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule", "verdict")).alias("best"))
    o, b = out.alias("o"), best.alias("b")
    joined = o.join(b, F.col("o.id").eqNullSafe(F.col("b.id")) & (F.col("o.host") == F.col("b.host")) & (F.col("o.path") == F.col("b.path")), "left")
    return joined.select(F.col("o.id").alias(key), "o.host", "o.path", F.col("b.best.rule").alias("rule"), F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"))


# The four rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = r"""
WITH rules(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p0 FROM pages),
rest AS (SELECT page_id, CASE WHEN p0 > 0 THEN substr(u, p0 + 3) ELSE '' END AS r FROM parts),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
hit AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM hit WHERE k = 1) h ON p.page_id = h.page_id
"""
