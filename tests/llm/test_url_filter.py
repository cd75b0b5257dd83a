from . import rows as R  # noqa: F401
from pyspark.sql import functions as F

from assay.llm import bloom
from assay.llm import url_filter as U

URLS = [None, "", "no scheme", "http://net", "http://NET/", "https://a.example.NET/en/x?y#z", "https://a.example.net/EN/", "x://example.com/de/1", "x://badexample.com/de/", "http://a.org/fr/", "http://a.org/fr", "http://b.org?q=://net/", "http://a.net#/x", "http://a.net:80/", "http:///net/"]


def _brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:n].translate(str.maketrans(U.UPPER, U.LOWER)), rest[n:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_against_brute_force(spark, tmp_path):
    rows = [(i % 13, u, "<p>") for i, u in enumerate(URLS * 2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(str, U.op2_url_filter(spark, str(tmp_path)).collect()))
    want = spark.createDataFrame([(i, *_brute(u)) for i, u, _ in rows], "page_id long, host string, path string, rule string, verdict string")
    assert got == sorted(map(str, want.collect()))


def test_large_list_and_salted_join_agree(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 700).cast("string"), F.lit(".net/p/"), F.col("id").cast("string")).alias("url"))
    listed = spark.range(600).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".net")).alias("host"), F.lit("/p/1").alias("path"), F.lit("block").alias("verdict"))
    a = U.judge_urls(pages, listed).orderBy("page_id").collect()
    b = U.judge_urls(pages, listed, broadcast_rows=10).orderBy("page_id").collect()
    assert a == b
    want = {i for i in range(3000) if i % 700 < 600 and str(i).startswith("1")}
    assert {r["page_id"] for r in a if r["verdict"] == "block"} == want


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge_urls(none, rules).count() == 0
    assert U.judge_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), rules.limit(0)).first()["verdict"] == "allow"


def test_bloom_has_no_false_negative(spark):
    keys, blocks = spark.range(500), bloom.block_count(500)
    out = bloom.passing(spark.range(20_000), F.col("id"), bloom.build(keys, F.col("id"), blocks), blocks)
    got = {r["id"] for r in out.collect()}
    assert set(range(500)) <= got and len(got) < 1500
