"""Text functions on inputs that the test tables do not hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from assay.functions import leaves as L
from assay.functions import scalars as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("path", "want"), [("", "."), ("a//b/./c/", "a/b/c"), ("a/../..", ".."), ("../../a", "../../a"), ("/..", "/"), ("/a/../b", "/b"), ("a/..", "."), ("./", "."), ("../a/../..", "../..")])
def test_clean_path(spark, path, want):
    assert one(spark, S.clean_path, path) == want


def test_identifiers(spark):
    assert one(spark, S.sha_tokens, "éabcdef1 xabcdef12 ABCDEF0 " + "a" * 41) == ["abcdef1", "ABCDEF0"]
    assert sorted(one(spark, S.pr_numbers, "PR #12")) == ["12", "12"]
    assert one(spark, S.cve_ids, "cve-2024-12345 CVE-24-1") == ["cve-2024-12345"]
    assert one(spark, S.patch_shas, "From ABCDEF1234 x\ncommit abcdef1234\n commit 1234567") == ["abcdef1234"]


def test_shingles(spark):
    f = lambda c: S.shingles(S.tokens(c))
    assert one(spark, f, "a b c d e f g") == []
    assert one(spark, f, "A b-c d é e f g h i") == ["a b c d e f g h", "b c d e f g h i"]
    assert one(spark, f, None) in (None, [])


def test_waits(spark):
    assert one(spark, S.reset_hint, "Try again in 5 minutes") == 300
    assert one(spark, S.reset_hint, "try again at 2:30 PM") == 2
    assert one(spark, S.reset_hint, "retry-after: 0") is None
    assert one(spark, S.rate_limit_match, "Error 429: usage limit") == "429"
    assert one(spark, S.rate_limit_match, "14290 bytes") is None
    now = datetime.datetime(2026, 1, 1, 13, 0)
    wait = lambda c: S.stall_wait(F.lit("try again at 2:30 PM"), c, F.lit(7))
    assert one(spark, wait, now, "timestamp") == 5430
    assert one(spark, wait, now.replace(hour=15), "timestamp") == 7


def test_statuses(spark):
    df = spark.createDataFrame([("CONFIRMED", "ODD"), ("REJECTED", ""), (None, None)], "b string, c string")
    assert [r[0] for r in df.select(S.final_status(F.col("b"), F.col("c"))).collect()] == ["unassessed", "rejected", "unassessed"]
    assert [r[0] for r in df.select(S.survived(F.col("b"))).collect()] == [True, False, True]


def test_leaves(spark):
    df = spark.createDataFrame([(1, {"s": "x", "items": [{"file": "a.c", "n": 1}, {"file": None, "n": 2}], "tags": ["t"]})], "id int, doc struct<s:string,items:array<struct<file:string,n:int>>,tags:array<string>>")
    got = {(r["path"], r["value"]) for r in L.string_leaves(df, "doc", "id").collect()}
    assert got == {("$.s", "x"), ("$.items[0].file", "a.c"), ("$.tags[0]", "t")}


def test_novelty_of_spans(spark):
    from assay.operators import contamination as C

    words = [f"w{i}" for i in range(30)]
    disc = spark.createDataFrame([(0, "d", " ".join(words))], "source_pos int, source string, body string")
    shown = spark.createDataFrame([(0, " ".join(words[:12]))], "case_id int, text string")
    ex = C.exclusion_shingles(shown)
    index = C.discussion_index(disc, ex)

    def spans(text):
        s = spark.createDataFrame([(1, 0, "$.t", text)], "run_id int, case_id int, path string, text string")
        return C.span_hits(s, C.discussion_spans(C.novel_windows(s, index, ex))).collect()

    assert spans(" ".join(words[:14])) == []  # a bridge of quoted tokens
    hit = spans(" ".join(words[:24]))
    assert len(hit) == 1 and hit[0]["key_ref"] == "d" and hit[0]["matched"].endswith("w23")


def test_null_texts(spark):
    for f in (S.strip_diff_headers, lambda c: S.excerpt_around(c, F.lit("x")), S.first_line):
        assert one(spark, f, None) is None
    assert one(spark, lambda c: S.excerpt_around(c, F.lit("x")), "none here") == ""
