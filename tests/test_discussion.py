"""Discussion matching by hashes against the windows as text."""

import random

import pytest

from assay.operators import contamination as C
from assay.operators import discussion as D


def _tables(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    said = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    shown = [" ".join(r.choice(words) for _ in range(80)) + " " + said[k][40:150] for k in range(4)]
    strings = []
    for k in range(80):
        t = [r.choice(words) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(4)):
            src = r.choice(said + shown).split()
            a = r.randrange(len(src))
            t[r.randrange(len(t) + 1) : 0] = src[a : a + r.randrange(5, 30)]
        strings.append((k, k % 5, "$.x.excerpt" if k % 11 == 0 else "$.x", " ".join(t).upper() if k % 2 else "-".join(t)))
    strings += [(100, 0, "$.x", None), (101, 1, "$.x", ""), (102, 2, "$.x", said[0] + " " + said[0])]
    s = spark.createDataFrame(strings, "run_id long, case_id long, path string, text string")
    d = spark.createDataFrame([(k, f"s{k}", x) for k, x in enumerate([*said, said[0], "short one", None])], "source_pos long, source string, body string")
    return s, d, spark.createDataFrame([(0, x) for x in shown], "case_id long, text string")


@pytest.mark.parametrize("few", [D.FEW_HASHES, 0])
def test_same_windows_and_spans_as_by_text(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW_HASHES", few)  # 0: by shuffles
    s, d, shown = _tables(spark)
    cited = spark.createDataFrame([(k, k % 5, "./a//b") for k in range(0, 103, 2)] + [(1, 1, "../b"), (3, 3, "/a/b")], "run_id long, case_id long, file string")
    files = spark.createDataFrame([(c, "a/b", " ".join(f"w{(k * k + c) % 40}" for k in range(300))) for c in range(5)], "case_id long, path string, text string")
    files = files.unionByName(d.where("source_pos = 1").crossJoin(spark.range(5).toDF("c")).selectExpr("c AS case_id", "'a/b' AS path", "body AS text"))
    for extra in ({}, {"cited": cited, "files": files}):
        ex = C.exclusion_shingles(shown, extra.get("cited"), extra.get("files"))
        index = C.discussion_index(d, ex.withColumn("case_id", ex["case_id"]))
        old = C.novel_windows(s, index, ex)
        found = D.matched(s, d, shown, **extra)
        cols = ["run_id", "path", "pos", "source"]
        want = sorted(map(tuple, old.select(cols).collect()))
        assert sorted(map(tuple, D.novel_windows(found).select(cols).collect())) == want and len(want) > 100
        hits = ["run_id", "kind", "path", "matched", "key_ref"]
        assert sorted(map(tuple, C.discussion_hits(found).select(hits).collect())) == sorted(map(tuple, C.span_hits(s, C.discussion_spans(old)).select(hits).collect()))
    free = D.matched(s, d)
    want = C.novel_windows(s, C.discussion_index(d))
    assert sorted(map(tuple, D.novel_windows(free).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {r["unexcluded"] for r in free.collect()} == {True}


def test_by_case_and_empty(spark):
    s, d, shown = _tables(spark)
    own = d.withColumn("case_id", d["source_pos"] % 5)
    got = D.novel_windows(D.matched(s, own, by_case=True)).collect()
    want = C.novel_windows(s, C.discussion_index(own)).collect()
    assert sorted((r["run_id"], r["pos"], r["source"]) for r in got) == sorted((r["run_id"], r["pos"], r["source"]) for r in want)
    assert D.matched(s.limit(0), d, shown).count() == 0 and D.matched(s, d.limit(0), shown).count() == 0


def test_a_hit_an_occurrence(spark):
    sha = "abcdef0123" + "4" * 30
    s = spark.createDataFrame([(1, 1, "$.a", "st", f"abcdef0 then ABCDEF0 then abcdef0 and {sha}; see PR #12, #12 and pull/12")], "run_id long, case_id long, path string, stage string, text string")
    keys = spark.createDataFrame([(1, 2, sha), (1, 1, sha.upper()), (1, 3, None)], "case_id long, ordinal long, sha string")
    assert sorted(r["matched"] for r in C.scan_sha(s, keys).collect()) == ["ABCDEF0", "abcdef0", "abcdef0", sha]
    pr = C.scan_pr(s, spark.createDataFrame([(1, 12)], "case_id long, number long")).collect()
    assert sorted((r["matched"], r["key_ref"], r["stage"]) for r in pr) == [("#12", "12", "st"), ("#12", "12", "st"), ("PR #12", "12", "st"), ("pull/12", "12", "st")]
