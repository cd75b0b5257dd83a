"""Open JSON gives the same strings as a closed schema, to any depth."""

import json

from pyspark.sql import functions as F

from assay.functions import leaves as L

SCHEMA = "findings array<struct<id: string, n: int, evidence: array<struct<file: string, excerpt: string>>>>, summary string"


def test_same_as_the_closed_schema(spark):
    docs = [{"summary": "s", "findings": [{"id": "f1", "n": 3, "evidence": [{"file": "a", "excerpt": "x"}, {"file": "b"}]}, {"id": "f2", "evidence": []}]}, {"findings": []}, {"summary": ""}, {}]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, body string")
    closed = L.string_leaves(df.withColumn("doc", F.from_json("body", SCHEMA)), "doc", "k")
    got = sorted(map(tuple, L.open_leaves(df, "body", "k").collect()))
    assert got == sorted(map(tuple, closed.collect())) and len(got) == 7


def test_any_depth_and_odd_documents(spark):
    deep = '{"a":[' * 20 + '"bottom"' + "]}" * 20
    texts = [deep, None, "", "[1, 2", "null", '"alone"', "[[[]], {}, [null, true, 1.5]]", '{"k": "é\\n", "file": ["x", "y"]}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    got = sorted(map(tuple, L.open_leaves(df, "body", "k", levels=3).collect()))
    assert got == [(0, "$" + ".a[0]" * 20, "bottom"), (5, "$", "alone"), (7, "$.file[0]", "x"), (7, "$.file[1]", "y"), (7, "$.k", "é\n")]
    assert L.open_leaves(df.limit(0), "body", "k").count() == 0


def test_one_pass_whatever_the_depth(spark):
    """The plan has one step over the documents, not one a level, and no write before it; numbers of any length are no strings."""
    deep = '{"a":[' * 300 + '"bottom"' + "]}" * 300
    texts = [deep, '{"n": ' + "9" * 5000 + ', "s": "x"}', '{"n": NaN, "s": "x"}', '{"s": "\\ud800"}']
    df = L.open_leaves(spark.createDataFrame(list(enumerate(texts)), "k int, body string"), "body", "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 0 and plan.count("MapInArrow") == 1
    assert sorted(map(tuple, df.collect())) == [(0, "$" + ".a[0]" * 300, "bottom"), (1, "$.s", "x"), (3, "$.s", "?")]
