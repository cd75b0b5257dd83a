"""Language and toxicity: accuracy on held-out rows, edge cases, exact parts against brute force."""

import random
import zlib

from . import rows as R

from assay.llm import langid, toxicity

SAMPLE = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    got = langid.op4_language_id(spark, SAMPLE).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_language_edges(spark, tmp_path):
    got = {r["doc_id"]: r for r in langid.op4_language_id(spark, R.table(spark, tmp_path)).collect()}
    for i in (5, 6, 7, 11):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"]
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in got.values())
    assert langid.op4_language_id(spark, R.table(spark, tmp_path / "e", [])).count() == 0
    assert langid.features("\u00bd \u00b2 \u2167") is None and langid.features("\u00bd x") is not None  # numerals are no letters


def test_toxicity_held_out(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in toxic]
    hit = sum(r["predicted"] for r in got if toxic[r["doc_id"]] == 1)
    wrong = sum(r["predicted"] for r in got if toxic[r["doc_id"]] == 0)
    assert hit >= 0.8 * sum(toxic[r["doc_id"]] for r in got) and wrong <= 0.02 * len(got)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_edges(spark, tmp_path):
    docs = [(i, f"good day {R.words(i, 40)}" + (" vile slur here" if i % 4 == 0 else "")) for i in range(80)] + [(900, None), (901, ""), (None, "vile slur")]
    labels = _labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(80)] + [(3, 1, 0), (None, 1, 1), (5, 1, None)])
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, R.table(spark, tmp_path, docs, labels=labels)).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(80))
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    none = toxicity.op7_toxicity(spark, R.table(spark, tmp_path / "n", docs, labels=_labels(spark, []))).collect()
    assert all(r["score"] == 0 for r in none)
    ones = toxicity.op7_toxicity(spark, R.table(spark, tmp_path / "o", docs, labels=_labels(spark, [(i, 1, 1) for i in range(9)]))).collect()
    assert all(r["score"] == 1 for r in ones)


def test_maximal_segments_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        x = [r.choice([-3, -2, -1, 1, 2, 3]) for _ in range(r.randrange(1, 14))]

        def split(lo, hi):
            best = max(((sum(x[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            a = -best[2]
            b = a - best[1]
            return [*split(lo, a), (a, b, best[0]), *split(b, hi)]

        assert toxicity.segments([(i, i + 1, v) for i, v in enumerate(x)]) == split(0, len(x))


def test_toxicity_ignores_other_labels(spark, tmp_path):
    docs = [(i, f"good day {R.words(i, 40)}" + (" vile slur here" if i % 4 == 0 else "")) for i in range(80)]
    docs.append((100, "a plain text " * 30_000 + "vile slur here"))  # very long
    marks = [(i, 1, int(i % 4 == 0)) for i in range(80)]
    odd = [(i, 1, x) for i, x in ((1, 2), (2, -1), (3, None), (None, 1))]
    got = []
    for k, rows in enumerate((marks, marks + odd)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got.append(sorted(map(tuple, toxicity.op7_toxicity(spark, R.table(spark, tmp_path / str(k), docs, labels=labels)).collect())))
    assert got[0] == got[1] and len(got[0]) == 81
