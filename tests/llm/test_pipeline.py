import corpus_pipeline
from . import rows as R


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "secret_scans", "packing"]
    docs = [(i, f"good day {R.words(i, 60)}" + (" vile slur here" if i % 5 == 0 else "")) for i in range(100)]
    docs += [(200, docs[1][1]), (201, docs[1][1] + " more"), (300, None), (301, ""), (None, "lost words"), (302, R.words(77, 20) + " token = 0123456789abcdef0123456789abcdef")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    d = R.table(spark, tmp_path, docs, labels=labels)
    df, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, df, d).write.parquet(path)
        df2 = spark.read.parquet(path)
        assert df2.columns == df.columns
        df, kept[name] = df2, {r["doc_id"]: r["text"] for r in df2.collect()}
    clean = {i for i, _ in docs if i is None or i >= 100 or i % 5}
    assert set(kept["toxicity"]) == clean
    assert set(kept["line_dedup"]) == clean
    assert 200 in kept["line_dedup"] and kept["line_dedup"][200] == ""  # its only line stands in 1
    assert {300, 301, None, 302} <= set(kept["ngram_jaccard"])
    assert kept["secret_scans"][302].endswith("[secret]")
    packed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept["secret_scans"])


def test_empty(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, R.table(spark, tmp_path, [], labels=labels)).count() == 0


def test_line_stage_makes_no_row_of_every_near_pair(spark, monkeypatch):
    """400 lines behind one front of words: the pairs that the stage's joins bring lines to grow with the lines, not with their square."""
    from assay.llm import line_dedup

    front = R.words(5, 14)
    docs = R.frame(spark, [(k, f"{front} {R.words(1000 + k, 9)}") for k in range(400)] + [(400, f"{front} {R.words(1007, 9)} x")])
    rows, plain = [], line_dedup.verified

    def verified(pairs, texts):
        rows.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(line_dedup, "verified", verified)
    monkeypatch.setattr(line_dedup, "WHOLE", 3)
    kept = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert [r["doc_id"] for r in kept if not r["text"]] == [400]
    assert 0 < sum(rows) <= 20 * 400
