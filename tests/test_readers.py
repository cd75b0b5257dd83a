"""Readers and writers on small trees of documents."""

import hashlib
import json

import pytest

from assay.sources import readers as R


@pytest.fixture()
def tree(tmp_path):
    run = tmp_path / "runs" / "t-1"
    stage = run / "stages" / "reasoner-1"
    stage.mkdir(parents=True)
    (run / "run.json").write_text(json.dumps({"schema_version": "run-result/v1", "run_id": "t-1", "case_id": "c1", "status": "completed", "created_at": "2026-01-01T00:00:00Z", "stages": [{"stage": "reasoner-1", "attempts": 1, "usage": {"input_tokens": 5, "cost_usd": 0.5}}]}))
    (stage / "review-a.json").write_text(json.dumps({"findings": [{"id": "f1", "severity": "high", "confidence": 0.7}, {"id": "f2", "severity": "low"}]}))
    (stage / "telemetry.json").write_text(json.dumps({"stage": "reasoner-1", "attempts": [{"attempt": 1, "error": "429"}, {"attempt": 2, "error": ""}]}))
    (run / "events.jsonl").write_text('{"type":"start","time":"2026-01-01T00:00:00Z"}\n{"type":"end"}\n')
    return tmp_path


def test_runs_and_stages(spark, tree):
    root = f"{tree}/runs"
    assert R.read_runs(spark, root).first()["stages"][0]["usage"]["cost_usd"] == 0.5
    got = R.read_reviews(spark, root).orderBy("pos").collect()
    assert [(r["run_dir"], r["stage"], r["pos"], r["id"]) for r in got] == [("t-1", "reasoner-1", 0, "f1"), ("t-1", "reasoner-1", 1, "f2")]
    assert R.read_telemetry(spark, root).count() == 2
    assert {(r["run_dir"], r["type"]) for r in R.read_events(spark, root).collect()} == {("t-1", "start"), ("t-1", "end")}


def test_keys(spark, tmp_path):
    good = {"schema_version": R.KEYS_VERSION, "case_id": "c", "fixing_shas": ["a" * 40], "unknown": 1}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(good | {"fixing_shas": ["abc"]}))
    keys = R.read_keys(spark, str(tmp_path))
    want = hashlib.sha256((tmp_path / "bad.json").read_bytes()).hexdigest()
    assert [(r["file_sha256"], r["rule"]) for r in R.keys_violations(keys).collect()] == [(want, "malformed commit")]


def test_labels(spark, tmp_path):
    cases = [{"case_id": "a", "label": "positive", "pair_id": "1", "class": "x"}, {"case_id": "b", "label": "negative", "pair_id": "1"}, {"case_id": "c", "label": "positive", "pair_id": "2"}]
    (tmp_path / "labels.json").write_text(json.dumps({"cohort_manifest_sha256": "x", "cases": cases}))
    (tmp_path / "manifest").write_text("m")
    labels = R.read_labels(spark, f"{tmp_path}/labels.json")
    assert {(r["rule"], r["id"]) for r in R.labels_violations(labels).collect()} == {("positive without class", "c"), ("unbalanced pair", "2")}
    assert R.manifest_violations(spark, labels, f"{tmp_path}/manifest").count() == 1


def test_oracle_signals(spark, tmp_path):
    d = tmp_path / "c9"
    d.mkdir()
    doc = {"schema_version": "v", "retrospective": {"strong_signals": [{"signal_type": "fix", "source_ref": "r", "changed_paths": []}], "medium_signals": [{"signal_type": "m", "function_or_path": "f()", "changed_paths": ["a.c"]}], "weak_signals": [{"signal_type": "w", "file_path": "a.c"}]}}
    (d / "correlated-report.json").write_text(json.dumps(doc))
    got = {(r["case_id"], r["path"], r["tier"]) for r in R.signals_of(R.read_oracle(spark, str(tmp_path))).collect()}
    assert got == {("c9", None, 3), ("c9", "a.c", 2), ("c9", "a.c", 1)}


def test_maps(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"cases": {"a": "clean", "b": "odd"}}))
    (tmp_path / "j.json").write_text(json.dumps({"case_id": "a", "judge_model": "m", "verdicts": {"T": {"arm": "T", "agreement": "NONE"}}}))
    (tmp_path / "p.json").write_text(json.dumps({"case_id": "a", "responses": [{"probe": "p", "answer": "x"}]}))
    (tmp_path / "v.json").write_text(json.dumps({"unit": {"case_id": "a", "arm": "T"}, "disposition": "CONFIRMED"}))
    (tmp_path / "h.json").write_text(json.dumps({"case_id": "a", "risky": None, "reason": "no base"}))
    (tmp_path / "f.json").write_text(json.dumps({"case_id": "a", "paths": ["x", "y"]}))
    assert {(r[1], r[2]) for r in R.read_gate(spark, f"{tmp_path}/g.json").collect()} == {("a", "clean"), ("b", "odd")}
    assert R.read_judge(spark, f"{tmp_path}/j.json").first()["agreement"] == "NONE"
    assert R.read_probes(spark, f"{tmp_path}/p.json").first()["answer"] == "x"
    assert R.read_verify(spark, f"{tmp_path}/v.json").first()["arm"] == "T"
    assert R.read_history(spark, f"{tmp_path}/h.json").first()["reason"] == "no base"
    assert R.read_fixing_paths(spark, f"{tmp_path}/f.json").count() == 2


def test_bundle_and_checksums(spark, tmp_path):
    f = tmp_path / "case7" / "reviewer" / "repository" / "a.c"
    f.parent.mkdir(parents=True)
    f.write_text("int x;\n")
    (tmp_path / "case7" / "control").mkdir()
    (tmp_path / "case7" / "control" / "checksums.sha256").write_text("abc  reviewer/x\n\nonly\n")
    files = R.read_bundle_files(spark, str(tmp_path))
    assert {(r["case_id"], r["path"]) for r in files.collect()} == {("case7", "reviewer/repository/a.c"), ("case7", "control/checksums.sha256")}
    lines = R.read_checksum_manifest(spark, f"{tmp_path}/case7/control/checksums.sha256")
    assert {(r["digest"], r["path"], r["malformed"]) for r in lines.collect()} == {("abc", "reviewer/x", False), ("only", None, True)}
    tree = [r["line"] for r in R.checksum_tree(spark, f"{tmp_path}/case7/reviewer").collect()]
    assert tree == [hashlib.sha256(b"int x;\n").hexdigest() + "  repository/a.c"]


def test_write_partitioned(spark, tmp_path):
    R.write_partitioned(spark.createDataFrame([(1, "T"), (2, "G")], "x int, arm string"), f"{tmp_path}/o", "arm")
    assert spark.read.parquet(f"{tmp_path}/o").where("arm = 'T'").first()["x"] == 1


def test_rules_of_documents(spark, tmp_path):
    for name, body in {"ok": {"run_id": "1", "schema_version": R.RUN_VERSION}, "old": {"run_id": "2", "schema_version": "x"}, "more": {"run_id": "3", "schema_version": R.RUN_VERSION, "b": 1, "a": 2}, "type": {"run_id": "4", "stages": "none"}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "run.json").write_text('{"run_id": "5"')
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "run.json").write_text("\n")
    got = {tuple(r) for r in R.runs_violations(spark, str(tmp_path), version=R.RUN_VERSION).collect()}
    assert got == {("old", "schema version", "x"), ("more", "unknown field", "a,b"), ("type", "malformed", ""), ("cut", "malformed", ""), ("none", "malformed", "")}
    assert [r["run_dir"] for r in R.read_runs(spark, str(tmp_path), version=R.RUN_VERSION, strict=False).collect()] == ["ok"]
    with pytest.raises(Exception, match="malformed"):
        R.read_runs(spark, f"{tmp_path}", "cut/run.json").collect()


def test_trees_and_archives_read_alike(spark, tmp_path):
    rows = [("r 1/x", "a", '{"stage": "a", "attempts": [{"attempt": 1}, {"attempt": 2}]}'), ("r2", "b", '{"attempts": [{"attempt": 7}]}')]
    df = spark.createDataFrame(rows, "run_dir string, stage string, value string")
    R.write_tree(df, f"{tmp_path}/tree", "run_dir", "stage")
    got = {tuple(r)[:4] for r in R.read_telemetry(spark, f"{tmp_path}/tree", "run_dir=*/stage=*/*.txt").collect()}
    assert got == {("r 1/x", "a", 0, 1), ("r 1/x", "a", 1, 2), ("r2", "b", 0, 7)}
    packed = R.write_archive(df.selectExpr("concat_ws('/', 'x', replace(run_dir, '/', '_'), 'stages', stage, 'telemetry.json') file_path", "value").unionByName(spark.createDataFrame([("x/r/run.json", "{")], "file_path string, value string")), f"{tmp_path}/archive")
    assert {tuple(r)[:4] for r in R.read_telemetry(spark, packed).collect()} == {("r 1_x", "a", 0, 1), ("r 1_x", "a", 1, 2), ("r2", "b", 0, 7)}


def test_gate_of_other_records(spark, tmp_path):
    (tmp_path / "records").write_text("a\nb\n")
    digest = hashlib.sha256(b"a\nb\n").hexdigest()
    for name, sha in (("good", digest), ("bad", "0" * 64)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": R.GATE_VERSION, "records_sha256": sha, "cases": {"a": "clean"}}))
    assert R.read_gate(spark, f"{tmp_path}/good.json", f"{tmp_path}/records").count() == 1
    assert [(r["rule"], r["detail"]) for r in R.gate_documents(spark, f"{tmp_path}/*.json", f"{tmp_path}/records").where("rule is not null").collect()] == [("other records", "0" * 64)]
    with pytest.raises(Exception, match="other records"):
        R.read_gate(spark, f"{tmp_path}/bad.json", f"{tmp_path}/records").collect()


def test_archives_of_bundles_and_manifests(spark):
    body = [("x/case7/reviewer/repository/a b.c", "int x;\n"), ("x/case7/control/checksums.sha256", "abc  reviewer/x\n\n"), ("x/case7/control/checksums.sha256", "only\n")]
    archive = spark.createDataFrame(body, "file_path string, value string")
    files = R.read_bundle_files(spark, archive.where("file_path like '%.c'"))
    want = [("case7", "reviewer/repository/a b.c", hashlib.sha256(b"int x;\n").hexdigest())]
    assert [tuple(r) for r in R.bundle_digests(files).collect()] == want
    lines = R.read_checksum_manifest(spark, archive.where("file_path like '%.sha256'"))
    assert {(r["case_id"], r["digest"], r["path"], r["malformed"]) for r in lines.collect()} == {("case7", "abc", "reviewer/x", False), ("case7", "only", None, True)}


def test_archives_of_logs_and_gates(spark):
    log = spark.createDataFrame([("x/r1/events.jsonl", '{"type":"start"}\n'), ("x/r1/events.jsonl", '  \n{"type":"end"}\n[]\n')], "file_path string, value string")
    assert {(r["run_dir"], r["type"]) for r in R.read_events(spark, log, strict=False).collect()} == {("r1", "start"), ("r1", "end")}
    assert [r["rule"] for r in R.event_documents(spark, log).where("rule is not null").collect()] == ["malformed"]
    gate = json.dumps({"schema_version": R.GATE_VERSION, "records_sha256": hashlib.sha256(b"a\nb\n").hexdigest(), "cases": {"a": "clean"}})
    archive = lambda **files: spark.createDataFrame([(f"x/{k}/f", v) for k, v in files.items()], "file_path string, value string")
    assert R.read_gate(spark, archive(good=gate), archive(r="a\nb\n")).count() == 1
    assert [r["rule"] for r in R.gate_documents(spark, archive(good=gate), archive(r="a\nc\n")).collect()] == ["other records"]


def test_source_queries_write_no_file_a_document(spark, tmp_path):
    """Their files grow with the tasks, not with the documents."""
    import os

    from assay.plans import QUERIES
    from assay.sources.shared import shared_dir

    def count():
        return sum(len(files) for _, _, files in os.walk(shared_dir(spark).removeprefix("file:")))

    for name in ("s3_read_telemetry", "s4_events_violations", "s10_gate_violations", "s11_bundle_files", "s12_checksum_manifest", "s14_checksum_lines"):
        before = count()
        QUERIES[name](spark, "/root/testdata/sf0.01").count()
        assert count() - before < 60, name
