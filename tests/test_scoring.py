"""The verdict rules of both arms, and verification, on hand-made runs."""

import pytest

from assay.operators import cohort as H
from assay.operators import scoring as E

FINDINGS = "run_id int, pos int, finding_id string, severity string, confidence double, file string, mechanism string, paths array<string>, b_disp string, c_disp string"
ASSESSED = "run_id int, pos int, finding_id string, disposition string, mechanism string, paths array<string>"


@pytest.fixture()
def frames(spark):
    runs = spark.createDataFrame([(1, 10, "T"), (2, 10, "G"), (3, 11, "T"), (4, 12, "T"), (5, 13, "T")], "run_id int, case_id int, arm string")
    one = [("f1", "low", 0.9, "a.c"), ("f2", "medium", 0.2, "b.c"), ("f3", "high", 0.7, "c.c"), ("f2", "critical", 0.1, "d.c")]
    findings = spark.createDataFrame([(r, k, i, s, c, f, f"A {i}", [f"t/{i}"], None, None) for r in (1, 2, 4, 5) for k, (i, s, c, f) in enumerate(one)], FINDINGS)
    b = [(1, 0, "f1", "NARROWED", "B f1", ["t/z"]), (1, 1, "f3", "REJECTED", "B f3", None), (1, 2, "f2", "CONFIRMED", "B f2", None), (4, 0, "gone", "CONFIRMED", "x", None), (5, 0, "gone", "REJECTED", "x", None)]
    return runs, findings, spark.createDataFrame(b, ASSESSED)


def test_verdicts(frames):
    got = {r["run_id"]: r for r in E.case_verdict(*frames).collect()}
    t, g = got[1], got[2]
    # stage 2 ranks f1 first; the last finding called f2 is meant, and its severity counts
    assert (t["verdict"], t["primary_pos"], t["primary_mechanism"], t["deciding_pos"], t["survivors"], t["findings_at_or_above"], t["recommended_paths"]) == ("RISKY", 0, "B f1", 3, 2, 1, ["t/z"])
    assert t["risk_score"] == pytest.approx(0.225) and t["risk_score_all"] == pytest.approx(0.525)
    assert (g["verdict"], g["primary_pos"], g["primary_mechanism"], g["deciding_pos"], g["survivors"], g["findings_at_or_above"], g["recommended_paths"]) == ("RISKY", 0, "A f1", 2, None, 1, ["t/f1", "t/f3"])
    assert (got[3]["verdict"], got[3]["findings_discovered"], got[3]["risk_score"]) == ("CLEAN", 0, 0.0)
    assert 4 not in got and got[5]["verdict"] == "CLEAN"  # an assessment of no finding is not scored, unless rejected
    assert [tuple(r) for r in E.orphan_assessments(E.case_candidates(*frames)).collect()] == [(4, "gone")]
    assert {(r["run_id"], r["rank"], r["pos"]) for r in E.verification_units(frames[0], frames[1], None, frames[2]).collect()} == {(1, 2, 3), (2, 2, 2)}


def test_without_stage_two_ranks(frames):
    runs, findings, _ = frames
    marked = findings.drop("b_disp").withColumn("b_disp", E.F.when(E.F.col("finding_id") == "f3", "CONFIRMED"))
    got = {r["run_id"]: r for r in E.case_verdict(runs, marked).collect()}
    assert (got[1]["verdict"], got[1]["primary_pos"], got[1]["survivors"]) == ("RISKY", 2, 1)


def test_verification(spark):
    rows = [("T", 1, "confirmed", False, ""), ("T", 2, "CONFIRMED", True, None), ("T", 3, "REJECTED", False, ""), ("T", 4, "REJECTED", False, ""), ("T", 4, "CONFIRMED", False, "died"), ("T", 5, None, None, None)]
    v = spark.createDataFrame(rows, "arm string, case_id int, disposition string, unparseable_first_response boolean, error string")
    risky = spark.createDataFrame([("T", k, True) for k in range(1, 7)], "arm string, case_id int, risky boolean")
    assert {r["case_id"]: r["risky"] for r in H.apply_verification(risky, v).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert [tuple(r) for r in H.verify_pairs(v).collect()] == [("T", 4, 3)]
    assert {(r["disposition"], r["n"]) for r in H.verify_summary(v).collect()} == {("CONFIRMED", 1), ("INCONCLUSIVE", 2), ("REJECTED", 2), ("ERROR", 1)}


def test_hit_rate_reads_verdicts_once(spark):
    """The verdicts of h7_hit_rate are made once; its plan reads no line items any more."""
    from assay.plans import QUERIES

    plan = QUERIES["h7_hit_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_findings_of_scored_runs_are_made_once(spark):
    """The line items are read once, for the findings of runs that may be scored; the verdicts read those."""
    from assay.plans import QUERIES
    from assay.plans.verdicts import scored
    from assay.sources.bindings import bound

    sf = "/root/testdata/sf0.001"
    for name in ("e4_case_verdict", "h12_apply_verification"):
        assert "lineitem" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    t = lambda table, **given: bound(spark, sf, table, **given)
    runs, findings, _ = scored(t)
    every = t("b_findings")
    kept = every.join(t("b_runs").select("run_id"), "run_id", "left_semi")
    assert findings.count() == kept.count() < every.count() / 2
    assert findings.exceptAll(kept.select(findings.columns)).count() == 0


def test_lines_of_other_runs_go_before_the_shuffle(spark, monkeypatch):
    """A filter of the scored runs stands below the window of the findings, whatever else it lets pass; it loses no key."""
    from assay.plans import verdicts
    from assay.sources.bindings import bound
    from assay.sources.shared import may_be_among

    plans, stored = [], verdicts.stored

    def spied(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(verdicts, "stored", spied)
    verdicts.scored(lambda table, **given: bound(spark, "/root/testdata/sf0.001", table, **given))
    assert plans[-1].count("_block") and plans[-1].index("Window") < plans[-1].index("_block")
    keys = spark.range(0, 100_000, 7)
    kept = may_be_among(spark.range(100_000), keys, "id")
    assert keys.join(kept, "id", "left_anti").count() == 0
    assert kept.count() < 1.05 * keys.count()
    assert may_be_among(spark.range(10), spark.range(0), "id").count() == 0
