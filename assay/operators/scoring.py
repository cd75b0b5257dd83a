"""Per-run scoring: dispositions, final status, and the RISKY or CLEAN verdict of a run.

findings: run_id, pos (rank, from 0), severity, confidence, file, rec_path or paths (an array), b_disp,
c_disp, and finding_id and mechanism where there are any (an id is else the rank); one row a finding with its
later dispositions, null where a stage gave none (attach_dispositions() makes them from the stages'
own tables). assessments: run_id, pos (stage 2's own rank), finding_id, disposition, mechanism, rec_path or
paths. Ranks travel as `pos`, never as row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_or_above, final_status, severity_weight

DISPOSITIONS = ("CONFIRMED", "NARROWED", "REJECTED", "INCONCLUSIVE")
LEAST_CONFIDENCE = 0.6


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def attach_dispositions(findings: DataFrame, assessments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """findings with b_disp and c_disp; of several rows for one finding the last one counts."""
    last = lambda df, name: df.groupBy("run_id", "finding_id").agg(F.max_by("disposition", "pos").alias(name))
    return findings.join(last(assessments, "b_disp"), ["run_id", "finding_id"], "left").join(last(verdicts, "c_disp"), ["run_id", "finding_id"], "left")


def disposition_scores(findings: DataFrame) -> DataFrame:
    """A run's findings by disposition at stages 2 and 3 (all rows, matched or not)."""
    counts = [count_if(F.col(f"{s}_disp") == d).alias(f"{s}_{d.lower()}") for s in "bc" for d in DISPOSITIONS]
    return findings.groupBy("run_id").agg(F.count("*").alias("findings_discovered"), *counts)


def finding_status(findings: DataFrame, new_findings: DataFrame | None = None) -> DataFrame:
    """Every finding with its final status; stage 3's own findings are `new_unverified`."""
    out = findings.select("run_id", "pos", final_status(F.col("b_disp"), F.col("c_disp")).alias("status"))
    if new_findings is not None:
        out = out.unionByName(new_findings.select("run_id", "pos", F.lit("new_unverified").alias("status")))
    return out


SURVIVING = ("CONFIRMED", "NARROWED")


def _whole(df: DataFrame) -> DataFrame:
    """With finding_id, mechanism and paths, whatever of them a table leaves out."""
    have, none = df.columns, F.expr("CAST(array() AS array<string>)")
    if "paths" not in have:
        df = df.withColumn("paths", F.when(F.col("rec_path").isNotNull(), F.array("rec_path")).otherwise(none))
    out = df.withColumn("paths", F.coalesce("paths", none))
    if "finding_id" not in have:
        out = out.withColumn("finding_id", F.col("pos"))
    return out if "mechanism" in have else out.withColumn("mechanism", F.lit(None).cast("string"))


def assessments_of(findings: DataFrame) -> DataFrame:
    """Stage 2's assessments from findings that carry their disposition, where its own rank, mechanism and
    paths are not known: those of stage 1."""
    f = _whole(findings).where("b_disp is not null")
    return f.select("run_id", "pos", "finding_id", F.col("b_disp").alias("disposition"), "mechanism", "paths")


def case_candidates(runs: DataFrame, findings: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    """The findings a run's verdict is made from: rank, pos (in stage 1), attributes, counts. Arm G takes
    all in their order with stage 1's mechanism and paths, counting from medium severity and 0.6 confidence;
    arm T those that stage 2 confirmed or narrowed, in stage 2's order with its mechanism and paths,
    counting from medium severity. Of findings of one id the last is meant. An assessment without a
    finding is a row with `orphan`, and its run must not be scored."""
    f = _whole(findings)
    b = assessments_of(findings) if assessments is None else _whole(assessments)
    own = ["finding_id", "severity", "confidence", "file"]
    medium = at_or_above(F.col("severity"))
    last = lambda c: F.max_by(c, "pos").alias(c)
    g = f.join(runs.where("arm = 'G'").select("run_id", "case_id", "arm"), "run_id")
    g = g.select("run_id", "case_id", "arm", F.col("pos").alias("rank"), "pos", *own, "mechanism", "paths", F.lit(None).cast("string").alias("disposition"), (medium & (F.col("confidence") >= LEAST_CONFIDENCE)).alias("counts"), F.lit(False).alias("orphan"))
    t = b.where(F.col("disposition").isin(*SURVIVING)).join(runs.where("arm = 'T'").select("run_id", "case_id", "arm"), "run_id")
    t = t.select("run_id", "case_id", "arm", F.col("pos").alias("rank"), "finding_id", "mechanism", "paths", "disposition")
    one = f.groupBy("run_id", "finding_id").agg(F.max("pos").alias("pos"), last("severity"), last("confidence"), last("file"))
    t = t.join(one, ["run_id", "finding_id"], "left").withColumn("orphan", F.col("pos").isNull())
    t = t.withColumn("counts", medium & ~F.col("orphan"))
    return g.unionByName(t.select(*g.columns))


def orphan_assessments(candidates: DataFrame) -> DataFrame:
    """run_id, finding_id of assessments that no finding of the run stands behind."""
    return candidates.where("orphan").select("run_id", "finding_id")


def case_verdict(runs: DataFrame, findings: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    """One row a run: verdict, the primary (first) and deciding finding (the first that counts,
    if another), number of qualifying findings, survivors, recommended paths, risk scores. One grouping of
    candidates and one of all findings by run_id; a run without candidates is CLEAN, one with an
    assessment of no finding is not scored and has no row."""
    c = case_candidates(runs, findings, assessments)
    row = F.struct("rank", "pos", "finding_id", "severity", "confidence", "file", "mechanism", "paths", "disposition")
    primary, counted = F.min_by(row, "rank"), F.min_by(row, F.when(F.col("counts"), F.col("rank")))
    weight = severity_weight(F.col("severity")) * F.col("confidence")
    agg = c.groupBy("run_id").agg(
        primary.alias("primary"),
        F.when(F.max("counts"), counted).alias("first_counted"),
        F.coalesce(F.max("counts"), F.lit(False)).alias("risky"),
        F.max("orphan").alias("orphan"),
        count_if(F.col("counts")).alias("n_qualifying"),
        F.count("*").alias("n_candidates"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("counts"), F.col("paths"))))).alias("counted_paths"),
        F.max(weight).alias("score"),
    )
    every = findings.join(runs.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("discovered"), F.max(weight).alias("score_all"))
    out = runs.select("run_id", "case_id", "arm").join(agg, "run_id", "left").join(every, "run_id", "left").where(~F.coalesce("orphan", F.lit(False)))
    none = F.expr("CAST(array() AS array<string>)")
    deciding = F.col("first_counted.rank") != F.col("primary.rank")
    return out.select(
        "run_id", "case_id", "arm",
        F.when(F.col("risky"), "RISKY").otherwise("CLEAN").alias("verdict"),
        F.col("primary.pos").alias("primary_pos"),
        F.col("primary.file").alias("primary_file"),
        F.col("primary.mechanism").alias("primary_mechanism"),
        F.when(deciding, F.col("first_counted.pos")).alias("deciding_pos"),
        F.coalesce("n_qualifying", F.lit(0)).alias("n_qualifying"),
        F.when(F.col("arm") == "T", F.coalesce("n_candidates", F.lit(0))).alias("survivors"),
        F.coalesce("n_qualifying", F.lit(0)).alias("findings_at_or_above"),
        F.coalesce("discovered", F.lit(0)).alias("findings_discovered"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("counted_paths", none), F.coalesce("primary.paths", none)))).alias("recommended_paths"),
        F.coalesce("score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("score_all", F.lit(0.0)).alias("risk_score_all"),
    )


def verification_units(runs: DataFrame, findings: DataFrame, void_runs: DataFrame | None = None, assessments: DataFrame | None = None) -> DataFrame:
    """One row a qualifying finding of every RISKY run that is scored and not void, with its rank."""
    kept = runs if void_runs is None else runs.join(void_runs.select("run_id"), "run_id", "left_anti")
    c = case_candidates(kept, findings, assessments)
    return c.where("counts").join(orphan_assessments(c).select("run_id"), "run_id", "left_anti")
