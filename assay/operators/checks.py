"""Referential and evidence checks. A check returns the rows that break it; violation frames have
case_id, rule, path, detail where they are about a bundle. fail_if_any() is the one that raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_path, opaque_id

# The order in which a budget's bounds are tried.
BOUNDS = ("input_tokens", "output_tokens", "tool_calls", "cost_usd")


def fail_if_any(violations: DataFrame, what: str) -> None:
    """Raises with up to five of the rows if there are any."""
    if rows := violations.take(5):
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def ancestry_orphans(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """Assessments of a finding that no earlier stage produced."""
    return assessments.join(findings.select("run_id", "finding_id"), ["run_id", "finding_id"], "left_anti")


def ancestry_mechanism(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """R2: the discovery mechanism must be verbatim, CONFIRMED must keep it, NARROWED must change it;
    skipped where the finding states none."""
    f = findings.select("run_id", "finding_id", F.col("mechanism").alias("source")).where("coalesce(source, '') <> ''")
    a = assessments.join(f, ["run_id", "finding_id"])
    same = F.col("mechanism").eqNullSafe(F.col("source"))
    rule = F.when(~F.col("discovery_mechanism").eqNullSafe(F.col("source")), "not verbatim").when((F.col("disposition") == "CONFIRMED") & ~same, "confirmed but changed").when((F.col("disposition") == "NARROWED") & same, "narrowed but unchanged")
    return a.withColumn("rule", rule).where("rule is not null")


def dropped_findings(findings: DataFrame, assessments: DataFrame) -> DataFrame:
    """Findings handed over that no assessment names."""
    return findings.join(assessments.select("run_id", "finding_id"), ["run_id", "finding_id"], "left_anti")


def cited_slices(citations: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, path, first, last, n_lines, quoted: what every distinct range of lines that is cited holds. A
    file is split once, whatever number of citations it has, and only the slices leave it."""
    asked = citations.groupBy("case_id", "path").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))

    def cut_out(lines: Column) -> Column:
        def one(r: Column) -> Column:
            quoted = F.array_join(F.slice(lines, F.greatest(r["first"], F.lit(1)), F.greatest(r["last"] - r["first"] + 1, F.lit(0))), "\n")
            return F.struct(r["first"].alias("first"), r["last"].alias("last"), F.size(lines).alias("n_lines"), quoted.alias("quoted"))

        return F.transform("ranges", one)

    slices = F.get(F.transform(F.array(F.split("text", "\n")), cut_out), F.lit(0))  # bound, so that it is split once
    return files.where("text is not null").join(asked, ["case_id", "path"]).select("case_id", "path", F.inline(slices))


def citation_check(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations that leave the snapshot, name no file of it, point outside its lines, or (a
    warning) quote otherwise, white space around aside. No lines (0, 0, or null) mean the whole file, an end
    of 0 the line of the start; a file without text is absent. citations: case_id, file, start_line, end_line,
    excerpt; files: case_id, path, text."""
    a, z = F.coalesce("start_line", F.lit(0)), F.coalesce(F.nullif("end_line", F.lit(0)), "start_line", F.lit(0))
    c = citations.withColumns({"path": clean_path(F.col("file")), "first": a, "last": z})
    out = c.join(cited_slices(c, files), ["case_id", "path", "first", "last"], "left")
    away = F.startswith("path", F.lit("/")) | F.startswith("path", F.lit(".."))
    whole = (F.col("first") == 0) & (F.col("last") == 0)  # of the file
    outside = ~whole & ((F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("n_lines")))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    differs = ~whole & (F.coalesce("excerpt", F.lit("")) != "") & (bare("quoted") != bare(F.col("excerpt")))
    rule = F.when(away, "escapes").when(F.col("n_lines").isNull(), "absent").when(outside, "lines outside").when(differs, "excerpt differs")
    return out.withColumn("rule", rule).where("rule is not null").drop("first", "last", "n_lines", "quoted")


def usage_vs_budget(stages: DataFrame) -> DataFrame:
    """The first bound that the reported usage is over, and the bounds declared but reported as 0
    (unchecked). stages: run_id, stage, <bound>, max_<bound>."""
    over = F.coalesce(*[F.when((F.col(f"max_{b}") > 0) & (F.col(b) > F.col(f"max_{b}")), F.lit(b)) for b in BOUNDS])
    blind = F.filter(F.array(*[F.when((F.col(f"max_{b}") > 0) & (F.col(b) == 0), F.lit(b)) for b in BOUNDS]), lambda x: x.isNotNull())
    return stages.select("run_id", "stage", over.alias("violated"), F.array_join(blind, ",").alias("unchecked"))


def duplicate_runs(runs: DataFrame, void_runs: DataFrame) -> DataFrame:
    """Arm and case with more than one completed run that is not void."""
    kept = runs.where("status = 'completed'").join(void_runs.select("run_id"), "run_id", "left_anti")
    return kept.groupBy("arm", "case_id").agg(F.count("*").alias("n_runs")).where("n_runs > 1")


def cohort_fail_closed(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs of an unlabelled case and labels without any run (a void run is one)."""
    a = runs.select("case_id").distinct().join(labels.select("case_id"), "case_id", "left_anti").withColumn("rule", F.lit("run without label"))
    b = labels.select("case_id").join(runs.select("case_id"), "case_id", "left_anti").withColumn("rule", F.lit("label without run"))
    return a.unionByName(b)


def judge_consistency(judged: DataFrame, verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Judged pairs by another judge (judge_model, in_family, where they are given) than the first case's,
    or that have no verdict, name another finding than the primary, are not RISKY or not positive; the first
    rule that holds. judged: case_id, arm, pos; verdicts: case_id, arm, verdict, primary_pos."""
    out = judged.join(verdicts.select("case_id", "arm", "verdict", "primary_pos"), ["case_id", "arm"], "left").join(labels.select("case_id", "label"), "case_id", "left")
    rule = F.when(F.col("verdict").isNull(), "no verdict").when(~F.col("pos").eqNullSafe(F.col("primary_pos")), "not the primary").when(F.col("verdict") != "RISKY", "not risky").when(F.coalesce("label", F.lit("")) != "positive", "not positive")
    if "judge_model" in judged.columns:
        judge = F.struct("judge_model", "in_family")
        first = judged.agg(F.min_by(judge, F.struct("case_id", "arm"))).scalar()
        rule = F.coalesce(F.when(~judge.eqNullSafe(first), "judges disagree"), rule)
    return out.withColumn("rule", rule).where("rule is not null").select("case_id", "arm", "pos", "rule")


def opaque_check(pool: DataFrame) -> DataFrame:
    """Opaque ids that are not their hash or contain the arm or run id, whatever the case."""
    want = opaque_id(F.col("case_id"), F.col("arm"), F.concat_ws(":", "run_id", "pos"))
    tells = lambda c: F.contains(F.lower("opaque_id"), F.lower(F.col(c).cast("string"))) & (F.col(c).cast("string") != "")
    return pool.where((F.col("opaque_id") != want) | tells("arm") | tells("run_id"))


def subset_pairs(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """The units of the chosen arms and cases."""
    return units.join(pairs.select("arm", "case_id"), ["arm", "case_id"], "left_semi")


def pairs_without_unit(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chosen pairs that have no unit."""
    return pairs.join(units.select("arm", "case_id"), ["arm", "case_id"], "left_anti")
