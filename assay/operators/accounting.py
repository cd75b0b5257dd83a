"""Movement between stages, tokens, time and cost, and what is still to run.

attempts: run_id, stage, attempt, failed, error, usage columns, started_at, finished_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CLOCK, rate, rate_limit_match, reset_hint, stall_wait, survived
from .scoring import count_if


def label_movement(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """M1: findings with a label at stages 2 and 3 and how many changed it, per arm; and runs with a
    change."""
    f = findings.where("b_disp is not null and c_disp is not null").join(runs.select("run_id", "arm"), "run_id").withColumn("moved", F.col("b_disp") != F.col("c_disp"))
    per_run = f.groupBy("arm", "run_id").agg(F.count("*").alias("n"), count_if(F.col("moved")).alias("m"))
    return per_run.groupBy("arm").agg(F.sum("n").alias("findings"), F.sum("m").alias("findings_moved"), F.count("*").alias("runs"), count_if(F.col("m") > 0).alias("runs_moved"))


def a_to_c(findings: DataFrame, runs: DataFrame, new_findings: DataFrame | None = None) -> DataFrame:
    """M2: stage-1 findings taken as asserted: moved where stage 3 did not confirm, by how; and what stage 3 found
    itself (new_findings: run_id), which no assertion stands behind."""
    f = findings.where("c_disp is not null").join(runs.select("run_id", "arm"), "run_id")
    c = F.col("c_disp")
    out = f.groupBy("arm").agg(F.count("*").alias("findings"), count_if(c != "CONFIRMED").alias("moved"), count_if(c == "REJECTED").alias("rejected"), count_if(c == "NARROWED").alias("narrowed"), count_if(c == "INCONCLUSIVE").alias("inconclusive"))
    out = out.withColumn("share", rate(F.col("moved"), F.col("findings")))
    if new_findings is not None:
        new = new_findings.join(runs.select("run_id", "arm"), "run_id").groupBy("arm").agg(F.count("*").alias("new"))
        out = out.join(new, "arm", "full_outer").withColumn("new", F.coalesce("new", F.lit(0)))
    return out


def threshold_sweep(findings: DataFrame, runs: DataFrame, thresholds: list[float]) -> DataFrame:
    """M3: stage 1's label is CONFIRMED from a confidence on, else INCONCLUSIVE; moved where stage 3
    says otherwise, for every threshold."""
    f = findings.where("c_disp is not null").join(runs.select("run_id", "arm"), "run_id")
    f = f.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    a = F.when(F.col("confidence") >= F.col("threshold"), "CONFIRMED").otherwise("INCONCLUSIVE")
    return f.groupBy("arm", "threshold").agg(F.count("*").alias("findings"), count_if(a != F.col("c_disp")).alias("moved"))


QUARTILES = {"least": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "most": 1.0}


def confidence_quantiles(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """M4: minimum, quartiles and maximum of the confidence per arm, exact, with linear interpolation. Distinct
    values are counted before anything is ordered, and quantiles are read off the cumulative counts."""
    counts = findings.join(runs.select("run_id", "arm"), "run_id").where("confidence is not null").groupBy("arm", F.col("confidence").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("arm")
    upto = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.select("arm", "v", (upto - F.col("n")).alias("first"), upto.alias("end"), F.sum("n").over(w).alias("all"))
    out = []
    for name, q in QUARTILES.items():
        at = (F.col("all") - 1) * q
        here = lambda i: F.max(F.when((F.col("first") <= i) & (i < F.col("end")), F.col("v")))  # noqa: E731, B023
        out.append(F.struct(here(F.floor(at)).alias("low"), here(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("part")).alias(name))
    got = rows.groupBy("arm").agg(*out)
    return got.select("arm", *[(F.col(f"{n}.low") + (F.col(f"{n}.high") - F.col(f"{n}.low")) * F.col(f"{n}.part")).alias(n) for n in QUARTILES])


def stage_usage(attempts: DataFrame) -> DataFrame:
    """M5: tokens, tool calls and cost of a stage over all its attempts, wall time where both stamps are
    there and in order, and the usage of the last attempt that succeeded (else the last)."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    wall = seconds("finished_at") - seconds("started_at")
    final = F.max_by(F.struct("attempt", "tokens", "cost_usd"), F.struct(~F.col("failed"), F.col("attempt")))
    out = attempts.groupBy("run_id", "stage").agg(F.count("*").alias("attempts"), F.sum("tokens").alias("tokens"), F.sum("tool_calls").alias("tool_calls"), F.sum("cost_usd").alias("cost_usd"), F.sum(F.when(wall > 0, wall)).alias("wall_s"), final.alias("final"))
    return out.select("run_id", "stage", "attempts", "tokens", "tool_calls", "cost_usd", "wall_s", F.col("final.attempt").alias("final_attempt"), F.col("final.tokens").alias("final_tokens"), F.col("final.cost_usd").alias("final_cost_usd"))


def run_cost(usage: DataFrame, runs: DataFrame) -> DataFrame:
    """M6: cost per arm over its runs: total, mean, largest."""
    per = usage.groupBy("run_id").agg(F.sum("cost_usd").alias("cost_usd")).join(runs.select("run_id", "arm"), "run_id")
    return per.groupBy("arm").agg(F.count("*").alias("runs"), F.sum("cost_usd").alias("total"), F.avg("cost_usd").alias("mean"), F.max("cost_usd").alias("most"))


def cost_by_stage(usage: DataFrame) -> DataFrame:
    """M7: cost and its share of all, attempts and wall time, by stage."""
    total = usage.agg(F.sum("cost_usd")).scalar()
    out = usage.groupBy("stage").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("attempts").alias("attempts"), F.sum("wall_s").alias("wall_s"))
    return out.withColumn("share", F.col("cost_usd") / total)


def cohort_table(scores: DataFrame, usage: DataFrame, runs: DataFrame) -> DataFrame:
    """M8: a row a run: cost, wall time (null where no stage has both stamps), findings and dispositions."""
    per = usage.groupBy("run_id").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("wall_s").alias("wall_s"))
    return runs.select("run_id", "case_id", "arm").join(scores, "run_id", "left").join(per, "run_id", "left")


def incremental_cost(usage: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """M9: what each stage cost an arm and the findings whose status it decided: stage 3 those that it judged,
    stage 2 those that only it did, stage 1 the others; the cost of each such finding, null for none."""
    arm = runs.select("run_id", "arm")
    cost = usage.join(arm, "run_id").groupBy("arm", "stage").agg(F.sum("cost_usd").alias("cost_usd"))
    by = F.when(F.coalesce("c_disp", F.lit("")) != "", 3).when(F.coalesce("b_disp", F.lit("")) != "", 2).otherwise(1)
    paid = usage.select("run_id").distinct()
    n = findings.join(paid, "run_id", "left_semi").join(arm, "run_id").groupBy("arm", by.cast("bigint").alias("stage")).agg(F.count("*").alias("decided"))
    out = cost.join(n, ["arm", "stage"], "left").withColumn("decided", F.coalesce("decided", F.lit(0)))
    return out.withColumn("per_decided", rate(F.col("cost_usd"), F.col("decided")))


def cost_per_outcome(usage: DataFrame, findings: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """M9: an arm's cost per surviving finding and per finding suppressed on clean cases; null where
    there is none."""
    cost = usage.groupBy("run_id").agg(F.sum("cost_usd").alias("cost_usd"))
    s = survived(F.col("c_disp"))
    per = findings.groupBy("run_id").agg(count_if(s).alias("survived"), count_if(~s).alias("suppressed"))
    rows = runs.select("run_id", "case_id", "arm").join(labels.select("case_id", (F.col("label") == "negative").alias("clean")), "case_id").join(cost, "run_id").join(per, "run_id", "left")
    out = rows.groupBy("arm").agg(F.sum("cost_usd").alias("cost_usd"), F.coalesce(F.sum("survived"), F.lit(0)).alias("survived"), F.coalesce(F.sum(F.when(F.col("clean"), F.col("suppressed"))), F.lit(0)).alias("suppressed_clean"))
    return out.withColumns({"per_survivor": rate(F.col("cost_usd"), F.col("survived")), "per_suppressed_clean": rate(F.col("cost_usd"), F.col("suppressed_clean"))})


def work_queue(cases: DataFrame, arms: list[str] | dict[str, tuple[str, str | None]], all_runs: DataFrame, refused: DataFrame) -> DataFrame:
    """Every case and arm as done (a completed run is sealed), refused (with the reason) or to do. arms:
    names, or each arm's protocol version and hash: then a sealed run counts for the arms whose version it
    was made under and whose hash, where one is asked for, it has. refused: case_id, reason."""
    sealed = all_runs.where("status = 'completed'")
    every = cases.select("case_id").withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    if isinstance(arms, dict):
        meets = {a: (F.col("protocol_version") == v) & (F.col("protocol_hash").eqNullSafe(F.lit(h)) if h else F.lit(True)) for a, (v, h) in arms.items()}
        done = sealed.select("case_id", F.explode(F.array(*[F.when(c, a) for a, c in meets.items()])).alias("arm")).where("arm is not null")
    else:
        done = sealed.select("case_id", "arm")
    out = every.join(done.distinct().withColumn("done", F.lit(True)), ["case_id", "arm"], "left").join(refused, "case_id", "left")
    state = F.when(F.col("done"), "done").when(F.col("reason").isNotNull(), "refused").otherwise("to do")
    return out.select("case_id", "arm", state.alias("state"), F.when(state == "refused", F.col("reason")).alias("reason"))


STATES = {"done": "done", "refused": "refused", "stalled": "stalled", "failed": "failed", "to do": "to_do"}


def batch_summary(queue: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Cases by state per arm, and the cost so far. tried: (case_id, arm, outcome, cost_usd) of the last
    attempt at a case, by attempt_waits(): a case still to do whose last attempt stalled or failed is that."""
    rows = queue.withColumns({"outcome": F.lit(None).cast("string"), "cost_usd": F.lit(0.0)}) if tried is None else queue.join(tried, ["case_id", "arm"], "left")
    state = F.when((F.col("state") == "to do") & F.col("outcome").isin("stalled", "failed"), F.col("outcome")).otherwise(F.col("state"))
    counts = [count_if(state == s).alias(n) for s, n in STATES.items()]
    return rows.groupBy("arm").agg(*counts, F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts as succeeded, stalled (the error reads as a rate limit) or failed."""
    return attempts.withColumn("outcome", F.when(F.coalesce("error", F.lit("")) == "", "succeeded").when(rate_limit_match(F.col("error")).isNotNull(), "stalled").otherwise("failed"))


#: Seconds waited after a stall whose message names no time.
FALLBACK_S = 300


def attempt_waits(attempts: DataFrame, runs: DataFrame, fallback_s: int = FALLBACK_S) -> DataFrame:
    """By case and arm: attempts by outcome, the share that stalled, seconds waited after stalls (from
    the end of one to the start of the next attempt at the stage, never below 0) and seconds the messages ask
    for, the outcome of the last attempt of the last stage, cost. attempts: run_id, stage, attempt, error,
    started_at, finished_at, cost_usd; runs: run_id, case_id, arm."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    w = Window.partitionBy("run_id", "stage").orderBy("attempt")
    rows = attempt_outcomes(attempts).withColumns({"after": F.lag("outcome").over(w), "ended": F.lag("finished_at").over(w)})
    waited = F.when(F.col("after") == "stalled", F.greatest(F.lit(0.0), seconds(F.col("started_at")) - seconds(F.col("ended"))))
    clock = F.col("error").rlike(CLOCK)
    asked = F.when(clock, stall_wait(F.col("error"), F.col("finished_at"), F.lit(fallback_s))).otherwise(F.coalesce(reset_hint(F.col("error")), F.lit(fallback_s)))
    stalled = F.col("outcome") == "stalled"
    out = rows.withColumns({"waited": waited, "asked": F.when(stalled, asked)}).join(runs.select("run_id", "case_id", "arm"), "run_id").groupBy("case_id", "arm").agg(
        F.count("*").alias("attempts"), *[count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "stalled", "failed")],
        F.coalesce(F.sum("waited"), F.lit(0.0)).alias("waited_s"), F.coalesce(F.sum("asked").cast("double"), F.lit(0.0)).alias("asked_s"),
        F.max_by("outcome", F.struct("stage", "attempt")).alias("outcome"), F.sum("cost_usd").alias("cost_usd"),
    )
    return out.withColumn("stall_share", rate(F.col("stalled"), F.col("attempts")))


def provenance_drift(fingerprints: DataFrame) -> DataFrame:
    """Distinct values of each fingerprint per arm with the runs that have them; more than one is
    mixed. fingerprints: run_id, arm, name, value."""
    per = fingerprints.groupBy("arm", "name", "value").agg(F.count_distinct("run_id").alias("runs"))
    n = per.groupBy("arm", "name").agg((F.count("*") > 1).alias("mixed"))
    return per.join(n, ["arm", "name"])
