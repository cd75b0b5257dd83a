"""Cohort scoring: verdicts of arms against the labels of cases.

labels: case_id, pair_id, label, class and covariates; verdicts: arm, case_id, risky. A rate that
cannot be computed is null. Counts come from one grouping over (arm, dimension, bucket); tests get
a row a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_path, rate, strata
from ..functions.stats import fisher_p, paired_p
from .scoring import count_if

SMALL_COHORT = 20
SLACK = 1e-9


def void_filter(verdicts: DataFrame, void_runs: DataFrame, void_cases: DataFrame) -> DataFrame:
    """H1: without the runs a scan voided (one arm's run each) and the cases a probe voided (in all
    arms)."""
    return verdicts.join(void_runs.select("run_id"), "run_id", "left_anti").join(void_cases.select("case_id"), "case_id", "left_anti")


def _counts() -> list[Column]:
    p, r = F.col("label") == "positive", F.col("risky")
    return [count_if(p & r).alias("tp"), count_if(~p & r).alias("fp"), count_if(p & ~r).alias("fn"), count_if(~p & ~r).alias("tn")]


def confusion(labels: DataFrame, verdicts: DataFrame, *by: str) -> DataFrame:
    """H2: TP, FP, FN, TN per arm over the cases the arm scored."""
    return labels.join(verdicts, "case_id").groupBy("arm", *by).agg(F.count("*").alias("n_cases"), *_counts())


def precision_recall(counts: DataFrame) -> DataFrame:
    """H3: rates of confusion rows, null with the reason where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn),
        "precision_absent": F.when(tp + fp == 0, "no case called risky"), "recall_absent": F.when(tp + fn == 0, "no positive case scored"),
    })


def _for_arms(df: DataFrame, arms: list[str]) -> DataFrame:
    return df.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def absent_cases(labels: DataFrame, verdicts: DataFrame, arms: list[str], history: DataFrame | None = None) -> DataFrame:
    """H4: labelled cases without a verdict in an arm; with `history`, its reason for arm H."""
    out = _for_arms(labels.select("case_id"), arms).join(verdicts.select("arm", "case_id"), ["arm", "case_id"], "left_anti")
    if history is not None:
        reason = history.select("case_id", F.lit("H").alias("arm"), F.coalesce("reason", F.lit("not recorded")).alias("reason"))
        out = out.join(reason, ["arm", "case_id"], "left")
    return out


def history_verdicts(history: DataFrame) -> DataFrame:
    """The history baseline as arm H; a case with null `risky` is absent, not clean."""
    return history.where("risky is not null").select(F.lit("H").alias("arm"), "case_id", "risky")


def recall_by_class(labels: DataFrame, verdicts: DataFrame, arms: list[str]) -> DataFrame:
    """H5: recall per class of the positives, for every class and arm; null where none was scored."""
    pos = labels.where("label = 'positive'")
    every = _for_arms(pos.select("class").distinct(), arms)
    got = pos.join(verdicts, "case_id").groupBy("arm", "class").agg(F.count("*").alias("n"), count_if(F.col("risky")).alias("hit"))
    out = every.join(got, ["arm", "class"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hit": F.coalesce("hit", F.lit(0))})
    return out.withColumn("recall", rate(F.col("hit"), F.col("n")))


def is_fallback() -> Column:
    """Whether a pair was matched by its subsystem alone; where no flag says so, what it was matched on does (in
    any case of letters); null where neither is recorded."""
    alone = (F.size("match_key_used") == 1) & (F.lower(F.get("match_key_used", F.lit(0))) == "subsystem")
    return F.coalesce("fallback_pair", F.when(F.size("match_key_used") > 0, alone))


def with_strata(labels: DataFrame) -> DataFrame:
    """labels with a row for each of the five covariates they record (dim, bucket)."""
    f = F.when(is_fallback(), "fallback").when(~is_fallback(), "fully matched")
    c = F.when(F.col("fix_before_cutoff"), "before cutoff").when(~F.col("fix_before_cutoff"), "after cutoff")
    return labels.withColumn("s", F.explode(strata(subsystem=F.col("subsystem"), admission_description=F.col("admission.description"), source=F.coalesce(F.nullif("source", F.lit("")), "source_window"), fallback_pair=f, fix_before_cutoff=c))).select("*", "s.dim", "s.bucket").drop("s")


def stratified(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """H6: counts and rates per arm, dimension and bucket, in one grouping."""
    return precision_recall(confusion(with_strata(labels), verdicts, "dim", "bucket"))


def hit_rate(labels: DataFrame, verdicts: DataFrame, recommended: DataFrame, fixing_paths: DataFrame) -> DataFrame:
    """H7: among risky true positives with fixing paths, the share whose recommended path is a fixing
    path or a directory above one; those without fixing paths are counted apart. A fixing path is
    exploded into itself and its ancestors, so the prefix test is an equality join."""
    tp = labels.where("label = 'positive'").select("case_id").join(verdicts.where("risky").select("arm", "case_id"), "case_id")
    parts = F.split(clean_path(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = fixing_paths.select("case_id", F.explode(up).alias("at")).distinct()
    rec = recommended.select("arm", "case_id", clean_path(F.col("rec_path")).alias("at")).distinct()
    hit = rec.join(above, ["case_id", "at"]).select("arm", "case_id").distinct().withColumn("hit", F.lit(True))
    has = fixing_paths.select("case_id").distinct().withColumn("has", F.lit(True))
    rows = tp.join(has, "case_id", "left").join(hit, ["arm", "case_id"], "left")
    out = rows.groupBy("arm").agg(count_if(F.coalesce("has", F.lit(False))).alias("with_paths"), count_if(F.col("has").isNull()).alias("without_paths"), count_if(F.coalesce("has", F.lit(False)) & F.coalesce("hit", F.lit(False))).alias("hits"))
    return out.withColumn("hit_rate", rate(F.col("hits"), F.col("with_paths")))


def vs_chance(counts: DataFrame) -> DataFrame:
    """H8: two-sided Fisher p of [[TP FP][FN TN]]."""
    return counts.withColumn("p", fisher_p("tp", "fp", "fn", "tn"))


def paired_counts(labels: DataFrame, verdicts: DataFrame, treatment: str, baseline: str) -> DataFrame:
    """One row: the cases both arms scored, by label and by who called them risky."""
    t = verdicts.where(F.col("arm") == treatment).select("case_id", F.col("risky").alias("t"))
    b = verdicts.where(F.col("arm") == baseline).select("case_id", F.col("risky").alias("b"))
    p, rt, rb = F.col("label") == "positive", F.col("t"), F.col("b")
    sums = {"common": F.lit(True), "positives": p, "b_pos": p & rt & rb, "b_neg": ~p & rt & rb, "t_pos": p & rt & ~rb, "t_neg": ~p & rt & ~rb, "u_pos": p & ~rt & rb, "u_neg": ~p & ~rt & rb}
    out = labels.join(t, "case_id").join(b, "case_id").agg(*[count_if(c).alias(n) for n, c in sums.items()])
    return out.withColumn("comparison", F.lit(f"{treatment}-{baseline}"))


def pairwise_delta(counts: DataFrame, threshold: float = 15.0) -> DataFrame:
    """H9: treatment minus baseline, null where undefined, and whether it meets `threshold` points."""
    c = F.col
    tp_t, tp_b = c("b_pos") + c("t_pos"), c("b_pos") + c("u_pos")
    all_t, all_b = tp_t + c("b_neg") + c("t_neg"), tp_b + c("b_neg") + c("u_neg")
    out = counts.withColumns({
        "discordant": c("t_pos") + c("t_neg") + c("u_pos") + c("u_neg"),
        "delta_precision": rate(tp_t, all_t) - rate(tp_b, all_b),
        "delta_recall": rate(tp_t, c("positives")) - rate(tp_b, c("positives")),
    })
    return out.withColumns({f"meets_{m}": c(f"delta_{m}") * 100 >= threshold - SLACK for m in ("precision", "recall")})


def paired_test(counts: DataFrame) -> DataFrame:
    """Exact one- and two-sided p of the paired differences."""
    names = ("positives", "b_pos", "b_neg", "t_pos", "t_neg", "u_pos", "u_neg")
    return counts.withColumn("p", paired_p(*names)).select("comparison", "common", *names, "p.*")


def comparisons(labels: DataFrame, verdicts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Paired counts of every comparison, over all cases and without fallback pairs."""
    out = None
    for subset, some in (("all", labels), ("without fallback", labels.where(~F.coalesce(is_fallback(), F.lit(False))))):
        for t, b in pairs:
            row = paired_counts(some, verdicts, t, b).withColumn("subset", F.lit(subset))
            out = row if out is None else out.unionByName(row)
    return out


def _unparseable(verified: DataFrame) -> Column:
    return F.coalesce("unparseable_first_response", F.lit(False)) if "unparseable_first_response" in verified.columns else F.lit(False)


def verified_pairs(verified: DataFrame) -> DataFrame:
    """arm, case_id, confirmed, covered: a pair is covered if none of its verifications failed, and confirmed
    if one that could be read says so, in capitals or not."""
    failed = F.coalesce("error", F.lit("")) != ""
    says = ~failed & ~_unparseable(verified) & (F.upper(F.coalesce("disposition", F.lit(""))) == "CONFIRMED")
    return verified.groupBy("arm", "case_id").agg(F.max(says).alias("confirmed"), (~F.max(failed)).alias("covered"))


def apply_verification(verdicts: DataFrame, verified: DataFrame) -> DataFrame:
    """RISKY is withdrawn where a pair was verified without an error and nothing was confirmed.
    verified: arm, case_id, disposition, error and, where there is one, unparseable_first_response."""
    out = verdicts.join(verified_pairs(verified), ["arm", "case_id"], "left")
    confirmed, covered = F.coalesce("confirmed", F.lit(False)), F.coalesce("covered", F.lit(False))
    return out.withColumn("risky", F.col("risky") & ~(covered & ~confirmed)).withColumn("arm", F.concat("arm", F.lit("'"))).select("arm", "case_id", "risky")


def verify_summary(verified: DataFrame) -> DataFrame:
    """Verifications by disposition, in capitals (ERROR where one failed; INCONCLUSIVE where there is none or
    the first response could not be read)."""
    d = F.when(F.coalesce("error", F.lit("")) != "", "ERROR").when(_unparseable(verified), "INCONCLUSIVE").otherwise(F.upper(F.coalesce("disposition", F.lit("INCONCLUSIVE"))))
    return verified.groupBy("arm", d.alias("disposition")).agg(F.count("*").alias("n"))


def verify_pairs(verified: DataFrame) -> DataFrame:
    """Pairs covered and pairs withdrawn (covered, nothing confirmed) per arm."""
    return verified_pairs(verified).groupBy("arm").agg(count_if(F.col("covered")).alias("covered"), count_if(F.col("covered") & ~F.col("confirmed")).alias("withdrawn"))


def cohort_header(labels: DataFrame, void_cases: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: size, positives, negatives, underpowered, probe-voided, unresolved, provisional."""
    flag = lambda df, name: df.select("case_id").distinct().withColumn(name, F.lit(True))
    rows = labels.join(flag(void_cases, "void"), "case_id", "left").join(flag(unresolved, "open"), "case_id", "left")
    kept = F.col("void").isNull()
    out = rows.agg(
        count_if(kept).alias("cohort"),
        count_if(kept & (F.col("label") == "positive")).alias("positives"),
        count_if(kept & (F.col("label") == "negative")).alias("negatives"),
        count_if(~kept).alias("probe_voided"),
        count_if(F.col("open").isNotNull()).alias("unresolved"),
    )
    return out.withColumns({"underpowered": F.col("positives") <= SMALL_COHORT, "provisional": F.col("unresolved") > 0})


def criteria_table(observed: DataFrame) -> DataFrame:
    """Criterion, observed value, threshold -> meets, does not, or cannot be evaluated."""
    v, t = F.col("observed"), F.col("threshold")
    return observed.withColumn("outcome", F.when(v.isNull(), "cannot be evaluated").when(v >= t - SLACK, "meets").otherwise("does not"))


def stratum_counts(labels: DataFrame) -> DataFrame:
    """Recorded cases per bucket, and for how many of all cases the dimension is recorded."""
    rows = with_strata(labels)
    per = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    recorded = rows.groupBy("dim").agg(F.count("*").alias("recorded"))
    return per.join(recorded, "dim").withColumn("n_cases", labels.agg(F.count("*")).scalar())
