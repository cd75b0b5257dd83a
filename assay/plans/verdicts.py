"""Queries of run scoring, cohort scoring, accounting and the referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting as A
from ..operators import checks as R
from ..operators import cohort as H
from ..operators import scoring as E
from ..sources import readers as IO
from ..sources.shared import cut, may_be_among, stored
from .common import query

#: Candidates by rank; runs with an assessment of no finding are not scored.
CAND = """allcand AS (SELECT f.run_id, f.pos AS rank, f.pos, severity, confidence, file, CAST(NULL AS VARCHAR) AS mechanism, rec_path, r.case_id, r.arm, severity <> 'low' AND confidence >= 0.6 AS counts, FALSE AS orphan FROM b_findings f JOIN b_runs r ON f.run_id = r.run_id WHERE arm = 'G'
  UNION ALL SELECT a.run_id, a.pos, f.pos, severity, confidence, file, a.mechanism, a.rec_path, r.case_id, r.arm, f.pos IS NOT NULL AND severity <> 'low', f.pos IS NULL FROM b_assessments a JOIN b_runs r ON a.run_id = r.run_id LEFT JOIN b_findings f ON f.run_id = a.run_id AND f.pos = a.finding_id WHERE arm = 'T' AND disposition IN ('CONFIRMED', 'NARROWED')),
  cand AS (SELECT * FROM allcand WHERE run_id NOT IN (SELECT run_id FROM allcand WHERE orphan)), scored AS (SELECT * FROM b_runs WHERE run_id NOT IN (SELECT run_id FROM allcand WHERE orphan))"""
WEIGHT = "CASE severity WHEN 'low' THEN 0.25e0 WHEN 'medium' THEN 0.5e0 WHEN 'high' THEN 0.75e0 ELSE 1e0 END * confidence"
VERDICT = f"{CAND}, agg AS (SELECT run_id, bool_or(counts) AS risky, min(rank) AS primary_rank, min(rank) FILTER (counts) AS counted_rank, min_by(pos, rank) AS primary_pos, min_by(pos, rank) FILTER (counts) AS counted_pos, count(*) FILTER (counts) AS n_qualifying, count(*) AS n_candidates, max({WEIGHT}) AS score, min_by(file, rank) AS primary_file, arg_min_null(mechanism, rank) AS primary_mechanism FROM cand GROUP BY run_id), v AS (SELECT r.run_id, r.case_id, r.arm, coalesce(risky, FALSE) AS risky, primary_rank, counted_rank, primary_pos, counted_pos, n_qualifying, n_candidates, score, primary_file, primary_mechanism FROM scored r LEFT JOIN agg ON r.run_id = agg.run_id)"


def _f(t) -> DataFrame:
    return t("b_findings").drop("partkey", "suppkey")


def _labels(t) -> DataFrame:
    """The labels with the admission as they are read."""
    return t("b_labels").withColumn("admission", F.struct(F.col("admission_description").alias("description")))


def scored(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs that may be scored, their findings and their assessments: written once, as several steps read them, and
    a cohort scores one run of a case and an arm, so most findings are of none of these."""
    runs = stored(t("b_runs"))
    # most lines are of no such run: they go before the window of b_findings, and all but a few before they are shuffled
    keys = runs.select(F.col("run_id").alias("l_orderkey"))
    lines = may_be_among(t("lineitem"), keys, "l_orderkey").join(keys, "l_orderkey", "left_semi")
    findings = stored(t("b_findings", lineitem=lines).drop("c_disp", "agreement", "fix_id"))
    return runs, findings.drop("partkey", "suppkey"), t("b_assessments", b_findings=findings).join(runs.select("run_id"), "run_id", "left_semi")


def _verdict(t) -> DataFrame:
    return E.case_verdict(*scored(t))


def _risky(t) -> DataFrame:
    return _risky_of(_verdict(t))


def _risky_of(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("run_id", "arm", "case_id", (F.col("verdict") == "RISKY").alias("risky"))


@query("e1_disposition_scores", "SELECT run_id, count(*) AS findings_discovered, " + ", ".join(f"count(*) FILTER ({s}_disp = '{d}') AS {s}_{d.lower()}" for s in "bc" for d in E.DISPOSITIONS) + " FROM b_findings GROUP BY run_id")
def _(t):
    return E.disposition_scores(_f(t))


@query("e2_finding_status", "SELECT run_id, pos, CASE coalesce(nullif(c_disp, ''), b_disp) WHEN 'CONFIRMED' THEN 'confirmed' WHEN 'NARROWED' THEN 'narrowed' WHEN 'REJECTED' THEN 'rejected' WHEN 'INCONCLUSIVE' THEN 'inconclusive' ELSE 'unassessed' END AS status FROM b_findings WHERE b_disp IS NOT NULL UNION ALL SELECT run_id, pos, 'new_unverified' FROM b_findings WHERE b_disp IS NULL")
def _(t):
    f = _f(t)
    ids = f.where("b_disp is not null").select("run_id", F.col("pos").alias("finding_id"), "pos")
    disp = lambda c: f.where(f"{c} is not null").select("run_id", F.col("pos").alias("finding_id"), "pos", F.col(c).alias("disposition"))
    new = f.where("b_disp is null").select("run_id", "pos")
    return E.finding_status(E.attach_dispositions(ids, disp("b_disp"), disp("c_disp")), new)


@query("e3_case_candidates", f"WITH {CAND} SELECT run_id, rank, pos, case_id, arm, mechanism, rec_path, counts, orphan FROM allcand")
def _(t):
    return E.case_candidates(*scored(t)).select("run_id", "rank", "pos", "case_id", "arm", "mechanism", F.get("paths", F.lit(0)).alias("rec_path"), "counts", "orphan")


@query("e3_orphan_assessments", f"WITH {CAND} SELECT run_id, 999 AS finding_id FROM allcand WHERE orphan")
def _(t):
    return E.orphan_assessments(E.case_candidates(*scored(t)))


@query("e4_case_verdict", f"WITH {VERDICT} SELECT run_id, case_id, arm, CASE WHEN risky THEN 'RISKY' ELSE 'CLEAN' END AS verdict, primary_pos, primary_file, primary_mechanism, CASE WHEN counted_rank <> primary_rank THEN counted_pos END AS deciding_pos, coalesce(n_qualifying, 0) AS n_qualifying, coalesce(n_qualifying, 0) AS findings_at_or_above, CASE WHEN arm = 'T' THEN coalesce(n_candidates, 0) END AS survivors FROM v")
def _(t):
    return _verdict(t).select("run_id", "case_id", "arm", "verdict", "primary_pos", "primary_file", "primary_mechanism", "deciding_pos", "n_qualifying", "findings_at_or_above", "survivors")


@query("e5_recommended_paths", f"WITH {VERDICT}, p AS (SELECT cand.run_id, rec_path FROM cand JOIN v ON cand.run_id = v.run_id WHERE counts OR rank = primary_rank) SELECT r.run_id, coalesce(string_agg(DISTINCT rec_path, ',' ORDER BY rec_path), '') AS paths FROM scored r LEFT JOIN p ON r.run_id = p.run_id GROUP BY r.run_id")
def _(t):
    return _verdict(t).select("run_id", F.array_join("recommended_paths", ",").alias("paths"))


@query("e6_risk_scores", f"WITH {VERDICT}, a AS (SELECT run_id, max({WEIGHT}) AS s, count(*) AS n FROM b_findings GROUP BY run_id) SELECT v.run_id, coalesce(score, 0) AS risk_score, coalesce(s, 0) AS risk_score_all, coalesce(n, 0) AS findings_discovered, coalesce(n_qualifying, 0) AS findings_at_or_above FROM v LEFT JOIN a ON v.run_id = a.run_id")
def _(t):
    return _verdict(t).select("run_id", "risk_score", "risk_score_all", "findings_discovered", "findings_at_or_above")


@query("e7_verification_units", f"WITH {CAND} SELECT case_id, arm, run_id, rank, pos, severity, file FROM cand WHERE counts AND run_id % 17 <> 0")
def _(t):
    runs, findings, assessments = scored(t)
    return E.verification_units(runs, findings, runs.where("run_id % 17 = 0"), assessments).select("case_id", "arm", "run_id", "rank", "pos", "severity", "file")


# --- cohort -------------------------------------------------------------------------------

CONF = f"{VERDICT}, conf AS (SELECT arm, count(*) AS n_cases, count(*) FILTER (label = 'positive' AND risky) AS tp, count(*) FILTER (label = 'negative' AND risky) AS fp, count(*) FILTER (label = 'positive' AND NOT risky) AS fn, count(*) FILTER (label = 'negative' AND NOT risky) AS tn FROM v JOIN b_labels l ON v.case_id = l.case_id GROUP BY arm)"


@query("h1_void_filter", f"WITH {VERDICT} SELECT arm, case_id, run_id, risky FROM v WHERE run_id % 17 <> 0 AND case_id % 19 <> 0")
def _(t):
    return H.void_filter(_risky(t), t("b_runs").where("run_id % 17 = 0"), t("b_labels").where("case_id % 19 = 0"))


@query("h2_confusion", f"WITH {CONF} SELECT * FROM conf")
def _(t):
    return H.confusion(t("b_labels"), _risky(t))


@query("h3_precision_recall", f"WITH {CONF} SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, CASE WHEN tp + fp = 0 THEN 'no case called risky' END AS precision_absent, CASE WHEN tp + fn = 0 THEN 'no positive case scored' END AS recall_absent FROM conf")
def _(t):
    return H.precision_recall(H.confusion(t("b_labels"), _risky(t)))


@query("h4_absent_cases", f"WITH {VERDICT} SELECT a.arm, l.case_id, CAST(NULL AS VARCHAR) AS reason FROM b_labels l JOIN (VALUES ('T'), ('G')) a(arm) ON TRUE WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.arm = a.arm AND v.case_id = l.case_id) UNION ALL SELECT 'H', l.case_id, CASE WHEN h.case_id IS NOT NULL THEN coalesce(reason, 'not recorded') END FROM b_labels l LEFT JOIN b_history h ON l.case_id = h.case_id WHERE h.risky IS NULL")
def _(t):
    v = _risky(t).select("arm", "case_id", "risky").unionByName(H.history_verdicts(t("b_history")))
    return H.absent_cases(t("b_labels"), v, ["T", "G", "H"], t("b_history"))


@query("h5_recall_by_class", f"WITH {VERDICT}, e AS (SELECT DISTINCT arm, class FROM b_labels JOIN (VALUES ('T'), ('G')) a(arm) ON TRUE WHERE label = 'positive') SELECT e.arm, e.class, count(v.case_id) AS n, count(*) FILTER (risky) AS hit, count(*) FILTER (risky) / nullif(count(v.case_id), 0) AS recall FROM e JOIN b_labels l ON l.class = e.class LEFT JOIN v ON v.case_id = l.case_id AND v.arm = e.arm GROUP BY e.arm, e.class")
def _(t):
    return H.recall_by_class(t("b_labels"), _risky(t), ["T", "G"])


STRATA = "s AS (SELECT case_id, label, 'subsystem' AS dim, subsystem AS bucket FROM b_labels WHERE coalesce(subsystem, '') <> '' UNION ALL SELECT case_id, label, 'admission_description', admission_description FROM b_labels WHERE admission_description IS NOT NULL UNION ALL SELECT case_id, label, 'source', coalesce(nullif(source, ''), source_window) FROM b_labels WHERE coalesce(nullif(source, ''), source_window) IS NOT NULL UNION ALL SELECT case_id, label, 'fallback_pair', CASE WHEN fb THEN 'fallback' ELSE 'fully matched' END FROM (SELECT *, CASE WHEN fallback_pair IS NOT NULL THEN fallback_pair WHEN len(match_key_used) > 0 THEN len(match_key_used) = 1 AND lower(match_key_used[1]) = 'subsystem' END AS fb FROM b_labels) WHERE fb IS NOT NULL UNION ALL SELECT case_id, label, 'fix_before_cutoff', CASE WHEN fix_before_cutoff THEN 'before cutoff' ELSE 'after cutoff' END FROM b_labels WHERE fix_before_cutoff IS NOT NULL)"


@query("h6_strata", f"WITH {VERDICT}, {STRATA}, c AS (SELECT arm, dim, bucket, count(*) AS n_cases, count(*) FILTER (label = 'positive' AND risky) AS tp, count(*) FILTER (label = 'negative' AND risky) AS fp, count(*) FILTER (label = 'positive' AND NOT risky) AS fn, count(*) FILTER (label = 'negative' AND NOT risky) AS tn FROM v JOIN s ON v.case_id = s.case_id GROUP BY arm, dim, bucket) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c")
def _(t):
    return H.stratified(_labels(t), _risky(t)).drop("precision_absent", "recall_absent")


@query("h7_hit_rate", f"WITH {VERDICT}, rec AS (SELECT DISTINCT cand.arm, cand.case_id, rec_path FROM cand JOIN v ON v.run_id = cand.run_id WHERE counts OR rank = primary_rank), tp AS (SELECT v.arm, v.case_id FROM v JOIN b_labels l ON v.case_id = l.case_id WHERE risky AND label = 'positive'), x AS (SELECT tp.arm, tp.case_id, path IS NOT NULL AS has, EXISTS (SELECT 1 FROM rec WHERE rec.arm = tp.arm AND rec.case_id = tp.case_id AND (rec_path = path OR starts_with(path, rec_path || '/'))) AS hit FROM tp LEFT JOIN b_fixing_paths p ON tp.case_id = p.case_id) SELECT arm, count(*) FILTER (has) AS with_paths, count(*) FILTER (NOT has) AS without_paths, count(*) FILTER (has AND hit) AS hits, count(*) FILTER (has AND hit) / nullif(count(*) FILTER (has), 0) AS hit_rate FROM x GROUP BY arm")
def _(t):
    v = cut(_verdict(t).select("arm", "case_id", (F.col("verdict") == "RISKY").alias("risky"), "recommended_paths"))  # read twice
    rec = v.where("risky").select("arm", "case_id", F.explode("recommended_paths").alias("rec_path"))
    return H.hit_rate(t("b_labels"), v, rec, t("b_fixing_paths"))


FISHER = "WITH {head}, k AS (SELECT *, unnest(range(greatest(0, {a} + {c} - {c} - {d}), least({a} + {b}, {a} + {c}) + 1)) AS x FROM {src}), w AS (SELECT *, lgamma({a} + {b} + 1) - lgamma(x + 1) - lgamma({a} + {b} - x + 1) + lgamma({c} + {d} + 1) - lgamma({a} + {c} - x + 1) - lgamma({d} - {a} + x + 1) AS lp FROM k), z AS (SELECT *, exp(lp - (lgamma({a} + {b} + {c} + {d} + 1) - lgamma({a} + {c} + 1) - lgamma({b} + {d} + 1))) AS p FROM w)"


@query("h8_vs_chance", FISHER.format(head=CONF, src="conf", a="tp", b="fp", c="fn", d="tn") + " SELECT arm, tp, fp, fn, tn, round(least(1, sum(p) FILTER (p <= here * (1 + 1e-9))), 7) AS p FROM (SELECT *, max(p) FILTER (x = tp) OVER (PARTITION BY arm) AS here FROM z) GROUP BY arm, tp, fp, fn, tn")
def _(t):
    return H.vs_chance(H.confusion(t("b_labels"), _risky(t))).select("arm", "tp", "fp", "fn", "tn", F.round("p", 7).alias("p"))


PAIR = f"{VERDICT}, j AS (SELECT label = 'positive' AS p, a.risky AS a, b.risky AS b, coalesce(CASE WHEN fallback_pair IS NOT NULL THEN fallback_pair WHEN len(match_key_used) > 0 THEN len(match_key_used) = 1 AND lower(match_key_used[1]) = 'subsystem' END, FALSE) AS fallback FROM b_labels l JOIN v a ON a.case_id = l.case_id AND a.arm = 'T' JOIN v b ON b.case_id = l.case_id AND b.arm = 'G')"
PAIR_COUNTS = "count(*) AS common, count(*) FILTER (p) AS positives, count(*) FILTER (p AND a AND b) AS b_pos, count(*) FILTER (NOT p AND a AND b) AS b_neg, count(*) FILTER (p AND a AND NOT b) AS t_pos, count(*) FILTER (NOT p AND a AND NOT b) AS t_neg, count(*) FILTER (p AND NOT a AND b) AS u_pos, count(*) FILTER (NOT p AND NOT a AND b) AS u_neg"


@query("h9_pairwise_delta", f"WITH {PAIR}, c AS (SELECT 'T-G' AS comparison, {PAIR_COUNTS} FROM j), d AS (SELECT *, t_pos + t_neg + u_pos + u_neg AS discordant, (b_pos + t_pos) / nullif(b_pos + t_pos + b_neg + t_neg, 0) - (b_pos + u_pos) / nullif(b_pos + u_pos + b_neg + u_neg, 0) AS delta_precision, (b_pos + t_pos) / nullif(positives, 0) - (b_pos + u_pos) / nullif(positives, 0) AS delta_recall FROM c) SELECT comparison, common, discordant, round(delta_precision, 9) AS delta_precision, round(delta_recall, 9) AS delta_recall, delta_precision * 100 >= 15 - 1e-9 AS meets_precision, delta_recall * 100 >= 15 - 1e-9 AS meets_recall FROM d")
def _(t):
    d = H.pairwise_delta(H.paired_counts(t("b_labels"), cut(_risky(t)), "T", "G"))
    return d.select("comparison", "common", "discordant", F.round("delta_precision", 9).alias("delta_precision"), F.round("delta_recall", 9).alias("delta_recall"), "meets_precision", "meets_recall")


@query("h10_paired_permutation", f"WITH {PAIR}, c AS (SELECT {PAIR_COUNTS} FROM j), k AS (SELECT *, t_pos + u_pos AS d, unnest(range(0, t_pos + u_pos + 1)) AS x FROM c), w AS (SELECT *, exp(lgamma(d + 1) - lgamma(x + 1) - lgamma(d - x + 1) - d * ln(2)) AS m FROM k) SELECT common, round((t_pos - u_pos) / positives, 9) AS delta_recall, round(sum(m) FILTER (2 * x - d >= t_pos - u_pos), 7) AS p1_recall, round(sum(m) FILTER (abs(2 * x - d) >= abs(t_pos - u_pos)), 7) AS p2_recall FROM w GROUP BY ALL")
def _(t):
    p = H.paired_test(H.paired_counts(t("b_labels"), cut(_risky(t)), "T", "G"))
    return p.select("common", F.round("delta_recall", 9).alias("delta_recall"), F.round("p1_recall", 7).alias("p1_recall"), F.round("p2_recall", 7).alias("p2_recall"))


#: All outcomes x, y of both binomials, one by one.
GRID = f"""{PAIR}, c AS (SELECT {PAIR_COUNTS} FROM j), d AS (SELECT *, t_pos + u_pos AS dp, t_neg + u_neg AS dn, (b_pos + t_pos) / nullif(b_pos + b_neg + t_pos + t_neg, 0) - (b_pos + u_pos) / nullif(b_pos + b_neg + u_pos + u_neg, 0) AS obs FROM c),
  gx AS (SELECT *, unnest(range(0, dp + 1)) AS x FROM d), g AS (SELECT *, unnest(range(0, dn + 1)) AS y FROM gx),
  w AS (SELECT *, (b_pos + x) / nullif(b_pos + b_neg + x + y, 0) - (b_pos + dp - x) / nullif(b_pos + b_neg + dp - x + dn - y, 0) AS diff, exp(lgamma(dp + 1) - lgamma(x + 1) - lgamma(dp - x + 1) - dp * ln(2) + lgamma(dn + 1) - lgamma(y + 1) - lgamma(dn - y + 1) - dn * ln(2)) AS m FROM g)"""


@query("h10_paired_precision", f"WITH {GRID} SELECT 'T-G' AS comparison, common, round(obs, 9) AS delta_precision, round(sum(m) FILTER (diff >= obs - 1e-12) / sum(m) FILTER (diff IS NOT NULL), 7) AS p1_precision, round(sum(m) FILTER (abs(diff) >= abs(obs) - 1e-12) / sum(m) FILTER (diff IS NOT NULL), 7) AS p2_precision FROM w GROUP BY common, obs")
def _(t):
    p = H.paired_test(H.paired_counts(t("b_labels"), cut(_risky(t)), "T", "G"))
    return p.select("comparison", "common", F.round("delta_precision", 9).alias("delta_precision"), *[F.round(c, 7).alias(c) for c in ("p1_precision", "p2_precision")])


@query("h11_pairwise_subset", f"WITH {PAIR} SELECT 'T-G' AS comparison, 'all' AS subset, {PAIR_COUNTS} FROM j UNION ALL SELECT 'T-G', 'without fallback', {PAIR_COUNTS} FROM j WHERE NOT fallback")
def _(t):
    return H.comparisons(t("b_labels"), cut(_risky(t)), [("T", "G")])


VERIFY = f"""{CAND}, ver AS (SELECT arm, case_id, CASE (run_id + rank) % 3 WHEN 0 THEN CASE WHEN rank % 2 = 1 THEN 'confirmed' ELSE 'CONFIRMED' END WHEN 1 THEN 'Inconclusive' END AS disposition, (run_id + rank) % 6 = 0 AS unparseable, CASE WHEN (run_id + rank) % 29 = 0 THEN 'timed out' ELSE '' END AS error FROM cand WHERE counts),
  pair AS (SELECT arm, case_id, coalesce(bool_or(upper(disposition) = 'CONFIRMED' AND NOT unparseable AND error = ''), FALSE) AS confirmed, bool_and(error = '') AS covered FROM ver GROUP BY arm, case_id)"""


def _verified(runs: DataFrame, findings: DataFrame, assessments: DataFrame) -> DataFrame:
    c = E.verification_units(runs, findings, None, assessments).withColumn("k", F.col("run_id") + F.col("rank"))
    d = F.when(F.col("k") % 3 == 0, F.when(F.col("rank") % 2 == 1, "confirmed").otherwise("CONFIRMED")).when(F.col("k") % 3 == 1, "Inconclusive")
    return c.select("arm", "case_id", d.alias("disposition"), (F.col("k") % 6 == 0).alias("unparseable_first_response"), F.when(F.col("k") % 29 == 0, "timed out").otherwise("").alias("error"))


@query("h12_apply_verification", f"WITH {VERIFY}, r AS (SELECT r.arm, r.case_id, coalesce(bool_or(counts), FALSE) AS risky FROM scored r LEFT JOIN cand ON r.run_id = cand.run_id GROUP BY r.arm, r.case_id) SELECT concat(r.arm, '''') AS arm, r.case_id, risky AND NOT (coalesce(covered, FALSE) AND NOT coalesce(confirmed, FALSE)) AS risky FROM r LEFT JOIN pair ON r.arm = pair.arm AND r.case_id = pair.case_id")
def _(t):
    own = scored(t)
    return H.apply_verification(_risky_of(E.case_verdict(*own)), _verified(*own))


@query("h13_verify_summary", f"WITH {VERIFY} SELECT arm, CASE WHEN error <> '' THEN 'ERROR' WHEN unparseable THEN 'INCONCLUSIVE' ELSE upper(coalesce(disposition, 'INCONCLUSIVE')) END AS disposition, count(*) AS n FROM ver GROUP BY 1, 2")
def _(t):
    return H.verify_summary(_verified(*scored(t)))


@query("h13_verify_pairs", f"WITH {VERIFY} SELECT arm, count(*) FILTER (covered) AS covered, count(*) FILTER (covered AND NOT confirmed) AS withdrawn FROM pair GROUP BY arm")
def _(t):
    return H.verify_pairs(_verified(*scored(t)))


@query("h14_cohort_header", "SELECT count(*) FILTER (case_id % 19 <> 0) AS cohort, count(*) FILTER (case_id % 19 <> 0 AND label = 'positive') AS positives, count(*) FILTER (case_id % 19 <> 0 AND label = 'negative') AS negatives, count(*) FILTER (case_id % 19 = 0) AS probe_voided, count(*) FILTER (case_id % 23 = 0) AS unresolved, count(*) FILTER (case_id % 19 <> 0 AND label = 'positive') <= 20 AS underpowered, count(*) FILTER (case_id % 23 = 0) > 0 AS provisional FROM b_labels")
def _(t):
    return H.cohort_header(t("b_labels"), t("b_labels").where("case_id % 19 = 0"), t("b_labels").where("case_id % 23 = 0"))


@query("h15_criteria_table", f"WITH {CONF}, o AS (SELECT concat('precision ', arm) AS criterion, tp / nullif(tp + fp, 0) AS observed, 0.5 AS threshold FROM conf UNION ALL SELECT concat('recall ', arm), tp / nullif(tp + fn, 0), 0.9 FROM conf) SELECT criterion, round(observed, 9) AS observed, CASE WHEN observed IS NULL THEN 'cannot be evaluated' WHEN observed >= threshold - 1e-9 THEN 'meets' ELSE 'does not' END AS outcome FROM o")
def _(t):
    pr = H.precision_recall(H.confusion(t("b_labels"), _risky(t)))
    row = lambda m, least: pr.select(F.concat(F.lit(f"{m} "), "arm").alias("criterion"), F.col(m).alias("observed"), F.lit(least).alias("threshold"))
    out = H.criteria_table(row("precision", 0.5).unionByName(row("recall", 0.9)))
    return out.select("criterion", F.round("observed", 9).alias("observed"), "outcome")


@query("h16_stratum_case_counts", f"WITH {STRATA} SELECT dim, bucket, count(*) AS n, sum(count(*)) OVER (PARTITION BY dim)::BIGINT AS recorded, (SELECT count(*) FROM b_labels) AS n_cases FROM s GROUP BY dim, bucket")
def _(t):
    return H.stratum_counts(_labels(t))


# --- accounting ---------------------------------------------------------------------------


@query("m1_label_movement", "WITH m AS (SELECT arm, f.run_id, count(*) AS n, count(*) FILTER (b_disp <> c_disp) AS k FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id WHERE b_disp IS NOT NULL AND c_disp IS NOT NULL GROUP BY arm, f.run_id) SELECT arm, sum(n)::BIGINT AS findings, sum(k)::BIGINT AS findings_moved, count(*) AS runs, count(*) FILTER (k > 0) AS runs_moved FROM m GROUP BY arm")
def _(t):
    return A.label_movement(_f(t), t("b_all_runs"))


@query("m2_a_to_c", "SELECT arm, count(*) AS findings, count(*) FILTER (c_disp <> 'CONFIRMED') AS moved, count(*) FILTER (c_disp = 'REJECTED') AS rejected, count(*) FILTER (c_disp = 'NARROWED') AS narrowed, count(*) FILTER (c_disp = 'INCONCLUSIVE') AS inconclusive, count(*) FILTER (c_disp <> 'CONFIRMED') / count(*) AS share, (SELECT count(*) FROM b_all_runs n WHERE n.run_id % 10 = 0 AND n.arm = r.arm) AS new FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id WHERE c_disp IS NOT NULL GROUP BY arm")
def _(t):
    return A.a_to_c(_f(t), t("b_all_runs"), t("b_all_runs").where("run_id % 10 = 0").select("run_id"))


@query("m3_threshold_sweep", "SELECT arm, threshold, count(*) AS findings, count(*) FILTER (CASE WHEN confidence >= threshold THEN 'CONFIRMED' ELSE 'INCONCLUSIVE' END <> c_disp) AS moved FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id JOIN (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0)) x(threshold) ON TRUE WHERE c_disp IS NOT NULL GROUP BY arm, threshold")
def _(t):
    return A.threshold_sweep(_f(t), t("b_all_runs"), [0.2, 0.4, 0.6, 0.8])


@query("m4_confidence_quantiles", "SELECT arm, min(confidence) AS least, quantile_cont(confidence, 0.25) AS p25, quantile_cont(confidence, 0.5) AS p50, quantile_cont(confidence, 0.75) AS p75, max(confidence) AS most FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id GROUP BY arm")
def _(t):
    return A.confidence_quantiles(_f(t), t("b_all_runs"))


USAGE = "u AS (SELECT run_id, stage, count(*) AS attempts, sum(tokens)::BIGINT AS tokens, sum(tool_calls)::BIGINT AS tool_calls, sum(cost_usd) AS cost_usd, CAST(sum(CASE WHEN tool_calls > 1 THEN tool_calls - 1 END) AS DOUBLE) AS wall FROM b_attempts GROUP BY run_id, stage)"


def _usage(t) -> DataFrame:
    a = t("b_attempts").withColumns({"started_at": F.col("ts"), "finished_at": F.col("ts") + F.expr("make_dt_interval(0, 0, 0, tool_calls - 1)")})
    return A.stage_usage(a)


@query("m5_stage_usage", f"WITH {USAGE}, l AS (SELECT run_id, stage, max_by(attempt, CASE WHEN failed THEN 0 ELSE 1000000 END + attempt) AS final_attempt, max_by(tokens, CASE WHEN failed THEN 0 ELSE 1000000 END + attempt) AS final_tokens, CAST(sum(CASE WHEN tool_calls > 1 THEN tool_calls - 1 END) AS DOUBLE) AS wall_s FROM b_attempts GROUP BY run_id, stage) SELECT u.run_id, u.stage, attempts, tokens, tool_calls, round(cost_usd, 6) AS cost_usd, wall_s, final_attempt, final_tokens FROM u JOIN l ON u.run_id = l.run_id AND u.stage = l.stage")
def _(t):
    return _usage(t).select("run_id", "stage", "attempts", "tokens", "tool_calls", F.round("cost_usd", 6).alias("cost_usd"), F.round("wall_s", 3).alias("wall_s"), "final_attempt", "final_tokens")


@query("m6_run_cost", f"WITH {USAGE}, p AS (SELECT u.run_id, arm, sum(cost_usd) AS c FROM u JOIN b_all_runs r ON u.run_id = r.run_id GROUP BY u.run_id, arm) SELECT arm, count(*) AS runs, round(sum(c), 6) AS total, round(avg(c), 6) AS mean, round(max(c), 6) AS most FROM p GROUP BY arm")
def _(t):
    out = A.run_cost(_usage(t), t("b_all_runs"))
    return out.select("arm", "runs", *[F.round(c, 6).alias(c) for c in ("total", "mean", "most")])


@query("m7_cost_by_stage", f"WITH {USAGE} SELECT stage, round(sum(cost_usd), 6) AS cost_usd, sum(attempts)::BIGINT AS attempts, round(sum(wall), 3) AS wall_s, round(sum(cost_usd) / (SELECT sum(cost_usd) FROM u), 9) AS share FROM u GROUP BY stage")
def _(t):
    return A.cost_by_stage(_usage(t)).select("stage", F.round("cost_usd", 6).alias("cost_usd"), "attempts", F.round("wall_s", 3).alias("wall_s"), F.round("share", 9).alias("share"))


@query("m8_cohort_table", f"WITH {USAGE}, c AS (SELECT run_id, sum(cost_usd) AS cost, sum(wall) AS wall FROM u GROUP BY run_id), s AS (SELECT run_id, count(*) AS found, count(*) FILTER (b_disp = 'CONFIRMED') AS b_confirmed, count(*) FILTER (c_disp = 'REJECTED') AS c_rejected FROM b_findings GROUP BY run_id) SELECT r.run_id, r.case_id, r.arm, found AS findings_discovered, b_confirmed, c_rejected, round(cost, 6) AS cost_usd, round(wall, 3) AS wall_s FROM b_all_runs r LEFT JOIN s ON r.run_id = s.run_id LEFT JOIN c ON r.run_id = c.run_id")
def _(t):
    out = A.cohort_table(E.disposition_scores(_f(t)), _usage(t), t("b_all_runs"))
    return out.select("run_id", "case_id", "arm", "findings_discovered", "b_confirmed", "c_rejected", F.round("cost_usd", 6).alias("cost_usd"), F.round("wall_s", 3).alias("wall_s"))


@query("m9_cost_per_outcome", f"WITH {USAGE}, c AS (SELECT run_id, sum(cost_usd) AS cost FROM u GROUP BY run_id), s AS (SELECT run_id, count(*) FILTER (coalesce(c_disp, '') <> 'REJECTED') AS sv, count(*) FILTER (c_disp = 'REJECTED') AS sp FROM b_findings GROUP BY run_id), x AS (SELECT arm, sum(cost) AS cost, coalesce(sum(sv), 0)::BIGINT AS sv, coalesce(sum(sp) FILTER (label = 'negative'), 0)::BIGINT AS sp FROM b_all_runs r JOIN b_labels l ON r.case_id = l.case_id JOIN c ON r.run_id = c.run_id LEFT JOIN s ON r.run_id = s.run_id GROUP BY arm) SELECT arm, round(cost, 6) AS cost_usd, sv AS survived, sp AS suppressed_clean, round(cost / nullif(sv, 0), 6) AS per_survivor, round(cost / nullif(sp, 0), 6) AS per_suppressed_clean FROM x")
def _(t):
    out = A.cost_per_outcome(_usage(t), _f(t), t("b_all_runs"), t("b_labels"))
    return out.select("arm", F.round("cost_usd", 6).alias("cost_usd"), "survived", "suppressed_clean", F.round("per_survivor", 6).alias("per_survivor"), F.round("per_suppressed_clean", 6).alias("per_suppressed_clean"))


@query("m9_incremental_cost", f"WITH {USAGE}, c AS (SELECT arm, stage, sum(cost_usd) AS cost FROM u JOIN b_all_runs r ON u.run_id = r.run_id GROUP BY arm, stage), d AS (SELECT arm, CASE WHEN c_disp IS NOT NULL THEN 3 WHEN b_disp IS NOT NULL THEN 2 ELSE 1 END AS stage, count(*) AS n FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id WHERE f.run_id IN (SELECT run_id FROM u) GROUP BY 1, 2) SELECT c.arm, c.stage, round(cost, 6) AS cost_usd, coalesce(n, 0) AS decided, round(cost / n, 9) AS per_decided FROM c LEFT JOIN d ON c.arm = d.arm AND c.stage = d.stage")
def _(t):
    out = A.incremental_cost(_usage(t), _f(t), t("b_all_runs"))
    return out.select("arm", "stage", F.round("cost_usd", 6).alias("cost_usd"), "decided", F.round("per_decided", 9).alias("per_decided"))


#: Arm T asks for a version and a hash, arm G for a version; some runs are of others, or have no hash.
QUEUE = """p AS (SELECT case_id, CASE WHEN run_id % 11 = 0 THEN 'v0' WHEN arm = 'T' THEN 'v1' ELSE 'g1' END AS version, CASE WHEN run_id % 13 = 0 THEN 'h2' WHEN run_id % 17 <> 0 THEN 'h1' END AS hash FROM b_all_runs WHERE status = 'completed'),
  sealed AS (SELECT case_id, 'T' AS arm FROM p WHERE version = 'v1' AND hash = 'h1' UNION SELECT case_id, 'G' FROM p WHERE version = 'g1'),
  q AS (SELECT l.case_id, a.arm, CASE WHEN EXISTS (SELECT 1 FROM sealed r WHERE r.case_id = l.case_id AND r.arm = a.arm) THEN 'done' WHEN l.case_id % 5 = 0 THEN 'refused' ELSE 'to do' END AS state FROM b_labels l JOIN (VALUES ('T'), ('G')) a(arm) ON TRUE)"""


def _queue(t) -> DataFrame:
    k = F.col("run_id")
    runs = t("b_all_runs").withColumns({"protocol_version": F.when(k % 11 == 0, "v0").when(F.col("arm") == "T", "v1").otherwise("g1"), "protocol_hash": F.when(k % 13 == 0, "h2").when(k % 17 != 0, "h1")})
    refused = t("b_labels").where("case_id % 5 = 0").select("case_id", F.lit("probe void").alias("reason"))
    return A.work_queue(t("b_labels"), {"T": ("v1", "h1"), "G": ("g1", None)}, runs, refused)


@query("m10_work_queue", f"WITH {QUEUE} SELECT case_id, arm, state, CASE WHEN state = 'refused' THEN 'probe void' END AS reason FROM q")
def _(t):
    return _queue(t)


#: A user's events are the attempts of a run; stalls name a wait, or none.
WAITS = """a AS (SELECT run_id, stage, attempt, CASE WHEN NOT failed THEN 'succeeded' WHEN tool_calls % 2 = 0 THEN 'stalled' ELSE 'failed' END AS outcome, tool_calls, cost_usd, epoch(ts) AS began, epoch(ts) + tool_calls - 1 AS ended FROM b_attempts),
  l AS (SELECT *, lag(outcome) OVER w AS after, lag(ended) OVER w AS before FROM a WINDOW w AS (PARTITION BY run_id, stage ORDER BY attempt)),
  m AS (SELECT run_id * 3 AS case_id, CASE WHEN run_id % 2 = 0 THEN 'T' ELSE 'G' END AS arm, count(*) AS attempts, count(*) FILTER (outcome = 'succeeded') AS succeeded, count(*) FILTER (outcome = 'stalled') AS stalled, count(*) FILTER (outcome = 'failed') AS failed,
    coalesce(sum(greatest(0, began - before)) FILTER (after = 'stalled'), 0) AS waited, coalesce(sum(CASE WHEN tool_calls > 2 THEN tool_calls * 60 ELSE 300 END) FILTER (outcome = 'stalled'), 0) AS asked, max_by(outcome, stage * 1000000 + attempt) AS outcome, sum(cost_usd) AS cost FROM l GROUP BY run_id)"""


def _waits(t) -> DataFrame:
    k = F.col("tool_calls")
    stall = F.when(k > 2, F.concat(F.lit("Usage limit reached, try again in "), k, F.lit(" minutes"))).otherwise("Usage limit reached")
    error = F.when(~F.col("failed"), "").when(k % 2 == 0, stall).otherwise("connection reset")
    ends = F.col("ts") + F.expr("make_dt_interval(0, 0, 0, tool_calls - 1)")
    attempts = t("b_attempts").withColumns({"error": error, "started_at": F.col("ts"), "finished_at": ends})
    runs = attempts.select("run_id").distinct().select("run_id", (F.col("run_id") * 3).alias("case_id"), F.when(F.col("run_id") % 2 == 0, "T").otherwise("G").alias("arm"))
    return A.attempt_waits(attempts, runs)


@query("m12_attempt_waits", f"WITH {WAITS} SELECT case_id, arm, attempts, succeeded, stalled, failed, round(waited, 2) AS waited_s, CAST(asked AS DOUBLE) AS asked_s, outcome, round(cost, 6) AS cost_usd, round(stalled / attempts, 9) AS stall_share FROM m")
def _(t):
    return _waits(t).withColumns({"waited_s": F.round("waited_s", 2), "cost_usd": F.round("cost_usd", 6), "stall_share": F.round("stall_share", 9)})


@query("m11_batch_summary", f"WITH {QUEUE}, {WAITS}, s AS (SELECT q.arm, CASE WHEN state = 'to do' AND outcome IN ('stalled', 'failed') THEN outcome ELSE state END AS state, cost FROM q LEFT JOIN m ON q.case_id = m.case_id AND q.arm = m.arm) SELECT arm, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'refused') AS refused, count(*) FILTER (state = 'stalled') AS stalled, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'to do') AS to_do, round(coalesce(sum(cost), 0), 6) AS cost_usd FROM s GROUP BY arm")
def _(t):
    return A.batch_summary(_queue(t), _waits(t).select("case_id", "arm", "outcome", "cost_usd")).withColumn("cost_usd", F.round("cost_usd", 6))


@query("m12_attempt_outcomes", "SELECT stage, CASE WHEN NOT failed THEN 'succeeded' WHEN tool_calls % 2 = 0 THEN 'stalled' ELSE 'failed' END AS outcome, count(*) AS n FROM b_attempts GROUP BY 1, 2")
def _(t):
    error = F.when(~F.col("failed"), "").when(F.col("tool_calls") % 2 == 0, F.concat(F.lit("Usage limit reached after "), "tool_calls", F.lit(" calls"))).otherwise("connection reset")
    return A.attempt_outcomes(t("b_attempts").withColumn("error", error)).groupBy("stage", "outcome").agg(F.count("*").alias("n"))


@query("m13_provenance_drift", "WITH p AS (SELECT arm, 'engine' AS name, concat('v', CAST(CASE WHEN arm = 'T' THEN run_id % 3 ELSE 0 END AS VARCHAR)) AS value, run_id FROM b_all_runs), c AS (SELECT arm, name, value, count(DISTINCT run_id) AS runs FROM p GROUP BY arm, name, value) SELECT *, count(*) OVER (PARTITION BY arm, name) > 1 AS mixed FROM c")
def _(t):
    v = F.concat(F.lit("v"), F.when(F.col("arm") == "T", F.col("run_id") % 3).otherwise(0).cast("string"))
    return A.provenance_drift(t("b_all_runs").select("run_id", "arm", F.lit("engine").alias("name"), v.alias("value")))


# --- checks -------------------------------------------------------------------------------


def _found(t) -> DataFrame:
    return t("b_findings").where("b_disp is not null or pos % 4 <> 0").select("run_id", F.col("pos").alias("finding_id"), F.concat("severity", F.lit(" "), "file").alias("mechanism"))


def _assessed(t) -> DataFrame:
    m = F.concat("severity", F.lit(" "), "file")
    own = F.when(F.col("partkey") % 10 < 5, m).otherwise(F.concat(m, F.lit(" narrowed")))
    return t("b_findings").where("b_disp is not null or pos % 8 = 0").select("run_id", F.col("pos").alias("finding_id"), F.when(F.col("suppkey") % 7 == 0, F.upper(m)).otherwise(m).alias("discovery_mechanism"), own.alias("mechanism"), F.col("b_disp").alias("disposition"))


@query("r1_ancestry_orphans", "SELECT run_id, pos AS finding_id FROM b_findings WHERE b_disp IS NULL AND pos % 8 = 0")
def _(t):
    return R.ancestry_orphans(_assessed(t), _found(t)).select("run_id", "finding_id")


@query("r2_ancestry_mechanism", "SELECT run_id, finding_id, rule FROM (SELECT run_id, pos AS finding_id, CASE WHEN suppkey % 7 = 0 THEN 'not verbatim' WHEN b_disp = 'CONFIRMED' AND partkey % 10 >= 5 THEN 'confirmed but changed' WHEN b_disp = 'NARROWED' AND partkey % 10 < 5 THEN 'narrowed but unchanged' END AS rule FROM b_findings WHERE b_disp IS NOT NULL) WHERE rule IS NOT NULL")
def _(t):
    return R.ancestry_mechanism(_assessed(t), _found(t)).select("run_id", "finding_id", "rule")


@query("r3_dropped_findings", "SELECT run_id, pos AS finding_id FROM b_findings WHERE b_disp IS NULL AND pos % 4 <> 0")
def _(t):
    return R.dropped_findings(_found(t), _assessed(t)).select("run_id", "finding_id")


_BARE = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("r4_citation_check", f"SELECT doc_id AS case_id, rule FROM (SELECT doc_id, CASE WHEN k = 0 THEN 'escapes' WHEN k = 1 OR text IS NULL THEN 'absent' WHEN k = 2 AND n < 3 THEN 'lines outside' WHEN k = 4 AND even AND n < 2 THEN 'lines outside' WHEN k = 3 AND even AND head <> '' AND {_BARE.format('line')} <> {_BARE.format('head')} THEN 'excerpt differs' END AS rule FROM (SELECT doc_id, text, doc_id % 5 AS k, doc_id % 2 = 0 AS even, len(string_split(text, chr(10))) AS n, string_split(text, chr(10))[1] AS line, substr(string_split(text, chr(10))[1], 1, 5) AS head FROM documents)) WHERE rule IS NOT NULL")
def _(t):
    d = t("documents")
    k, even, line = F.col("doc_id") % 5, F.col("doc_id") % 2 == 0, F.split("text", "\n")[0]
    file = F.when(k == 0, "../etc").when(k == 1, "none.txt").otherwise("./a//doc.txt")
    # of five citations: outside the snapshot, of no file, of lines 1-3, a part of line 1 or all of it in blanks, of line 2 without an end or of the whole file
    start, end = F.when(k < 4, 1).when(even, 2).otherwise(0), F.when(k == 2, 3).when(k < 4, 1).otherwise(0)
    excerpt = F.when((k == 3) & even, F.substring(line, 1, 5)).when(k == 3, F.concat(F.lit(" "), line, F.lit("  "))).otherwise("")
    c = d.select(F.col("doc_id").alias("case_id"), file.alias("file"), start.alias("start_line"), end.alias("end_line"), excerpt.alias("excerpt"))
    return R.citation_check(c, d.select(F.col("doc_id").alias("case_id"), F.lit("a/doc.txt").alias("path"), "text")).select("case_id", "rule")


@query("r5_usage_vs_budget", f"WITH {USAGE} SELECT run_id, stage, CASE WHEN tokens > 9000 THEN 'input_tokens' WHEN tool_calls > 10 THEN 'tool_calls' END AS violated, CASE WHEN tool_calls = 0 THEN 'output_tokens,tool_calls' ELSE 'output_tokens' END AS unchecked FROM (SELECT run_id, stage, tokens, tool_calls FROM u) WHERE tokens > 0")
def _(t):
    s = _usage(t).where("tokens > 0").select("run_id", "stage", F.col("tokens").alias("input_tokens"), F.lit(0).alias("output_tokens"), "tool_calls", F.lit(0.5).alias("cost_usd"), F.lit(9000).alias("max_input_tokens"), F.lit(100).alias("max_output_tokens"), F.lit(10).alias("max_tool_calls"), F.lit(0.0).alias("max_cost_usd"))
    return R.usage_vs_budget(s)


@query("r6_duplicate_runs", "SELECT arm, case_id, count(*) AS n_runs FROM b_all_runs WHERE status = 'completed' AND run_id % 17 <> 0 GROUP BY arm, case_id HAVING count(*) > 1")
def _(t):
    return R.duplicate_runs(t("b_all_runs"), t("b_all_runs").where("run_id % 17 = 0"))


@query("r7_cohort_fail_closed", "SELECT case_id, 'run without label' AS rule FROM (SELECT DISTINCT case_id FROM b_all_runs) WHERE case_id % 21 = 0 UNION ALL SELECT case_id, 'label without run' FROM b_labels WHERE case_id % 21 <> 0 AND case_id NOT IN (SELECT case_id FROM b_all_runs)")
def _(t):
    return R.cohort_fail_closed(t("b_all_runs"), t("b_labels").where("case_id % 21 <> 0"))


@query("r8_judge_consistency", f"""WITH {VERDICT}, j AS (SELECT case_id, arm, case_id % 3 AS pos, CASE WHEN case_id % 31 = 0 THEN 'b' ELSE 'a' END AS model, case_id % 37 = 0 AS family FROM (SELECT DISTINCT case_id, arm FROM b_all_runs)), one AS (SELECT model, family FROM j ORDER BY case_id, arm LIMIT 1)
  SELECT case_id, arm, pos, rule FROM (SELECT j.*, CASE WHEN j.model <> one.model OR j.family <> one.family THEN 'judges disagree' WHEN v.case_id IS NULL THEN 'no verdict' WHEN pos IS DISTINCT FROM primary_pos THEN 'not the primary' WHEN NOT risky THEN 'not risky' WHEN coalesce(label, '') <> 'positive' THEN 'not positive' END AS rule FROM j JOIN one ON TRUE LEFT JOIN v ON j.case_id = v.case_id AND j.arm = v.arm LEFT JOIN b_labels l ON j.case_id = l.case_id) WHERE rule IS NOT NULL""")
def _(t):
    c = F.col("case_id")
    judged = t("b_all_runs").select("case_id", "arm").distinct().withColumns({"pos": c % 3, "judge_model": F.when(c % 31 == 0, "b").otherwise("a"), "in_family": c % 37 == 0})
    return R.judge_consistency(judged, _verdict(t), t("b_labels"))


@query("r10_subset_pairs", "SELECT run_id, arm, case_id FROM b_all_runs WHERE case_id % 3 = 0 AND arm = 'T'")
def _(t):
    pairs = t("b_labels").where("case_id % 3 = 0").select("case_id", F.lit("T").alias("arm"))
    return R.subset_pairs(t("b_all_runs"), pairs).select("run_id", "arm", "case_id")


@query("r10_pairs_without_unit", "SELECT case_id, 'T' AS arm FROM b_labels WHERE case_id % 3 = 0 AND case_id NOT IN (SELECT case_id FROM b_all_runs WHERE arm = 'T')")
def _(t):
    return R.pairs_without_unit(t("b_all_runs"), t("b_labels").where("case_id % 3 = 0").select("case_id", F.lit("T").alias("arm")))


@query("s6_labels_violations", "SELECT 'repeated case' AS rule, CAST(case_id AS VARCHAR) AS id FROM b_labels WHERE case_id % 40 = 0 UNION ALL SELECT 'positive without class', CAST(case_id AS VARCHAR) FROM b_labels WHERE case_id % 14 = 0 AND case_id % 40 <> 0 UNION ALL SELECT 'positive without class', CAST(case_id AS VARCHAR) FROM b_labels JOIN (VALUES (1), (2)) x(k) ON TRUE WHERE case_id % 14 = 0 AND case_id % 40 = 0 UNION ALL SELECT 'unbalanced pair', CAST(pair_id AS VARCHAR) FROM (SELECT pair_id, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label = 'negative') AS n FROM (SELECT * FROM b_labels UNION ALL SELECT * FROM b_labels WHERE case_id % 40 = 0) GROUP BY pair_id) WHERE p <> 1 OR n <> 1")
def _(t):
    df = t("b_labels").withColumn("class", F.when(F.col("case_id") % 14 != 0, F.col("class")))
    return IO.labels_violations(df.unionByName(df.where("case_id % 40 = 0")))


@query("s7_history_of", "SELECT l.case_id, risky, CASE WHEN h.case_id IS NULL THEN 'no history file' WHEN risky IS NULL THEN coalesce(reason, 'not recorded') END AS absent FROM b_labels l LEFT JOIN b_history h ON l.case_id = h.case_id")
def _(t):
    return IO.history_of(t("b_labels"), t("b_history"))
