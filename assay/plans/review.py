"""Queries of evidence tiers, mechanism agreement and bundle admissibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admissibility as V
from ..operators import agreement as J
from ..operators import checks as R
from ..operators import evidence as O
from ..operators.scoring import case_verdict
from .common import query
from .text import OPAQUE
from .verdicts import VERDICT, scored

TIERS = "(VALUES ('strong', 3), ('strong+medium', 2), ('all', 1)) x(threshold, least)"


@query("o1_path_evidence", "SELECT case_id, path, max(tier) AS tier, string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS signal_types, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (tier = 2), '') AS symbols, CASE WHEN case_id % 2 = 0 THEN max(overlap) % 10 END AS overlap FROM b_signals GROUP BY case_id, path UNION ALL SELECT case_id, 'only/overlap.c', 0, NULL, NULL, 1 FROM b_signals WHERE case_id % 10 = 0")
def _(t):
    s = t("b_signals")
    twice = F.inline(F.array(F.struct(F.lit(0).alias("pos"), "overlap"), F.struct(F.lit(1).alias("pos"), (F.col("overlap") % 10).alias("overlap"))))
    o = s.where("case_id % 2 = 0").select("case_id", "path", twice)  # the later of two overlaps counts, not the greater
    o = o.unionByName(s.where("case_id % 10 = 0").select("case_id", F.lit("only/overlap.c").alias("path"), F.lit(7).alias("pos"), F.lit(1).alias("overlap")))
    out = O.path_evidence(s, o)
    return out.select("case_id", "path", "tier", F.array_join("signal_types", ",").alias("signal_types"), F.array_join("symbols", ",").alias("symbols"), "overlap")


STRENGTH = "st AS (SELECT l.case_id, CASE l.case_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MID' END AS category, coalesce(max(tier), 0) AS max_tier FROM b_labels l LEFT JOIN b_signals s ON l.case_id = s.case_id GROUP BY l.case_id)"


def _strength(t) -> DataFrame:
    c = F.when(F.col("case_id") % 3 == 0, "HIGH").when(F.col("case_id") % 3 == 1, "LOW").otherwise("MID")
    return O.case_strength(t("b_signals"), t("b_labels").select("case_id", c.alias("category")))


@query("o2_case_strength", f"WITH {STRENGTH} SELECT case_id, category, max_tier, (category = 'HIGH' AND max_tier = 0) OR (max_tier = 3 AND category = 'LOW') AS conflict FROM st")
def _(t):
    return _strength(t)


CITED = "cited AS (SELECT case_id, arm, concat(CAST(f.run_id AS VARCHAR), ':', CAST(pos AS VARCHAR)) AS finding, file FROM b_findings f JOIN b_runs r ON f.run_id = r.run_id), ev AS (SELECT case_id, path, max(tier) AS tier FROM b_signals GROUP BY case_id, path), top AS (SELECT case_id, max(tier) AS max_tier FROM ev GROUP BY case_id)"


def _cited(t) -> DataFrame:
    f = t("b_findings").join(t("b_runs"), "run_id")
    return f.select("case_id", "arm", F.concat_ws(":", "run_id", "pos").alias("finding"), "file")


@query("o3_tier_matches", f"WITH {CITED} SELECT cited.case_id, finding, threshold, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM cited JOIN ev ON cited.case_id = ev.case_id AND file = path JOIN {TIERS} ON tier >= least GROUP BY cited.case_id, finding, threshold")
def _(t):
    return O.tier_matches(_cited(t), O.path_evidence(t("b_signals"))).withColumn("files", F.array_join("files", ","))


@query("o4_tier_sensitivity", f"WITH {CITED}, r AS (SELECT threshold, arm, coalesce(max_tier >= least, FALSE) AS ok, coalesce(tier >= least, FALSE) AS hit FROM cited JOIN {TIERS} ON TRUE LEFT JOIN top ON cited.case_id = top.case_id LEFT JOIN ev ON cited.case_id = ev.case_id AND file = path) SELECT threshold, arm, count(*) AS findings, count(*) FILTER (ok) AS scoreable, count(*) FILTER (hit) AS hits, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS of_all, round(coalesce(100.0 * count(*) FILTER (hit) / nullif(count(*) FILTER (ok), 0), 0), 6) AS of_scoreable FROM r GROUP BY GROUPING SETS ((threshold, arm), (threshold))")
def _(t):
    out = O.tier_sensitivity(_cited(t), O.path_evidence(t("b_signals")))
    return out.select("threshold", "arm", "findings", "scoreable", "hits", F.round("of_all", 6).alias("of_all"), F.round("of_scoreable", 6).alias("of_scoreable"))


@query("o5_strong_refs", "SELECT DISTINCT case_id, left(concat(md5(symbol), md5(path)), 40) AS source_ref, left(md5(symbol), 12) AS fix_id FROM b_signals WHERE tier = 3 AND case_id % 2 = 0")
def _(t):
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    ref = F.substring(F.concat(md5("symbol"), md5("path")), F.lit(1), F.when(F.col("case_id") % 2 == 0, 40).otherwise(39))
    return O.strong_refs(t("b_signals").withColumn("source_ref", ref))


# --- agreement ----------------------------------------------------------------------------

POOL = f"pool AS (SELECT r.case_id, r.arm, f.run_id, f.pos, file, agreement, fix_id, b_disp, c_disp, partkey, suppkey, {OPAQUE.replace('run_id', 'f.run_id')} AS opaque_id FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id WHERE b_disp IS NOT NULL AND status = 'completed')"


def _pool(t) -> DataFrame:
    return J.pool_findings(t("b_all_runs"), t("b_findings"))


@query("j1_pool_findings", f"WITH {POOL} SELECT opaque_id, case_id, arm, file FROM pool")
def _(t):
    return _pool(t).select("opaque_id", "case_id", "arm", "file")


@query("j2_anticipation", f"WITH {POOL}, a AS (SELECT arm, count(*) FILTER (agreement = 'MECHANISM') AS mechanism, count(*) FILTER (agreement = 'LOCALITY_ONLY') AS locality_only, count(*) FILTER (agreement = 'NONE') AS none, count(*) FILTER (agreement = 'TOO_VAGUE') AS too_vague FROM pool GROUP BY ROLLUP (arm)) SELECT *, round(100.0 * mechanism / (mechanism + locality_only + none), 6) AS anticipated, round(100.0 * too_vague / (mechanism + locality_only + none + too_vague), 6) AS vague, round(100.0 * locality_only / (mechanism + locality_only), 6) AS locality FROM a")
def _(t):
    out = J.anticipation(_pool(t))
    return out.select("arm", "mechanism", "locality_only", "none", "too_vague", *[F.round(c, 6).alias(c) for c in ("anticipated", "vague", "locality")])


HIT = f"{POOL}, hit AS (SELECT DISTINCT p.case_id, p.arm, p.fix_id FROM pool p JOIN b_fixes x ON p.case_id = x.case_id AND p.fix_id = x.fix_id WHERE agreement = 'MECHANISM')"


@query("j3_fix_recall", f"WITH {HIT}, n AS (SELECT count(*) AS fixes FROM b_fixes), c AS (SELECT arm, count(*) AS covered FROM hit GROUP BY arm UNION ALL SELECT NULL, count(*) FROM (SELECT DISTINCT case_id, fix_id FROM hit) UNION ALL SELECT 'X', 0) SELECT arm, fixes, covered, round(100.0 * covered / fixes, 6) AS recall FROM c JOIN n ON TRUE")
def _(t):
    return J.fix_recall(t("b_fixes"), _pool(t), ["T", "G", "X"]).select("arm", "fixes", "covered", F.round("recall", 6).alias("recall"))


@query("j4_unattributed", f"WITH {POOL} SELECT opaque_id FROM pool WHERE partkey % 31 = 0")
def _(t):
    p = _pool(t)
    return J.unattributed(p, p.where("partkey % 31 <> 0")).select("opaque_id")


@query("j4_missing_verdicts", f"WITH {POOL} SELECT opaque_id, case_id FROM pool WHERE partkey % 37 = 0")
def _(t):
    return J.missing_verdicts(_pool(t), _pool(t).where("partkey % 37 <> 0")).select("opaque_id", "case_id")


@query("j5_excluded_cases", f"WITH {POOL}, {STRENGTH}, n AS (SELECT case_id, count(*) AS n FROM pool GROUP BY case_id) SELECT st.case_id, max_tier, coalesce(n, 0) AS n_findings FROM st LEFT JOIN n ON st.case_id = n.case_id WHERE max_tier < 3")
def _(t):
    return J.excluded_cases(_strength(t), _pool(t))


@query("j6_locality_ratio", "SELECT severity, round(100.0 * count(*) FILTER (agreement = 'LOCALITY_ONLY') / nullif(count(*) FILTER (agreement IN ('LOCALITY_ONLY', 'MECHANISM')), 0), 6) AS ratio FROM b_findings GROUP BY severity")
def _(t):
    n = lambda a: F.sum((F.col("agreement") == a).cast("long"))
    return t("b_findings").groupBy("severity").agg(F.round(J.locality_ratio(n("MECHANISM"), n("LOCALITY_ONLY")), 6).alias("ratio"))


@query("j7_eligible_primaries", f"WITH {VERDICT} SELECT v.case_id, arm, run_id, primary_pos FROM v JOIN b_labels l ON v.case_id = l.case_id WHERE risky AND label = 'positive' AND (arm = 'T' OR primary_file <> 'src/p7.c')")
def _(t):
    blank = F.when(F.col("file") != "src/p7.c", F.concat(F.lit("in "), "file")).otherwise("  ")
    runs, findings, assessments = scored(t)
    v = case_verdict(runs, findings.withColumn("mechanism", blank), assessments).withColumnRenamed("primary_mechanism", "mechanism")
    return J.eligible_primaries(v, t("b_labels")).select("case_id", "arm", "run_id", "primary_pos")


@query("j8_reason_match", f"WITH {POOL}, k AS (SELECT arm, CASE WHEN partkey % 41 = 0 THEN 'NONE' ELSE agreement END AS a FROM pool WHERE case_id % 19 <> 0 AND run_id % 17 <> 0) SELECT arm, count(*) AS judged, count(*) FILTER (a = 'MECHANISM') AS mechanism, count(*) FILTER (a = 'LOCALITY_ONLY') AS locality_only, count(*) FILTER (a = 'NONE') AS none, count(*) FILTER (a = 'TOO_VAGUE') AS too_vague, count(*) FILTER (a = 'MECHANISM') / count(*) AS rate FROM k GROUP BY arm")
def _(t):
    j = _pool(t).withColumn("agreement", F.when(F.col("partkey") % 41 == 0, "UNHEARD_OF").otherwise(F.col("agreement")))
    return J.reason_match(j, t("b_labels").where("case_id % 19 = 0"), t("b_all_runs").where("run_id % 17 = 0"))


@query("j8_void_reasons", f"WITH {POOL} SELECT DISTINCT arm, case_id, CASE WHEN case_id % 19 = 0 THEN 'probe' ELSE 'scan' END AS reason FROM pool WHERE case_id % 19 = 0 OR run_id % 17 = 0")
def _(t):
    return J.void_reasons(_pool(t), t("b_labels").where("case_id % 19 = 0"), t("b_all_runs").where("run_id % 17 = 0"))


CLASS = "cls AS (SELECT f.run_id, pos, r.arm, r.case_id, label = 'negative' AS negative, c_disp, b_disp IS NULL AS new_by_stage3, coalesce(c_disp, '') NOT IN ('REJECTED', 'INCONCLUSIVE') AS s FROM b_findings f JOIN b_all_runs r ON f.run_id = r.run_id JOIN b_labels l ON r.case_id = l.case_id WHERE status = 'completed')"


def _class(t) -> DataFrame:
    return J.classify_findings(t("b_all_runs"), t("b_findings"), t("b_labels"))


@query("j9_classify_findings", f"WITH {CLASS} SELECT run_id, pos, arm, case_id, negative, c_disp, new_by_stage3 FROM cls")
def _(t):
    return _class(t)


SPEC = f"{CLASS}, x AS (SELECT cls.*, w.with_new FROM cls JOIN (VALUES (TRUE), (FALSE)) w(with_new) ON with_new OR NOT new_by_stage3), sp AS (SELECT arm, with_new, count(*) FILTER (negative) AS neg_findings, count(*) FILTER (negative AND s) AS neg_survived, count(*) FILTER (NOT negative) AS pos_findings, count(*) FILTER (NOT negative AND s) AS pos_survived FROM x GROUP BY GROUPING SETS ((arm, with_new), (with_new)))"


@query("j10_specificity", f"WITH {SPEC}, u AS (SELECT count(*) FILTER (label = 'negative') AS neg_cases, count(*) FILTER (label = 'positive') AS pos_cases FROM b_labels) SELECT arm, with_new, neg_findings, neg_survived, pos_findings, pos_survived, neg_cases, pos_cases, round(100.0 * (neg_findings - neg_survived) / neg_findings, 6) AS neg_suppressed, round(100.0 * (pos_findings - pos_survived) / pos_findings, 6) AS pos_suppressed, round(neg_survived / neg_cases, 9) AS neg_per_case, round(pos_survived / pos_cases, 9) AS pos_per_case FROM sp JOIN u ON TRUE")
def _(t):
    out = J.specificity(_class(t), t("b_labels").select("case_id", (F.col("label") == "negative").alias("negative")))
    return out.withColumns({c: F.round(c, 6) for c in ("neg_suppressed", "pos_suppressed")}).withColumns({c: F.round(c, 9) for c in ("neg_per_case", "pos_per_case")})


STATS = f"{CLASS}, pr AS (SELECT arm, case_id, negative, count(*) AS findings, count(*) FILTER (NOT s) AS suppressed, count(*) FILTER (NOT s) / count(*) AS rate FROM cls WHERE NOT new_by_stage3 GROUP BY arm, case_id, negative)"


@query("j11_pr_stats", f"WITH {STATS} SELECT arm, case_id, negative, findings, suppressed, round(rate, 9) AS rate FROM pr")
def _(t):
    return J.pr_stats(_class(t)).withColumn("rate", F.round("rate", 9))


@query("j11_gap", f"WITH {STATS} SELECT arm, round(avg(rate) FILTER (negative) - avg(rate) FILTER (NOT negative), 9) AS gap FROM pr GROUP BY arm")
def _(t):
    return J.gap(J.pr_stats(_class(t))).withColumn("gap", F.round("gap", 9))


@query("j12_pr_permutation")
def _(t):
    return J.pr_permutation(J.pr_stats(_class(t)))


#: Ten cases an arm: every way to label as many of them clean, one by one.
SMALL = f"""{{stats}}, c AS (SELECT concat(arm, CAST(CAST(floor(case_id / 10) AS BIGINT) AS VARCHAR)) AS cohort, case_id, rate, negative FROM pr), i AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY case_id, rate) - 1 AS i FROM c),
  n AS (SELECT cohort, count(*) AS n, count(*) FILTER (negative) AS k, sum(rate) AS total, sum(rate) FILTER (negative) AS seen FROM c GROUP BY cohort), mixed AS (SELECT * FROM n WHERE k > 0 AND k < n),
  masks AS (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM mixed), picked AS (SELECT masks.cohort, mask, n, k, total, seen, sum(rate) AS s FROM masks JOIN i ON i.cohort = masks.cohort WHERE (mask >> i) & 1 = 1 AND bit_count(mask) = k GROUP BY ALL),
  g AS (SELECT cohort, s / k - (total - s) / (n - k) AS g, seen / k - (total - seen) / (n - k) AS obs FROM picked)"""


@query("j12_small_cohorts", f"WITH {SMALL.format(stats=STATS)} SELECT cohort, round(obs, 9) AS gap, round(count(*) FILTER (g >= obs - 1e-9) / count(*), 7) AS p1, round(count(*) FILTER (abs(g) >= abs(obs) - 1e-9) / count(*), 7) AS p2, 'exact' AS method FROM g GROUP BY cohort, obs UNION ALL SELECT cohort, 0, 1, 1, 'degenerate' FROM n WHERE k = 0 OR k = n")
def _(t):
    stats = J.pr_stats(_class(t)).withColumn("cohort", F.concat("arm", F.floor(F.col("case_id") / 10).cast("string")))
    return J.cohort_permutation(stats, "cohort").select("cohort", F.round("gap", 9).alias("gap"), F.round("p1", 7).alias("p1"), F.round("p2", 7).alias("p2"), "method")


@query("j13_finding_fisher", f"WITH {CLASS}, q AS (SELECT arm, count(*) FILTER (negative AND NOT s) AS a, count(*) FILTER (negative AND s) AS b, count(*) FILTER (NOT negative AND NOT s) AS c, count(*) FILTER (NOT negative AND s) AS d FROM cls WHERE NOT new_by_stage3 GROUP BY arm), k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM q), z AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1))) AS p FROM k), h AS (SELECT *, max(p) FILTER (x = a) OVER (PARTITION BY arm) AS here FROM z) SELECT arm, a, b, c, d, round(least(1, sum(p) FILTER (p <= here * (1 + 1e-9))), 6) AS p FROM h GROUP BY arm, a, b, c, d")
def _(t):
    return J.finding_fisher(_class(t)).withColumn("p", F.round("p", 6))


@query("j14_small_cell_flag", f"WITH {SPEC} SELECT arm, with_new, neg_survived < 5 OR pos_survived < 5 AS small_cell, round(pos_survived / nullif(neg_survived, 0), 9) AS ratio FROM sp")
def _(t):
    spec = J.specificity(_class(t), t("b_labels").select("case_id", (F.col("label") == "negative").alias("negative")))
    return J.small_cell_flag(spec).select("arm", "with_new", "small_cell", F.round("ratio", 9).alias("ratio"))


@query("j15_disposition_by_agreement", f'WITH {POOL} SELECT b_disp, count(*) FILTER (agreement = \'MECHANISM\') AS "MECHANISM", count(*) FILTER (agreement = \'LOCALITY_ONLY\') AS "LOCALITY_ONLY", count(*) FILTER (agreement = \'NONE\') AS "NONE", count(*) FILTER (agreement = \'TOO_VAGUE\') AS "TOO_VAGUE" FROM pool GROUP BY b_disp')
def _(t):
    return J.disposition_by_agreement(_pool(t))


@query("j16_arm_complementarity", f"WITH {HIT}, p AS (SELECT case_id, fix_id, count(*) AS k FROM hit GROUP BY case_id, fix_id) SELECT sum(k)::BIGINT AS sum_of_arms, count(*) AS union_of_arms, count(*) FILTER (k > 1) AS overlap, (SELECT max(n) FROM (SELECT count(*) AS n FROM hit GROUP BY arm)) AS best_arm FROM p")
def _(t):
    return J.arm_complementarity(t("b_fixes"), _pool(t))


TWO = "CASE (partkey + 2 * suppkey) % 4 WHEN 0 THEN 'MECHANISM' WHEN 1 THEN 'LOCALITY_ONLY' WHEN 2 THEN 'NONE' ELSE 'TOO_VAGUE' END"


@query("j17_design_agreement", f"WITH {POOL}, d AS (SELECT agreement = 'MECHANISM' AS x, {TWO} = 'MECHANISM' AS y FROM pool) SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_one, count(*) FILTER (y AND NOT x) AS only_two, count(*) FILTER (x AND y) / count(*) FILTER (x OR y) AS jaccard FROM d")
def _(t):
    p = _pool(t)
    return J.design_agreement(p, p.withColumn("agreement", F.expr(TWO)))


@query("j17_transitions", f'WITH {POOL} SELECT agreement AS "from", {TWO} AS "to", count(*) AS n FROM pool GROUP BY 1, 2')
def _(t):
    p = _pool(t)
    return J.transitions(p, p.withColumn("agreement", F.expr(TWO)))


@query("r9_opaque_check", f"WITH {POOL} SELECT run_id, pos FROM pool WHERE partkey % 43 = 0 OR contains(opaque_id, lower(arm)) OR contains(opaque_id, CAST(run_id AS VARCHAR))")
def _(t):
    bad = _pool(t).withColumn("opaque_id", F.when(F.col("partkey") % 43 == 0, F.concat(F.lit("x"), "opaque_id")).otherwise(F.col("opaque_id")))
    return R.opaque_check(bad).select("run_id", "pos")


# --- admissibility: a file for each part, its case the part's size ----------------------------

PATHS = "CASE p_partkey % 12 WHEN 0 THEN 'reviewer/diff.patch' WHEN 1 THEN 'reviewer/metadata.json' WHEN 2 THEN concat('reviewer/extra', CAST(p_partkey AS VARCHAR), '/x') WHEN 3 THEN concat('reviewer/repository/a/.git/', CAST(p_partkey AS VARCHAR)) WHEN 4 THEN concat('reviewer/repository/b', CAST(p_partkey AS VARCHAR), '/HEAD') WHEN 5 THEN concat('reviewer/repository/o', CAST(p_partkey AS VARCHAR), '/Oracle.json') WHEN 6 THEN concat('reviewer/repository/oracle_dialect', CAST(p_partkey AS VARCHAR), '.go') WHEN 7 THEN concat('reviewer/repository/x/my_answer_key_', CAST(p_partkey AS VARCHAR)) WHEN 8 THEN concat('reviewer/Solution', CAST(p_partkey AS VARCHAR)) ELSE concat('reviewer/repository/src/f', CAST(p_partkey AS VARCHAR), '.c') END"
FILES = f"files AS (SELECT p_size AS case_id, p_partkey AS k, {PATHS} AS path FROM part)"


def _files(t) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 12 == 9, "symlink").when(F.col("p_partkey") % 12 == 10, F.when(F.col("p_partkey") % 5 == 0, "socket").otherwise("file")).otherwise("file")
    target = F.when(F.col("p_partkey") % 4 == 1, "/etc/passwd").when(F.col("p_partkey") % 5 == 1, "../../../x").when(F.col("p_partkey") % 5 == 2, "none.c").when(F.col("p_partkey") % 5 == 3, "..").otherwise(F.concat(F.lit("./f"), F.col("p_partkey").cast("string"), F.lit(".c")))
    return t("part").select(F.col("p_size").alias("case_id"), F.col("p_partkey").alias("k"), F.expr(PATHS.replace("VARCHAR", "STRING")).alias("path"), kind.alias("kind"), target.alias("link_target"))


V1 = "SELECT DISTINCT case_id, 'allowed-paths' AS rule, concat('reviewer/', string_split(path, '/')[2]) AS path, 'entry is not allowed' AS detail FROM files WHERE string_split(path, '/')[2] NOT IN ('repository', 'diff.patch', 'metadata.json')"
V2 = "SELECT DISTINCT case_id, 'no-git-metadata' AS rule, CASE k % 12 WHEN 3 THEN 'reviewer/repository/a/.git' ELSE path END AS path, CASE k % 12 WHEN 3 THEN '.git' ELSE 'HEAD' END AS detail FROM files WHERE k % 12 IN (3, 4)"
V3 = "SELECT DISTINCT case_id, 'oracle-shaped' AS rule, path, CASE k % 12 WHEN 5 THEN 'oracle.json' WHEN 7 THEN 'answer_key' ELSE 'solution' END AS detail FROM files WHERE k % 12 IN (5, 7, 8)"


@query("v1_reviewer_allowlist", f"WITH {FILES} {V1}")
def _(t):
    return V.reviewer_allowlist(_files(t))


@query("v2_git_metadata_names", f"WITH {FILES} {V2}")
def _(t):
    return V.git_metadata_names(_files(t))


@query("v3_oracle_shaped_paths", f"WITH {FILES} {V3}")
def _(t):
    return V.oracle_shaped_paths(_files(t))


V4 = "SELECT case_id, 'no-irregular-files' AS rule, path, CASE WHEN k % 12 = 10 THEN 'socket' WHEN k % 4 = 1 THEN 'absolute target' WHEN k % 5 = 1 THEN 'escapes the snapshot' WHEN k % 5 = 2 THEN 'target does not exist' ELSE 'target is a link' END AS detail FROM files WHERE (k % 12 = 10 AND k % 5 = 0) OR (k % 12 = 9 AND (k % 4 = 1 OR k % 5 <> 3))"


@query("v4_link_containment", f"WITH {FILES} {V4}")
def _(t):
    return V.link_containment(_files(t))


def _metadata(t) -> DataFrame:
    """Metadata JSON of every part: fields that are fine, not allowed, null, of a wrong type, telling."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat(F.lit("Fix it, REVERTED later "), k.cast("string"))).otherwise(F.concat(F.lit("see #"), k.cast("string"), F.lit(" for the solution")))
    text = F.to_json(F.struct(F.when(k % 2 == 0, "reviewer-metadata/v2").otherwise("reviewer-metadata/v1").alias("schema_version"), title.alias("title"), F.array("p_type").alias("commit_messages"), F.when(k % 5 == 0, k).alias("merged_at"), F.when(k % 7 == 0, F.array(k)).alias("base_branch")))
    return t("part").select(k.alias("case_id"), text.alias("json"))


@query("v5_metadata_fields", "SELECT p_partkey AS case_id, 'metadata-fields' AS rule, 'title' AS path, 'reverted' AS detail FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'metadata-fields', 'merged_at', 'not allowed' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'metadata-fields', 'base_branch', 'not a string' FROM part WHERE p_partkey % 7 = 0")
def _(t):
    return V.metadata_fields(V.metadata_entries(_metadata(t)))


@query("v6_metadata_identifiers", "SELECT p_partkey AS case_id, 'title' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'warning' ELSE 'violation' END AS level, 'pr' AS kind, concat('#', CAST(p_partkey AS VARCHAR)) AS matched FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    versions = t("part").select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_partkey") % 2 == 0, "reviewer-metadata/v2").otherwise("reviewer-metadata/v1").alias("version"))
    return V.metadata_identifiers(V.metadata_entries(_metadata(t)), versions)


@query("v6_metadata_vocabulary", "SELECT p_partkey AS case_id, 'title' AS path, 'warning' AS level, 'solution' AS fragment, concat('see #', CAST(p_partkey AS VARCHAR), ' for the solution') AS excerpt FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    return V.metadata_vocabulary(V.metadata_entries(_metadata(t)))


@query("v7_checksum_reconcile", "SELECT p_size AS case_id, 'checksums' AS rule, concat('f', CAST(p_partkey AS VARCHAR)) AS path, CASE p_partkey % 6 WHEN 0 THEN 'not listed' WHEN 1 THEN 'missing' WHEN 2 THEN 'digest differs' ELSE 'malformed line' END AS detail FROM part WHERE p_partkey % 6 IN (0, 1, 2) OR p_partkey % 18 = 5 UNION ALL SELECT p_size, 'checksums', concat('f', CAST(p_partkey AS VARCHAR)), 'not listed' FROM part WHERE p_partkey % 18 = 5")
def _(t):
    k = F.col("p_partkey")
    base = t("part").select(F.col("p_size").alias("case_id"), F.concat(F.lit("f"), k.cast("string")).alias("path"), F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"), k.alias("k"))
    manifest = base.where("k % 6 <> 0").select("case_id", "path", F.when(F.col("k") % 6 == 2, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"), (F.col("k") % 18 == 5).alias("malformed"))
    return V.checksum_reconcile(base.where("k % 6 <> 1").select("case_id", "path", "digest"), manifest)


@query("v8_pinned_schemas", "SELECT p_partkey AS case_id, 'pinned-schemas' AS rule, CASE WHEN p_partkey % 4 = 0 THEN 'reviewer-metadata/v3' ELSE 'reviewer-metadata/v1' END AS path, CASE WHEN p_partkey % 4 = 0 THEN 'metadata version' ELSE 'manifest version' END AS detail FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 9 = 0")
def _(t):
    k = F.col("p_partkey")
    return V.pinned_schemas(t("part").select(k.alias("case_id"), F.when(k % 4 == 0, "reviewer-metadata/v3").otherwise("reviewer-metadata/v1").alias("version"), F.when(k % 9 == 0, "other/v1").otherwise(V.MANIFEST_VERSION).alias("manifest")))


BOUNDARY = f"{FILES}, vio AS ({V1} UNION ALL {V2} UNION ALL ({V3} AND k % 24 <> 8)), rules(ord, rule) AS (VALUES (0, 'allowed-paths'), (1, 'no-irregular-files'), (2, 'no-git-metadata'), (3, 'oracle-shaped'), (4, 'metadata-fields'), (5, 'checksums'), (6, 'pinned-schemas')), rep AS (SELECT c.case_id, ord, r.rule, count(v.rule) AS violation_count FROM (SELECT DISTINCT case_id FROM files) c JOIN rules r ON TRUE LEFT JOIN vio v ON v.case_id = c.case_id AND v.rule = r.rule GROUP BY c.case_id, ord, r.rule)"


def _report(t) -> DataFrame:
    f = _files(t)
    found = V.reviewer_allowlist(f).unionByName(V.git_metadata_names(f)).unionByName(V.oracle_shaped_paths(f))
    return V.boundary_report(f.select("case_id").distinct(), found, f.where("k % 24 = 8").select("case_id", "path"))


@query("v9_boundary_report", f"WITH {BOUNDARY} SELECT case_id, ord, rule, violation_count, CASE WHEN violation_count > 0 THEN 'fail' ELSE 'pass' END AS result FROM rep")
def _(t):
    return _report(t)


@query("v9_case_result", f"WITH {BOUNDARY} SELECT case_id, sum(violation_count) = 0 AS admissible FROM rep GROUP BY case_id")
def _(t):
    return V.case_result(_report(t))
