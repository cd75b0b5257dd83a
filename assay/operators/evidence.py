"""Evidence tiers and path correspondence.

signals: case_id, path (null where the signal names none), tier (1 weak, 2 medium, 3 strong), signal_type,
symbol; overlaps: case_id, path, overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent
from .scoring import count_if

# The thresholds findings are matched at, by the least tier each admits.
THRESHOLDS = {"strong": 3, "strong+medium": 2, "all": 1}


def path_evidence(signals: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """O1: per case and path the strongest tier, sorted distinct signal types and symbols; a medium
    signal without a path stands under its symbol; a path only an overlap names has tier 0. Of several
    overlaps of a path the last one counts (by pos, where overlaps have it)."""
    key = F.coalesce(F.nullif("path", F.lit("")), F.when(F.col("tier") == 2, F.nullif("symbol", F.lit(""))))
    set_of = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
    out = signals.withColumn("path", key).where("path is not null").groupBy("case_id", "path").agg(F.max("tier").alias("tier"), set_of("signal_type").alias("signal_types"), set_of(F.when(F.col("tier") == 2, F.col("symbol"))).alias("symbols"))
    if overlaps is not None:
        o = overlaps.where("coalesce(path, '') <> ''").groupBy("case_id", "path").agg((F.max_by("overlap", "pos") if "pos" in overlaps.columns else F.max("overlap")).alias("overlap"))
        out = out.join(o, ["case_id", "path"], "full_outer").withColumn("tier", F.coalesce("tier", F.lit(0)))
    return out


def case_strength(signals: DataFrame, heuristic: DataFrame) -> DataFrame:
    """O2: the strongest tier of a case (signals of a named type count without a path too), and
    whether it contradicts the heuristic: HIGH without evidence, or strong evidence and LOW.
    heuristic: case_id, category."""
    top = signals.where("coalesce(path, '') <> '' or coalesce(signal_type, '') <> ''").groupBy("case_id").agg(F.max("tier").alias("max_tier"))
    out = heuristic.join(top, "case_id", "left").withColumn("max_tier", F.coalesce("max_tier", F.lit(0)))
    t, c = F.col("max_tier"), F.col("category")
    return out.withColumn("conflict", ((c == "HIGH") & (t == 0)) | ((t == 3) & (c == "LOW")))


def tier_matches(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """O3: per finding and threshold the cited files at or above its tier. cited: case_id, finding, file."""
    hit = cited.join(evidence.select("case_id", F.col("path").alias("file"), "tier"), ["case_id", "file"])
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(v).alias("least")) for k, v in THRESHOLDS.items()]))
    rows = hit.withColumn("at", at).where(F.col("tier") >= F.col("at.least"))
    return rows.groupBy("case_id", "finding", F.col("at.threshold").alias("threshold")).agg(F.array_sort(F.collect_set("file")).alias("files"))


def tier_sensitivity(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings hit, over all findings and over those in cases with evidence of the tier, per
    threshold, overall (null arm) and per arm. cited: case_id, arm, finding, file."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(v).alias("least")) for k, v in THRESHOLDS.items()]))
    every = cited.select("case_id", "arm", "finding").distinct().withColumn("at", at).select("case_id", "arm", "finding", "at.threshold", "at.least")
    scoreable = evidence.groupBy("case_id").agg(F.max("tier").alias("max_tier"))
    hits = tier_matches(cited, evidence).select("case_id", "finding", "threshold").withColumn("hit", F.lit(True))
    rows = every.join(scoreable, "case_id", "left").join(hits, ["case_id", "finding", "threshold"], "left")
    ok, hit = F.coalesce(F.col("max_tier") >= F.col("least"), F.lit(False)), F.coalesce("hit", F.lit(False))
    both = rows.withColumns({"ok": ok, "hit": hit}).withColumn("g", F.explode(F.array(F.struct(F.lit(None).cast("string").alias("arm")), F.struct(F.col("arm")))))
    out = both.groupBy("threshold", F.col("g.arm").alias("arm")).agg(F.count("*").alias("findings"), count_if(F.col("ok")).alias("scoreable"), count_if(F.col("hit")).alias("hits"))
    return out.withColumns({"of_all": percent(F.col("hits"), F.col("findings")), "of_scoreable": percent(F.col("hits"), F.col("scoreable"))})


def strong_refs(signals: DataFrame) -> DataFrame:
    """Distinct 40-character references of strong signals per case, with their 12-character id.
    signals: case_id, tier, source_ref."""
    return signals.where("tier = 3 and length(source_ref) = 40").select("case_id", "source_ref", F.substring("source_ref", 1, 12).alias("fix_id")).distinct()
