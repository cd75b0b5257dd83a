"""Contamination scan: does a run's text show knowledge of the later fix?

strings: run_id, case_id, path (of the string in its document), text, and stage where it is known. keys:
case_id, ordinal, sha / number / cve. Identifiers are found by regular expressions and matched by equality
joins, a hit for each occurrence. Phrases
are exact eight-token windows of the discussion, joined by hash and text; what the reviewer was
shown is excluded. A string's windows are followed in order by position columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import SHINGLE
from .discussion import NOVEL, SKIP_SUFFIX, spans  # NOVEL: uncovered tokens that a matching window needs
from .scoring import count_if

HIT = ("run_id", "case_id", "kind", "path", "matched", "key_ref")
LEAST_SHA = 7


def _hit_columns(strings: DataFrame) -> list[str]:
    return [*HIT, *(["stage"] if "stage" in strings.columns else [])]


def scan_sha(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """Hex runs that are a prefix (7 or more) of a fixing commit, with the first such key; a hit an
    occurrence. Joined on the case and the first seven digits, which every match shares; the keys of
    one such head are one row, so occurrences stay apart without a grouping."""
    tok = strings.withColumn("matched", F.explode(S.sha_tokens(F.col("text")))).withColumn("low", F.lower("matched")).withColumn("head", F.substring("low", 1, LEAST_SHA))
    k = keys.select("case_id", F.lower("sha").alias("sha"), "ordinal").where("sha is not null").withColumn("head", F.substring("sha", 1, LEAST_SHA))
    k = k.groupBy("case_id", "head").agg(F.array_sort(F.collect_set(F.struct("ordinal", "sha"))).alias("known"))
    first = F.get(F.filter("known", lambda x: F.startswith(x["sha"], F.col("low"))), F.lit(0))
    return tok.join(k, ["case_id", "head"]).withColumn("key_ref", first["sha"]).where("key_ref is not null").withColumn("kind", F.lit("sha")).select(*_hit_columns(strings))


def scan_pr(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """Pull-request references whose number, as text, is a key; a hit for each shape and occurrence,
    with the whole mention."""
    tok = strings.withColumn("m", F.explode(S.pr_mentions(F.col("text")))).withColumns({"number": F.col("m.number"), "matched": F.col("m.mention")})
    k = keys.select("case_id", F.col("number").cast("string").alias("number")).distinct()
    return tok.join(k, ["case_id", "number"]).withColumns({"kind": F.lit("pr"), "key_ref": F.col("number")}).select(*_hit_columns(strings))


def scan_cve(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """Every CVE is a hit; key_ref is `other` where it is no key of the case."""
    tok = strings.withColumn("matched", F.explode(S.cve_ids(F.col("text")))).withColumn("cve", F.upper("matched"))
    k = keys.select("case_id", F.upper("cve").alias("cve")).distinct().withColumn("known", F.col("cve"))
    return tok.join(k, ["case_id", "cve"], "left").withColumns({"kind": F.lit("cve"), "key_ref": F.coalesce("known", F.lit("other"))}).select(*_hit_columns(strings))


def windows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for every eight-token window of a text: keep..., pos (from 0), shingle, h (its hash)."""
    rows = df.select(*keep, F.posexplode(S.shingles(S.tokens(F.col(text)))).alias("pos", "shingle"))
    return rows.withColumn("h", F.xxhash64("shingle"))


def discussion_index(discussion: DataFrame, exclusion: DataFrame | None = None) -> DataFrame:
    """C4: window -> first source over the discussion bodies in order, without windows excluded for all
    runs (those that one run excludes go in novel_windows).
    discussion: source_pos, source, body (and case_id where keys differ by case)."""
    by = ["case_id"] if "case_id" in discussion.columns else []
    rows = windows(discussion, "body", *by, "source_pos", "source")
    if exclusion is not None:
        rows = rows.join(exclusion.where("run_id is null").select(*by, "h", "shingle").distinct(), [*by, "h", "shingle"], "left_anti")
    return rows.groupBy(*by, "h", "shingle").agg(F.min_by("source", F.struct("source_pos", "pos")).alias("source"))


def exclusion_shingles(shown: DataFrame, cited: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Windows of what a reviewer was shown: texts of the case, and the files of its snapshot that a run
    cites. What is shown counts for every run of the case (its run_id is null), a cited file only for the
    runs that cite it. A file is cut into windows once per case, whatever number of runs cite it.
    shown: case_id, text; cited: run_id, case_id, file; files: case_id, path, text."""
    out = windows(shown, "text", "case_id").select("case_id", F.lit(None).cast("long").alias("run_id"), "h", "shingle").distinct()
    if cited is not None and files is not None:
        c = cited.withColumn("path", S.clean_path(F.col("file"))).where(~F.startswith("path", F.lit("/")) & ~F.startswith("path", F.lit("../")) & (F.col("path") != "..")).select("run_id", "case_id", "path").distinct()
        w = windows(files.join(c, ["case_id", "path"], "left_semi"), "text", "case_id", "path").select("case_id", "path", "h", "shingle").distinct()
        out = out.unionByName(w.join(c, ["case_id", "path"]).select("case_id", "run_id", "h", "shingle").distinct())
    return out


def novel_windows(strings: DataFrame, index: DataFrame, exclusion: DataFrame | None = None) -> DataFrame:
    """Windows of the strings that the index holds and whose tokens are news: a token is covered
    if an excluded window covers it, and a window needs three uncovered tokens. Frames are only
    computed for strings with a match."""
    by = ["case_id"] if "case_id" in index.columns else []
    w = windows(strings.where(~F.endswith("path", F.lit(SKIP_SUFFIX))), "text", "run_id", "case_id", "path")
    hit = w.join(index, [*by, "h", "shingle"])
    if exclusion is None:
        return hit.select("run_id", "case_id", "path", "pos", "source")
    shown, own = exclusion.where("run_id is null").select(*by, "h", "shingle").distinct(), exclusion.where("run_id is not null").select("run_id", "h", "shingle").distinct()
    hit = hit.join(own, ["run_id", "h", "shingle"], "left_anti").select("run_id", "case_id", "path", "pos", "source")
    some = w.join(hit.select("run_id", "path").distinct(), ["run_id", "path"], "left_semi")
    marked = some.join(shown, [*by, "h", "shingle"], "left_semi").select("run_id", "path", "pos").unionByName(some.join(own, ["run_id", "h", "shingle"], "left_semi").select("run_id", "path", "pos"))
    cover = marked.select("run_id", "path", F.explode(F.sequence("pos", F.col("pos") + (SHINGLE - 1))).alias("token")).distinct()
    need = hit.select("run_id", "path", "pos", F.explode(F.sequence("pos", F.col("pos") + (SHINGLE - 1))).alias("token"))
    covered = need.join(cover, ["run_id", "path", "token"]).groupBy("run_id", "path", "pos").agg(F.count("*").alias("covered"))
    out = hit.join(covered, ["run_id", "path", "pos"], "left")
    return out.where(SHINGLE - F.coalesce("covered", F.lit(0)) >= NOVEL).drop("covered")


def discussion_spans(matches: DataFrame) -> DataFrame:
    """Maximal runs of consecutive matching windows, one hit a run, with the first window's source:
    first_pos, n_windows, n_tokens."""
    w = Window.partitionBy("run_id", "path").orderBy("pos")
    island = matches.withColumn("island", F.col("pos") - F.row_number().over(w))
    out = island.groupBy("run_id", "case_id", "path", "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_windows"), F.min_by("source", "pos").alias("source"))
    return out.withColumn("n_tokens", F.col("n_windows") + (SHINGLE - 1)).drop("island")


def span_hits(strings: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans as hits, with the tokens of the whole span as the matched text."""
    t = strings.select("run_id", "path", S.tokens(F.col("text")).alias("toks"))
    hit = spans.join(t, ["run_id", "path"])
    text = F.array_join(F.slice("toks", F.col("first_pos") + 1, F.col("n_tokens").cast("int")), " ")
    return hit.select("run_id", "case_id", F.lit("discussion").alias("kind"), "path", text.alias("matched"), F.col("source").alias("key_ref"))


def discussion_hits(found: DataFrame) -> DataFrame:
    """C7 as hits: the spans of discussion.matched(), and whether they were made without an exclusion."""
    rows = spans(found).withColumns({"kind": F.lit("discussion"), "key_ref": F.col("source")})
    return rows.select(*_hit_columns(found), "unexcluded")


def all_hits(identifiers: list[DataFrame], found: DataFrame) -> DataFrame:
    """Hits of all four rules; `unexcluded` is only set on those of the discussion."""
    out = discussion_hits(found)
    for df in identifiers:
        out = out.unionByName(df.withColumn("unexcluded", F.lit(False)))
    return out


def contamination_scan(runs: DataFrame, hits: DataFrame, keyed: DataFrame, exclusion_applied: bool | DataFrame = True, stages: DataFrame | None = None) -> DataFrame:
    """Run -> void and hit count; runs whose case has no keys are skipped, not clean. exclusion_applied:
    for all runs, or the cases (case_id) whose bundle was at hand; stages: (run_id, stage) that were read.
    The rules as applied stand beside: digits of a commit, tokens of a window, novel tokens."""
    n = hits.groupBy("run_id").agg(F.count("*").alias("n_hits"))
    out = runs.join(keyed.select("case_id").distinct().withColumn("has_keys", F.lit(True)), "case_id", "left").join(n, "run_id", "left")
    if isinstance(exclusion_applied, DataFrame):
        out = out.join(exclusion_applied.select("case_id").distinct().withColumn("bundled", F.lit(True)), "case_id", "left").withColumn("bundled", F.coalesce("bundled", F.lit(False)))
    else:
        out = out.withColumn("bundled", F.lit(exclusion_applied))
    if stages is not None:
        out = out.join(stages.groupBy("run_id").agg(F.array_sort(F.collect_set("stage")).alias("stages")), "run_id", "left")
    hits_ = F.coalesce("n_hits", F.lit(0))
    state = F.when(F.col("has_keys").isNull(), "skipped").when(hits_ > 0, "void").otherwise("clean")
    rules = [F.lit(LEAST_SHA).alias("sha_min_prefix"), F.lit(SHINGLE).alias("shingle_tokens"), F.lit(NOVEL).alias("min_novel_tokens")]
    seen = [F.array_join("stages", ",").alias("stages_scanned")] if stages is not None else []
    return out.select("run_id", "case_id", "arm", state.alias("state"), hits_.alias("n_hits"), F.col("bundled").alias("exclusion_applied"), *rules, *seen)


def contamination_summary(scans: DataFrame) -> DataFrame:
    """Scanned, voided and skipped runs per arm."""
    s = F.col("state")
    return scans.groupBy("arm").agg(count_if(s != "skipped").alias("scanned"), count_if(s == "void").alias("voided"), count_if(s == "skipped").alias("skipped"))


def void_kinds(hits: DataFrame) -> DataFrame:
    """The sorted distinct kinds of hits of each voided run."""
    return hits.groupBy("run_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def preflight_scan(inputs: DataFrame, shas: DataFrame, numbers: DataFrame, cves: DataFrame) -> DataFrame:
    """The identifier rules over what reviewers will be shown: metadata texts, and diffs without their
    header lines. inputs: case_id, path, text, is_diff."""
    text = F.when(F.col("is_diff"), S.strip_diff_headers(F.col("text"))).otherwise(F.col("text"))
    s = inputs.select(F.col("case_id").alias("run_id"), "case_id", "path", text.alias("text"))
    return scan_sha(s, shas).unionByName(scan_pr(s, numbers)).unionByName(scan_cve(s, cves)).drop("run_id")


def preflight_summary(cases: DataFrame, hits: DataFrame, keyed: DataFrame) -> DataFrame:
    """C11: cases by outcome: failed, passed, or unchecked for want of keys."""
    bad = hits.select("case_id").distinct().withColumn("bad", F.lit(True))
    has = keyed.select("case_id").distinct().withColumn("has", F.lit(True))
    state = F.when(F.col("has").isNull(), "unchecked").when(F.col("bad"), "failed").otherwise("passed")
    return cases.select("case_id").join(has, "case_id", "left").join(bad, "case_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def probe_scan(answers: DataFrame, shas: DataFrame, numbers: DataFrame, cves: DataFrame) -> DataFrame:
    """The identifier rules over non-empty model answers. answers: case_id, probe, answer."""
    s = answers.where("coalesce(answer, '') <> ''").select(F.col("case_id").alias("run_id"), "case_id", F.col("probe").alias("path"), F.col("answer").alias("text"))
    return scan_sha(s, shas).unionByName(scan_pr(s, numbers)).unionByName(scan_cve(s, cves)).drop("run_id")


def probe_decide(cases: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Void by a mechanical hit, then void by the evaluator, then unresolved without a verdict, then
    clear. verdicts: case_id, hit."""
    kinds = hits.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    out = cases.select("case_id").join(kinds, "case_id", "left").join(verdicts.groupBy("case_id").agg(F.max("hit").alias("hit")), "case_id", "left")
    state = F.when(F.col("kinds").isNotNull(), "void").when(F.col("hit"), "void").when(F.col("hit").isNull(), "unresolved").otherwise("clear")
    return out.select("case_id", state.alias("state"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def gate_coverage(cases: DataFrame, gate: DataFrame) -> DataFrame:
    """C14: cases that the gate does not state, or states otherwise than clean, void or unresolved.
    gate: case_id, state."""
    out = cases.select("case_id").join(gate, "case_id", "left")
    rule = F.when(F.col("state").isNull(), "missing").when(~F.col("state").isin("clean", "void", "unresolved"), "malformed")
    return out.withColumn("rule", rule).where("rule is not null").select("case_id", "rule", F.coalesce("state", F.lit("")).alias("detail"))
