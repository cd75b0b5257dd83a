"""Queries of the text functions and the contamination scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import leaves as L
from ..functions import scalars as S
from ..operators import contamination as C
from ..operators import discussion as D
from ..operators.scoring import count_if
from ..operators.cohort import with_strata
from .common import query
from .verdicts import STRATA, _labels

TOKS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query("p1_string_leaves", "SELECT run_id, concat('$.findings[', CAST(pos AS VARCHAR), '].', k) AS path, CASE k WHEN 'file' THEN file ELSE severity END AS value FROM b_findings, (VALUES ('file'), ('severity')) v(k)")
def _(t):
    docs = t("b_findings").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "severity", "file"))).alias("findings"))
    docs = docs.select("run_id", F.struct(F.transform("findings", lambda x: F.struct(x["severity"].alias("severity"), x["file"].alias("file"))).alias("findings")).alias("doc"))
    return L.string_leaves(docs, "doc", "run_id")


#: Documents without a schema: nested deeper than one pass goes, odd keys, empty containers; some are no JSON.
OPEN_DOC = """CASE WHEN run_id % 29 = 0 THEN '{"cut": [' ELSE concat('{"n": ', CAST(pos AS VARCHAR), ', "none": null, "empty": {}, "list": [[], "', severity, '", {"file": "', file, '"}, [["', rec_path, '"]]], "a b": {"": "', severity, '"}, "deep": ',
  repeat('{"x":[', CAST(run_id % 9 AS INTEGER)), '"end"', repeat(']}', CAST(run_id % 9 AS INTEGER)), '}') END"""


@query("p1_open_json", """SELECT run_id, pos, path, value FROM (SELECT run_id, pos, unnest(['$.list[1]', '$.list[2].file', '$.list[3][0][0]', '$.a b.', concat('$.deep', repeat('.x[0]', CAST(run_id % 9 AS INTEGER)))]) AS path, unnest([severity, file, rec_path, severity, 'end']) AS value FROM b_findings WHERE run_id % 29 <> 0)""")
def _(t):
    docs = t("b_findings").select("run_id", "pos", F.expr(OPEN_DOC.replace("VARCHAR", "STRING").replace("INTEGER", "INT")).alias("body"))
    return L.open_leaves(docs, "body", "run_id", "pos")


@query("p9_cited_files", "SELECT run_id, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM b_findings GROUP BY run_id")
def _(t):
    leaves = t("b_findings").select("run_id", F.concat(F.lit("$.findings["), F.col("pos").cast("string"), F.lit("].file")).alias("path"), F.col("file").alias("value"))
    return L.cited_files(leaves, "run_id").select("run_id", F.array_join("files", ",").alias("files"))


@query("p10_citations", "SELECT run_id, file, pos + 1 AS start_line, pos + 3 AS end_line, severity AS excerpt FROM b_findings WHERE pos % 3 <> 0")
def _(t):
    item = F.struct(F.when(F.col("pos") % 3 != 0, F.col("file")).alias("file"), (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 3).alias("end_line"), F.col("severity").alias("excerpt"))
    runs = t("b_findings").groupBy("run_id").agg(F.collect_list(item).alias("evidence"))
    return L.citations(runs, "evidence", "run_id")


@query("p2_tokens", f"SELECT doc_id, len({TOKS}) AS n_tokens, md5(array_to_string({TOKS}, ' ')) AS digest FROM documents")
def _(t):
    k = S.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.md5(F.array_join(k, " ").cast("binary")).alias("digest"))


@query("p3_shingles", f"SELECT doc_id, greatest(len(k) - 7, 0) AS n_shingles, md5(array_to_string(list_transform(range(1, greatest(len(k) - 6, 1)), lambda i: array_to_string(list_slice(k, i, i + 7), ' ')), '|')) AS digest FROM (SELECT doc_id, {TOKS} AS k FROM documents)")
def _(t):
    df = t("documents").select("doc_id", S.shingles(S.tokens(F.col("text"))).alias("s"))
    return df.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


SHA_SQL = r"regexp_extract_all(text, '(?i)\b[0-9a-f]{7,40}\b')"


@query("p4_sha_tokens", f"SELECT doc_id, unnest({SHA_SQL}) AS matched FROM documents")
def _(t):
    return t("documents").select("doc_id", F.explode(S.sha_tokens(F.col("text"))).alias("matched"))


REFS = "concat('Fixes #', CAST(doc_id AS VARCHAR), ', see PR ', CAST(n_chars % 97 AS VARCHAR), ' and pull/', CAST(doc_id % 7 AS VARCHAR), '; Pull request #', CAST(n_chars AS VARCHAR), '. cve-2024-', CAST(10000 + doc_id % 900 AS VARCHAR), ' CVE-19-1 xPR 5 #', CAST(doc_id % 13 AS VARCHAR), 'a')"
PR_SQL = r"list_concat(list_concat(regexp_extract_all(r, '#(\d+)\b', 1), regexp_extract_all(r, '(?i)\bPR[ -]?#?(\d+)\b', 1)), list_concat(regexp_extract_all(r, '(?i)\bpull/(\d+)\b', 1), regexp_extract_all(r, '(?i)\bpull request #?(\d+)\b', 1)))"


PR_MENTION_SQL = PR_SQL.replace(", 1)", ", 0)")


def _refs(t) -> DataFrame:
    return t("documents").select("doc_id", F.expr(REFS.replace("VARCHAR", "STRING")).alias("r"))


@query("p5_pr_refs", f"SELECT doc_id, unnest({PR_SQL}) AS number FROM (SELECT doc_id, {REFS} AS r FROM documents)")
def _(t):
    return _refs(t).select("doc_id", F.explode(S.pr_numbers(F.col("r"))).alias("number"))


@query("p6_cve_refs", rf"SELECT doc_id, unnest(regexp_extract_all(r, '(?i)\bCVE-\d{{4}}-\d{{4,7}}\b')) AS matched FROM (SELECT doc_id, {REFS} AS r FROM documents)")
def _(t):
    return _refs(t).select("doc_id", F.explode(S.cve_ids(F.col("r"))).alias("matched"))


HEADERS = "|".join(S.DIFF_HEADERS)


@query("p7_strip_diff_headers", f"SELECT doc_id, md5(array_to_string(list_filter(string_split('diff --git a b' || chr(10) || 'index 12..34' || chr(10) || text || chr(10) || ' index kept', chr(10)), lambda x: NOT regexp_matches(x, '^({HEADERS})')), chr(10))) AS digest FROM documents")
def _(t):
    patch = F.concat(F.lit("diff --git a b\nindex 12..34\n"), "text", F.lit("\n index kept"))
    return t("documents").select("doc_id", F.md5(S.strip_diff_headers(patch).cast("binary")).alias("digest"))


@query("p8_patch_shas", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p, '(?im)^(?:From|commit)\s+([0-9a-f]{7,40})\b', 1), lambda x: lower(x)))), ',') AS shas FROM (SELECT doc_id, concat('From ', md5(CAST(doc_id AS VARCHAR)), ' Mon', chr(10), 'commit ', upper(left(md5(coalesce(source, '')), 12)), chr(10), 'see commit abcdef0', chr(10), 'COMMIT ', left(md5(coalesce(source, '')), 12)) AS p FROM documents)")
def _(t):
    md5 = lambda c: F.md5(c.cast("binary"))
    s = F.substring(md5(F.coalesce("source", F.lit(""))), 1, 12)
    p = F.concat(F.lit("From "), md5(F.col("doc_id").cast("string")), F.lit(" Mon\ncommit "), F.upper(s), F.lit("\nsee commit abcdef0\nCOMMIT "), s)
    return t("documents").select("doc_id", F.array_join(F.array_sort(S.patch_shas(p)), ",").alias("shas"))


@query("p11_severity", "SELECT run_id, pos, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END AS sev_rank, CASE severity WHEN 'low' THEN 0.25e0 WHEN 'medium' THEN 0.5e0 WHEN 'high' THEN 0.75e0 WHEN 'critical' THEN 1e0 ELSE 0e0 END AS weight, severity <> 'low' AS at_or_above FROM b_findings")
def _(t):
    s = F.col("severity")
    return t("b_findings").select("run_id", "pos", S.severity_rank(s).alias("sev_rank"), S.severity_weight(s).alias("weight"), S.at_or_above(s).alias("at_or_above"))


@query("p12_final_status", "SELECT run_id, pos, CASE coalesce(nullif(c_disp, ''), b_disp) WHEN 'CONFIRMED' THEN 'confirmed' WHEN 'NARROWED' THEN 'narrowed' WHEN 'REJECTED' THEN 'rejected' WHEN 'INCONCLUSIVE' THEN 'inconclusive' ELSE 'unassessed' END AS status FROM b_findings")
def _(t):
    return t("b_findings").select("run_id", "pos", S.final_status(F.col("b_disp"), F.col("c_disp")).alias("status"))


@query("p13_survived", "SELECT run_id, pos, coalesce(b_disp, '') NOT IN ('REJECTED', 'INCONCLUSIVE') AS survived FROM b_findings")
def _(t):
    return t("b_findings").select("run_id", "pos", S.survived(F.col("b_disp")).alias("survived"))


OPAQUE = "concat('f', substr(sha256(concat_ws(chr(0), CAST(case_id AS VARCHAR), arm, concat(CAST(run_id AS VARCHAR), ':', CAST(pos AS VARCHAR)))), 1, 10))"


@query("p14_opaque_id", f"SELECT run_id, pos, {OPAQUE} AS opaque_id FROM b_findings JOIN b_all_runs USING (run_id)")
def _(t):
    df = t("b_findings").join(t("b_all_runs"), "run_id")
    return df.select("run_id", "pos", S.opaque_id(F.col("case_id"), F.col("arm"), F.concat_ws(":", "run_id", "pos")).alias("opaque_id"))


@query("p15_first_line", "SELECT doc_id, trim(CASE WHEN strpos(text, '.') BETWEEN 2 AND 120 THEN substr(text, 1, strpos(text, '.')) ELSE substr(text, 1, 120) END) AS title FROM documents")
def _(t):
    return t("documents").select("doc_id", S.first_line(F.col("text")).alias("title"))


@query("p16_clean_path", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN concat('src/p', CAST(l_partkey % 50 AS VARCHAR), '/f.c') WHEN l_partkey % 4 = 1 THEN concat('/p', CAST(l_partkey % 50 AS VARCHAR)) WHEN l_partkey % 4 = 2 THEN '../a' ELSE '.' END AS path FROM lineitem")
def _(t):
    k = (F.col("l_partkey") % 50).cast("string")
    raw = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("./src//x/../p"), k, F.lit("/./f.c/"))).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("/../p"), k, F.lit("/y/.."))).when(F.col("l_partkey") % 4 == 2, "b/../../a").otherwise("")
    return t("lineitem").select("l_orderkey", "l_linenumber", S.clean_path(raw).alias("path"))


@query("p17_arm_of_run", "SELECT run_id, CASE WHEN run_id % 2 = 0 AND CAST(run_id AS VARCHAR) LIKE '1%' THEN 'T1' WHEN run_id % 2 = 0 THEN 'T' WHEN run_id % 3 = 0 THEN NULL ELSE 'G' END AS arm FROM b_all_runs")
def _(t):
    name = F.concat(F.when(F.col("run_id") % 2 == 0, "t-run-").when(F.col("run_id") % 3 == 0, "other-").otherwise("g-"), F.col("run_id").cast("string"))
    return t("b_all_runs").select("run_id", S.arm_of(name, {"t-": "T", "t-run-1": "T1", "g-": "G"}).alias("arm"))


MESSAGE = "CASE event_id % 7 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN concat('Rate-limit hit, try again in ', CAST(event_id % 50 AS VARCHAR), ' minutes') WHEN 2 THEN concat('usage limit. Try again at ', CAST(event_id % 12 + 1 AS VARCHAR), ':30 PM.') WHEN 3 THEN 'Retry-After: 30, overloaded' WHEN 4 THEN 'connection reset' WHEN 5 THEN 'quota exhausted; resets in 3 hours' END"


def _messages(t) -> DataFrame:
    return t("events").select("event_id", "ts", F.expr(MESSAGE.replace("VARCHAR", "STRING")).alias("message"))


@query("p18_rate_limited", "SELECT event_id, coalesce(" + ", ".join(f"nullif(regexp_extract(message, '(?i){p}'), '')" for p in ("rate[ _-]?limit", r"\b429\b", "too many requests", "usage limit", "quota (?:exceeded|exhausted)", "try again (?:in|after)", "capacity constraints", "overloaded")) + f") AS matched FROM (SELECT event_id, {MESSAGE} AS message FROM events)")
def _(t):
    return _messages(t).select("event_id", S.rate_limit_match(F.col("message")).alias("matched"))


@query("p19_reset_hint", "SELECT event_id, CASE event_id % 7 WHEN 1 THEN nullif(event_id % 50, 0) * 60 WHEN 2 THEN event_id % 12 + 1 WHEN 3 THEN 30 WHEN 5 THEN 10800 END AS hint_s FROM events")
def _(t):
    return _messages(t).select("event_id", S.reset_hint(F.col("message")).alias("hint_s"))


@query("p20_stall_wait", "SELECT event_id, CASE WHEN event_id % 7 = 2 AND d BETWEEN 60 AND 43200 THEN d + 30 ELSE 300 END AS wait_s FROM (SELECT event_id, CAST((CASE WHEN event_id % 12 + 1 = 12 THEN 12 ELSE event_id % 12 + 13 END) * 3600 + 1800 AS BIGINT) - CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS d FROM events)")
def _(t):
    return _messages(t).select("event_id", S.stall_wait(F.col("message"), F.col("ts"), F.lit(300)).cast("long").alias("wait_s"))


@query("p21_identifier_shapes", rf"SELECT doc_id, len(regexp_extract_all(r, '(?i)\b[0-9a-f]{{7,40}}\b')) AS n_sha, len({PR_SQL}) AS n_pr, len(regexp_extract_all(r, '(?i)\bCVE-\d{{4}}-\d{{4,7}}\b')) AS n_cve FROM (SELECT doc_id, concat({REFS}, coalesce(text, '')) AS r FROM documents)")
def _(t):
    df = t("documents").select("doc_id", S.identifier_shapes(F.concat(F.expr(REFS.replace("VARCHAR", "STRING")), F.coalesce("text", F.lit("")))).alias("s"))
    n = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", n("sha"), n("pr"), n("cve"))


@query("p22_excerpt_around", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN k > 0 THEN trim(substr(text, greatest(k - 40, 1), k + 5 + 40 - greatest(k - 40, 1))) ELSE '' END AS excerpt FROM (SELECT doc_id, text, strpos(lower(text), 'token') AS k FROM documents)")
def _(t):
    return t("documents").select("doc_id", S.excerpt_around(F.col("text"), F.lit("Token")).alias("excerpt"))


@query("p23_strata", f"WITH {STRATA} SELECT case_id, dim, bucket FROM s")
def _(t):
    return with_strata(_labels(t)).select("case_id", "dim", "bucket")


# --- contamination: documents are the runs' strings, benchmark items the discussion -----------


def _strings(t) -> DataFrame:
    path = F.when(F.col("lang") == "de", "$.text.excerpt").otherwise("$.text")
    return t("documents").select(F.col("doc_id").alias("run_id"), (F.col("doc_id") % 100).alias("case_id"), path.alias("path"), "text")


#: Every fifth text also stands a second time, so that its identifiers occur twice.
TWICE = "CASE WHEN doc_id % 5 = 0 THEN concat(text, ' ', text) ELSE text END"


def _twice(t) -> DataFrame:
    return _strings(t).withColumn("text", F.expr(TWICE.replace("doc_id", "run_id")))


def _sha_keys(t) -> DataFrame:
    tok = t("documents").select(F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 100).alias("case_id"), F.explode(S.sha_tokens(F.col("text"))).alias("sha"))
    return tok.where("length(sha) = 40")


KEYS_SQL = f"keys AS (SELECT ordinal, case_id, lower(sha) AS sha FROM (SELECT doc_id AS ordinal, doc_id % 100 AS case_id, unnest({SHA_SQL}) AS sha FROM documents) WHERE length(sha) = 40)"
TOK_SQL = f"tok AS (SELECT doc_id AS run_id, doc_id % 100 AS case_id, CASE WHEN lang = 'de' THEN '$.text.excerpt' ELSE '$.text' END AS path, unnest({SHA_SQL.replace('(text,', '(' + TWICE + ',')}) AS matched FROM documents)"


#: A row an occurrence; dealt by its place, so that repeats of one token stay apart.
SHAH_SQL = "shah AS (SELECT run_id, tok.case_id, path, matched, min_by(sha, ordinal) AS key_ref FROM (SELECT *, row_number() OVER () AS occurrence FROM tok) tok JOIN keys ON tok.case_id = keys.case_id AND starts_with(sha, lower(matched)) GROUP BY run_id, tok.case_id, path, matched, occurrence)"


@query("c1_scan_sha", f"WITH {KEYS_SQL}, {TOK_SQL}, {SHAH_SQL} SELECT run_id, case_id, 'sha' AS kind, path, matched, key_ref FROM shah")
def _(t):
    return C.scan_sha(_twice(t), _sha_keys(t))


def _ref_strings(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("run_id"), (F.col("doc_id") % 100).alias("case_id"), F.lit("$.text").alias("path"), F.expr(REFS.replace("VARCHAR", "STRING")).alias("text"))


@query("c2_scan_pr", f"SELECT run_id, s.case_id, 'pr' AS kind, '$.text' AS path, mention AS matched, s.number AS key_ref FROM (SELECT doc_id AS run_id, doc_id % 100 AS case_id, unnest({PR_SQL}) AS number, unnest({PR_MENTION_SQL}) AS mention FROM (SELECT doc_id, {REFS} AS r FROM documents)) s JOIN (SELECT DISTINCT case_id % 100 AS case_id, CAST(case_id % 97 AS VARCHAR) AS number FROM b_labels) k ON s.case_id = k.case_id AND s.number = k.number")
def _(t):
    return C.scan_pr(_ref_strings(t), t("b_labels").select((F.col("case_id") % 100).alias("case_id"), (F.col("case_id") % 97).alias("number")))


@query("c3_scan_cve", rf"SELECT run_id, s.case_id, 'cve' AS kind, '$.text' AS path, matched, coalesce(k.cve, 'other') AS key_ref FROM (SELECT doc_id AS run_id, doc_id % 100 AS case_id, unnest(regexp_extract_all(r, '(?i)\bCVE-\d{{4}}-\d{{4,7}}\b')) AS matched FROM (SELECT doc_id, {REFS} AS r FROM documents)) s LEFT JOIN (SELECT DISTINCT case_id % 100 AS case_id, concat('CVE-2024-', CAST(10000 + case_id % 900 AS VARCHAR)) AS cve FROM b_labels) k ON s.case_id = k.case_id AND upper(matched) = k.cve")
def _(t):
    return C.scan_cve(_ref_strings(t), t("b_labels").select((F.col("case_id") % 100).alias("case_id"), F.concat(F.lit("CVE-2024-"), (10000 + F.col("case_id") % 900).cast("string")).alias("cve")))


def _discussion(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("source_pos"), F.col("item_id").cast("string").alias("source"), F.col("text").alias("body"))


def _exclusion(t) -> DataFrame:
    shown = t("documents").where("source in ('src0', 'src1')").select(F.lit(0).alias("case_id"), "text")
    return C.exclusion_shingles(shown)


def _win(src: str, keep: str, text: str = "text") -> str:
    toks = TOKS.replace("text", text)
    return f"SELECT {keep}, p AS pos, array_to_string(list_slice(k, p + 1, p + 8), ' ') AS shingle FROM (SELECT {keep}, k, unnest(range(0, greatest(len(k) - 7, 0))) AS p FROM (SELECT {keep}, {toks} AS k FROM {src}))"


EX_SQL = f"ex AS (SELECT DISTINCT shingle FROM ({_win('documents', 'doc_id, source')}) WHERE source IN ('src0', 'src1'))"
INDEX_SQL = f"idx AS (SELECT shingle, min_by(item_id, item_id * 1000000 + pos) AS source FROM ({_win('benchmark', 'item_id')}) WHERE shingle NOT IN (SELECT shingle FROM ex) GROUP BY shingle)"


@query("c4_discussion_index", f"WITH {EX_SQL}, {INDEX_SQL} SELECT shingle, CAST(source AS VARCHAR) AS source FROM idx")
def _(t):
    return C.discussion_index(_discussion(t), _exclusion(t)).select("shingle", "source")


@query("c5_exclusion_shingles", f"WITH {EX_SQL} SELECT shingle FROM ex")
def _(t):
    return _exclusion(t).select("shingle")


DOCW = f"w AS ({_win('documents', 'doc_id, lang')})"
NOVEL_SQL = f"{EX_SQL}, {INDEX_SQL}, {DOCW}, m AS (SELECT doc_id AS run_id, pos, source FROM w JOIN idx USING (shingle) WHERE lang <> 'de'), cov AS (SELECT DISTINCT doc_id AS run_id, pos + unnest(range(0, 8)) AS token FROM w WHERE shingle IN (SELECT shingle FROM ex)), need AS (SELECT run_id, pos, source, pos + unnest(range(0, 8)) AS token FROM m), novel AS (SELECT need.run_id, pos, source FROM need LEFT JOIN cov ON need.run_id = cov.run_id AND need.token = cov.token GROUP BY need.run_id, pos, source HAVING count(*) - count(cov.token) >= 3)"


def _shown(t) -> DataFrame:
    return t("documents").where("source in ('src0', 'src1')").select("text")


def _found(t) -> DataFrame:
    return D.matched(_strings(t), _discussion(t), _shown(t))


@query("c6_novel_windows", f"WITH {NOVEL_SQL} SELECT run_id, pos, CAST(source AS VARCHAR) AS source FROM novel")
def _(t):
    return D.novel_windows(_found(t)).select("run_id", "pos", "source")


OWN_SQL = f"bw AS ({_win('benchmark', 'item_id')}), own AS (SELECT DISTINCT w.doc_id AS run_id, w.pos FROM w JOIN bw ON bw.item_id = w.doc_id % 40 AND bw.shingle = w.shingle)"


@query("c6_cited_windows", f"WITH {EX_SQL}, {INDEX_SQL}, {DOCW}, {OWN_SQL}, m AS (SELECT doc_id AS run_id, pos, source FROM w JOIN idx USING (shingle) WHERE lang <> 'de' AND NOT EXISTS (SELECT 1 FROM own WHERE own.run_id = w.doc_id AND own.pos = w.pos)), cov AS (SELECT DISTINCT run_id, pos + unnest(range(0, 8)) AS token FROM (SELECT doc_id AS run_id, pos FROM w WHERE shingle IN (SELECT shingle FROM ex) UNION SELECT run_id, pos FROM own)), need AS (SELECT run_id, pos, source, pos + unnest(range(0, 8)) AS token FROM m) SELECT need.run_id, pos, CAST(source AS VARCHAR) AS source FROM need LEFT JOIN cov ON need.run_id = cov.run_id AND need.token = cov.token GROUP BY need.run_id, pos, source HAVING count(*) - count(cov.token) >= 3")
def _(t):
    """Every run cites one item as a file: its windows are hidden from that run, not from the others."""
    cited = t("documents").select(F.col("doc_id").alias("run_id"), F.lit(0).alias("case_id"), F.concat(F.lit("./items//"), (F.col("doc_id") % 40).cast("string")).alias("file"))
    files = t("benchmark").select(F.lit(0).alias("case_id"), F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("path"), "text")
    return D.novel_windows(D.matched(_strings(t), _discussion(t), _shown(t), cited, files)).select("run_id", "pos", "source")


SPAN_SQL = f"{NOVEL_SQL}, isl AS (SELECT *, pos - row_number() OVER (PARTITION BY run_id ORDER BY pos) AS island FROM novel), spans AS (SELECT run_id, min(pos) AS first_pos, count(*) AS n_windows, min_by(source, pos) AS source FROM isl GROUP BY run_id, island)"


@query("c7_discussion_spans", f"WITH {SPAN_SQL} SELECT run_id, first_pos, n_windows, n_windows + 7 AS n_tokens, CAST(source AS VARCHAR) AS source FROM spans")
def _(t):
    return D.spans(_found(t)).select("run_id", "first_pos", "n_windows", "n_tokens", "source")


@query("c7_discussion_text", f"WITH {SPAN_SQL}, toks AS (SELECT doc_id, {TOKS} AS k FROM documents) SELECT run_id, 'discussion' AS kind, array_to_string(list_slice(k, first_pos + 1, first_pos + n_windows + 7), ' ') AS matched, CAST(source AS VARCHAR) AS key_ref FROM spans JOIN toks ON doc_id = run_id")
def _(t):
    return C.discussion_hits(_found(t)).select("run_id", "kind", "matched", "key_ref")


ALL_TEXT = f"concat(coalesce({TWICE}, ''), ' ', CASE WHEN doc_id % 7 = 3 THEN {REFS.replace('n_chars', 'length(text)')} ELSE '' END)"
REF_KEYS_SQL = "prk AS (SELECT DISTINCT case_id % 100 AS case_id, CAST(case_id % 97 AS VARCHAR) AS number FROM b_labels), cvk AS (SELECT DISTINCT case_id % 100 AS case_id, concat('CVE-2024-', CAST(10000 + case_id % 900 AS VARCHAR)) AS cve FROM b_labels)"
REF_SQL = rf"refs AS (SELECT doc_id AS run_id, doc_id % 100 AS case_id, CASE WHEN lang = 'de' THEN '$.text.excerpt' ELSE '$.text' END AS path, {ALL_TEXT} AS r FROM documents), {REF_KEYS_SQL}, prh AS (SELECT run_id, s.case_id, path, mention AS matched, s.number AS key_ref FROM (SELECT run_id, case_id, path, unnest({PR_SQL}) AS number, unnest({PR_MENTION_SQL}) AS mention FROM refs) s JOIN prk ON s.case_id = prk.case_id AND s.number = prk.number), cvh AS (SELECT run_id, s.case_id, path, matched, coalesce(cve, 'other') AS key_ref FROM (SELECT run_id, case_id, path, unnest(regexp_extract_all(r, '(?i)\bCVE-\d{{4}}-\d{{4,7}}\b')) AS matched FROM refs) s LEFT JOIN cvk ON s.case_id = cvk.case_id AND upper(matched) = cve)"


def _all_strings(t) -> DataFrame:
    """The strings with references in some of them."""
    return _strings(t).withColumn("text", F.expr(ALL_TEXT.replace("VARCHAR", "STRING").replace("doc_id", "run_id")))


def _numbers(t) -> DataFrame:
    return t("b_labels").select((F.col("case_id") % 100).alias("case_id"), (F.col("case_id") % 97).alias("number"))


def _cves(t) -> DataFrame:
    return t("b_labels").select((F.col("case_id") % 100).alias("case_id"), F.concat(F.lit("CVE-2024-"), (10000 + F.col("case_id") % 900).cast("string")).alias("cve"))


#: Cases that end in 9 have no bundle: nothing is excluded for their runs.
NOVEL8_SQL = f"""{EX_SQL}, {INDEX_SQL}, idx0 AS (SELECT shingle, min_by(item_id, item_id * 1000000 + pos) AS source FROM ({_win('benchmark', 'item_id')}) GROUP BY shingle), {DOCW},
  m AS (SELECT doc_id AS run_id, pos, source FROM w JOIN idx USING (shingle) WHERE lang <> 'de' AND doc_id % 10 <> 9 UNION ALL SELECT doc_id, pos, source FROM w JOIN idx0 USING (shingle) WHERE lang <> 'de' AND doc_id % 10 = 9),
  cov AS (SELECT DISTINCT doc_id AS run_id, pos + unnest(range(0, 8)) AS token FROM w WHERE doc_id % 10 <> 9 AND shingle IN (SELECT shingle FROM ex)), need AS (SELECT run_id, pos, source, pos + unnest(range(0, 8)) AS token FROM m),
  novel AS (SELECT need.run_id, pos, source FROM need LEFT JOIN cov ON need.run_id = cov.run_id AND need.token = cov.token GROUP BY need.run_id, pos, source HAVING count(*) - count(cov.token) >= 3),
  isl AS (SELECT *, pos - row_number() OVER (PARTITION BY run_id ORDER BY pos) AS island FROM novel), spans AS (SELECT run_id, min(pos) AS first_pos, count(*) AS n_windows, min_by(source, pos) AS source FROM isl GROUP BY run_id, island)"""


def _staged(df: DataFrame) -> DataFrame:
    return df.withColumn("stage", F.concat(F.lit("stage "), (F.col("run_id") % 3).cast("string")))


def _hits(t) -> DataFrame:
    strings, whole = _staged(_strings(t)), _staged(_all_strings(t))
    ids = [C.scan_sha(whole, _sha_keys(t)), C.scan_pr(whole, _numbers(t)), C.scan_cve(whole, _cves(t))]
    bundled = D.matched(strings.where("case_id % 10 <> 9"), _discussion(t), _shown(t))
    return C.all_hits(ids, bundled.unionByName(D.matched(strings.where("case_id % 10 = 9"), _discussion(t))))


SCAN_SQL = f"{KEYS_SQL}, {TOK_SQL}, {SHAH_SQL}, {REF_SQL}, {NOVEL8_SQL}, hits AS (SELECT run_id, 'sha' AS kind, FALSE AS unexcluded FROM shah UNION ALL SELECT run_id, 'pr', FALSE FROM prh UNION ALL SELECT run_id, 'cve', FALSE FROM cvh UNION ALL SELECT run_id, 'discussion', run_id % 10 = 9 FROM spans), n AS (SELECT run_id, count(*) AS n FROM hits GROUP BY run_id), scans AS (SELECT doc_id AS run_id, doc_id % 100 AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE 'G' END AS arm, CASE WHEN doc_id % 100 IN (SELECT case_id FROM keys) THEN CASE WHEN n > 0 THEN 'void' ELSE 'clean' END ELSE 'skipped' END AS state, coalesce(n, 0) AS n_hits FROM documents LEFT JOIN n ON doc_id = run_id)"


def _scans(t) -> DataFrame:
    runs = t("documents").select(F.col("doc_id").alias("run_id"), (F.col("doc_id") % 100).alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "T").otherwise("G").alias("arm"))
    return C.contamination_scan(runs, _hits(t), _sha_keys(t), runs.where("case_id % 10 <> 9"), _staged(_strings(t)).select("run_id", "stage"))


@query("c8_hits", f"WITH {SCAN_SQL} SELECT run_id, kind, unexcluded, concat('stage ', CAST(run_id % 3 AS VARCHAR)) AS stage, count(*) AS n FROM hits GROUP BY run_id, kind, unexcluded")
def _(t):
    return _hits(t).groupBy("run_id", "kind", "unexcluded", "stage").agg(F.count("*").alias("n"))


@query("c8_contamination_scan", f"WITH {SCAN_SQL} SELECT run_id, case_id, arm, state, n_hits, case_id % 10 <> 9 AS exclusion_applied, 7 AS sha_min_prefix, 8 AS shingle_tokens, 3 AS min_novel_tokens, concat('stage ', CAST(run_id % 3 AS VARCHAR)) AS stages_scanned FROM scans")
def _(t):
    return _scans(t)


@query("c9_contamination_summary", f"WITH {SCAN_SQL} SELECT arm, count(*) FILTER (state <> 'skipped') AS scanned, count(*) FILTER (state = 'void') AS voided, count(*) FILTER (state = 'skipped') AS skipped FROM scans GROUP BY arm")
def _(t):
    return C.contamination_summary(_scans(t))


@query("c9_void_kinds", f"WITH {SCAN_SQL} SELECT run_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM hits GROUP BY run_id")
def _(t):
    return C.void_kinds(_hits(t)).select("run_id", F.array_join("kinds", ",").alias("kinds"))


def _preflight(t) -> DataFrame:
    inputs = _all_strings(t).withColumn("is_diff", F.col("run_id") % 2 == 1).select("case_id", "path", "text", "is_diff")
    return C.preflight_scan(inputs, _sha_keys(t), _numbers(t), _cves(t))


PRE_SQL = f"{KEYS_SQL}, {TOK_SQL}, {SHAH_SQL}, {REF_SQL}, pre AS (SELECT case_id, 'sha' AS kind, path, matched, key_ref FROM shah UNION ALL SELECT case_id, 'pr', path, matched, key_ref FROM prh UNION ALL SELECT case_id, 'cve', path, matched, key_ref FROM cvh)"


@query("c10_preflight_scan", f"WITH {PRE_SQL} SELECT case_id, kind, path, matched, key_ref FROM pre")
def _(t):
    return _preflight(t)


@query("c11_preflight_summary", f"WITH {PRE_SQL} SELECT CASE WHEN case_id NOT IN (SELECT case_id FROM keys) THEN 'unchecked' WHEN case_id IN (SELECT case_id FROM pre) THEN 'failed' ELSE 'passed' END AS state, count(*) AS n FROM (SELECT DISTINCT doc_id % 100 AS case_id FROM documents) GROUP BY 1")
def _(t):
    return C.preflight_summary(t("documents").select((F.col("doc_id") % 100).alias("case_id")).distinct(), _preflight(t), _sha_keys(t))


def _probe_hits(t) -> DataFrame:
    answers = _all_strings(t).select("case_id", F.lit("p").alias("probe"), F.col("text").alias("answer"))
    return C.probe_scan(answers, _sha_keys(t), _numbers(t), _cves(t))


@query("c12_probe_scan", f"WITH {KEYS_SQL}, {TOK_SQL}, {SHAH_SQL}, {REF_SQL} SELECT case_id, kind, count(*) AS n FROM (SELECT case_id, 'sha' AS kind, matched FROM shah UNION ALL SELECT case_id, 'pr', matched FROM prh UNION ALL SELECT case_id, 'cve', matched FROM cvh) GROUP BY case_id, kind")
def _(t):
    return _probe_hits(t).groupBy("case_id", "kind").agg(F.count("*").alias("n"))


@query("c13_probe_decide", "SELECT case_id, CASE WHEN case_id % 4 = 0 THEN 'void' WHEN risky THEN 'void' WHEN risky IS NULL THEN 'unresolved' ELSE 'clear' END AS state, CASE WHEN case_id % 8 = 0 THEN 'pr,sha' WHEN case_id % 4 = 0 THEN 'sha' ELSE '' END AS kinds FROM b_labels LEFT JOIN b_history USING (case_id)")
def _(t):
    k = F.explode(F.when(F.col("case_id") % 8 == 0, F.array(F.lit("sha"), F.lit("pr"))).otherwise(F.array(F.lit("sha"))))
    hits = t("b_labels").where("case_id % 4 = 0").select("case_id", k.alias("kind"))
    return C.probe_decide(t("b_labels"), hits, t("b_history").select("case_id", F.col("risky").alias("hit")))


@query("c14_gate_coverage", "SELECT case_id, CASE WHEN case_id % 11 = 0 THEN 'missing' ELSE 'malformed' END AS rule, CASE WHEN case_id % 11 = 0 THEN '' ELSE 'maybe' END AS detail FROM b_labels WHERE case_id % 11 = 0 OR case_id % 13 = 0")
def _(t):
    state = F.when(F.col("case_id") % 13 == 0, "maybe").when(F.col("case_id") % 3 == 0, "void").when(F.col("case_id") % 3 == 1, "clean").otherwise("unresolved")
    return C.gate_coverage(t("b_labels"), t("b_history").select("case_id", state.alias("state")))


@query("c8_scan_rate", f"WITH {SCAN_SQL} SELECT case_id, count(*) AS runs, count(*) FILTER (state = 'void') AS voided FROM scans GROUP BY case_id")
def _(t):
    return _scans(t).groupBy("case_id").agg(F.count("*").alias("runs"), count_if(F.col("state") == "void").alias("voided"))
