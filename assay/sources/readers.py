"""Readers and writers of trees of sealed review documents, over any path Spark can read.

Schemas are explicit. A document that breaks a rule of its own fails the read that is strict (the default)
with its file and rule; otherwise it is left out and stands in the *_violations() of the same tree.
A root is the folder of a sealed tree, with one document a file, or an archive of it (a table of
file_path and value); `pattern` reads trees that write_tree() made. An archive may hold a file of lines (a log, a
manifest) in several rows of whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as T
from .documents import accepted, documents, path_part, texts, violations

KEYS_VERSION = "contamination-keys/v1"
RUN_VERSION = "run-result/v1"
GATE_VERSION = "contamination-probe-gate/v1"
REVIEWS = {"a": (T.REVIEW_A, "findings"), "b": (T.REVIEW_B, "assessments"), "c": (T.REVIEW_C, "verdicts")}


def _at(root: str | DataFrame, pattern: str) -> str | DataFrame:
    """The files of a pattern under a root, or an archive as it is."""
    return f"{root}/{pattern}" if isinstance(root, str) else root


def run_documents(spark: SparkSession, root: str | DataFrame, pattern: str = "*/run.json", version: str | None = None) -> DataFrame:
    return documents(spark, _at(root, pattern), T.RUN, version, closed=True, name="run.json")


def read_runs(spark: SparkSession, root: str | DataFrame, pattern: str = "*/run.json", version: str | None = None, strict: bool = True) -> DataFrame:
    """Run manifests, one a run folder."""
    df = accepted(run_documents(spark, root, pattern, version), strict)
    return df.withColumn("run_dir", path_part("run_dir", 2))


def runs_violations(spark: SparkSession, root: str | DataFrame, pattern: str = "*/run.json", version: str | None = None) -> DataFrame:
    """run_dir, rule, detail of manifests that are not readable, of another version or not closed."""
    return violations(run_documents(spark, root, pattern, version), run_dir=path_part("run_dir", 2))


def review_documents(spark: SparkSession, root: str | DataFrame, letter: str = "a", pattern: str | None = None) -> DataFrame:
    return documents(spark, _at(root, pattern or f"*/stages/*/review-{letter}.json"), REVIEWS[letter][0], closed=True, name=f"review-{letter}.json")


def read_reviews(spark: SparkSession, root: str | DataFrame, letter: str = "a", pattern: str | None = None, strict: bool = True) -> DataFrame:
    """Stage documents of one kind with run folder and stage; the array position is the rank."""
    df = accepted(review_documents(spark, root, letter, pattern), strict)
    return df.select(path_part("run_dir", 4).alias("run_dir"), path_part("stage", 2).alias("stage"), F.posexplode(REVIEWS[letter][1]).alias("pos", "item")).select("run_dir", "stage", "pos", "item.*")


def new_findings(spark: SparkSession, root: str | DataFrame, pattern: str | None = None, strict: bool = True) -> DataFrame:
    """What stage 3 found itself, by rank."""
    df = accepted(review_documents(spark, root, "c", pattern), strict)
    return df.select(path_part("run_dir", 4).alias("run_dir"), path_part("stage", 2).alias("stage"), F.posexplode("new_findings").alias("pos", "item")).select("run_dir", "stage", "pos", "item.*")


def reviews_violations(spark: SparkSession, root: str | DataFrame, letter: str = "a", pattern: str | None = None) -> DataFrame:
    """run_dir, stage, rule, detail."""
    return violations(review_documents(spark, root, letter, pattern), run_dir=path_part("run_dir", 4), stage=path_part("stage", 2))


def telemetry_documents(spark: SparkSession, root: str | DataFrame, pattern: str = "*/stages/*/telemetry.json") -> DataFrame:
    return documents(spark, _at(root, pattern), T.TELEMETRY, name="telemetry.json")


def read_telemetry(spark: SparkSession, root: str | DataFrame, pattern: str = "*/stages/*/telemetry.json", strict: bool = True) -> DataFrame:
    """S3: attempts of every stage in their order (pos); the stage is the document's, or else its folder."""
    df = accepted(telemetry_documents(spark, root, pattern), strict)
    stage = F.coalesce(F.nullif("stage", F.lit("")), path_part("stage", 2))
    return df.select(path_part("run_dir", 4).alias("run_dir"), stage.alias("stage"), F.posexplode("attempts").alias("pos", "a")).select("run_dir", "stage", "pos", "a.*")


def event_documents(spark: SparkSession, root: str | DataFrame, pattern: str = "*/events.jsonl") -> DataFrame:
    return documents(spark, _at(root, pattern), T.EVENTS, lines=True, name="events.jsonl")


def read_events(spark: SparkSession, root: str | DataFrame, pattern: str = "*/events.jsonl", strict: bool = True) -> DataFrame:
    """Event logs, one JSON a line; blank lines are none."""
    return accepted(event_documents(spark, root, pattern), strict).withColumn("run_dir", path_part("run_dir", 2)).drop("file_path", "file_sha256")


def read_keys(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """Contamination keys with the SHA-256 of each file's bytes; unknown fields are let pass."""
    return accepted(documents(spark, path, T.KEYS), strict).drop("file_path")


def keys_violations(keys: DataFrame) -> DataFrame:
    """Keys of another version, without a case, or with a commit that is not 40 hex digits."""
    bad_sha = F.coalesce(F.exists("fixing_shas", lambda s: ~s.rlike("^[0-9a-fA-F]{40}$")), F.lit(False))
    rule = F.when(~F.col("schema_version").eqNullSafe(F.lit(KEYS_VERSION)), "schema version").when(F.coalesce("case_id", F.lit("")) == "", "no case").when(bad_sha, "malformed commit")
    return keys.withColumn("rule", rule).where("rule is not null").select("file_sha256", "case_id", "rule")


def read_labels(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """Labels, a row a case, with the manifest's hash."""
    return accepted(documents(spark, path, T.LABELS), strict).select("cohort_manifest_sha256", F.explode("cases").alias("c")).select("cohort_manifest_sha256", "c.*")


def labels_violations(labels: DataFrame) -> DataFrame:
    """Repeated cases, unknown labels, positives without a class, cases without a pair, pairs that
    are not one positive and one negative. Rows: rule, id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rule = F.when(~text("label").isin("positive", "negative"), "unknown label").when((F.col("label") == "positive") & (text("class") == ""), "positive without class").when(text("pair_id") == "", "no pair")
    one = labels.withColumn("rule", rule).where("rule is not null").select("rule", text("case_id").alias("id"))
    twice = labels.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated case").alias("rule"), text("case_id").alias("id"))
    n = lambda x: F.sum((F.col("label") == x).cast("int"))
    pairs = labels.where(text("pair_id") != "").groupBy("pair_id").agg(n("positive").alias("p"), n("negative").alias("n")).where("p <> 1 or n <> 1").select(F.lit("unbalanced pair").alias("rule"), text("pair_id").alias("id"))
    return one.unionByName(twice).unionByName(pairs)


def manifest_violations(spark: SparkSession, labels: DataFrame, manifest_path: str) -> DataFrame:
    """Labels made for another manifest than the file at this path."""
    real = spark.read.format("binaryFile").load(manifest_path).select(F.sha2("content", 256).alias("real"))
    return labels.select("cohort_manifest_sha256").distinct().join(real, F.col("cohort_manifest_sha256") == F.col("real"), "left_anti")


def read_history(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """History baselines; a null `risky` stays null with its reason."""
    return accepted(documents(spark, path, T.HISTORY), strict).drop("file_path", "file_sha256")


def history_of(labels: DataFrame, history: DataFrame) -> DataFrame:
    """Every labelled case with its baseline; null with a reason where the file is missing."""
    h = history.select("case_id", "risky", "reason").withColumn("there", F.lit(True))
    out = labels.select("case_id").join(h, "case_id", "left")
    return out.select("case_id", "risky", F.when(F.col("there").isNull(), "no history file").when(F.col("risky").isNull(), F.coalesce("reason", F.lit("not recorded"))).alias("absent"))


def read_fixing_paths(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """Paths that the fix touched, a row a path."""
    return accepted(documents(spark, path, T.FIXING_PATHS), strict).select("case_id", F.explode("paths").alias("path"))


def oracle_documents(spark: SparkSession, root: str | DataFrame, pattern: str = "*/correlated-report.json") -> DataFrame:
    """Correlated records; one without a version breaks a rule."""
    docs = documents(spark, _at(root, pattern), T.ORACLE, name="correlated-report.json")
    none = F.col("rule").isNull() & (F.coalesce("doc.schema_version", F.lit("")) == "")
    return docs.withColumn("rule", F.when(none, "no schema_version").otherwise(F.col("rule"))).withColumn("detail", F.when(none, "").otherwise(F.col("detail")))


def read_oracle(spark: SparkSession, root: str | DataFrame, pattern: str = "*/correlated-report.json", strict: bool = True) -> DataFrame:
    """Correlated records, the case being the folder."""
    return accepted(oracle_documents(spark, root, pattern), strict).withColumn("case_id", path_part("case_id", 2)).drop("file_path", "file_sha256")


def signals_of(oracle: DataFrame) -> DataFrame:
    """The three signal arrays as rows: case_id, path, tier, signal_type, symbol, source_ref."""
    def tier(n: int, items: str, paths: Column, symbol: Column) -> DataFrame:
        rows = oracle.select("case_id", F.explode(f"retrospective.{items}").alias("s"))
        return rows.select("case_id", F.explode_outer(paths).alias("path"), F.lit(n).alias("tier"), "s.signal_type", symbol.alias("symbol"), "s.source_ref")

    none = F.lit(None).cast("string")
    strong = tier(3, "strong_signals", F.col("s.changed_paths"), none)
    medium = tier(2, "medium_signals", F.col("s.changed_paths"), F.col("s.function_or_path"))
    return strong.unionByName(medium).unionByName(tier(1, "weak_signals", F.array("s.file_path"), none))


def overlaps_of(oracle: DataFrame) -> DataFrame:
    """Reversal overlaps in their order: case_id, pos, path, overlap."""
    rows = oracle.select("case_id", F.posexplode("retrospective.reversal.path_overlaps").alias("pos", "o"))
    return rows.select("case_id", "pos", "o.path", F.col("o.lineage_supported_removed_overlap_count").alias("overlap"))


def read_judge(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """Case-level judge reports, a row a verdict."""
    df = accepted(documents(spark, path, T.JUDGE), strict)
    return df.select("case_id", "judge_model", "in_family", F.explode("verdicts").alias("key", "v")).select("case_id", "judge_model", "in_family", "v.*")


def read_verify(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """Verification reports, a row a unit."""
    return accepted(documents(spark, path, T.VERIFY), strict).select("unit.*", "disposition", "unparseable_first_response", "error")


def verify_violations(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file_sha256, rule of reports that are not readable or name no arm or case."""
    docs = documents(spark, path, T.VERIFY)
    unnamed = (F.coalesce("doc.unit.arm", F.lit("")) == "") | (F.coalesce("doc.unit.case_id", F.lit("")) == "")
    return docs.withColumn("rule", F.coalesce("rule", F.when(unnamed, "no arm or case"))).where("rule is not null").select("file_sha256", "rule")


def read_probes(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """Probe reports, a row an answer."""
    return accepted(documents(spark, path, T.PROBE), strict).select("case_id", "void", F.explode("responses").alias("r")).select("case_id", "void", "r.*")


def gate_documents(spark: SparkSession, path: str | DataFrame, records: str | DataFrame) -> DataFrame:
    """Gates, held against the cohort's records: a gate breaks a rule if it is of another version or
    its records_sha256 is not the digest of a file at `records`."""
    docs = documents(spark, path, T.GATE, GATE_VERSION)
    real = _contents(spark, records).select(F.sha2("content", 256).alias("digest")).distinct()
    docs = docs.join(real, F.col("doc.records_sha256") == F.col("digest"), "left")
    wrong = F.col("rule").isNull() & F.col("digest").isNull()
    detail = F.when(wrong, F.coalesce("doc.records_sha256", F.lit(""))).otherwise(F.col("detail"))
    return docs.select("file_path", "file_sha256", "doc", F.when(wrong, "other records").otherwise(F.col("rule")).alias("rule"), detail.alias("detail"))


def read_gate(spark: SparkSession, path: str | DataFrame, records: str | DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The gate's statement for every case; with `records`, only of gates written for them."""
    docs = gate_documents(spark, path, records) if records is not None else documents(spark, path, T.GATE)
    return accepted(docs, strict).select("records_sha256", F.explode("cases").alias("case_id", "state"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _contents(spark: SparkSession, source: str | DataFrame, tree: bool = False) -> DataFrame:
    """file_path, content: the bytes of files under a path or glob (or a whole tree), or of an archive."""
    if isinstance(source, DataFrame):
        return source.select("file_path", F.col("value").cast("binary").alias("content"))
    files = _files(spark, source) if tree else spark.read.format("binaryFile").load(source)
    return files.select(F.col("path").alias("file_path"), "content")


def read_bundle_files(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """Every file of every bundle with its bytes; the case is the folder under the root, or the one
    called case_id=..., with the path in one called path=... below it."""
    shape, written = r"/([^/]+)/((?:reviewer|control)/.*)$", r"/case_id=([^/]+)/path=([^/]+)/[^/]+$"
    at = F.col("file_path")
    named = F.regexp_extract(at, written, 1) != ""
    once = lambda c: F.url_decode(F.replace(c, F.lit("%25"), F.lit("%")))  # noqa: E731  a folder's name is escaped again in a URI
    case = F.when(named, once(F.regexp_extract(at, written, 1))).otherwise(F.regexp_extract(at, shape, 1))
    path = F.when(named, once(F.regexp_extract(at, written, 2))).otherwise(F.regexp_extract(at, shape, 2))
    raw = _contents(spark, root, tree=True)
    return raw.select(case.alias("case_id"), path.alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("link_target"), "content").where("path <> ''")


def bundle_digests(files: DataFrame) -> DataFrame:
    """case_id, path, digest; contents stay where they are read."""
    return files.select("case_id", "path", F.sha2("content", 256).alias("digest"))


def read_checksum_manifest(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Digest and path of each line; blank lines are skipped, others than two fields malformed."""
    df = texts(spark, path, lines=True).select(F.trim("value").alias("line"), "file_path").where("line <> ''")
    f = F.split("line", r"\s+")
    return df.select("file_path", path_part("case_id", 3).alias("case_id"), F.get(f, 0).alias("digest"), F.get(f, 1).alias("path"), (F.size(f) != 2).alias("malformed"))


def write_partitioned(df: DataFrame, path: str, *by: str, form: str = "parquet") -> None:
    """Writes a table in folders by the columns named; replaces what is there."""
    df.write.mode("overwrite").partitionBy(*by).format(form).save(path)


def write_tree(df: DataFrame, path: str, *by: str, order: str = "value") -> None:
    """One text file a folder: the column `value`, in order, of the rows of that folder."""
    write_partitioned(df.select("value", *by).repartition(*by).sortWithinPartitions(*by, order), path, *by, form="text")


def write_archive(df: DataFrame, path: str) -> DataFrame:
    """Documents as an archive, read again: file_path (as in a sealed tree) and value. Millions of small
    files cost a cluster more in listing than in reading."""
    df.select("file_path", "value").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def checksum_lines(files: DataFrame, *by: str) -> DataFrame:
    """By..., value: a `sha256  path` line of every file but manifests. files: by..., path, digest."""
    return files.where(F.element_at(F.split("path", "/"), -1) != "checksums.sha256").select(*by, F.concat("digest", F.lit("  "), "path").alias("value"))


def checksum_tree(spark: SparkSession, root: str | DataFrame, manifest: str = "checksums.sha256") -> DataFrame:
    """`sha256  path` lines of every file under the root but the manifest, in order of the path."""
    at = F.instr("path", root.rstrip("/").split(":")[-1].lstrip("/")) + F.length(F.lit(root.rstrip("/").split(":")[-1].lstrip("/"))) + 1
    out = _files(spark, root).select(F.sha2("content", 256).alias("digest"), F.substring("path", at, F.length("path")).alias("path")).where(F.col("path") != manifest)
    return out.orderBy("path").select(F.concat("digest", F.lit("  "), "path").alias("line"))
