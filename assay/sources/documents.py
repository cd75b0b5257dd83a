"""JSON documents of closed schemas, one a file or one a line, and what breaks their rules.

A document is read as text and parsed once: its file's path names the run, stage or case it belongs
to, its digest is taken where it is read, and a document that breaks a rule becomes a row with the
rule instead of failing its task. Folders are found by name (`run_dir=x`, as Spark writes them) or else
by their place from the end of the path (as sealed trees have them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"


def fields_of(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def _decoded(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def path_part(name: str, k: int) -> Column:
    """The folder called `name=...`, or else the k-th part of the path from its end (1 is the file)."""
    named = F.regexp_extract("file_path", f"/{name}=([^/]+)/", 1)
    return F.when(named != "", _decoded(named)).otherwise(F.element_at(F.split("file_path", "/"), -k))


def texts(spark: SparkSession, source: str | DataFrame, lines: bool = False) -> DataFrame:
    """file_path, value: whole files (or lines) under a path or glob; or an archive, which is a table of
    those two columns, as many small documents are better kept."""
    if isinstance(source, str):
        at = F.col("_metadata.file_path").alias("file_path")
        if lines:
            return spark.read.text(source).select(at, "value")
        # this source names files as URIs, the text source as they are
        return spark.read.format("binaryFile").load(source).select(_decoded(F.col("_metadata.file_path")).alias("file_path"), F.col("content").cast("string").alias("value"))
    return source.select("file_path", F.explode(F.split("value", "\n")).alias("value")) if lines else source.select("file_path", "value")


def documents(spark: SparkSession, source: str | DataFrame, schema: str, version: str | None = None, closed: bool = False, lines: bool = False, name: str | None = None) -> DataFrame:
    """file_path, file_sha256 (of a line, where there is one document a line), doc, rule, detail: every
    document of texts(); Spark lists no file of no bytes, so one has no row. rule is null, or `malformed` (not JSON, or a field of another type),
    `schema version`, or `unknown field` (of a closed schema, at its top level). Blank lines are none. name: of an archive,
    only files called so."""
    raw = texts(spark, source, lines)
    mine = F.lit(True) if name is None or isinstance(source, str) else F.element_at(F.split("file_path", "/"), -1) == name
    if lines:
        raw = raw.where(F.trim("value") != "")
    doc = F.from_json("value", f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = raw.select("file_path", F.sha2(F.col("value").cast("binary"), 256).alias("file_sha256"), "value", doc.alias("doc"))
    broken = F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull() | F.json_object_keys("value").isNull()
    unknown = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(f) for f in fields_of(schema)])) if closed else F.expr("CAST(array() AS array<string>)")
    other = ~F.col("doc.schema_version").eqNullSafe(F.lit(version)) if version else F.lit(False)
    rule = F.when(~mine, None).when(broken, "malformed").when(other, "schema version").when(F.size(unknown) > 0, "unknown field")
    detail = F.when(broken, "").when(other, F.coalesce(F.col("doc.schema_version"), F.lit("")) if version else F.lit("")).when(F.size(unknown) > 0, F.array_join(F.array_sort(unknown), ","))
    # a rule that another file breaks must not fail a strict read, in whatever order filters are applied
    return out.where(mine).select("file_path", "file_sha256", "doc", rule.alias("rule"), detail.alias("detail"))


def accepted(docs: DataFrame, strict: bool = True) -> DataFrame:
    """The documents that break no rule, their fields as columns beside file_path and file_sha256; strict:
    one that does fails the read with its file and rule."""
    names = [f for f in docs.schema["doc"].dataType.fieldNames() if f != CORRUPT]
    if strict:
        why = F.raise_error(F.concat_ws(" ", "rule", "detail", F.lit("in"), "file_path")).cast(docs.schema["doc"].dataType)
        docs = docs.withColumn("doc", F.when(F.col("rule").isNull(), F.col("doc")).otherwise(why))
    else:
        docs = docs.where("rule is null")
    return docs.select("file_path", "file_sha256", *[F.col(f"doc.{n}").alias(n) for n in names])


def violations(docs: DataFrame, **keys: Column) -> DataFrame:
    """keys..., rule, detail of the documents that break a rule."""
    return docs.where("rule is not null").select(*[c.alias(n) for n, c in keys.items()], "rule", "detail")
