"""Cleaning a corpus in stages: STAGES in order, each on what the one before it kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import toxicity as tox
from assay.llm.bpe import vocabulary
from assay.llm.common import part_of, table
from assay.llm.line_dedup import dedup_lines
from assay.llm.ngram_join import similar
from assay.llm.packing import pack
from assay.llm.secret_scan import redact


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is 0.5 or more go. The model learns from the
    labelled rows whose crc32(doc_id) mod 5 is not 0."""
    model = tox.train(docs, table(spark, sf_dir, "labels"), part_of(F.col("doc_id"), 5) != 0)
    return tox.keep_clean(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; of near-equal lines only the first in the corpus does."""
    return dedup_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents the one with the smallest doc_id stays; documents
    without an id or without a word stay."""
    groups = similar(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a packed sequence."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("secret_scans", secret_scans), ("packing", packing)]

#: Spans, classifiers, fuzzy joins and tokens have no SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-pipeline-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
