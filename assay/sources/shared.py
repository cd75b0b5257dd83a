"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINTS = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a folder of our own, kept for the session, and
    only in local mode, as in tests; elsewhere that raises, as executors would not see it."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINTS)
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"set {CHECKPOINTS} to a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a written table in the shared folder, for what packs well in columns."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a filter table at most, keys of a row (of 256 bits) up to there.
MOST_BLOCKS, BLOCK_KEYS = 1 << 18, 16


def may_be_among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among `keys`, and a few others: a Bloom filter of four bits a key, as a table of blocks that is
    sent to every task. For a semi join behind it, so that fewer rows are shuffled. keys is read twice."""
    blocks = min(MOST_BLOCKS, max(1, keys.count() // BLOCK_KEYS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    bit = lambda c, k: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64({c}, 1), {6 * k}) & 63 AS INT))")
    of = keys.groupBy(block(key).alias("_block")).agg(*[F.bit_or(bit(key, k)).alias(f"_w{k}") for k in range(4)])
    met = block(key) == F.col("_block")
    for k in range(4):
        met &= F.col(f"_w{k}").bitwiseAND(bit(key, k)) != 0
    return df.join(F.broadcast(of), met, "left_semi")
