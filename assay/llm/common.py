"""What several operators of this subpackage share: table reading, cutting lineage,
five-word shingle sets and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a written table in the shared folder, for what packs well in columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def part_of(column: Column, mod: int) -> Column:
    """crc32 of an id's decimal text modulo `mod`; null ids give null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(mod))


# --- five-word shingles ------------------------------------------------------------

SHINGLE = 5
_MIX = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: A-Z lower-cased, split at ASCII white space."""
    if not text:
        return np.empty(0, U64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both times
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word windows; a shorter text that has
    words is one window, a text without words the empty set."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.full(n, U64(min(width, len(w))), U64)
    for k in range(min(width, len(w))):
        h += (w[k : k + n] + U64(k)) * _MIX[k % 5]
    return np.unique(mix64(h))


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit digest of a shingle set."""
    x = xxhash.xxh3_64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


# --- connected components ----------------------------------------------------------

#: Edges of a task in a round: rounds shrink, and so do their tasks.
ROUND = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(src long, dst long) -> (id long, component long): smallest id of the component, a row
    for every id that has a link.

    Every round maps each vertex to the one of lowest hash within two steps and joins the edges
    between the images, so a star is one vertex after a round and edges shrink by a constant factor in
    expectation however long the chains are; hubs are pre-aggregated by the partial min. Nothing is collected but
    the count that ends the loop.
    """
    e = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct())
    maps: list[DataFrame] = []
    few = first = None
    for turn in range(64):
        n = e.count()
        if not n:
            break
        few = lambda df, n=n: df.coalesce(-(-n // ROUND))  # noqa: E731  else every small round writes files of all partitions
        first = first or few
        both = few(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        near = few(both.groupBy("src").agg(F.least(F.min(rank("dst")), F.first(rank("src"))).alias("m"))).select(F.col("src").alias("dst"), "m")
        to = cut(few(both.join(near, "dst").groupBy("src").agg(F.min("m").alias("m"))).select(F.col("src").alias("v"), F.col("m.v").alias("r")))
        maps.append(to)
        a = to.select(F.col("v").alias("src"), F.col("r").alias("a"))
        b = to.select(F.col("v").alias("dst"), F.col("r").alias("b"))
        e = few(few(e.join(a, "src")).join(b, "dst")).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        e = cut(few(e.where("src <> dst").distinct()))
    else:
        raise RuntimeError("components did not contract in 64 rounds")
    if not maps:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    out = maps[0].select(F.col("v").alias("id"), F.col("r").alias("root"))
    for to in maps[1:]:
        step = to.select(F.col("v").alias("root"), F.col("r").alias("next"))
        out = first(out.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    low = first(out.groupBy("root").agg(F.min("id").alias("component")))
    return cut(first(out.join(low, "root").select("id", "component")))
