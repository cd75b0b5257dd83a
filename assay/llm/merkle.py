"""A Merkle manifest of a dataset, as a postorder append log, with a proof for every row.

A row's leaf is the SHA-256 of its columns, each `-` if null, else its UTF-8 length, `:` and its
value. Rows of a tree (a value of the `tree` column) ascend by key; every 8 consecutive nodes of a
level become one of the next until one is left, the subroot; the subroots, by tree (null first, then
bytewise), are the leaves of one more tree, whose last node is the root.

Leaves are ranked by a range sort and counts per range, and dealt to aligned builders: 512 leaves
(8 ** HEIGHT) from a multiple of 512 are a whole subtree, whose nodes a builder appends in the order
in which they are complete, which is postorder. That segment of the log is a row. The roots of
segments are the leaves of the next tier of builders, so the tiers are as many as the logarithm of
the rows to base 512. Where a node stands in a log is a closed form of its level, its index and the
number of leaves (`position`), from the sizes of the subtrees before it; siblings for proofs are
addressed by it, segment by segment, from the root down. No task holds more than a segment and its
leaves, and nothing but the number of tiers comes to the driver.

Defined results: null keys come first, equal keys of a tree are in the order of their leaves (equal
rows are then exchangeable); an empty table has no root and no rows; columns other than those asked
for are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import part_of, shuffle_partitions, stored, table

ARITY = 8
#: Levels a builder makes above its leaves.
HEIGHT = 3
#: Ranges of the sort whose counts are broadcast; past that they are joined by a shuffle.
FEW_COUNTS = 200_000


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above n leaves."""
    k = 0
    while ARITY**k < n:
        k += 1
    return k


def position(level: int, index: int, n: int, height: int) -> int:
    """Place in the postorder log of n leaves and `height` levels of the index-th node of a level:
    all nodes of lower levels over the leaves up to its last one, its own elder nodes, and the
    nodes of higher levels that end before it begins."""
    begin, end = index * ARITY**level, min((index + 1) * ARITY**level, n)
    below = sum(-(-end // ARITY**m) for m in range(level))
    return below + index + sum(begin // ARITY**m for m in range(level + 1, height + 1))


def append_log(leaves: list[str], height: int) -> list[str]:
    """All nodes over the leaves, in the order in which they are complete; the last is the root."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(height + 1)]

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        add(level + 1, sha("".join(run)))

    def add(level: int, node: str) -> None:
        log.append(node)
        open_runs[level].append(node)
        if len(open_runs[level]) == ARITY and level < height:
            close(level)

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):  # what is left over is complete at the end
        if open_runs[level]:
            close(level)
    return log


def siblings(log: list[str], index: int, n: int, height: int) -> Iterator[tuple[str, str]]:
    """Level by level, the nodes of its run left and right of the one over a leaf."""
    width = n
    for level in range(height):
        first = index // ARITY * ARITY
        left = [log[position(level, k, n, height)] for k in range(first, index)]
        right = [log[position(level, k, n, height)] for k in range(index + 1, min(first + ARITY, width))]
        yield "".join(left), "".join(right)
        index, width = index // ARITY, -(-width // ARITY)


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 in lowercase hex of columns, each `-` or byte length, `:`, value."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


# --- ranks ---------------------------------------------------------------------------


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows and (rank long from 0, size long) in the given order within each tree (never null).

    A range sort over all trees; a range's rows of a tree are numbered from the tree's rows in the ranges
    before it, of which there is one count a range and tree. Equal rows share a range.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select(tree, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("size")))
    counts = F.broadcast(counts) if counts.count() <= FEW_COUNTS else counts
    return dealt.join(counts, [tree, "_range"]).select(*names, (F.col("_at") + F.col("_shift")).alias("rank"), "size")


# --- builders ------------------------------------------------------------------------

_SEGMENT = "tree string, tier int, block long, n int, height int, size long, total long, nodes array<string>"
_PATH = "array<struct<left: string, right: string>>"


def _built(nodes: DataFrame, tier: int, most: int) -> DataFrame:
    """(tree, rank, size, total, digest) -> segments: the log of n nodes of a tier and `height` levels
    above them. A tree of one segment ends with its subroot."""
    span = ARITY**most

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        size, total = int(rows["size"].iloc[0]), int(rows["total"].iloc[0])
        height = levels(size) if size <= span else most
        log = append_log(rows.sort_values("rank")["digest"].tolist(), height)
        return pd.DataFrame({"tree": [key[0]], "tier": [tier], "block": [key[1]], "n": [len(rows)], "height": [height], "size": [size], "total": [total], "nodes": [log]})

    block = F.floor(F.col("rank") / span).alias("block")
    return nodes.select("tree", block, "rank", "size", "total", "digest").groupBy("tree", "block").applyInPandas(build, _SEGMENT)


def forest(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """(tree, rank, size, digest) -> segments of all trees, a stored table a tier."""
    span, tiers = ARITY**height, []
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes = leaves.withColumn("total", F.col("size"))
    while True:
        tiers.append(stored(_built(nodes, len(tiers), height)))
        if most <= span:
            return tiers
        most = -(-most // span)
        nodes = tiers[-1].where(F.col("size") > span).select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / span).alias("size"), "total", F.element_at("nodes", -1).alias("digest"))


def subroots(tiers: list[DataFrame], height: int) -> DataFrame:
    """(tree, subroot)."""
    ends = [t.where(F.col("size") <= ARITY**height).select("tree", F.element_at("nodes", -1).alias("subroot")) for t in tiers]
    return reduce(DataFrame.unionByName, ends)


def _steps(nodes, index: int, n: int, height: int, upper) -> list[dict]:
    own = [{"left": a, "right": b} for a, b in siblings(nodes, index, n, height)]
    return own + [dict(x) for x in upper]


def segment_paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """Paths of the subroots (tree, subroot, root, path) -> the lowest tier's segments and subroot, root,
    path (of the segment's root), from the highest tier down."""
    span = ARITY**height

    def down(batches):
        for rows in batches:
            out = []
            for tree, block, n, h, nodes, subroot, root, path in rows.itertuples(index=False, name=None):
                out += [(tree, block * span + k, subroot, root, _steps(nodes, k, n, h, path)) for k in range(n)]
            yield pd.DataFrame(out, columns=["tree", "block", "subroot", "root", "path"])

    at = None
    for tier in reversed(range(len(tiers))):
        here = tiers[tier].select("tree", "block", "n", "height", "size", "nodes")
        ends = here.where(F.col("size") <= span).select("tree", "block").join(tops, "tree")
        at = ends if at is None else ends.unionByName(at)
        at = here.join(at, ["tree", "block"]).select("tree", "block", "n", "height", "nodes", "subroot", "root", "path")
        if tier:
            at = stored(at.mapInPandas(down, f"tree string, block long, subroot string, root string, path {_PATH}"))
    return at


@dataclass
class Manifest:
    """leaves: the rows asked for, tree (0, or 1 and the value), rank, size; tiers: segments of the log;
    subroots: (tree, subroot, rank); top: segments over the subroots."""

    leaves: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    height: int

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return subroots(self.top, self.height).select(F.col("subroot").alias("root"))

    def log(self) -> DataFrame:
        """(tree, position, level, index, digest): the append log of every tree, node by node."""
        most = self.height

        def nodes(batches):
            for rows in batches:
                out = []
                for tree, tier, block, n, height, total, log in rows.itertuples(index=False, name=None):
                    for level in range(1 if tier else 0, height + 1):  # its leaves stand in the tier below
                        for k in range(-(-n // ARITY**level)):
                            up, index = tier * most + level, block * ARITY ** (most - level) + k
                            out.append((tree, position(up, index, total, levels(total)), up, index, log[position(level, k, n, height)]))
                yield pd.DataFrame(out, columns=["tree", "position", "level", "index", "digest"])

        return reduce(DataFrame.unionByName, self.tiers).select("tree", "tier", "block", "n", "height", "total", "nodes").mapInPandas(nodes, "tree string, position long, level int, index long, digest string")

    def proofs(self) -> DataFrame:
        """leaves and (subroot, root, path): level by level the siblings left and right of the nodes from
        the leaf to the root, each side's digests joined."""
        span, whole = ARITY**self.height, F.lit("")
        ends = subroots(self.top, self.height).select("tree", "subroot", F.col("subroot").alias("root"), F.array().cast(_PATH).alias("path"))

        def apart(batches):
            for rows in batches:
                out = []
                for block, n, height, nodes, root, path in rows.itertuples(index=False, name=None):
                    out += [(block * span + k, root, _steps(nodes, k, n, height, path)) for k in range(n)]
                yield pd.DataFrame(out, columns=["rank", "root", "path"])

        tops = segment_paths(self.top, ends, self.height).select("block", "n", "height", "nodes", "root", "path").mapInPandas(apart, f"rank long, root string, path {_PATH}")
        tops = stored(self.subroots.join(tops, "rank").select("tree", "subroot", "root", "path"))
        segments = segment_paths(self.tiers, tops, self.height)
        segments = segments.withColumnsRenamed({c: f"_{c}" for c in segments.columns})
        names = self.leaves.columns

        def prove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            _, block, n, height, nodes, subroot, root, path = right.iloc[0].tolist()
            found = [_steps(nodes, int(k) - block * span, n, height, path) for k in left["rank"].tolist()]
            return left[names].assign(subroot=subroot, root=root, path=found)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.leaves.schema.fields)
        dealt = self.leaves.withColumn("_at", F.floor(F.col("rank") / span)).groupBy("tree", "_at")
        return dealt.cogroup(segments.groupBy("_tree", "_block")).applyInPandas(prove, f"{schema}, subroot string, root string, path {_PATH}")


def manifest(rows: DataFrame, columns: list[str], tree: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of rows by the digest of `columns`, a tree for each value of `tree` in order of
    `key`; keep: more columns of the result's leaves."""
    coded = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0")).alias("tree")
    leaves = rows.select(F.col(key), coded, leaf_digest(*map(F.col, columns)).alias("digest"), *[c.alias(n) for n, c in (keep or {}).items()])
    leaves = stored(ranked(stored(leaves), "tree", key, "digest"))
    tiers = forest(leaves.select("tree", "rank", "size", "digest"), height)
    ends = subroots(tiers, height).select(F.lit("").alias("tree"), F.col("tree").alias("sub"), F.col("subroot").alias("digest"))
    ends = stored(ranked(ends, "tree", "sub"))
    top = forest(ends.select("tree", "rank", "size", "digest"), height)
    return Manifest(leaves, tiers, ends.select(F.col("sub").alias("tree"), F.col("digest").alias("subroot"), "rank"), top, height)


# --- the query -----------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents`; rows without an id are not tampered with."""
    text = F.translate("text", _UPPER, _LOWER)
    tampered = F.when(part_of(F.col("doc_id"), 3) == 0, leaf_digest(*map(F.col, _COLUMNS[:-1]), text))
    made = manifest(table(spark, sf_dir, "documents"), _COLUMNS, keep={"tampered": tampered}).proofs()
    siblings_of = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    root = folded(F.coalesce("tampered", "digest"), F.col("path"))
    out = made.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings_of.cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
