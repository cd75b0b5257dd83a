"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of at most 2 (1 - c). The vectors are
rotated (principal axes of a bounded sample) and cut into blocks; every block gets a share of
that distance in proportion to its variance. If two vectors are near, then in some block they are
within its share, so a range join of every block finds every pair: the first axes of a block make a
grid, a vector lives in its cell and visits the later neighbours that its range reaches. Pairs of
a cell are compared in tiles of bounded size, by block distance in single precision with slack, then exactly by cosine in double
precision; a pair counts in the first block that has it within its share, so nothing needs a
distinct. A tile returns sums of links and a spanning forest, never its pairs.

Equal vectors are one entry with a count from the start. The sample only turns the axes and sets
shares that always add up: it changes the work, never the result.

Defined results: vectors that are null, empty, zero or have null or non-finite components, rows
with a null id, and vectors of different lengths link with nothing; repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

GRID = 2  # axes of a block's grid
NUMBERS = 4_000_000  # of a tile's vectors
ROWS, SLACK = 512, 1e-5  # rows compared at once; what single precision may be wrong by, before the exact check
_TILES = "a long, b long, link boolean"


def axes(rows: list, dim: int, least: float, blocks: int) -> dict:
    """Rotation (dim x dim, columns in block order), block bounds and squared shares."""
    blocks = max(1, min(blocks, dim // GRID))
    x = np.array(rows, float).reshape(-1, dim)
    if len(x) > dim:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        values, turn = np.linalg.eigh(np.cov(x.T).reshape(dim, dim))
        values, turn = np.maximum(values[::-1], 1e-9), turn[:, ::-1]
    else:
        values, turn = np.ones(dim), np.eye(dim)
    to = np.arange(dim) % (2 * blocks)
    to = np.where(to < blocks, to, 2 * blocks - 1 - to)  # dealt to and fro, so that blocks are alike
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(blocks + 1))
    share = np.add.reduceat(values[order], bounds[:-1])
    return {"turn": turn[:, order], "bounds": bounds, "budget": 2 * (1 - least) * share / share.sum() + 1e-9}


def route(x: np.ndarray, m: dict) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, row numbers, cells, role) for unit vectors; role 0 lives in the cell, 1 visits it."""
    y = x @ m["turn"]
    out = []
    for b, first in enumerate(m["bounds"][:-1]):
        r = float(np.sqrt(m["budget"][b])) * (1 + 1e-9)
        width = 2 * r
        p = y[:, first : first + GRID] / width
        if p.shape[1] < GRID:
            p = np.hstack([p, np.zeros((len(p), GRID - p.shape[1]))])
        c = np.floor(p).astype(np.int64)
        low, high = p - c, 1 - (p - c)  # to the cell's edges, in widths
        rows = np.arange(len(x))
        out.append((b, rows, c, np.zeros(len(x), np.int32)))
        for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
            d2 = (high[:, 0] ** 2 if dx else 0) + (high[:, 1] ** 2 if dy > 0 else low[:, 1] ** 2 if dy < 0 else 0)
            near = np.flatnonzero(d2 <= 0.25 * (1 + 1e-9))
            out.append((b, near, c[near] + np.array([dx, dy]), np.ones(len(near), np.int32)))
    return out


def near_pairs(x1: np.ndarray, x2: np.ndarray, within: bool, block: int, m: dict, least: float):
    """(i, j) of the rows of two tiles that link and first meet in this block."""
    n1, n2 = np.linalg.norm(x1, axis=1), np.linalg.norm(x2, axis=1)
    y1, y2 = (x1 / n1[:, None]) @ m["turn"], (x2 / n2[:, None]) @ m["turn"]
    a, z = m["bounds"][block], m["bounds"][block + 1]
    b1, b2 = y1[:, a:z].astype(np.float32), y2[:, a:z].astype(np.float32)
    half, most = (b2 * b2).sum(axis=1) / 2, np.float32(m["budget"][block] + SLACK)
    out = []
    for at in range(0, len(x1), ROWS):  # the table of distances is never whole
        one = b1[at : at + ROWS]
        near = one @ b2.T >= ((one * one).sum(axis=1) - most)[:, None] / 2 + half[None, :]
        if within:
            near &= np.arange(len(x2))[None, :] > np.arange(at, at + len(one))[:, None]
        i, j = np.nonzero(near)
        for k in range(0, len(i), 20_000):
            p, q = i[k : k + 20_000] + at, j[k : k + 20_000]
            each = np.add.reduceat((y1[p] - y2[q]) ** 2, m["bounds"][:-1], axis=1) <= m["budget"]
            ok = each[:, block] & ~each[:, :block].any(axis=1)
            ok &= np.einsum("ij,ij->i", x1[p], x2[q]) / (n1[p] * n2[q]) >= least
            out.append((p[ok], q[ok]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, blocks: int = 4, tile: int = 8000, sample_rows: int = 10_000) -> DataFrame:
    """(key, embedding) -> (key, n_links, component_id, kept)."""
    src = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"  # as they travel
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall("v", lambda x: x == 0)
    good = F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & ~odd & ~zero, F.lit(False))
    src = src.withColumn("cid", F.when(good, F.xxhash64("v", F.size("v"))))
    entries = src.where("cid is not null").select("cid", "vec_id", "v").distinct()
    entries = cut(entries.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("m"), F.first("v").alias("v")))
    n = entries.count()
    sample = entries.where(F.pmod(F.xxhash64("cid"), F.lit(1_000_003)) < min(1.0, sample_rows / max(1, n)) * 1_000_003)
    by_dim: dict[int, list] = {r["d"]: [] for r in entries.select(F.size("v").alias("d")).distinct().collect()}
    for r in sample.select("v").collect():
        by_dim[len(r["v"])].append(r["v"])
    models = {d: axes(rows, d, least, blocks) for d, rows in by_dim.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def routed(batches):
        for b in batches:
            ids, ms = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            lists = [np.array(x, float) for x in b.column(2).to_pylist()]
            for d in {len(x) for x in lists}:
                pick = np.array([i for i, x in enumerate(lists) if len(x) == d])
                raw = np.stack([lists[i] for i in pick])
                packed = np.array([x.tobytes() for x in raw.astype(kind)], object)
                for block, rows, c, role in route(raw / np.linalg.norm(raw, axis=1, keepdims=True), sent.value[d]):
                    if len(rows):
                        at = pick[rows]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), block, np.int32)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(role), pa.array(ids[at]), pa.array(ms[at]), pa.array(packed[rows].tolist(), pa.binary())], ["dim", "block", "cx", "cy", "role", "cid", "m", "v"])

    rows = cut(entries.select("cid", "m", "v").mapInArrow(routed, "dim int, block int, cx long, cy long, role int, cid long, m long, v binary"))
    cell = ["dim", "block", "cx", "cy"]
    fits = F.least(F.lit(tile), F.floor(F.lit(NUMBERS) / F.col("dim")) + 1)  # vectors of a tile
    size = rows.groupBy(*cell).agg(F.sum((F.col("role") == 0).cast("int")).alias("s"), F.sum("role").alias("q"))
    size = size.withColumns({c: F.ceil(F.col(c) / fits).cast("int") for c in ("s", "q")})
    large = size.where("s > 1 or q > 1")
    dealt = rows.join(large, cell, "left").withColumns({"s": F.greatest(F.coalesce("s", F.lit(1)), F.lit(1)), "q": F.greatest(F.coalesce("q", F.lit(1)), F.lit(1))})
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("cid"), F.when(F.col("role") == 0, F.col("s")).otherwise(F.col("q"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    to = lambda k, i, j: F.struct(F.lit(k).alias("kind"), i.alias("i"), j.alias("j"))
    salt = F.col("salt")
    small = F.array(to(0, F.lit(0), F.lit(0)))
    homes = F.concat(F.transform(every(F.col("s")), lambda k: to(1, F.least(k, salt), F.greatest(k, salt))), F.transform(every(F.col("q")), lambda k: to(2, salt, k)))
    visits = F.transform(every(F.col("s")), lambda k: to(2, k, salt))
    dealt = dealt.withColumn("to", F.explode(F.when((F.col("s") == 1) & (F.col("q") == 1), small).when(F.col("role") == 0, homes).otherwise(visits)))
    dealt = dealt.select(*cell, "to.kind", "to.i", "to.j", "role", "salt", "cid", "m", "v")

    def tiled(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        m, block = sent.value[int(first["dim"])], int(first["block"])
        x = np.stack([np.frombuffer(v, kind) for v in pdf["v"]]).astype(float)
        role, salt_ = pdf["role"].to_numpy(), pdf["salt"].to_numpy()
        home, visit = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        tasks = []
        if first["kind"] == 1 and first["i"] != first["j"]:
            tasks.append((home[salt_[home] == first["i"]], home[salt_[home] == first["j"]], False))
        elif first["kind"] in (0, 1):
            tasks.append((home, home, True))
        if first["kind"] in (0, 2):
            tasks.append((home, visit, False))
        ii, jj = [], []
        for p, q, within in tasks:
            if len(p) and len(q):
                i, j = near_pairs(x[p], x[q], within, block, m, least)
                ii.append(p[i])
                jj.append(q[j])
        i, j = (np.concatenate(ii), np.concatenate(jj)) if ii else (np.empty(0, int), np.empty(0, int))
        ids, count = pdf["cid"].to_numpy(), pdf["m"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, i, count[j])
        np.add.at(links, j, count[i])
        root = roots(len(pdf), i, j)
        some, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(pdf)))
        return pd.DataFrame({"a": np.concatenate([ids[some], ids[joined]]), "b": np.concatenate([links[some], ids[root[joined]]]), "link": np.r_[np.zeros(len(some), bool), np.ones(len(joined), bool)]})

    found = cut(dealt.groupBy(*cell, "kind", "i", "j").applyInPandas(tiled, _TILES))
    links = found.where("not link").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    whole = components(found.where("link").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "cid")
    named = entries.select("cid", "rep", "m").join(whole, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "component").join(links, "cid", "left").select("cid", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = src.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
