"""Toxicity by maximum-scoring segments of token log-odds.

Training: among labelled documents, a token's document counts in toxic and in clean ones give its
log-odds with an informative Dirichlet prior (the pooled counts) and its z-score; tokens far
from zero in both become the model, every other token gets the small negative score that makes
the scores a likelihood ratio. Scoring: one linear pass finds every maximal-scoring segment of a
text (no larger segment scores more). The chance of a best segment as good in a clean text of
that length follows an extreme-value law, fitted to the clean training documents; a logistic curve
turns it into a probability.

Labelled rows are sampled to at most about `sample_labels`, documents are joined to that bounded
sample by broadcast, so the tokens of the model are bounded by those of that sample; texts are never shuffled.

Defined results: null text counts as empty; without a positive label every score is 0; without a
clean label every score is 1; a document labelled both ways counts as toxic.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_of, table

# Letters of any script stay, A-Z in lower case, everything else in ASCII is a gap.
_TOKENS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TOKENS).split()


def segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence of (start, end, score) runs, in linear time: a
    list of candidates, each with the sums before and through it; a new positive run merges with
    the nearest candidate that starts lower as long as it also ends lower."""
    found: list[list] = []  # start, end, sum before, sum through, link
    total = 0.0
    for start, end, score in scores:
        if score <= 0:
            total += score
            continue
        new = [start, end, total, total + score, None]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - q) for a, b, q, r, _ in found]


def passages(words: list[bytes], model: dict) -> list[tuple[int, int, float]]:
    """Maximal segments (first word, end, score) of a tokenised text."""
    known, gap = model["tokens"], model["gap"]
    runs, at = [], 0
    for i, w in enumerate(words):
        if w in known:
            if i > at:
                runs.append((at, i, gap * (i - at)))
            runs.append((i, i + 1, known[w]))
            at = i + 1
    return segments(runs)


def surprise(score: float, n: int, model: dict) -> float:
    """-ln of the chance that a clean text of n tokens has a segment with this score; 0 to 60."""
    if score <= 0:
        return 0.0
    x = math.log(model["k"] * max(1, n)) - model["lambda"] * score
    p = -math.expm1(-math.exp(min(50.0, x))) if x > -30 else math.exp(x)
    return min(60.0, -math.log(max(p, 1e-26)))


def probability(words: list[bytes], model: dict) -> float:
    if model["tokens"] is None:
        return model["base"]
    best = max((s for _, _, s in passages(words, model)), default=0.0)
    return 1 / (1 + math.exp(-(model["a"] + model["b"] * surprise(best, len(words), model))))


def train(docs: DataFrame, labels: DataFrame, where: Column, sample_labels: int = 20_000, prior: float = 50.0, least_z: float = 3.5, least_odds: float = 1.5, key: str = "doc_id") -> dict:
    """The model of the labelled rows for which `where` (over the labels' key) holds."""
    rows = labels.where(where & F.col("toxic").cast("int").isin(0, 1) & F.col(key).isNotNull())  # other labels tell nothing
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = dict(rows.groupBy("toxic").agg(F.count("*").alias("n")).collect())
    none = {"tokens": None, "base": 1.0 if count.get(1) else 0.0}
    if not count.get(1) or not count.get(0):
        return none
    share = F.when(F.col("toxic") == 1, min(1.0, sample_labels / 2 / count[1])).otherwise(min(1.0, sample_labels / 2 / count[0]))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select(F.col(key).alias("id"), "text").join(F.broadcast(chosen), "id").select("toxic", "text")

    def counted(batches):
        for b in batches:
            n = [Counter(), Counter()]
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = set(tokens(t.as_py()))
                n[y].update(words)
                n[y][b" "] += 1  # a document
            every = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([n[1][w] for w in every], pa.int64()), pa.array([n[0][w] for w in every], pa.int64())], ["w", "n1", "n0"])

    df = texts.mapInArrow(counted, "w binary, n1 long, n0 long").groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    every = df.where(F.col("w") == F.lit(b" ")).collect()
    d1, d0 = (every[0]["n1"], every[0]["n0"]) if every else (0, 0)
    if not d1 or not d0:
        return none
    pooled = (F.col("n1") + F.col("n0")) / (d1 + d0)
    y1, y0 = F.col("n1") + prior * pooled, F.col("n0") + prior * pooled
    odds = F.log(y1 / (d1 + prior - y1 + 1e-9)) - F.log(y0 / (d0 + prior - y0 + 1e-9))
    odd = df.where(F.col("w") != F.lit(b" ")).select("w", "n1", "n0", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    odd = odd.where((F.abs("z") >= least_z) & (F.abs("odds") >= least_odds))
    known = {bytes(r["w"]): float(np.clip(r["odds"], -8.0, 8.0)) for r in odd.collect()}
    model = {"tokens": known, "gap": -0.02, "lambda": 1.0, "k": 1.0, "a": 0.0, "b": 0.0}
    if not any(s > 0 for s in known.values()):
        return none | {"base": min(0.49, count[1] / (count[0] + count[1]))}

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for b in batches:
            out = []
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = tokens(t.as_py())
                out.append((y, len(words), max((s for _, _, s in passages(words, sent.value)), default=0.0), sum(w in known for w in words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.int64()), strict=True)] if out else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.float64(), pa.int64())], ["y", "n", "s", "hits"])

    got = np.array([tuple(r) for r in texts.mapInArrow(scored, "y int, n long, s double, hits long").collect()], float)
    y, n, s = got[:, 0], got[:, 1], got[:, 2]
    # The law's scale is 1 for likelihood ratios; K is what the clean texts' best segments show.
    floor = min(v for v in known.values() if v > 0)
    clean = y == 0
    model["k"] = float((np.sum(s[clean] >= floor) + 0.5) / (np.sum(n[clean]) * math.exp(-model["lambda"] * floor) + 1.0))
    x = np.array([surprise(a, int(b), model) for a, b in zip(s, n, strict=True)])
    weight = np.where(y == 1, count[1] / max(1, (y == 1).sum()), count[0] / max(1, (y == 0).sum()))
    model["a"], model["b"] = logistic(x, y, weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve a + b x by Newton's steps, with a small pull of b to 0."""
    a = b = 0.0
    weight = weight / weight.sum() * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        m = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.linalg.solve(m, [g.sum() - 1e-3 * a, (g * x).sum() - 1e-3 * b])
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, max(b, 0.0)


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", most: float = 1e-3) -> DataFrame:
    """(key, text) -> (key, score, passages array<struct<first,end,score>>): the segments whose chance
    in a clean text of that length is at most `most`, as word numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        m = sent.value
        for b in batches:
            p, found = [], []
            for t in b.column(1):
                words = tokens(t.as_py())
                p.append(probability(words, m))
                all_ = passages(words, m) if m["tokens"] is not None else []
                found.append([{"first": i, "end": j, "score": s} for i, j, s in all_ if surprise(s, len(words), m) >= -math.log(most)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(found, kind)], ["id", "score", "passages"])

    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(judged, "id long, score double, passages array<struct<first:int,end:int,score:double>>").withColumnRenamed("id", key)


def keep_clean(docs: DataFrame, model: dict, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose score is below `least`."""
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        for b in batches:
            yield b.filter(pa.array([probability(tokens(t.as_py()), sent.value) < least for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), part_of(F.col("doc_id"), 5) != 0)
    out = score(docs, model)
    held = F.coalesce(part_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
