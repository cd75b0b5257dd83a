"""Language identification: averaged embeddings of hashed subwords under a linear softmax,
trained by stochastic gradient descent, with calibrated rejection.

A text's features are the shares of its hashed character 2-, 3- and 4-grams (lower case, runs of
anything but letters as one blank), over the whole text. The classifier is fitted on the driver
on a sample of labelled rows bounded by `sample_docs`; predictions run in the tasks and only use
the text. A part of the sample sets the temperature of the probabilities and the score below
which a prediction is marked as not accepted.

Defined results: a text that is null or has no letter is `und` with score 0, not accepted; with no
labelled row every text is `und`; with one language every text with a letter is that language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_of, table

BUCKETS, DIMS = 1 << 13, 16
GAPS = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Counts of the hashed subwords by bucket; None for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = (" " + GAPS.sub(" ", text.lower()) + " ").encode("utf-32-le", "surrogatepass")
    p = np.frombuffer(raw, "<u4").astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    h = p * np.uint32(0x9E3779B1)
    for n in (1, 2, 3):
        if len(p) <= n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + p[n:] * np.uint32(0xC2B2AE3D)
        out += np.bincount((h ^ (h >> np.uint32(13))) >> np.uint32(19), minlength=BUCKETS)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample_features(docs: DataFrame, per_lang: int, key: str) -> list:
    """(lang, counts) of at most about per_lang rows of each language, chosen by a hash of the key."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))])
    chosen = docs.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)

    def made(batches):
        for b in batches:
            got = [(lang.as_py(), features(t.as_py())) for lang, t in zip(b.column(0), b.column(1), strict=True)]
            got = [(lang, np.flatnonzero(f), f) for lang, f in got if f is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1].astype("<u2").tobytes() for x in got], pa.binary()), pa.array([x[2][x[1]].astype("<f4").tobytes() for x in got], pa.binary())], ["lang", "at", "n"])

    return chosen.select("lang", "text").mapInArrow(made, "lang string, at binary, n binary").collect()


def fit(rows: list, epochs: int = 12, batch: int = 32, rate: float = 30.0, seed: int = 7) -> dict | None:
    """The classifier of (lang, at, n) rows: score table per bucket, bias, temperature, least score."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    y = np.array([langs.index(r[0]) for r in rows])
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        v = np.frombuffer(r[2], "<f4")
        x[i, np.frombuffer(r[1], "<u2")] = v / v.sum()
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    train = order[len(rows) // 5 :] if len(rows) >= 50 else order
    e = rng.uniform(-1, 1, (BUCKETS, DIMS)).astype(np.float32) / DIMS
    w, bias = np.zeros((DIMS, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = max(1, epochs * -(-len(train) // batch))
    done = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            pick = train[at : at + batch]
            r = rate * (1 - done / steps)
            xb = x[pick]
            hidden = xb @ e
            d = softmax(hidden @ w + bias)
            d[np.arange(len(pick)), y[pick]] -= 1
            d /= len(pick)
            grad = np.clip(xb.T @ (d @ w.T), -0.05, 0.05)
            w -= r * 0.1 * (hidden.T @ d)
            bias -= r * 0.01 * d.sum(axis=0)
            e -= r * grad
            done += 1
    logits = x[held] @ (e @ w) + bias
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    least = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return {"langs": langs, "table": e @ w / t, "bias": bias / t, "least": least}


def predict(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> (key, lang_pred, score, accepted)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        m = sent.value
        for b in batches:
            lang, score, ok = [], [], []
            for t in b.column(1):
                f = features(t.as_py()) if m else None
                if f is None:
                    lang.append("und")
                    score.append(0.0)
                    ok.append(False)
                    continue
                p = softmax(f.astype(np.float32) @ m["table"] / max(1, f.sum()) + m["bias"])
                lang.append(m["langs"][int(p.argmax())])
                score.append(float(min(1.0, p.max())))
                ok.append(bool(p.max() >= m["least"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["id", "lang_pred", "score", "accepted"])

    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(judged, "id long, lang_pred string, score double, accepted boolean").withColumnRenamed("id", key)


def train(docs: DataFrame, where: Column, sample_docs: int = 4000, key: str = "doc_id") -> dict | None:
    """Fits on at most about `sample_docs` of the rows with a language for which `where` holds."""
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("id"), "lang", "text")
    n = max(1, rows.select("lang").distinct().count())
    return fit(sample_features(rows, max(1, sample_docs // n), "id"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, F.coalesce(part_of(F.col("doc_id"), 4) != 2, F.lit(True)))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(part_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
