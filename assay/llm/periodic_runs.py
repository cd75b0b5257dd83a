"""Periodic runs of words: scale-tiled search for stretches that repeat themselves.

A run is a stretch of consecutive words with smallest period q that is at least max(24, 3 q) words
long and that no neighbouring word extends. In the space of matches (words i and i + q are
identical) it is a stretch of at least max(24 - q, 2 q) positions.

Every document is exploded into overlapping tiles per octave of the period: for periods from B to
2 B (1 to 15 for the first octave, B = 8) a tile around every B-th word, from B words before that
boundary to 4 B after it. A match stretch of such a period holds a boundary that is followed by B
matching words, so a tile with no repeated B-word gram after its boundary has no run; the others are
solved on their own by Z-functions of the boundary, forwards and backwards. What a tile finds is a
fragment (period, matching positions); periods whose block repeats a shorter one are dropped there.
A tile reads its document's words only, so tiles are solved where the document is, and the
fragments are shuffled by document and period and stitched: fragments of one run overlap, those of
two runs of one period never touch. Work and memory are O(n log n) and O(n) for n words.

Words are compared by number, one for each distinct word of a document: results are exact. Gram
hashes only choose tiles.

Defined results: null, empty and blank texts have no words and no runs; each row is a document of
its own, whatever its key (null and repeated keys too); other columns are not read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, mix64, stored, table

LEAST, TIMES, BASE = 24, 3, 8
#: With more shifts than this a tile's whole Z-function is computed, else the values asked for.
FEW = 8
_K = U64(0x9E3779B97F4A7C15)
#: Bytes of text in a batch that is sent back.
BATCH = 8_000_000

_RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"
_TILED = "key long, n_words long, words_sha256 string, text binary, fragments array<struct<period: int, first: int, last: int>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words of the list only."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def z_values(x: np.ndarray, shifts: list[int]) -> dict[int, int]:
    """Shift -> length of the longest common prefix of x and x[shift:]."""
    n = len(x)
    if len(shifts) <= FEW:
        out = {}
        for s in shifts:
            differ = x[s:] != x[: n - s]
            at = int(differ.argmax()) if n > s else 0
            out[s] = at if n > s and differ[at] else n - s
        return out
    w, z, left, right = x.tolist(), [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return {s: z[s] for s in shifts}


@lru_cache(100_000)
def prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def solve(words: np.ndarray, c: int, size: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """The tile at boundary c of an octave of that size: (period, first, last + 1 of the matching
    positions) of the given periods, as far as the tile reaches."""
    n, low = len(words), max(0, c - size)
    ahead = words[c : c + 4 * size]
    if len(periods) > FEW:  # the tile may repeat something short, whose multiples go at once
        d = int(np.diff(periods).min())
        if (ahead[d : 2 * size] == ahead[: len(ahead[d : 2 * size])]).all():
            periods = [q for q in periods if q == d or q % d]
    shorter = {q: [q // p for p in prime_factors(q)] for q in periods}
    forward = z_values(ahead, sorted({*periods}.union(*shorter.values())))
    periods = [q for q in periods if forward[q] >= size and all(forward[d] < q - d for d in shorter[q])]
    if not periods:
        return []
    m, top = c - low, min(n, c + 2 * size)
    behind = np.concatenate([words[low:c][::-1], [-1], words[low:top][::-1]])
    back = z_values(behind, [m + 1 + top - c - q for q in periods])
    out = []
    for q in periods:
        after, before = forward[q], back[m + 1 + top - c - q]
        if before < m and after < len(ahead) - q and before + after + q < max(LEAST, TIMES * q):
            continue  # whole, and too short
        out.append((q, c - before, c + after))
    return out


def tiles(words: np.ndarray):
    """(boundary, octave size, periods) of the tiles that may hold a part of a run."""
    n, size = len(words), BASE
    if n < LEAST:
        return
    gram, have = mix64(words.astype(U64) + U64(1)), 1
    while TIMES * size <= n or size == BASE:
        while have < size:
            gram = gram[:-have] * (_K + U64(2 * have)) + gram[have:]
            have *= 2
        last = n - size  # where the last gram starts
        rows = np.zeros((last // size + 2) * size, U64)
        rows[: last + 1] = gram
        rows = rows.reshape(-1, size)
        found = []
        k, j = np.nonzero(rows[1:] == rows[:-1, :1])
        found.append((k * size, j + size))
        if size == BASE:
            k, j = np.nonzero(rows[:, 1:] == rows[:, :1])
            found.append((k * size, j + 1))
        at, q = (np.concatenate(x) for x in zip(*found, strict=True))
        real = (at + q <= last) & (TIMES * q <= n)
        if real.any():
            at, q = at[real], q[real]
            order = np.lexsort((q, at))
            at, q = at[order], q[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for c, periods in zip(at[starts].tolist(), np.split(q, starts[1:]), strict=True):
                yield c, size, periods.tolist()
        size *= 2


def fragments(words: np.ndarray) -> list[tuple[int, int, int]]:
    return [f for c, size, periods in tiles(words) for f in solve(words, c, size, periods)]


def tiled(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(row, key, n_words, words_sha256, text, fragments), stored: a row a document; the text (UTF-8)
    of those that have fragments, or of all (whole), and the digest of the words joined by one space."""

    def made(batches):
        for b in batches:
            out, size = [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py()
                words = raw.split() if raw else []  # bytes: the six ASCII white-space characters
                found = fragments(numbered(words)) if len(words) >= LEAST else []
                out.append((i, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), raw if found or whole else None, [dict(zip(("period", "first", "last"), f, strict=True)) for f in found]))
                size += len(raw or b"") if found or whole else 100
                if size > BATCH:
                    yield _batch(out)
                    out, size = [], 0
            yield _batch(out)

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return stored(src.mapInArrow(made, _TILED).select(F.monotonically_increasing_id().alias("row"), "*")).withColumnRenamed("key", key)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part = pa.struct([("period", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(part)]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ("key", "n_words", "words_sha256", "text", "fragments")])


def stitched(found: DataFrame) -> DataFrame:
    """tiled() -> (row, start, length, period): the runs, from fragments joined by document and period."""
    parts = found.select("row", F.inline("fragments"))
    w = Window.partitionBy("row", "period").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("opens", F.when(F.col("first") <= before, 0).otherwise(1))
    parts = parts.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("row", "period", "island").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    runs = runs.select("row", F.col("start").cast("long").alias("start"), length.cast("long").alias("length"), F.col("period").cast("long").alias("period"))
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def runs_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, period): a row a run of every document."""
    found = tiled(docs, key, text)
    return stitched(found).join(found.select("row", key), "row").select(key, "start", "length", "period")


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run (start, length, period) holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _with_runs(found: DataFrame) -> DataFrame:
    """Documents with fragments, and their runs in order; texts are shuffled for these only."""
    own = stitched(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return found.where(F.size("fragments") > 0).drop("fragments").join(own, "row", "left")


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_runs), a row a document: a text with runs has them cut down to one period and
    one space between its words; any other text (null too) stays as it is."""
    found = tiled(docs, key, text, whole=True)
    cut_down = F.pandas_udf(_collapsed, "string")
    n = F.coalesce(F.size("runs"), F.lit(0))
    some = _with_runs(found).withColumn("n_runs", F.when(F.col("runs").isNull(), 0).otherwise(n))
    some = some.select(key, F.when(F.col("n_runs") > 0, cut_down("text", F.coalesce("runs", F.array().cast(_RUNS)))).otherwise(F.col("text").cast("string")).alias(text), "n_runs")
    return some.unionByName(found.where(F.size("fragments") == 0).select(key, F.col("text").cast("string").alias(text), F.lit(0).alias("n_runs")))


def _collapsed(texts: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([b" ".join(kept_words(t.split(), [(x["start"], x["length"], x["period"]) for x in r])).decode("utf-8", "replace") for t, r in zip(texts, runs, strict=True)])


# --- the query -----------------------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"
_OP13 = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def edited(key: Column, text: Column) -> Column:
    """The text of the contract: where h % 10 = 0 the words from a on repeat the p words after a."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, (a + F.pmod(i, p)).cast("int")))
        return F.concat_ws(" ", F.slice(w, F.lit(1), a), tail)

    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text)), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, bound).otherwise(text)


def best(runs: list[tuple[int, int, int]]) -> tuple:
    """(start, length, period, exponent in thousandths) of the run (start, length, period) with the
    greatest exact exponent; ties: smallest start, then period; four nulls without a run."""
    if not runs:
        return None, None, None, None
    start, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, q, 1000 * length // q


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` after the contract's edit; null text: no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", edited(F.col("doc_id"), F.col("text")).alias("text"))
    found = tiled(docs)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def digests(batches):
        for b in batches:
            out = []
            for i, t, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                runs = [(x["start"], x["length"], x["period"]) for x in r or ()]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rest = b" ".join(kept_words(t.as_py().split(), runs))
                out.append((i, len(runs), *best(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _OP13.split(", ")])

    some = _with_runs(found).select("doc_id", "text", "runs").mapInArrow(digests, _OP13)
    none = F.lit(None).cast("long")
    rest = found.where(F.size("fragments") == 0).select("doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("words_sha256").alias("collapsed_sha256"))
    return some.unionByName(rest)
