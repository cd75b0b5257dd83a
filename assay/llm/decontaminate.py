"""Benchmark decontamination: which windows of benchmark items occur in documents, by a prefix-filtered
set join.

Words are what lies between ASCII signs, A-Z lower-cased. An item's windows are its runs of `width`
consecutive words (all its words, if fewer), and a window's set its distinct `shingle`-word shingles
(all its words, if fewer). A window occurs where at least `share` of its set lies in as many
consecutive words of a document as it has; with a share of 1 the words must be equal one by one.

1. The shingles of all windows are counted over all documents: they pass a Bloom filter of the
   windows' shingles inside the scan, and only counts are shuffled.
2. Each window's shingles are ordered by rarity. An occurrence holds at least n - ceil(share n) of
   its n shingles besides any one it lacks, so one of the first n - ceil(share n) + 1 is in it: this
   prefix (one shingle, if all must be there) is what is joined. A window with a shingle that no
   document has joins nothing.
3. Documents send the places of prefix shingles with the words around them, as far as a window that
   holds the place can reach; a second filter keeps the others back.
4. Pairs that meet in a shingle are bounded by length (the document has as many words) and by position
   (the shingle's place in the window gives where the window would begin), then verified word by
   word.

The filters have at most 2^28 bits whatever the number of items and are checked behind by exact joins.
Window tables are broadcast up to FEW rows, counted first; beyond, they are dealt in SALTS copies, so
that a passage in many documents is split.

Defined results: null and blank texts have no words; items without words have no windows; items of
one id count once, items without an id hit words but are not listed; each row of the documents is a
document of its own, whatever its key; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _MIX, U64, mix64, stored, table

WIDTH, SHINGLE = 10, 3
#: Window rows that are broadcast (some 200 bytes each); copies of each row past that.
FEW, SALTS = 100_000, 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bytes of words in a batch that is sent back.
BATCH = 4_000_000

_FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: letters and digits of ASCII and everything beyond it."""
    return raw.translate(_FOLD).split() if raw else []


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Signed 64-bit hash of the `size` words from every place on."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.full(n, U64(size), U64)
    for k in range(size):
        h += (words[k : k + n] + U64(k)) * _MIX[k]
    return mix64(h).view(np.int64)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    return [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []


# --- filters -------------------------------------------------------------------------


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter, two bits a key, of the distinct longs of the column `hash`."""
    size = LEAST_BITS
    n = hashes.count()
    while size < 16 * n and size < MOST_BITS:
        size *= 2
    place = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1))))
    places = hashes.select(place.alias("p")).select((F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("bit"))
    rows = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(U64)


def maybe_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for a hash means that it was not put in."""
    h, mask = hashes.view(U64), U64(64 * len(bits) - 1)
    low, high = h & mask, (h >> U64(32)) & mask
    test = lambda p: (bits[p >> U64(6)] >> (p & U64(63))) & U64(1)
    return (test(low) & test(high)).astype(bool)


# --- windows -------------------------------------------------------------------------


def windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(item, window) of every window and (window, words, n, shingles): the distinct windows, their words
    joined by one space, how many, and (hash, size, offsets) of the distinct shingles. Both stored."""

    def split(batches):
        for b in batches:
            rows = [(i, b" ".join(w)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in windows_of(words_of(t), width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item", "words"])

    part = pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("offsets", pa.list_(pa.int32()))])

    def sets(batches):
        for b in batches:
            n, out = [], []
            for raw in b.column(1).to_pylist():
                w = raw.split()
                size, at = min(shingle, len(w)), {}
                for k, h in enumerate(shingle_hashes(hashed(w), size).tolist()):
                    at.setdefault(h, []).append(k)
                n.append(len(w))
                out.append([{"hash": h, "size": size, "offsets": x} for h, x in at.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(out, pa.list_(part))], ["window", "words", "n", "shingles"])

    every = stored(items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).mapInArrow(split, "item string, words binary"))
    own = stored(every.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"))
    members = stored(every.distinct().join(own, "words").select("item", "window"))
    return members, stored(own.mapInArrow(sets, "window long, words binary, n int, shingles array<struct<hash: long, size: int, offsets: array<int>>>"))


def needed(n: int, share: float) -> int:
    """How many of n shingles an occurrence has at least."""
    return max(1, math.ceil(share * n - 1e-9))


def prefixes(own: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(hash, size, offsets, window, words, n): the rarest shingles of every window, one more than an
    occurrence may lack."""
    every = own.select("window", "words", "n", F.size("shingles").alias("k"), F.inline("shingles")).join(counts, "hash", "left")  # null: in no document
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "hash"))
    lacking = F.col("k") - F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("k") - 1e-9))
    return every.withColumn("rank", rank).where((F.col("rank") <= lacking + 1) & F.col("count").isNotNull()).select("hash", "size", "offsets", "window", "words", "n")


# --- documents -----------------------------------------------------------------------


def _found(raw: bytes | None, sizes: list[int], bits: np.ndarray) -> tuple[list[bytes], Iterator]:
    words = words_of(raw)
    h = hashed(words)

    def places():
        for size in sizes:
            s = shingle_hashes(h, size)
            at = np.flatnonzero(maybe_in(bits, s)) if len(s) else np.empty(0, np.int64)
            yield size, at, s[at]

    return words, places()


def _counts(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(hash, count) over all documents of the shingles that pass the filter."""

    def tally(batches):
        for b in batches:
            hits = [s for raw in b.column(0) for _, _, s in _found(raw.as_py(), sizes, bits.value)[1]]
            h, n = np.unique(np.concatenate([np.empty(0, np.int64), *hits]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["hash", "n"])

    return docs.select("text").mapInArrow(tally, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("count"))


_PLACED = "key long, n_words long, places array<struct<hash: long, at: int, first: int, context: binary>>"


def _placed(docs: DataFrame, sizes: list[int], bits, reach: int) -> DataFrame:
    """(row, key, n_words, places), stored: a row a document; a place is a shingle's word number,
    that of the first word of its context, and the context."""
    part = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("context", pa.binary())])

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(part)), strict=True)], ["key", "n_words", "places"])

    def place(batches):
        for b in batches:
            out, held = [], 0
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, hits = _found(raw.as_py(), sizes, bits.value)
                places = []
                for size, at, hashes in hits:
                    for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
                        first = max(0, p - reach + size)
                        context = b" ".join(words[first : p + reach])
                        held += len(context)
                        places.append({"hash": h, "at": p, "first": first, "context": context})
                out.append((i, len(words), places))
                if held > BATCH:
                    yield batch(out)
                    out, held = [], 0
            yield batch(out)

    return stored(docs.mapInArrow(place, _PLACED).select(F.monotonically_increasing_id().alias("row"), "*"))


def beside(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """big join small: broadcast up to FEW rows, else in SALTS parts of every key of big."""
    if small.count() <= FEW:
        return big.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")


def occurring(context: list[bytes], first: int, at: int, size: int, offsets: list[int], words: list[bytes], share: float) -> list[int]:
    """Where in the document a window begins that has its shingle at word `at`."""
    n = len(words)
    if share >= 1:
        return [at - k for k in offsets if at - k >= first and context[at - k - first : at - k - first + n] == words]
    own = {tuple(words[k : k + size]) for k in range(n - size + 1)}
    least = needed(len(own), share)
    out = []
    for start in range(max(first, at - n + size), min(at, first + len(context) - n) + 1):
        w = context[start - first : start - first + n]
        if len(own & {tuple(w[k : k + size]) for k in range(n - size + 1)}) >= least:
            out.append(start)
    return out


def _verified(pairs: DataFrame, share: float) -> DataFrame:
    """(row, window, start, n) of the windows that occur; distinct."""

    def check(batches):
        for b in batches:
            out = []
            for row, window, at, first, context, size, offsets, words, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(row, window, s, n) for s in occurring(context.split(), first, at, size, offsets, words.split(), share)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "window", "start", "n"])

    pairs = pairs.select("row", "window", "at", "first", "context", "size", "offsets", "words", "n")
    return pairs.mapInArrow(check, "row long, window long, start long, n long").distinct()


class Found:
    """documents: (row, key, n_words); hits: (row, window, start, n), stored; members: (item, window)."""

    def __init__(self, documents: DataFrame, hits: DataFrame, members: DataFrame):
        self.documents, self.hits, self.members = documents, hits, members

    def occurrences(self) -> DataFrame:
        """(row, key, item, start, n): every item window in every document, by word number."""
        return beside(self.hits, self.members, "window").join(self.documents.select("row", "key"), "row").select("row", "key", "item", "start", "n")

    def by_document(self) -> DataFrame:
        """(row, key, n_words, n_hit, items): words inside an occurrence, item ids as sorted strings."""
        spans = self.hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")).select("row", covered(F.col("spans")).alias("n_hit"))
        items = beside(self.hits.select("row", "window").distinct(), self.members, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
        out = self.documents.join(spans, "row", "left").join(items, "row", "left")
        return out.select("row", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, n)."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(acc, s):
        end = s["start"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["sum"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("sum"))

    return F.aggregate(spans, zero, add, lambda acc: acc["sum"])


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, shingle: int = SHINGLE, share: float = 1.0) -> Found:
    """Occurrences of the items' windows in documents."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    members, own = windows(items, item, item_text, width, shingle)
    sizes = [r["size"] for r in own.select(F.explode("shingles.size").alias("size")).distinct().orderBy("size").collect()]  # at most `shingle`
    all_bits = spark.sparkContext.broadcast(filter_bits(own.select(F.explode("shingles.hash").alias("hash")).distinct()))
    counts = _counts(src, sizes, all_bits)
    chosen = stored(prefixes(own, counts, share))
    bits = spark.sparkContext.broadcast(filter_bits(chosen.select("hash").distinct()))
    placed = _placed(src, sizes, bits, width)
    places = placed.where(F.size("places") > 0).select("row", "n_words", F.inline("places"))
    pairs = beside(places, chosen, "hash").where(F.col("n_words") >= F.col("n"))
    return Found(placed.select("row", "key", "n_words"), stored(_verified(pairs, share)), members)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` against the whole of `benchmark`."""
    out = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).by_document()
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
