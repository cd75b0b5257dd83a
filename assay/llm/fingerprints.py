"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's code points. A boundary is where it has enough zero bits: more
of them before the normal chunk size than after it, which draws chunk sizes together
(normalised chunking), between a least and a greatest size. As the hash forgets all but the last
32 code points, an insertion only moves the boundaries beside it. A fingerprint is the set of
(digest, length) of the chunks; how much of one text another contains is the length of its
chunks that the other has over the length of all its chunks.

Defined results: null text counts as empty and has the empty fingerprint; two empty fingerprints
are alike (1), an empty and another are not (0); equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, shuffle_partitions, table

LEAST, NORMAL, GREATEST = 24, 64, 256
STRICT, LOOSE = np.uint32(0b1111111 << 25), np.uint32(0b11111 << 27)  # the top bits depend on 32 code points


def gear_hash(points: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 32 of gear(points[i - k]) << k, by doubling the window five times."""
    h = mix64(points.astype(U64) + U64(0x9E3779B9)).astype(np.uint32)
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(points: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    n = len(points)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hash(points)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0].tolist() + [n]
    loose = loose.tolist() + [n]
    ends, at, i, j = [], 0, 0, 0
    while at < n:
        least, normal, last = at + LEAST, at + NORMAL, min(n, at + GREATEST)
        while strict[i] < least and strict[i] < n:
            i += 1
        end = strict[i]
        if end > normal:
            while loose[j] < normal and loose[j] < n:
                j += 1
            end = loose[j]
        at = min(end, last)
        ends.append(at)
    return ends


def chunk_digests(text: str | None) -> dict[int, int]:
    """48-bit digest -> length of the distinct chunks of a text."""
    if not text:
        return {}
    raw = text.encode("utf-32-le", "surrogatepass")
    ends = boundaries(np.frombuffer(raw, "<u4"))
    view, out, at = memoryview(raw), {}, 0
    for end in ends:
        out[xxhash.xxh3_64_intdigest(view[4 * at : 4 * end]) >> 16] = end - at
        at = end
    return out


def contained(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's length that lies in chunks b has too."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def as_text(f: dict[int, int]) -> str:
    """Sorted digest:length pairs in hex; parse() reads it back."""
    return ",".join(f"{d:012x}:{n:x}" for d, n in sorted(f.items()))


def parse(s: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in s.split(",") if x)}


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> (key, fingerprint string), in place, without a shuffle."""

    def made(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(chunk_digests(t.as_py())) for t in b.column(1)], pa.string())], ["id", "fingerprint"])

    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(made, "id long, fingerprint string").select(F.col("id").alias(key), "fingerprint")


def with_next(docs: DataFrame, consume, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """mapInArrow over every row and the row after it in order of the key (nulls first, ties by
    text; the first after the last): `consume` gets an iterator of (id, text, next text).

    Ids are cut into ranges at quantiles; a range's first row is also sent to the range before
    it, so texts are shuffled once and no task sees more than its range. The driver holds two
    numbers a range.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark) * 4
    src = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("at", F.coalesce("id", F.lit(-(1 << 63))))
    cuts = src.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.expr("CAST(array() AS array<bigint>)")
    bucket = F.size(F.filter(cuts, lambda c: c <= F.col("at")))
    heads = [tuple(r) for r in src.groupBy(bucket.alias("b")).agg(F.min("at").alias("h")).orderBy("b").collect()]
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
    sent = F.create_map(*[F.lit(x) for h in before.items() for x in h]) if before else F.expr("CAST(map() AS map<bigint,int>)")
    own = F.struct(bucket.alias("b"), F.lit(0).alias("extra"))
    also = F.struct(F.element_at(sent, F.col("at")).alias("b"), F.lit(1).alias("extra"))
    rows = src.withColumn("to", F.explode(F.when(also["b"].isNotNull(), F.array(own, also)).otherwise(F.array(own)))).select("to.b", "to.extra", "at", "id", "text")
    rows = rows.repartition(parts, "b").sortWithinPartitions("b", "extra", "at", "text").select("b", "extra", "id", "text")

    def each(batches):
        held = None
        for batch in batches:
            for b, extra, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if held is None and extra:  # copies of the next range's first row
                    continue
                t = t.as_py()
                if held is not None:
                    yield held[1], held[2], t
                held = None if extra else (b, i, t)

    return rows.mapInArrow(lambda batches: consume(each(batches)), schema)


_OP1 = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def compared(rows):
        out, size, last, known = [], 0, None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in _OP1.split(", ")]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for i, text, after in rows:
            n = len(text)
            edited = text[: n - n // 4] + after[: n // 4]
            own = known if last is text else chunk_digests(text)
            new, known, last = chunk_digests(edited), chunk_digests(after), after
            out.append((i, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(new), contained(own, new), contained(own, known)))
            size += n
            if size > 8_000_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return with_next(table(spark, sf_dir, "documents"), compared, _OP1)
