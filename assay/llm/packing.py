"""Hierarchical multi-length packing of documents into token sequences.

Every document's ids and one end id are routed by length to a tier (256, 512, 1024 or 2048
ids; a longer document first gives off whole 2048 windows). Tiers are packed from the longest
down: an item opens a window of its tier and the gap behind it is filled from shorter tiers,
with whole items while they fit and then with the cut-off head of one, whose rest is routed
again. So every window is full; what is left when a partition ends is laid end to end and cut into
2048s and then powers of two, which need no padding. Step groups are runs of sequences of equal
token count. Each partition is packed on its own without a shuffle: its pool holds at most about
`pool_ids` ids plus one document, whatever the input's size.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed
like other documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Packed, text_chunks, vocabulary, words_of
from .common import table

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

_known: dict[str, Packed] = {}


class Encoder:
    """Ids of texts, with a bounded table of words that outlives the task in its worker: two halves, of which the older one is
    dropped when the newer is full, and words that come up again move to the newer, so frequent ones stay."""

    def __init__(self, path: str, most: int = 150_000):
        self.path, self.most, self.at_once = path, most, max(1, most // 16)
        if path not in _known:
            _known[path] = Packed(path)

    @property
    def known(self) -> dict[str, bytes]:
        return {**_known[self.path].older, **_known[self.path]}

    def __call__(self, texts: list) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(self.packed(words_of(t))), "<u4") for t in texts]

    def packed(self, words: list[str]):
        for at in range(0, len(words), self.at_once):
            part = words[at : at + self.at_once]
            now = _known[self.path]
            if len(now) + 3 * len(part) > self.most // 2:  # a word, and the two parts it is made of
                now.older = {}
                now = _known[self.path] = Packed(self.path, now)
            yield b"".join(map(now.__getitem__, part))


class Packer:
    """Items (document, start, ids, whole length) in, full sequences out."""

    def __init__(self, first: int, group_ids: int):
        self.pools = {t: deque() for t in TIERS}
        self.size, self.sequence, self.first = 0, 0, first
        self.group_ids, self.group, self.filled = group_ids, 0, 0
        self.rows: list[tuple] = []

    def add(self, item: tuple) -> None:
        doc, start, ids, total = item
        while len(ids) >= TIERS[-1]:
            self.emit([(doc, start, ids[: TIERS[-1]], total)], TIERS[-1])
            start, ids = start + TIERS[-1], ids[TIERS[-1] :]
        if len(ids):
            self.pools[next(t for t in TIERS if len(ids) <= t)].append((doc, start, ids, total))
            self.size += len(ids)

    def emit(self, items: list[tuple], tier: int) -> None:
        offset = 0
        for doc, start, ids, total in items:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.first + self.sequence, offset, tier, self.first + self.group))
            offset += len(ids)
        self.sequence += 1
        self.filled += tier
        if self.filled >= self.group_ids:
            self.group, self.filled = self.group + 1, 0

    def take(self, gap: int, tier: int) -> tuple | None:
        """A whole item of a tier up to this one that fits the gap, else the head of one."""
        shorter = [t for t in reversed(TIERS) if t <= tier and self.pools[t]]
        for t in shorter:
            if len(self.pools[t][0][2]) <= gap:
                item = self.pools[t].popleft()
                self.size -= len(item[2])
                return item
        lower = [t for t in shorter if t < tier] or shorter
        if not lower:
            return None
        doc, start, ids, total = self.pools[lower[0]].popleft()
        self.size -= len(ids)
        self.add((doc, start + gap, ids[gap:], total))
        return doc, start, ids[:gap], total

    def pack(self) -> None:
        for tier in reversed(TIERS):
            while self.pools[tier] and self.size >= tier:
                items, gap = [], tier
                while gap:
                    item = self.pools[tier].popleft() if not items else None
                    if item:
                        self.size -= len(item[2])
                    item = item or self.take(gap, tier)
                    items.append(item)
                    gap -= len(item[2])
                    if gap and not any(self.pools[t] for t in TIERS if t <= tier):
                        break
                if gap:  # nothing as short is left: these wait for more
                    for item in items:
                        self.add(item)
                    break
                self.emit(items, tier)

    def flush(self) -> None:
        rest = [x for t in reversed(TIERS) for x in self.pools[t]]
        left = sum(len(x[2]) for x in rest)
        while left:
            size = min(TIERS[-1], 1 << (left.bit_length() - 1))
            items, gap = [], size
            while gap:
                doc, start, ids, total = rest.pop(0)
                items.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.insert(0, (doc, start + gap, ids[gap:], total))
                gap -= len(items[-1][2])
            self.emit(items, size)
            left -= size
        self.pools = {t: deque() for t in TIERS}
        self.size = 0

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", pool_ids: int = 2_000_000, group_ids: int = 65_536, max_chars: int = 1_000_000, words: int = 150_000) -> DataFrame:
    """(key, text) -> a row a piece: doc_id, start, length, ids (packed uint32), doc_tokens,
    sequence_id, offset, tier (the sequence's length), step_group. `words` bounds the table of words of a worker (some 200 bytes each)."""

    def packed(batches):
        context = TaskContext.get()
        encoder, packer = Encoder(path, words), Packer((context.partitionId() if context else 0) << 36, group_ids)
        for ids, texts in text_chunks(batches, max_chars):
            for doc, got in zip(ids, encoder(texts), strict=True):
                whole = np.append(got, np.uint32(end_id))
                packer.add((doc, 0, whole, len(whole)))
                if packer.size >= pool_ids:
                    packer.pack()
            packer.pack()
            if packer.rows:
                yield packer.batch()
        packer.flush()
        if packer.rows:
            yield packer.batch()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(packed, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), vocabulary(), words=600_000)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
