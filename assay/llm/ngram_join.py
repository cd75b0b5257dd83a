"""N-gram Jaccard join by a token-group matrix.

Documents are their sets of five-word shingles; two link when 100 * intersection >= 75 * union.
Texts with one set are one entry from the start. Then
 1. similar entries are put into groups: entries that agree in a min-hash name the most central of
    them (its min-hashes are the commonest) as leader, and each goes to its likeliest leader; those
    that the exact test confirms hang together with it;
 2. the matrix says which groups hold which tokens. Of an entry's tokens in a global order, rare
    ones first, only some three tenths are looked up: two entries that link share a twentieth of
    their size there, whatever the order is;
 3. for every entry and every group of another leader met there, the entry's overlap with the union of the
    group's tokens bounds its overlap with any member. Only a group that reaches the bound is
    opened and its members are compared exactly.
Each token's most central entry is tried first, and entries that hang together by then are not compared
again, so a group of many near copies costs a few tests a member and not all its pairs. Groups are cut into parts of some 128 members.

The order comes from a count sketch of all tokens of all documents, of a fixed size (4 Mi counters,
8 MB as sent to the tasks); its errors change the order, never the result.

Defined results: null or empty texts and texts without a word have the empty set and link with
nothing; repeated rows share their component; null ids keep a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import U64, components, cut, mix64, set_id, shingle_set, shuffle_partitions, stored, table

SHARE = 75  # of 100
COUNTERS, SEGMENT = 1 << 22, 1 << 16
BANDS, MINS = 6, 16
ALIKE = 8  # equal min-hashes of an entry and the leader whose group it joins
LIKELY = 12  # equal min-hashes of a member worth testing; others are left to the matrix
_MULTIPLY = mix64(np.arange(1, MINS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def least(n: int) -> int:
    """The smallest intersection that a set of n tokens needs to link with any other."""
    return -(-SHARE * n // 100)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> U64(40)).astype(np.int64) & (COUNTERS - 1)


def token_counts(docs: DataFrame) -> np.ndarray:
    """The sketch: how many documents have a token of each slot (up to 65535), over all documents."""
    parts = shuffle_partitions(docs.sparkSession)

    def counted(batches):
        c = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for t in b.column(0):
                c[_slots(shingle_set(t.as_py()))] += 1
        parts_ = np.minimum(c, 65535).astype("<u2").reshape(-1, SEGMENT)
        some = [i for i in range(len(parts_)) if parts_[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts_[i].tobytes() for i in some], pa.binary())], ["segment", "n"])

    def summed(batches):
        now, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())], ["segment", "n"])
        for b in batches:
            for segment, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, total = segment, np.zeros(SEGMENT, np.int64)
                total += np.frombuffer(n.as_py(), "<u2")
        if now is not None:
            yield done()

    schema = "segment int, n binary"
    rows = docs.select("text").mapInArrow(counted, schema).repartition(min(parts, COUNTERS // SEGMENT), "segment").sortWithinPartitions("segment").mapInArrow(summed, schema)
    out = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.uint16)
    for r in rows.collect():  # 8 MB at most
        out[r["segment"]] = np.frombuffer(r["n"], "<u2")
    return out.reshape(-1)


def hits(n: int) -> int:
    """How many looked-up tokens a set of n shares with one of its size that it links with."""
    return 1 + n // 20


def prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens of a set to look up: the first n - least(n) + hits(n) in the order (sketched count,
    hash). Sets that share least(n) tokens share hits(n) of these; if sizes differ, the lesser hits()."""
    return s[np.lexsort((s, counts[_slots(s)]))[: len(s) - least(len(s)) + hits(len(s))]]


def _entries(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n, mins array<int>): mins are the low 32 bits of the set's min-hashes."""

    def made(batches):
        for b in batches:
            ids, ns, mins = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                ids.append(set_id(s) if len(s) else None)
                ns.append(len(s))
                mins.append(mix64(np.array([(s * k).min() for k in _MULTIPLY])).astype(np.uint32).view(np.int32).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(mins, pa.list_(pa.int32()))], ["doc_id", "set_id", "n", "mins"])

    return docs.mapInArrow(made, "doc_id long, set_id long, n long, mins array<int>")


def _prefix_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, set_id, n), the prefixes of all entries; copies in one task are told once."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def made(batches):
        told = set()
        for b in batches:
            tokens, ids, ns = [], [], []
            for t in b.column(0):
                s = shingle_set(t.as_py())
                if not len(s) or (i := set_id(s)) in told:
                    continue
                told.add(i)
                p = prefix(s, sent.value)
                tokens.append(p)
                ids.append(np.full(len(p), i))
                ns.append(np.full(len(p), len(s), np.int32))
                if len(tokens) >= 2000:
                    yield _columns(tokens, ids, ns)
                    tokens, ids, ns = [], [], []
            if tokens:
                yield _columns(tokens, ids, ns)

    def _columns(tokens, ids, ns):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns))], ["token", "set_id", "n"])

    return docs.select("text").mapInArrow(made, "token long, set_id long, n int")


def _compare(docs: DataFrame, groups: DataFrame, queries: DataFrame, reps: DataFrame, chunk: int = 512) -> DataFrame:
    """groups and queries (grp, set_id, comp) -> (src, dst): for each query a link to every other
    component that members of the group bring. A group is sent once for every `chunk` queries, and
    streams by before them; so a task holds one group, however many queries it has. The overlap with
    the union bounds that with any member; past the bound one lookup counts all members'."""
    parts = shuffle_partitions(docs.sparkSession)
    size = queries.groupBy("grp").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    q = queries.join(size, "grp").select("grp", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "set_id", "comp")
    m = groups.join(size, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "set_id", "comp")
    asked = m.unionByName(q).join(reps.select("set_id", F.col("rep").alias("doc")), "set_id")
    need = cut(asked)
    wanted = need.select("doc").distinct()
    blocks = bloom.block_count(wanted.count())
    texts = bloom.passing(docs.where("doc_id is not null"), F.col("doc_id"), bloom.build(wanted, F.col("doc"), blocks), blocks)
    rows = need.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("grp", "chunk", "role", "set_id", "comp", "text")
    rows = rows.repartition(parts, "grp", "chunk").sortWithinPartitions("grp", "chunk", "role")

    def compared(batches):
        now, members, tokens = None, [], None
        for b in batches:
            src, dst = [], []
            for grp, chunk_, role, i, comp, t in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5), strict=True):
                s = shingle_set(t.as_py())
                if set_id(s) != i:  # another row of the same id
                    continue
                if (grp, chunk_) != now:
                    now, members, tokens = (grp, chunk_), [], None
                if role == 0:
                    members.append((i, comp, s))
                    continue
                if not members:
                    continue
                if tokens is None:
                    tokens = np.concatenate([x for *_, x in members])
                    order = np.argsort(tokens, kind="stable")
                    tokens, owner = tokens[order], np.repeat(np.arange(len(members)), [len(x) for *_, x in members])[order]
                    sizes = np.array([len(x) for *_, x in members])
                lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                n = hi - lo
                if np.count_nonzero(n) < least(len(s)):  # the group need not be opened
                    continue
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(members))
                met = set()
                for j in np.flatnonzero(100 * both >= SHARE * (sizes + len(s) - both)):
                    other, its, _ = members[j]
                    if other != i and its != comp and its not in met:
                        met.add(its)
                        src.append(i)
                        dst.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows.mapInArrow(compared, "src long, dst long")


def _enough(n: Column, shared: Column) -> Column:
    """Whether so many shared looked-up tokens leave a set of n a chance: hits() of the smallest set that
    it can link with."""
    return shared >= 1 + F.floor(F.ceil(SHARE * n / 100) / 20)


def _fits(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SHARE * F.greatest(a, b)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = 128) -> DataFrame:
    """(key, text) -> (key, n_shingles, component_id)."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = cut(_entries(src))
    reps = every.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("mins").alias("mins"))
    reps = cut(reps)
    counts = token_counts(src)

    # 1. groups: the likeliest of the leaders that an entry shares a min-hash with, if it holds
    bands = reps.select("set_id", "n", "mins", F.posexplode(F.slice("mins", 1, BANDS)).alias("band", "low"))
    # an entry whose min-hashes are common stands in the middle of its like: it leads
    common = bands.groupBy("band", "low").agg(F.count("*").alias("k"))
    central = bands.join(common, ["band", "low"]).groupBy("set_id").agg(F.sum("k").alias("score"))
    bands = bands.join(central, "set_id")
    lead = bands.groupBy("band", "low").agg(F.max(F.struct("score", "set_id", "n", "mins")).alias("lead"))
    pairs = bands.join(lead, ["band", "low"]).where((F.col("set_id") != F.col("lead.set_id")) & _fits(F.col("n"), F.col("lead.n")))
    same = F.size(F.filter(F.zip_with("mins", "lead.mins", lambda a, b: a == b), lambda x: x))
    pairs = pairs.select("set_id", F.struct(same.alias("same"), F.col("lead.score").alias("score"), F.col("lead.set_id").alias("grp")).alias("to")).where(F.col("to.same") >= ALIKE)
    alike = cut(pairs.groupBy("set_id").agg(F.max("to").alias("to")).select("set_id", F.col("to.grp").alias("lead"), "to.same"))
    alone = lambda df: df.withColumn("comp", F.col("set_id"))
    pairs = alike.where(F.col("same") >= LIKELY).select(F.col("lead").alias("grp"), "set_id")
    stars = cut(_compare(src, alone(pairs.select("grp", F.col("grp").alias("set_id")).distinct()), alone(pairs), reps))

    # 2. the matrix: tokens that entries of different groups look up
    rows = _prefix_rows(src, counts)
    w = Window.partitionBy("token")
    shared = rows.withColumns({"lo": F.min("set_id").over(w), "hi": F.max("set_id").over(w)}).where("lo < hi").select("token", "set_id", "n").distinct()
    led = stars.select(F.col("src").alias("set_id"), F.col("dst").alias("up"))
    led = led.join(led.select(F.col("set_id").alias("up"), F.col("up").alias("top")), "up", "left").select("set_id", F.coalesce("top", "up").alias("comp"))
    score = cut(central)
    cells = stored(shared.join(led, "set_id", "left").join(score, "set_id").withColumn("comp", F.coalesce("comp", "set_id")))
    # 3. entry and group, with sizes that can link: first only each token's most central entry
    lead = cells.groupBy("token").agg(F.max(F.struct("score", "comp", "set_id", "n")).alias("lead"))
    pairs = cells.join(lead, "token").where((F.col("comp") != F.col("lead.comp")) & _fits(F.col("n"), F.col("lead.n")))
    pairs = pairs.groupBy(F.col("lead.set_id").alias("grp"), "set_id").agg(F.max("n").alias("n"), F.count("*").alias("k"))
    pairs = cut(pairs.where(_enough(F.col("n"), F.col("k"))).select("grp", "set_id"))
    more = cut(_compare(src, alone(pairs.select("grp", F.col("grp").alias("set_id")).distinct()), alone(pairs), reps))

    # then every entry and the groups that hold what it is not joined to yet, by their unions
    first = components(stars.unionByName(more)).withColumnRenamed("id", "set_id").withColumnRenamed("component", "comp")
    sizes = alike.groupBy("lead").agg(F.ceil((F.count("*") + 1) / part).alias("parts"))
    of = reps.select("set_id").join(alike.select("set_id", "lead"), "set_id", "left").withColumn("lead", F.coalesce("lead", "set_id")).join(sizes, "lead", "left")
    of = of.select("set_id", F.xxhash64("lead", F.pmod(F.xxhash64("set_id"), F.coalesce("parts", F.lit(1)))).alias("grp")).join(first, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    of = cut(of)
    cells = cells.select("token", "set_id", "n").join(of, "set_id")
    cells = cells.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).where("lo < hi").select("token", "set_id", "n", "comp", "grp")
    bounds = cells.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    q, g = cells.alias("q"), bounds.alias("g")
    news = (F.col("g.lo") != F.col("q.comp")) | (F.col("g.hi") != F.col("q.comp"))
    met = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.grp") >= F.col("g.grp")) & news & (100 * F.col("g.high") >= SHARE * F.col("q.n")) & (100 * F.col("q.n") >= SHARE * F.col("g.low")))
    met = met.groupBy(F.col("g.grp").alias("grp"), F.col("q.set_id").alias("set_id"), F.col("q.comp").alias("comp")).agg(F.max("q.n").alias("n"), F.count("*").alias("k"))
    met = cut(met.where(_enough(F.col("n"), F.col("k"))).select("grp", "set_id", "comp"))
    found = _compare(src, of.join(met.select("grp").distinct(), "grp", "left_semi"), met, reps)

    whole = components(stars.unionByName(more).unionByName(found)).withColumnRenamed("id", "set_id")
    named = reps.join(whole, "set_id", "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "component").select("set_id", "component_id")
    out = every.join(named, "set_id", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
