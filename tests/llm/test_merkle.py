import hashlib
import zlib

from . import rows as R

from assay.llm import merkle as M


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def up(nodes):
    """All levels over the nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: up([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    top = up([built[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            steps = [*path(built[t], i), *path(top, k)]
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf((*r[:4], r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])))
            for a, b in steps:
                node = sha("".join([*a, node, *b]))
            out.append((r[0], own, built[t][-1][0], top[-1][0], sha("".join(x for a, b in steps for x in a + b)), node, node == top[-1][0]))
    return out


def test_positions_are_postorder():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512, 513, 700]:
        height = M.levels(n)
        log = M.append_log([str(k) for k in range(n)], height)
        levels = up([str(k) for k in range(n)])
        assert len(log) == sum(map(len, levels))
        for level, nodes in enumerate(levels):
            for k, node in enumerate(nodes):
                assert log[M.position(level, k, n, height)] == node
    part = M.append_log(["a"], 2)  # a builder of a larger tree goes on to its own height
    assert part == ["a", sha("a"), sha(sha("a"))]


def test_query_against_brute_force(spark, tmp_path):
    docs = R.documents() + [(3, "Another text with the same id"), (3, "Another text with the same id"), (None, "Also without an id"), (1000, "ÄÖ Upper"), (1001, "lower only")]
    docs += [(2000 + k, f"Text {k % 50}") for k in range(1700)]  # more than one builder a language
    sf = R.table(spark, tmp_path, docs)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*M._COLUMNS).collect()]
    df = M.op12_merkle_manifest(spark, sf)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == sorted(expected(rows), key=str)
    assert 0 < sum(not g[-1] for g in got) < len(got) / 2


def test_tiers_of_builders_and_the_log(spark):
    docs = R.frame(spark, [(k, f"t{k}") for k in range(700)])
    made = M.manifest(docs, ["doc_id", "text"], height=1)
    assert len(made.tiers) == 3
    rows = made.proofs().withColumn("folded", M.folded(M.F.col("digest"), M.F.col("path"))).collect()
    assert len(rows) == 700 and {r["folded"] for r in rows} == {made.root().first()["root"]}
    for tree, of in (("1en", 0), ("1fr", 1), ("0", 2)):
        leaves = [sha(f"{len(str(k))}:{k}{len(f't{k}')}:t{k}") for k in range(of, 700, 3)]
        log = [r["digest"] for r in made.log().where(M.F.col("tree") == tree).orderBy("position").collect()]
        assert log == M.append_log(leaves, M.levels(len(leaves)))


def test_many_trees_and_one_row(spark):
    one = spark.createDataFrame([(1, "x")], "doc_id long, lang string")
    made = M.manifest(one, ["doc_id"])
    assert made.root().collect() == made.log().select("digest").collect() and made.proofs().first()["path"] == []
    many = spark.range(300).selectExpr("id doc_id", "cast(id as string) lang", "'x' digest")
    rows = M.manifest(many, ["doc_id"]).proofs().collect()
    top = up([sha(f"{len(str(k))}:{k}") for k in sorted(range(300), key=str)])
    assert {r["root"] for r in rows} == {top[-1][0]} and {len(r["path"]) for r in rows} == {3}


def test_empty_table(spark, tmp_path):
    assert M.op12_merkle_manifest(spark, R.table(spark, tmp_path, [])).count() == 0
