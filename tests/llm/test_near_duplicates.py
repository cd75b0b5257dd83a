import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from . import rows as R

from assay.llm import embed_dedup, line_dedup, lines, ngram_join
from assay.llm.common import components, shingle_set


def _groups(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _ngram_docs():
    r = random.Random(3)
    docs = R.documents()
    passage = R.words(77, 60)
    for g in range(6):
        base = R.words(200 + g, r.randrange(20, 90)).split()
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"new{r.randrange(900)}"
            docs.append((1000 + 20 * g + k, " ".join(w)))
    docs += [(2000 + k, R.words(300 + k, 80) + " " + passage) for k in range(30)]
    docs += [(3000 + k, R.words(400, 40)) for k in range(25)]
    return docs


def test_ngram_join_against_brute_force(spark, tmp_path):
    docs = _ngram_docs()
    got = {r["doc_id"]: r for r in ngram_join.op9_ngram_jaccard(spark, R.table(spark, tmp_path, docs)).collect()}
    sets = [set(shingle_set(t).tolist()) for _, t in docs]
    edges = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and docs[a][0] is not None and docs[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = _groups(len(docs), edges)
    for k, (i, _) in enumerate(docs):
        assert got[i]["n_shingles"] == len(sets[k])
        if i is not None:
            assert got[i]["component_id"] == min(docs[j][0] for j in range(len(docs)) if root[j] == root[k] and docs[j][0] is not None), i
    assert got[8]["component_id"] == got[9]["component_id"] == 8
    assert ngram_join.op9_ngram_jaccard(spark, R.table(spark, tmp_path / "e", [])).count() == 0


def test_embeddings_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 64))
    rows = [(i, base[i].tolist()) for i in range(120)]
    for k in range(500):
        v = base[k % 9] if k < 300 else base[k % 120]
        rows.append((1000 + k, (v * r.uniform(0.5, 2) + r.normal(size=64) * r.choice([0.02, 0.2, 0.3, 0.33])).tolist()))
    rows += [(5000 + k, base[0].tolist()) for k in range(40)]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 63 + [float("inf")], [1.0, None] * 32]
    rows += [(9000 + k, v) for k, v in enumerate(bad)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["vec_id"]: x for x in embed_dedup.op8_embedding_dedup(spark, str(tmp_path)).collect()}
    small = {x["vec_id"]: x for x in embed_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), tile=37).collect()}
    assert got == small
    x = np.array([v for _, v in rows[: -len(bad)]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 1000
    root = _groups(len(x), zip(*np.nonzero(near), strict=True))
    for k, (i, _) in enumerate(rows[: -len(bad)]):
        assert got[i]["n_links"] == near[k].sum()
        assert got[i]["component_id"] == rows[root[k]][0] and got[i]["kept"] == (root[k] == k)
    for k in range(len(bad)):
        assert got[9000 + k]["n_links"] == 0 and got[9000 + k]["component_id"] == 9000 + k


def test_embeddings_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _lines(text):
    """The normalised lines of a text, written out plainly."""
    kept = "".join(c.lower() if "A" <= c <= "Z" else c if c == "\n" or c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "")
    return [" ".join(x.split(" ")).strip() and " ".join(w for w in x.split(" ") if w) for x in kept.split("\n")]


def test_lines_against_brute_force(spark):
    docs = [x for x in R.documents() if len(x[1] or "") < 5000]
    docs += [(700 + k, "\n".join([R.words(600 + k, 12), "a licence line with many words in it that only differs by " + "abcdefgh"[k % 8], "short", ""])) for k in range(16)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(R.frame(spark, docs), removed="gone").collect()}
    occ = [(i, no, x) for i, t in docs if i is not None and t is not None for no, x in enumerate(_lines(t)) if len(x.encode()) >= 16]
    lines = sorted({x for *_, x in occ})
    edges = [(a, b) for a in range(len(lines)) for b in range(a) if _distance(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b])) // line_dedup.TENTH]
    root = dict(zip(lines, _groups(len(lines), edges), strict=True))
    first = {}
    for i, no, x in sorted(occ):
        first.setdefault(root[x], (i, no))
    drop = {(i, no) for i, no, x in occ if first[root[x]] != (i, no)}
    assert drop and edges
    for i, t in docs:
        want = t if t is None or i is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in drop)
        assert out[i]["text"] == want and out[i]["gone"] == sum(d[0] == i for d in drop)
    assert line_dedup.dedup_lines(R.frame(spark, [])).count() == 0


def test_lines_odd_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))  # one very long line, and it once more with a change
    docs = [(1, long), (2, long.replace("w777 ", "x777 ")), (3, "y" * 80_000), (4, "y" * 80_000), (5, "A line of several words here\nsecond"), (5, "another text of the same id here\nA line of several words here"), (None, "A line of several words here"), (6, "A LINE of several words, here!")]
    rows = [(i, t, "x", "y", "z", len(t)) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, _drop string, _drop_id string, h string, n_chars int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"], r["_drop"], r["_drop_id"], r["h"], r["n_chars"]) for r in out.collect())
    text = {1: [long], 2: [""], 3: ["y" * 80_000], 4: [""], 5: ["A line of several words here\nsecond", "another text of the same id here"], 6: [""], 0: ["A line of several words here"]}
    # the line stands in both rows of id 5, first on line 0 of the id: on line 1 it goes
    assert got == sorted((i, t, "x", "y", "z", len(t)) for i, ts in text.items() for t in ts)
    every = line_dedup.dedup_lines(R.frame(spark, [(1, "a b"), (2, "A  b!"), (3, "c")]), least_chars=0)
    assert {r["doc_id"]: r["text"] for r in every.collect()} == {1: "a b", 2: "", 3: "c"}


def test_common_keys_are_dealt_out(spark, monkeypatch):
    docs = [(k, f"all rights to this page are reserved by the holder of number {k * 7919 % 100_000:05d}") for k in range(400)] + [(500 + k, R.words(k, 9)) for k in range(50)]
    want = {x["doc_id"] for x in line_dedup.drops(R.frame(spark, docs)).collect()}
    assert want == set(range(1, 400))
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    monkeypatch.setattr(line_dedup, "COMMON", 20)
    monkeypatch.setattr(line_dedup, "shuffle_partitions", lambda _: 32)
    assert line_dedup.common_keys(R.frame(spark, docs), 16)
    assert {x["doc_id"] for x in line_dedup.drops(R.frame(spark, docs)).collect()} == want


def test_dealt_keys_lose_no_variants(spark, monkeypatch):
    """Families of variants of a line, whose keys are common: dealt out, at whatever number of partitions, they are joined as when they are not."""
    r = random.Random(11)
    docs = []
    for k in range(6):
        base = R.words(900 + k, 20).split(" ")
        for _ in range(300):
            w = list(base)
            for at in r.sample(range(20), 2):
                c = r.randrange(len(w[at]))
                w[at] = w[at][:c] + r.choice("bcdfgh") + w[at][c + 1 :]
            docs.append((len(docs), " ".join(w)))
    frame = R.frame(spark, docs)
    undealt = line_dedup.drops(frame).count()
    assert undealt >= 0.98 * 6 * 299
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    monkeypatch.setattr(line_dedup, "COMMON", 20)
    for n in (120,):
        monkeypatch.setattr(line_dedup, "shuffle_partitions", lambda _, n=n: n)
        parts = line_dedup.common_keys(frame, 16)
        assert parts and all(len(q) == len(line_dedup.TURNS) and (np.diff(x.astype(float)) >= 0).all() for q in parts.values() for x in q)
        dealt = line_dedup.drops(frame).count()
        assert dealt >= undealt - 0.005 * 6 * 299


@pytest.mark.parametrize("whole, common", [(512, 1024), (3, 1024), (3, 10)])
def test_holes_lose_no_near_pair(spark, monkeypatch, whole, common):
    """Chains of lines, each a word from the next, in shared holes: all near pairs of the holes within a tenth join, where holes
    give all pairs, where they are compared in tiles and where their keys are common too."""
    r = random.Random(12)
    texts, front = [], "the holder of this page says that"
    for k in range(12):
        w = R.words(700 + k, 16).split(" ")
        for step in range(12):
            texts.append(front + " " + " ".join(w))
            w[step] = w[step][:1] + "".join(r.choice("bcdfgh") for _ in range(len(w[step])))
    frame = R.frame(spark, list(enumerate(texts)))
    rows = line_dedup.entries(pa.array(texts), 16, set())
    text = {x["h"]: texts[x["doc_id"]] for x in line_dedup.occurrences(frame, 16).collect()}
    holes, edges = {}, set()
    for x in rows:
        holes.setdefault(x["key"], []).append(x)
    for own in holes.values():
        one = {n: np.array([x[n] for x in own]) for n in line_dedup.ROW.names}
        every = np.arange(len(own))
        near = line_dedup._near(one, every[:, None], every[None, :])[1]
        edges |= {(int(one["h"][i]), int(one["h"][j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    edges = {(a, b) for a, b in edges if _distance(text[a], text[b]) <= max(len(text[a]), len(text[b])) // 10}
    ids = sorted(text)
    want = _groups(len(ids), [(ids.index(a), ids.index(b)) for a, b in edges])
    assert len(ids) > len(set(want)) >= 12
    monkeypatch.setattr(line_dedup, "WHOLE", whole, raising=False)
    monkeypatch.setattr(line_dedup, "TILE", 16, raising=False)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    monkeypatch.setattr(line_dedup, "COMMON", common)
    assert bool(line_dedup.common_keys(frame, 16)) == (common == 10)
    assert line_dedup.drops(frame).count() == len(ids) - len(set(want))


def test_recall_on_real_lines(spark):
    """Of planted links, checked by plain edit distance, 0.9 or more are found for every length and kind."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    r = random.Random(4)
    pool = sorted({x for t in spark.read.parquet(path).select("text").collect() for x in _lines(t["text"]) if 8 <= x.count(" ") + 1 <= 70})
    bands = [(8, 14), (15, 24), (25, 40), (41, 70)]
    words = sorted({w for x in pool for w in x.split(" ")})
    docs, kind, base = [], {}, 0
    for lo, hi in bands:
        for one in r.sample([x for x in pool if lo <= x.count(" ") + 1 <= hi], 60):
            for how in ("typo", "word", "words", "typos"):
                w = one.split(" ")
                if how == "typo":
                    k = r.randrange(len(w))
                    w[k] = w[k] + "x"
                elif how in ("word", "words"):
                    for k in r.sample(range(len(w)), 1 if how == "word" else max(1, len(w) // 10)):
                        w[k] = r.choice(words)
                two = " ".join(w)
                if how == "typos":
                    c = list(two)
                    for k in r.sample(range(len(c)), max(1, len(c) // 25)):
                        c[k] = r.choice("aeinst")
                    two = "".join(c)
                if one == two or _distance(one, two) > max(len(one), len(two)) // 10:
                    continue
                docs.append((base, one, two))
                kind[base] = (lo, how)
                base += 2
    plain = spark.createDataFrame([(i, t) for i, x, y in docs for i, t in ((i, x), (i + 1, y))], "doc_id long, text string")
    pairs = line_dedup.candidate_pairs(plain, 16).select("a", "b")
    h = {x["doc_id"]: x["h"] for x in line_dedup.occurrences(plain, 16).collect()}
    found = {frozenset((x["a"], x["b"])) for x in pairs.collect()}
    entry = line_dedup.occurrences(plain, 16).groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    joined = components(line_dedup.links(plain, entry, 16))
    group = {x["id"]: x["component"] for x in joined.collect()}
    for key in sorted(set(kind.values())):
        own = [i for i in kind if kind[i] == key]
        assert len(own) >= 20 or key[1] == "word", key
        hit = sum(h[i] == h[i + 1] or group.get(h[i], h[i]) == group.get(h[i + 1], h[i + 1]) for i in own)
        assert hit >= 0.9 * len(own), (key, hit, len(own))
    assert found


def test_verified_is_the_edit_distance(spark):
    r, pairs = random.Random(2), [("", ""), ("", "abc"), ("x", "")]
    for _ in range(1500):
        a = "".join(r.choice("ab cdé") for _ in range(r.randrange(1, 60)))
        b = list(a)
        for _ in range(r.randrange(8)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(["", "x", "a", " "])
        pairs.append((a, "".join(b)))
    texts = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "h long, s string")
    asked = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs))], "a long, b long")
    got = {x["src"] // 2 for x in line_dedup.verified(asked, texts).collect()}
    want = {k for k, (a, b) in enumerate(pairs) if _distance(a, b) <= max(len(a), len(b)) // 10}
    assert got == want and 100 < len(want) < 1400


def test_lines_of_usual_length_link(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    docs = []
    for k, n in enumerate((2, 3, 5, 7, 9, 10, 12, 15, 20, 24, 25, 30, 40, 60) * 6):
        one = [word() for _ in range(n)]
        two = list(one)
        for at in r.sample(range(n), max(1, n // 10)):
            two[at] = word()[:6] if n >= 10 else "q" + two[at][1:]
        docs += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    want = {b for (a, x), (b, y) in zip(docs[::2], docs[1::2], strict=True) if _distance(x, y) <= max(len(x), len(y)) // line_dedup.TENTH}
    assert len(want) == len(docs) // 2
    assert {x["doc_id"] for x in line_dedup.drops(R.frame(spark, docs)).collect()} == want


def test_lines_of_other_numbers_stay(spark):
    rows = [(12.5, 4711, 3), (98.7, 2056, 4), (31.4, 8890, 6)]
    docs = [(k, f"Measured depth {d} m at station {s} on day {n}") for k, (d, s, n) in enumerate(rows)]
    docs.append((9, docs[0][1].upper() + "!"))
    assert [x["doc_id"] for x in line_dedup.drops(R.frame(spark, docs)).collect()] == [9]


def _distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        above, row = row, [i]
        for j, d in enumerate(y, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return row[-1]


def test_pairs_side_by_side_have_the_brute_force_edit_distance():
    rng = np.random.default_rng(5)
    for letters in ("ab", "abcdé漢\U0001f642"):
        xs, ys = [], []
        for _ in range(400):
            x = [letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 40))]
            y = list(x)
            for _ in range(rng.integers(0, 8)):
                at, c = rng.integers(0, len(y) + 1), letters[rng.integers(0, len(letters))]
                y[at : at + rng.integers(0, 2)] = [c] * rng.integers(0, 2)
            xs.append("".join(x))
            ys.append("".join(y) or "b")
        d = np.array([_distance(x, y) for x, y in zip(xs, ys, strict=True)])
        most = rng.integers(0, 7, len(xs))
        near = np.array([abs(len(x) - len(y)) for x, y in zip(xs, ys, strict=True)]) <= most
        pick = np.flatnonzero(near)
        got = lines.side_by_side([xs[k] for k in pick], [ys[k] for k in pick], most[pick])
        assert got.tolist() == (d <= most)[pick].tolist()
        assert lines.close(xs, ys, 10).tolist() == [e <= max(len(x), len(y)) // 10 for e, x, y in zip(d.tolist(), xs, ys, strict=True)]


def test_a_hole_gives_all_near_pairs_or_stands_for_the_rest():
    for n in (8, 12):  # 28 pairs of 8 entries are few, 66 of 12 are not
        r = np.zeros(n, line_dedup.ROW)
        r["key"], r["h"], r["sim"], r["size"] = 5, np.arange(n), [1 << k for k in range(n)], 1000
        found = line_dedup.candidates(r, {})
        pairs = {frozenset(x) for x in zip(found[0][0].tolist(), found[0][1].tolist(), strict=True)}
        assert len(pairs) == 28 if n == 8 else sorted(found[2]["h"].tolist()) == list(range(n))


@pytest.mark.parametrize("tile", [4096, 16])
def test_pairs_of_large_holes_are_no_rows_before_they_link(spark, monkeypatch, tile):
    """60 families of 4 lines in a hole, all near by SimHash (half of them with another first bit), every other line in a
    second hole too: what comes out are links alone, and they join each family."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    r, texts = random.Random(13), []
    for k in range(60):
        w = R.words(800 + k, 30).split(" ")
        texts += [" ".join([*w[:j], "x", *w[j + 1 :]]) for j in range(4)]
    order = r.sample(range(240), 240)  # h does not follow the families
    rows = [(key, order[k], (k % 2) * -(2**63) + k % 8, 1900 + k % 60, False) for k in range(240) for key in ((5,) if k % 4 < 2 else (5, -7))]
    rest = spark.createDataFrame(rows, "key long, h long, sim long, size int, few boolean").repartition(3)
    lines_ = spark.createDataFrame([(order[k], x) for k, x in enumerate(texts)] + [(order[0], texts[0])], "h long, s string")
    groups = spark.createDataFrame([(order[0], order[1]), (order[1], order[1])], "id long, component long")
    found = line_dedup.crossing(rest, groups, lines_).collect()
    assert len(found) == len({frozenset(x) for x in found}) <= 60 * 6  # of some 28,000 near pairs
    family = {h: k // 4 for k, h in enumerate(order)}
    assert all(family[a] == family[b] for a, b in found)
    root = _groups(240, [*found, (order[0], order[1])])
    assert len(set(root)) == 60


def test_long_pairs_side_by_side_have_the_brute_force_edit_distance():
    """Lines of several looks at what can still be near: alike, unlike at either end, all over and without a common letter."""
    r, xs, ys = random.Random(14), [], []
    for k in range(120):
        n = r.choice((150, 300, 400)) + r.randrange(20)
        x = "".join(r.choice("abcdefgh é") for _ in range(n))
        y = list(x)
        at = {0: range(n // 3), 1: range(n - n // 3, n), 2: range(n), 3: [n // 2]}[k % 4]
        for _ in range(r.randrange(1, n // 3)):
            p = r.choice(at) % len(y)
            y[p : p + r.randrange(2)] = r.choice("abz") * r.randrange(2)
        xs.append(x)
        ys.append("".join(y) if k % 10 else "z" * n)
    d = np.array([_distance(x, y) for x, y in zip(xs, ys, strict=True)])
    most = np.array([max(len(x), len(y)) // 10 for x, y in zip(xs, ys, strict=True)])
    pick = np.flatnonzero(np.array([abs(len(x) - len(y)) for x, y in zip(xs, ys, strict=True)]) <= most)
    got = lines.side_by_side([xs[k] for k in pick], [ys[k] for k in pick], most[pick])
    assert got.tolist() == (d <= most)[pick].tolist() and 20 < got.sum() < len(got) - 20
    assert lines.close(xs, ys, 10).tolist() == (d <= most).tolist()
    assert (lines.unlike(xs + ys, np.arange(120), np.arange(120, 240)) <= 2 * lines.GRAM * d).all()
