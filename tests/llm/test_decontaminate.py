import hashlib
import random
import re

from . import rows as R

from assay.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def windows(text):
    w = words(text)
    return {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()


def occurrences(w, window):
    n = len(window)
    return [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) == window]


def expected(i, text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        for window in windows(t):
            for k in occurrences(w, window):
                hit |= set(range(k, k + len(window)))
                found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return (i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))


def passage(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "a", "Ünter", "x9", "42", f"word{r.randrange(60)}"]) for _ in range(n))


ITEMS = [(k, passage(k, n)) for k, n in enumerate([30, 45, 10, 11, 9, 3, 2, 1, 60, 25])]
ITEMS += [(20, None), (21, ""), (22, "?!"), (23, ITEMS[0][1]), (23, ITEMS[1][1]), (None, passage(99, 20)), (24, "the of a the of a the of a the of a the of"), (25, "No_such item_text anywhere in_these documents at_all")]


def _docs():
    r = random.Random(4)
    docs = R.documents() + [(2, ITEMS[2][1]), (2, ITEMS[2][1])]
    for k in range(60):
        t = passage(1000 + k, r.randrange(5, 120)).split()
        for _ in range(r.randrange(3)):
            w = r.choice(ITEMS)[1] or ""
            w = w.split()[r.randrange(5) :][: r.randrange(5, 40)]
            if r.random() < 0.5 and w:
                w[r.randrange(len(w))] = "typo"
            t[r.randrange(len(t)) : 0] = w
        docs.append((500 + k, r.choice([" ", "-", " ,\n"]).join(t).upper() if k % 3 else " ".join(t)))
    docs += [(700 + k, f"before{k} {ITEMS[8][1]} after{k}") for k in range(40)]
    docs += [(800, passage(99, 20)), (801, "the of a " * 30), (802, ("long " * 3000) + ITEMS[1][1] + " more" * 3000)]
    return docs


def _tables(spark, path, docs, items):
    frame = spark.createDataFrame([(i, t, f"w{k}") for k, (i, t) in enumerate(items)], "item_id long, text string, words string")
    return R.table(spark, path, docs, benchmark=frame)


def test_query_against_brute_force(spark, tmp_path):
    docs = _docs()
    got = D.op11_benchmark_decontamination(spark, _tables(spark, tmp_path, docs, ITEMS))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = [expected(i, t, ITEMS) for i, t in docs]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 50 < sum(w[-1] for w in want) < len(want)


def test_salted_join_and_share_below_one(spark, monkeypatch):
    monkeypatch.setattr(D, "FEW", 0)
    docs = [d for d in _docs() if d[0] is not None and d[0] >= 500 and d[0] != 802]
    items = [x for x in ITEMS if x[0] is not None and x[0] < 10]
    frames = R.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for share in (1.0, 0.6):
        got = {tuple(r) for r in D.find(*frames, share=share).occurrences().select("key", "item", "start", "n").collect()}
        want = set()
        for i, t in docs:
            w = words(t)
            for item, x in items:
                for window in windows(x):
                    n = len(window)
                    size = min(3, n)
                    own = {window[k : k + size] for k in range(n - size + 1)}
                    for s in range(len(w) - n + 1):
                        there = tuple(w[s : s + n])
                        if (there == window) if share == 1 else len(own & {there[k : k + size] for k in range(n - size + 1)}) >= share * len(own) - 1e-9:
                            want.add((i, str(item), s, n))
        assert got == want and len(got) > 100


def test_empty_tables(spark, tmp_path):
    assert D.op11_benchmark_decontamination(spark, _tables(spark, tmp_path / "a", [], ITEMS)).count() == 0
    rows = D.op11_benchmark_decontamination(spark, _tables(spark, tmp_path / "b", R.documents(), [])).collect()
    assert len(rows) == len(R.documents()) and not any(r["contaminated"] for r in rows)
