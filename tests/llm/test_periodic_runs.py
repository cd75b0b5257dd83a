import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from . import rows as R

from assay.llm import periodic_runs as P

WORD = re.compile("[^\x20\x09-\x0d]+")


def runs(w):
    """Every (start, length, period) by comparing all words a period apart."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                block = w[i : i + q]
                if not any(q % d == 0 and block == block[:d] * (q // d) for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + k % p] for k in range(n - a)]
    found = runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic(seed, alphabet, n):
    r = random.Random(seed)
    w = [r.randrange(alphabet) for _ in range(n)]
    for _ in range(r.randrange(4) if n > 30 else 0):
        a = r.randrange(n)
        p = 1 + r.randrange(max(1, min(n - a, r.choice([3, 8, 20, 100]))))
        for i in range(a, min(n, a + int(p * r.uniform(2, 9)))):
            w[i] = w[a + (i - a) % p]
    return w


def stitch(words):
    out = {}
    for q, a, b in sorted(P.fragments(np.array(words, np.int64))):
        if out.get(q) and a <= out[q][-1][1]:
            out[q][-1][1] = max(b, out[q][-1][1])
        else:
            out.setdefault(q, []).append([a, b])
    found = [(a, b - a + q, q) for q, x in out.items() for a, b in x]
    return sorted((r for r in found if r[1] >= max(24, 3 * r[2])), key=lambda r: (r[0], r[2]))


def test_fragments_against_all_periods():
    r = random.Random(5)
    for k in range(250):
        w = periodic(k, r.choice([1, 2, 3, 50]), r.randrange(0, 400))
        assert stitch(w) == runs(w)
    assert stitch([0] * 5000) == [(0, 5000, 1)]
    assert stitch([k % 1000 for k in range(3000)]) == [(0, 3000, 1000)] and stitch([k % 1000 for k in range(2999)]) == []


def _odd():
    r = random.Random(8)
    docs = R.documents() + [(2, "a b c " * 9), (2, "a b c " * 9), (None, "x " * 30), (700, "x " * 23), (701, "x\ty \n" * 12), (702, "é\x0bè " * 12), (703, "p q r " * 8 + "p q")]
    docs += [(800 + k, " ".join(f"w{x}" for x in periodic(k, r.choice([2, 40]), r.randrange(20, 300)))) for k in range(60)]
    return docs


def test_query_against_brute_force(spark, tmp_path):
    docs = [(i, t) for i, t in _odd() if len(t or "") < 200_000]
    sf = R.table(spark, tmp_path, docs)
    got = sorted(map(tuple, P.op13_periodic_runs(spark, sf).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t in docs), key=str)
    assert sum(g[1] for g in got) > 20


def test_runs_and_collapse(spark):
    docs = _odd()
    frame = R.frame(spark, docs)
    found = {}
    for r in P.runs_of(frame).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["period"]))
    texts = {r["doc_id"]: r for r in P.collapse(frame).collect()}
    assert len(P.collapse(frame).collect()) == len(docs)
    assert texts[5]["text"] is None and texts[701]["n_runs"] == 1 and texts[700]["text"] == "x " * 23
    assert texts[703]["text"] == "p q r" and texts[702]["text"] == "é è"
    for i, t in docs:
        if i is not None and i not in (2, 10):
            assert sorted(found.get(i, [])) == sorted(runs(WORD.findall(t or "")))


def test_empty_table(spark, tmp_path):
    assert P.op13_periodic_runs(spark, R.table(spark, tmp_path, [])).count() == 0
