"""The exact tests against hand computations, published figures and enumeration."""

import math
import random
import time
from itertools import combinations, product

import pytest

from assay.functions import stats
from assay.functions.stats import fisher_exact, label_permutation, label_permutation_by, paired_permutation


@pytest.mark.parametrize(("table", "p"), [((3, 1, 1, 3), 0.4857), ((0, 0, 0, 0), 1.0), ((2, 0, 0, 2), 1 / 3), ((16, 11, 0, 9), 0.0019), ((14, 6, 1, 14), 0.0003), ((18, 19, 1, 1), 1.0), ((12, 19, 15, 63), 0.0483)])
def test_fisher(table, p):
    assert fisher_exact(*table) == pytest.approx(p, abs=6e-5)


def test_paired_published_row():
    r = paired_permutation(15, 14, 6, 1, 5, 0, 0)
    assert r["delta_precision"] == pytest.approx(-0.123, abs=1e-3)
    assert (r["p1_precision"], r["p2_precision"]) == (pytest.approx(0.9844, abs=1e-4), pytest.approx(0.0625, abs=1e-4))
    assert r["delta_recall"] == pytest.approx(0.067, abs=1e-3)
    assert (r["p1_recall"], r["p2_recall"]) == (0.5, 1.0)


def test_paired_only_treatment_finds():
    r = paired_permutation(3, 0, 0, 3, 0, 0, 0)
    assert r["delta_recall"] == 1 and r["p1_recall"] == 1 / 8 and "delta_precision" not in r


def _enumerated(pos, b_pos, b_neg, t_pos, t_neg, u_pos, u_neg):
    cases = [(True, True)] * t_pos + [(False, True)] * t_neg + [(True, False)] * u_pos + [(False, False)] * u_neg

    def stat(swap):
        own = [(p, a != s) for (p, a), s in zip(cases, swap, strict=True)]
        tp1, fp1 = b_pos + sum(p and a for p, a in own), b_neg + sum(not p and a for p, a in own)
        tp2, fp2 = b_pos + sum(p and not a for p, a in own), b_neg + sum(not p and not a for p, a in own)
        return tp1 / (tp1 + fp1) - tp2 / (tp2 + fp2) if tp1 + fp1 and tp2 + fp2 else None

    obs = stat([False] * len(cases))
    if obs is None:
        return None
    every = [s for s in (stat(x) for x in product([False, True], repeat=len(cases))) if s is not None]
    return sum(s >= obs - 1e-12 for s in every) / len(every), sum(abs(s) >= abs(obs) - 1e-12 for s in every) / len(every)


@pytest.mark.parametrize("counts", [(5, 1, 2, 2, 1, 1, 3), (4, 0, 0, 2, 2, 1, 1), (6, 2, 0, 0, 3, 1, 0), (3, 0, 1, 1, 0, 2, 4)])
def test_paired_equals_enumeration(counts):
    r, want = paired_permutation(*counts), _enumerated(*counts)
    assert (r["p1_precision"], r["p2_precision"]) == pytest.approx(want)


def test_label_permutation():
    assert label_permutation([], [])["p1"] == 1
    assert label_permutation([0.5, 0.2], [True, True])["method"] == "degenerate"
    r = label_permutation([1.0, 0.0, 0.0, 0.0], [True, False, False, False])
    assert r["gap"] == 1 and r["p1"] == 0.25 and r["method"] == "exact"
    assert label_permutation([0.1, 0.4, 0.9] * 4, [True, False, False] * 4, exact_limit=10, draws=500)["method"] == "monte carlo"


def test_label_permutation_past_two_million_labellings_is_exact(spark):
    rates, clean = [0.0] * 20 + [0.5] * 20 + [1.0] * 20, [True] * 4 + [False] * 16 + [True] * 10 + [False] * 10 + [True] * 16 + [False] * 4
    r = label_permutation(rates, clean)
    ways = {}
    for x in range(21):
        for y in range(max(0, 10 - x), min(20, 30 - x) + 1):
            s = y + 2 * (30 - x - y)
            ways[s] = ways.get(s, 0) + math.comb(20, x) * math.comb(20, y) * math.comb(20, 30 - x - y)
    assert sum(ways.values()) == math.comb(60, 30)
    assert r["method"] == "exact" and r["p1"] == pytest.approx(sum(w for s, w in ways.items() if s >= 42) / math.comb(60, 30), rel=1e-12)
    rows = [("a", int(2 * x), 2, c) for x, c in zip(rates, clean, strict=True)]
    drawn = [("b", x, 97, c) for (x, c) in zip(range(60), [False] * 30 + [True] * 30, strict=True)]
    got = {x["arm"]: x for x in label_permutation_by(spark.createDataFrame(rows + drawn, "arm string, hits long, n long, clean boolean"), "arm", "hits", "n", "clean", exact_limit=500, draws=9000).collect()}
    assert got["a"]["method"] == "exact" and got["a"]["p1"] == pytest.approx(r["p1"]) and got["a"]["p2"] == pytest.approx(r["p2"])
    assert got["b"]["method"] == "monte carlo" and got["b"]["p1"] == pytest.approx(1 / 9001) and got["b"]["gap"] == pytest.approx(30 / 97)


def test_paired_equals_the_grid():
    """Every x and y of the two binomials, weighed and compared one by one."""
    r = random.Random(7)
    for _ in range(300):
        pos, b_pos, b_neg, t_pos, t_neg, u_pos, u_neg = (r.choice([0, 0, 1, 3, r.randrange(12)]) for _ in range(7))
        got = paired_permutation(pos, b_pos, b_neg, t_pos, t_neg, u_pos, u_neg)
        want = _enumerated_grid(b_pos, b_neg, t_pos, t_neg, u_pos, u_neg)
        assert (want is None) == ("p1_precision" not in got)
        if want:
            assert (got["p1_precision"], got["p2_precision"]) == pytest.approx(want, abs=1e-12)


def _enumerated_grid(b_pos, b_neg, t_pos, t_neg, u_pos, u_neg):
    d_pos, d_neg = t_pos + u_pos, t_neg + u_neg

    def stat(x, y):
        n1, n2 = b_pos + b_neg + x + y, b_pos + b_neg + d_pos - x + d_neg - y
        return (b_pos + x) / n1 - (b_pos + d_pos - x) / n2 if n1 and n2 else None

    obs = stat(t_pos, t_neg)
    if obs is None:
        return None
    every = [(stat(x, y), math.comb(d_pos, x) * math.comb(d_neg, y)) for x in range(d_pos + 1) for y in range(d_neg + 1)]
    every = [(s, w) for s, w in every if s is not None]
    total = sum(w for _, w in every)
    return sum(w for s, w in every if s >= obs - 1e-12) / total, sum(w for s, w in every if abs(s) >= abs(obs) - 1e-12) / total


def test_paired_of_many_cases_is_fast():
    start = time.perf_counter()
    r = paired_permutation(200_000, 40_000, 30_000, 50_200, 50_000, 49_800, 50_000)
    assert time.perf_counter() - start < 4 and 0 < r["p1_precision"] < r["p2_precision"] < 1


def test_arrays_and_states_agree_with_enumeration():
    r = random.Random(3)
    for _ in range(40):
        n = r.randrange(2, 11)
        rates, clean = [r.randrange(4) / r.choice([3, 4, 6]) for _ in range(n)], [r.random() < 0.5 for _ in range(n)]
        k = sum(clean)
        if k in (0, n):
            continue
        sides = lambda chosen: sum(rates[i] for i in chosen) / k - (sum(rates) - sum(rates[i] for i in chosen)) / (n - k)
        obs = sides([i for i in range(n) if clean[i]])
        every = [sides(c) for c in combinations(range(n), k)]
        want = sum(s >= obs - 1e-9 for s in every) / len(every), sum(abs(s) >= abs(obs) - 1e-9 for s in every) / len(every)
        got = label_permutation(rates, clean)
        assert got["method"] == "exact" and (got["p1"], got["p2"]) == pytest.approx(want)
    primes = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37]
    odd = label_permutation([1 / p for p in primes], [True] * 4 + [False] * 8)  # sums without end, few labellings
    assert odd["method"] == "exact" and odd["p1"] == pytest.approx(1 / math.comb(12, 4))


def test_an_exact_count_is_estimated_before_it_is_tried():
    start = time.perf_counter()
    r = random.Random(1)
    out = label_permutation([r.randrange(q + 1) / q for q in (r.randrange(1, 41) for _ in range(4000))], [k % 2 == 0 for k in range(4000)], draws=50)
    assert out["method"] == "monte carlo" and time.perf_counter() - start < 2


def test_small_cohorts_are_dealt_over_all_partitions_and_counted_by_states(spark, monkeypatch):
    r, seen, cut = random.Random(12), [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda df: seen.append(df) or cut(df))
    by_arrays, used = stats._label_arrays, []
    monkeypatch.setattr(stats, "_label_arrays", lambda *a: used.append(a) or by_arrays(*a))
    rows = [(f"c{k // 10}", r.randrange(q + 1), q, k % 3 == 0) for k, q in enumerate(r.randrange(6, 20) for _ in range(400))]
    got = {x["g"]: x for x in label_permutation_by(spark.createDataFrame(rows, "g string, hits long, n long, clean boolean"), "g", "hits", "n", "clean").collect()}
    assert len(got) == 40 and {x["method"] for x in got.values()} == {"exact"}
    assert seen[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for g, x in got.items():
        cases = [(a / b, c) for h, a, b, c in rows if h == g]
        every = list(combinations([v for v, _ in cases], sum(c for _, c in cases)))
        total, k = sum(v for v, _ in cases), len(every[0])
        gaps = [sum(s) / k - (total - sum(s)) / (10 - k) for s in every]
        assert abs(x["p1"] - sum(y >= x["gap"] - 1e-9 for y in gaps) / len(gaps)) < 1e-12
        assert abs(x["p2"] - sum(abs(y) >= abs(x["gap"]) - 1e-9 for y in gaps) / len(gaps)) < 1e-12
        label_permutation([v for v, _ in cases], [c for _, c in cases])
    assert not used  # a few hundred labellings are no reason for arrays of every sum
