"""Exact tests on counts: vectorised helpers over a few rows a comparison."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _log_choose(n, k):
    return _lgamma(np.add(n, 1)) - _lgamma(np.add(k, 1)) - _lgamma(np.subtract(n, k) + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher p of [[a b][c d]]; 1 for an empty table."""
    n, row, col = a + b + c + d, a + b, a + c
    if n == 0:
        return 1.0
    x = np.arange(max(0, col - (c + d)), min(row, col) + 1)
    p = np.exp(_log_choose(row, x) + _log_choose(n - row, col - x) - _log_choose(n, col))
    here = p[x == a][0]
    return float(min(1.0, p[p <= here * (1 + 1e-9)].sum()))


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype=float)


def fisher_p(a: str, b: str, c: str, d: str) -> Column:
    """fisher_exact() over four count columns."""
    return F.pandas_udf(_fisher, "double")(a, b, c, d)


def _half_binomial(n: int) -> np.ndarray:
    x = np.arange(n + 1)
    return np.exp(_log_choose(n, x) - n * math.log(2)) if n > 50 else np.array([math.comb(n, int(k)) for k in x]) / 2.0**n


def _precision_tails(b_pos: int, b_neg: int, d_pos: int, d_neg: int, obs: float) -> tuple[float, float]:
    """Share of the outcomes (x, y) whose difference of precisions is at least obs, and at least as far
    from 0."""
    wx, x = _half_binomial(d_pos), np.arange(d_pos + 1)
    upto = np.concatenate([[0.0], np.cumsum(_half_binomial(d_neg))])  # weight of the first y

    def difference(y: np.ndarray) -> np.ndarray:
        n1, n2 = b_pos + b_neg + x + y, b_pos + b_neg + d_pos - x + d_neg - y
        return (b_pos + x) / np.maximum(n1, 1) - (b_pos + d_pos - x) / np.maximum(n2, 1)

    def how_many(holds) -> np.ndarray:
        """For each x the number of y, from 0 on, for which `holds` of the difference is still true."""
        low, high = np.zeros(d_pos + 1, np.int64), np.full(d_pos + 1, d_neg + 1)
        while (low < high).any():
            y = (low + high) // 2
            yes = holds(difference(np.minimum(y, d_neg))) & (low < high)
            low, high = np.where(yes, y + 1, low), np.where(yes | (low >= high), high, y)
        return low

    above = how_many(lambda d: d >= obs - 1e-12)
    far = abs(obs) - 1e-12
    right, left = how_many(lambda d: d >= far), how_many(lambda d: d > -far)
    one = float(wx @ upto[above])
    two = 1.0 if far <= 0 else float(wx @ (upto[right] + upto[-1] - upto[np.maximum(left, right)]))
    # one arm calls nothing risky in these two outcomes, if both arms agree on no case
    gone = {(0, 0), (d_pos, d_neg)} if b_pos + b_neg == 0 else set()
    whole = 1.0
    for i, j in gone:
        w = wx[i] * (upto[j + 1] - upto[j])
        whole -= w
        one -= w * (j < above[i])
        two -= w * (far <= 0 or j < right[i] or j >= left[i])
    return (min(1.0, max(0.0, one / whole)), min(1.0, max(0.0, two / whole))) if whole > 0 else (1.0, 1.0)


def paired_permutation(positives: int, b_pos: int, b_neg: int, t_pos: int, t_neg: int, u_pos: int, u_neg: int) -> dict:
    """Exact test of swapping two arms on their discordant cases.

    `positives` counts the positive cases both scored, b_* the cases both call risky, t_* those only the
    treatment does, u_* those only the baseline does, each by label. Under the null every
    discordant case goes to one arm by a fair coin, so the numbers that the treatment gets among the
    positives (x) and among the negatives (y) are binomial. For an x the difference of precisions falls as
    y grows, so the outcomes of a tail are an interval of y, found by bisection and weighed by cumulative
    binomials: O(d log d), no grid of x and y, no sampling. Outcomes where a precision is undefined leave
    its denominator.
    """
    d_pos, d_neg = t_pos + u_pos, t_neg + u_neg
    x = np.arange(d_pos + 1)[:, None]
    out: dict = {"common_discordant": d_pos + d_neg}
    wx = _half_binomial(d_pos)

    def tails(diff, obs, weight):
        total = weight.sum()
        return float(weight[diff >= obs - 1e-12].sum() / total), float(weight[np.abs(diff) >= abs(obs) - 1e-12].sum() / total)

    if positives > 0:
        obs = (t_pos - u_pos) / positives
        out["delta_recall"] = obs
        out["p1_recall"], out["p2_recall"] = tails((2 * x[:, 0] - d_pos) / positives, obs, wx)
    if b_pos + b_neg + t_pos + t_neg > 0 and b_pos + b_neg + u_pos + u_neg > 0:
        obs = (b_pos + t_pos) / (b_pos + b_neg + t_pos + t_neg) - (b_pos + u_pos) / (b_pos + b_neg + u_pos + u_neg)
        out["delta_precision"] = obs
        out["p1_precision"], out["p2_precision"] = _precision_tails(b_pos, b_neg, d_pos, d_neg, obs)
    return out


_PAIRED = "delta_precision double, p1_precision double, p2_precision double, delta_recall double, p1_recall double, p2_recall double"


def _paired(positives: pd.Series, b_pos: pd.Series, b_neg: pd.Series, t_pos: pd.Series, t_neg: pd.Series, u_pos: pd.Series, u_neg: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in _PAIRED.split(", ")]
    rows = [paired_permutation(*map(int, t)) for t in zip(positives, b_pos, b_neg, t_pos, t_neg, u_pos, u_neg, strict=True)]
    return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names, dtype=float)


def paired_p(*counts: str) -> Column:
    """paired_permutation() over its seven count columns, as a struct."""
    return F.pandas_udf(_paired, _PAIRED)(*counts)


def _sides(total: float, k: int, n: int, s) -> np.ndarray:
    return s / k - (total - s) / (n - k)


#: Multiply-adds of an exact count; past them draws cost less.
WORK = 4_000_000_000
#: States over all rates up to which they are gone through one by one, though arrays would hold them.
FEW_STATES = 4096


def _whole_numbers(rates: list[tuple[int, int]]) -> list[int]:
    """Fractions (a, b) as multiples of the same unit."""
    parts = [Fraction(a, b) for a, b in rates]
    unit = math.lcm(*(p.denominator for p in parts))
    values = [int(p * unit) for p in parts]
    common = math.gcd(*values) or 1
    return [v // common for v in values]


def _label_steps(values: list[int], sizes: list[int], k: int) -> list[tuple[int, int, int, int]]:
    """(least clean, most clean, greatest sum, ways) after each rate: what a count has to hold."""
    seen, top, ways, left, out = 0, 0, 1, sum(sizes), []
    for v, m in zip(values, sizes, strict=True):
        seen, left = seen + m, left - m
        top += v * min(m, k)
        ways *= min(m, k) + 1
        out.append((max(0, k - left), min(k, seen), top, ways))
    return out


def label_exact(rates: list[tuple[int, int]], sizes: list[int], clean: list[int], exact_limit: int = 2_000_000) -> dict | None:
    """The exact test over distinct rates (fractions of whole numbers) with their cases and clean cases: the
    weight of labellings by (clean so far, sum so far), rate by rate. It is estimated first: None where a
    step could have more than `exact_limit` such states or all of them more than WORK additions."""
    n, k = sum(sizes), sum(clean)
    values = _whole_numbers(rates)
    steps = _label_steps(values, sizes, k)
    cells = [(hi - lo + 1) * (top + 1) for lo, hi, top, _ in steps]
    labellings = math.comb(n, k) if min(k, n - k) * math.log(max(n, 2)) < 100 else exact_limit + 1
    small = max(min(w, labellings) for *_, w in steps) <= exact_limit
    dense = max(cells) <= exact_limit and sum(c * (min(m, k) + 1) for c, m in zip(cells, sizes, strict=True)) <= WORK
    if not (small or dense):
        return None
    whole = sum(v * m for v, m in zip(values, sizes, strict=True))
    seen = sum(v * c for v, c in zip(values, clean, strict=True))
    few = sum(min(w, labellings) for *_, w in steps) <= FEW_STATES
    sums, weights = (_label_states if few or not dense else _label_arrays)(values, sizes, k, steps)
    far = [abs(s * n - whole * k) >= abs(seen * n - whole * k) for s in sums]
    every = sum(weights)
    return {"p1": sum(w for s, w in zip(sums, weights, strict=True) if s >= seen) / every, "p2": sum(w for f, w in zip(far, weights, strict=True) if f) / every}


def _label_states(values: list[int], sizes: list[int], k: int, steps) -> tuple[list, list]:
    """Sums and exact numbers of labellings, by the states that occur."""
    states = {(0, 0): 1}
    for v, m, (low, high, _, _) in zip(values, sizes, steps, strict=True):
        ways, new = [math.comb(m, c) for c in range(min(m, k) + 1)], {}
        for (c, s), w in states.items():
            for x in range(max(0, low - c), min(m, high - c) + 1):
                key = (c + x, s + x * v)
                new[key] = new.get(key, 0) + w * ways[x]
        states = new
    return [s for _, s in states], list(states.values())


def _label_arrays(values: list[int], sizes: list[int], k: int, steps) -> tuple[list, list]:
    """The same as one array of clean by sum, shifted and added once for each number of clean cases of a
    rate; numbers that a double cannot hold are scaled, which leaves their shares."""
    now, low_was, exact = np.ones((1, 1)), 0, math.comb(sum(sizes), k) < 2**53
    for v, m, (low, high, top, _) in zip(values, sizes, steps, strict=True):
        new = np.zeros((high - low + 1, top + 1))
        log_ways = _log_choose(m, np.arange(min(m, k) + 1))
        for x, way in enumerate([float(math.comb(m, c)) for c in range(min(m, k) + 1)] if exact else np.exp(log_ways - log_ways.max())):
            first, last = max(low_was, low - x), min(low_was + len(now) - 1, high - x)  # clean before
            width = min(now.shape[1], top + 1 - x * v)
            if first <= last and width > 0:
                new[first + x - low : last + x - low + 1, x * v : x * v + width] += way * now[first - low_was : last - low_was + 1, :width]
        now, low_was = new if exact else new / new.max(), low
    last = now[k - low_was]
    at = np.flatnonzero(last)
    return at.tolist(), last[at].tolist()


def label_hits(rates: list[float], sizes: list[int], clean: list[int], draws: int, seed: list[int]) -> tuple[int, int]:
    """How many of `draws` random labellings have a gap as large, and as large either way: the clean cases
    of each distinct rate are multivariate hypergeometric."""
    r, m, c = np.asarray(rates, float), np.asarray(sizes, np.int64), np.asarray(clean, np.int64)
    n, k, total = int(m.sum()), int(c.sum()), float(r @ m)
    obs = _sides(total, k, n, float(r @ c))
    g = _sides(total, k, n, np.random.default_rng(seed).multivariate_hypergeometric(m, k, size=draws, method="marginals") @ r)
    return int((g >= obs - 1e-12).sum()), int((np.abs(g) >= abs(obs) - 1e-12).sum())


def _label_start(rates: list[tuple[int, int]], sizes: list[int], clean: list[int], exact_limit: int) -> dict:
    n, k = sum(sizes), sum(clean)
    if n == 0 or k == 0 or k == n:
        return {"gap": 0.0, "p1": 1.0, "p2": 1.0, "method": "degenerate"}
    total, seen = sum(a / b * m for (a, b), m in zip(rates, sizes, strict=True)), sum(a / b * c for (a, b), c in zip(rates, clean, strict=True))
    found = label_exact(rates, sizes, clean, exact_limit)
    return {"gap": float(_sides(total, k, n, seen)), **(found or {"p1": None, "p2": None}), "method": "exact" if found else "monte carlo"}


def _cells(rows) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(a, b, cases, clean cases) -> distinct rates in order, their cases, their clean cases."""
    cells: dict[Fraction, list[int]] = {}
    for a, b, n, k in rows:
        cell = cells.setdefault(Fraction(int(a), int(b)), [0, 0])
        cell[0] += int(n)
        cell[1] += int(k)
    order = sorted(cells)
    return [(f.numerator, f.denominator) for f in order], [cells[f][0] for f in order], [cells[f][1] for f in order]


def _fraction(rate: float) -> tuple[int, int]:
    """A rate as the simplest fraction that gives the same double."""
    part = Fraction(rate).limit_denominator(1_000_000)
    return (part.numerator, part.denominator) if float(part) == rate else Fraction(rate).as_integer_ratio()


def label_permutation(rates: list[float], clean: list[bool], exact_limit: int = 2_000_000, draws: int = 200_000, seed: int = 20260915) -> dict:
    """P of the gap between mean suppression of clean and of other cases over all ways to label as
    many cases clean: exact where the counts of labellings fit `exact_limit` states, else from seeded
    draws, with the observed labelling counted in (so never 0), and labelled so; 1 when no or every
    case is clean."""
    found, sizes, marked = _cells((*_fraction(float(r)), 1, bool(c)) for r, c in zip(rates, clean, strict=True))
    out = _label_start(found, sizes, marked, exact_limit)
    if out["method"] == "monte carlo":
        h1, h2 = label_hits([a / b for a, b in found], sizes, marked, draws, [seed])
        out |= {"p1": (1 + h1) / (1 + draws), "p2": (1 + h2) / (1 + draws)}
    return out


#: Draws of one task.
CHUNK = 4000


def label_permutation_by(df: DataFrame, group: str, hits: str, of: str, clean: str, exact_limit: int = 2_000_000, draws: int = 200_000, seed: int = 20260915) -> DataFrame:
    """(group, gap, p1, p2, method) of label_permutation for the per-case rows of each group, whose rates are
    the whole numbers `hits` / `of`. A group travels as the counts of its distinct rates; what is exact is
    settled once, and draws are dealt in chunks, each with its own seed."""
    cells = df.groupBy(F.col(group).alias("g"), F.col(hits).cast("long").alias("a"), F.col(of).cast("long").alias("b")).agg(F.count("*").alias("n"), F.count_if(clean).alias("k"))
    # groups are few bytes and much work: an asked-for number of partitions is not put together by size
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.repartition(n, "g").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("a", "b", "n", "k"))).alias("c"))

    def start(c: pd.Series) -> pd.DataFrame:
        out = []
        for cell in c:
            rates, sizes, marked = _cells((x["a"], x["b"], x["n"], x["k"]) for x in cell)
            out.append(_label_start(rates, sizes, marked, exact_limit) | {"r": [a / b for a, b in rates], "n": sizes, "k": marked})
        return pd.DataFrame(out, columns=["gap", "p1", "p2", "method", "r", "n", "k"]).astype({"gap": float, "p1": float, "p2": float})

    def drawn(r: pd.Series, n: pd.Series, k: pd.Series, at: pd.Series) -> pd.DataFrame:
        found = [label_hits(list(a), list(b), list(c), min(CHUNK, draws - CHUNK * int(i)), [seed, int(i)]) for a, b, c, i in zip(r, n, k, at, strict=True)]
        return pd.DataFrame(found, columns=["h1", "h2"])

    start.__annotations__ = {"c": pd.Series, "return": pd.DataFrame}
    drawn.__annotations__ = {"r": pd.Series, "n": pd.Series, "k": pd.Series, "at": pd.Series, "return": pd.DataFrame}
    started = cut(rows.select("g", F.pandas_udf(start, "gap double, p1 double, p2 double, method string, r array<double>, n array<long>, k array<long>")("c").alias("s")).select("g", "s.*"))
    chunks = -(-draws // CHUNK)
    dealt = started.where("method = 'monte carlo'").select("g", "r", "n", "k", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("at")).repartition(chunks, "g", "at")
    sums = dealt.withColumn("x", F.pandas_udf(drawn, "h1 long, h2 long")("r", "n", "k", "at")).groupBy("g").agg(F.sum("x.h1").alias("h1"), F.sum("x.h2").alias("h2"))
    out = started.join(sums.withColumnRenamed("g", "d"), F.col("g").eqNullSafe(F.col("d")), "left")
    p = lambda exact, h: F.coalesce(F.col(exact), (1 + F.col(h)) / F.lit(1.0 + draws)).alias(exact)
    return out.select(F.col("g").alias(group), "gap", p("p1", "h1"), p("p2", "h2"), "method")
