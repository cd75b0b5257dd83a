"""Hashes of token windows, as numbers that join and shuffle in place of the windows' text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import SHINGLE

_TOKEN = re.compile("[a-z0-9]+")
_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]


def _rolled(tokens: list[str], width: int, seed: int) -> np.ndarray:
    """A signed 64-bit hash of every window: the tokens' own hashes, weighted by place."""
    n = len(tokens) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    half = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in tokens), _U, len(tokens))
    half ^= half >> _U(29)
    h, weight = np.zeros(n, _U), _U(1)
    for k in range(width):
        weight = weight * _ODD[seed]
        h += half[k : k + n] * weight
    return (h ^ (h >> _U(32))).view(np.int64)


def window_hashes(text: Column, width: int = SHINGLE) -> Column:
    """array<bigint>: 64 bits for each window of `width` tokens (as tokens() has them), in order; empty for
    fewer tokens and null."""

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([_rolled(_TOKEN.findall(t or ""), width, 0) for t in texts])

    return F.pandas_udf(made, "array<bigint>")(F.lower(text))


def _near(hit: np.ndarray, reach: int) -> np.ndarray:
    """Places at most `reach` from a true one."""
    edge = np.zeros(len(hit) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, np.maximum(at - reach, 0), 1)
    np.add.at(edge, np.minimum(at + reach + 1, len(hit)), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]))


def known_in(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def windows_near(text: Column, known, reach: int, width: int = SHINGLE) -> Column:
    """array<struct<pos, h, g>>: the windows at most `reach` places from one whose h is in `known`, a broadcast
    sorted array; empty where there is none."""

    def made(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            tokens = _TOKEN.findall(t or "")
            h = _rolled(tokens, width, 0)
            at = _near(known_in(known.value, h), reach)
            g = _rolled(tokens, width, 1)[at] if len(at) else at
            out.append([{"pos": p, "h": a, "g": b} for p, a, b in zip(at.tolist(), h[at].tolist(), g.tolist(), strict=True)])
        return pd.Series(out)

    return F.pandas_udf(made, "array<struct<pos: int, h: bigint, g: bigint>>").asNondeterministic()(F.lower(text))  # evaluated once


def window_pairs(text: Column, width: int = SHINGLE) -> Column:
    """array<struct<h, g>>: the same with 64 independent bits more."""

    def made(texts: pd.Series) -> pd.DataFrame:
        tokens = [_TOKEN.findall(t or "") for t in texts]
        return pd.DataFrame({"h": [_rolled(t, width, 0) for t in tokens], "g": [_rolled(t, width, 1) for t in tokens]})

    pair = F.pandas_udf(made, "struct<h: array<bigint>, g: array<bigint>>")(F.lower(text))
    return F.transform(F.array(pair), lambda p: F.arrays_zip(p["h"].alias("h"), p["g"].alias("g")))[0]
