"""Phrases of a discussion in a run's strings, by hashes first (C4 to C7 in one pass).

A window of eight tokens is 128 bits and its place. Of a string only the windows that the discussion has, and
those that overlap one, leave its row; these and the discussion's are all that the texts shown to the
reviewers are asked for, so what is excluded never stands as a table of windows. Up to FEW_HASHES
hashes to look for are sent to the tasks (counted first; 8 bytes each); more are joined by a shuffle.
Matching windows are compared word by word in the strings' own tokens; coverage is a prefix sum over a
string's tokens, and spans are read off in the row.

Windows that are excluded are told by 128 bits, not by their text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.rolling import window_pairs, windows_near
from ..functions.scalars import SHINGLE
from ..sources.shared import cut

NOVEL = 3
SKIP_SUFFIX = ".excerpt"
#: Hashes of windows (8 bytes each) and windows with their texts (some 60) that are broadcast, counted first.
FEW_HASHES, FEW_TEXTS = 1_000_000, 100_000
_FOUND = "struct<windows: array<struct<pos: int, source: string>>, spans: array<struct<first_pos: int, n_windows: int, source: string, matched: string>>>"


def novel_and_spans(tokens: list[str], hits: list[tuple[int, str, str]], excluded: list[int], width: int = SHINGLE, novel: int = NOVEL) -> tuple[list, list]:
    """hits: (pos, source, window) that match, excluded: places of excluded windows -> (pos, source) of
    the hits with `novel` uncovered tokens, and their maximal runs (first pos, windows, first source,
    text)."""
    edge = np.zeros(len(tokens) + 1, np.int64)
    for p in excluded:
        edge[p] += 1
        edge[p + width] -= 1
    bare = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) == 0)])
    kept = sorted((p, s) for p, s, w in hits if bare[p + width] - bare[p] >= novel and " ".join(tokens[p : p + width]) == w)
    spans: list[list] = []
    for p, s in kept:
        if spans and spans[-1][0] + spans[-1][1] == p:
            spans[-1][1] += 1
        else:
            spans.append([p, 1, s])
    return kept, [(p, n, s, " ".join(tokens[p : p + n + width - 1])) for p, n, s in spans]


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("hs").alias("pos", "x")).select(*keep, "pos", "x.h", "x.g")


def _looked_up(texts: DataFrame, hashes: DataFrame, reach: int, *keep: str) -> DataFrame:
    """keep..., near: the windows of each text at most `reach` places from one whose h is in `hashes` (distinct);
    texts without one are left out."""
    spark = texts.sparkSession
    if hashes.count() <= FEW_HASHES:
        known = np.sort(hashes.select("h").toPandas()["h"].to_numpy(np.int64))
        near = texts.select(*keep, windows_near(F.col("text"), spark.sparkContext.broadcast(known), reach).alias("near"))
        return near.where(F.size("near") > 0)
    every = _exploded(texts.select("*", F.monotonically_increasing_id().alias("_row"), window_pairs(F.col("text")).alias("hs")), *keep, "_row")
    every = cut(every)
    at = every.join(hashes, "h", "left_semi").select("_row", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos")).distinct()
    return every.join(at, ["_row", "pos"], "left_semi").groupBy("_row", *keep).agg(F.array_sort(F.collect_list(F.struct("pos", "h", "g"))).alias("near")).drop("_row")


def cited_paths(cited: DataFrame) -> DataFrame:
    """run_id, case_id, path: cited files inside the snapshot, their paths cleaned."""
    c = cited.withColumn("path", S.clean_path(F.col("file")))
    return c.where(~F.startswith("path", F.lit("/")) & ~F.startswith("path", F.lit("../")) & (F.col("path") != "..")).select("run_id", "case_id", "path").distinct()


def matched(strings: DataFrame, discussion: DataFrame, shown: DataFrame | None = None, cited: DataFrame | None = None, files: DataFrame | None = None, by_case: bool = False) -> DataFrame:
    """The strings with novel windows of the discussion: run_id, case_id, path (and stage, if there is
    one), windows and spans, unexcluded (nothing was given to exclude).

    strings: run_id, case_id, path (one string each), text; discussion: source_pos, source, body;
    shown: text, counting for all runs; cited: run_id, case_id, file and files: case_id, path, text,
    counting for the runs that cite them. by_case: discussion and shown have a case_id that strings
    must share. Null texts and strings under eight tokens have no windows.
    """
    case = ["case_id"] if by_case else []
    keys = ["run_id", "case_id", "path"] + (["stage"] if "stage" in strings.columns else [])
    src = strings.where(~F.endswith("path", F.lit(SKIP_SUFFIX))).select(*keys, "text")
    said = discussion.select(*case, "source_pos", "source", window_pairs(F.col("body")).alias("hs"), S.tokens(F.col("body")).alias("toks"))
    said = said.select(*case, "source_pos", "source", "toks", F.posexplode("hs").alias("pos", "x"))
    said = cut(said.select(*case, "source_pos", "source", "pos", "x.h", "x.g", F.array_join(F.slice("toks", F.col("pos") + 1, SHINGLE), " ").alias("shingle")))
    near = _looked_up(src, said.select("h").distinct(), SHINGLE - 1, *keys, "text")
    some = cut(near.select(*keys, S.tokens(F.col("text")).alias("toks"), "near"))
    windows = some.select(*keys, F.inline("near"))

    index, excluded, needed = said, None, None
    if shown is not None or cited is not None:
        needed = cut(windows.select("h").union(said.select("h")).distinct())
    if shown is not None:
        rows = _looked_up(shown.select(*case, "text"), needed, 0, *case)
        rows = cut(rows.select(*case, F.inline("near")).select(*case, "h", "g").distinct())
        index = said.join(rows, [*case, "h", "g"], "left_anti")
        excluded = windows.join(rows, [*case, "h", "g"], "left_semi").select(*keys, "pos")
    index = index.groupBy(*case, "h", "g").agg(F.min_by(F.struct("source", "shingle"), F.struct("source_pos", "pos")).alias("of"))
    small = lambda df: F.broadcast(df) if said.count() <= FEW_TEXTS else df
    hits = windows.join(small(index), [*case, "h", "g"])
    if cited is not None and files is not None:
        paths = cited_paths(cited)
        there = files.join(paths, ["case_id", "path"], "left_semi").select("case_id", "path", "text")
        rows = _looked_up(there, needed, 0, "case_id", "path").select("case_id", "path", F.inline("near")).select("case_id", "path", "h", "g").distinct()
        own = cut(rows.join(paths, ["case_id", "path"]).select("run_id", "h", "g").distinct())
        hits = hits.join(own, ["run_id", "h", "g"], "left_anti")
        more = windows.join(own, ["run_id", "h", "g"], "left_semi").select(*keys, "pos")
        excluded = more if excluded is None else excluded.unionByName(more)
    hits = hits.groupBy(*keys).agg(F.collect_list(F.struct("pos", "of.source", "of.shingle")).alias("hits"))
    if excluded is None:
        both = hits.withColumn("gone", F.expr("CAST(array() AS array<int>)"))
    else:
        both = hits.join(excluded.groupBy(*keys).agg(F.collect_list("pos").alias("gone")), keys, "left").withColumn("gone", F.coalesce("gone", F.expr("CAST(array() AS array<int>)")))

    def read(toks: pd.Series, hits: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = [novel_and_spans(list(t), [(x["pos"], x["source"], x["shingle"]) for x in m], list(e)) for t, m, e in zip(toks, hits, gone, strict=True)]
        return pd.DataFrame({"windows": [[dict(zip(("pos", "source"), x, strict=True)) for x in w] for w, _ in out], "spans": [[dict(zip(("first_pos", "n_windows", "source", "matched"), x, strict=True)) for x in s] for _, s in out]})

    found = some.join(both, keys).select(*keys, F.pandas_udf(read, _FOUND)("toks", "hits", "gone").alias("f"))
    found = found.select(*keys, "f.windows", "f.spans", F.lit(shown is None and cited is None).alias("unexcluded"))
    return cut(found).where(F.size("windows") > 0)


def novel_windows(found: DataFrame) -> DataFrame:
    """A row a novel window: run_id, case_id, path, pos, source."""
    return found.select("run_id", "case_id", "path", F.inline("windows"))


def spans(found: DataFrame) -> DataFrame:
    """A row a maximal run of novel windows, with the first window's source and the whole text."""
    keep = [c for c in found.columns if c not in ("windows", "spans")]
    return found.select(*keep, F.inline("spans")).withColumn("n_tokens", F.col("n_windows") + (SHINGLE - 1))
