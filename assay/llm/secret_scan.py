"""Secret scan: rule matches, and sliding-window Shannon entropy per character class over
candidate strings, with allow-list suppression. DataFrame expressions only.

Rules (spans are code points of the whole match, end exclusive): `assign`, a secret-like name
given a value of 6 or more characters; `access`, AKIA and upper-case letters or digits, 20 or
more in all; `hex`, 24 or more lower-case hex digits. `entropy` adds candidate strings in
which some window of 20 characters reaches the class's entropy: the window's counts are kept
up by adding the character that enters and taking off the one that leaves. Candidates without
both a letter and a digit and those on the allow list are left alone; a rule's span is cut out
of a candidate and what is left is tested on its own; a rule's span is never suppressed.

Defined results: null text counts as empty and has no span; texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The patterns of the rules. With a least length inside the pattern the runs of
# `access` and `hex` are the same as with `+` and a later test, since a shorter run has no
# longer one inside it; `assign` may swallow a second name in its value, so it is tested after.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Least entropy in bits of a window, by character class (hex digits, upper case and
# digits, lower case and digits, letters and digits, the rest): what 98 of 100 random strings of
# 20 characters reach.
HEX_BITS, UPPER_BITS, LOWER_BITS, MIXED_BITS, WIDE_BITS = 2.94, 3.4, 3.48, 3.68, 3.68
# Strings that look random and are no secrets.
ALLOW = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)(example|placeholder|changeme|your[_-]|xxxx|dummy|lorem)",
    r"(?i)(0123456789|abcdefghij|qwertyuiop)",
    r"(?i)^(sha(1|256|384|512)|md5)-",
]


def _located(text: Column, pattern: str, matches: Column, holds: Column, kind: str, order: int) -> Column:
    """array<struct<start,order,end,kind>> of the matches for which `holds` is true, counted
    from what lies between the matches."""
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,order:int,end:int,kind:string>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("gap"), matches.alias("hit"), holds.alias("ok"))
    found = F.aggregate(rows, zero, step)["spans"]
    return F.when(F.size(matches) > 0, found).otherwise(zero["spans"])


def _entropy_hit(s: Column) -> Column:
    """Whether some window of the string reaches its class's entropy."""
    bits = F.when(s.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).when(s.rlike("^[0-9A-Z]+=*$"), F.lit(UPPER_BITS)).when(s.rlike("^[0-9a-z]+=*$"), F.lit(LOWER_BITS))
    bits = bits.when(s.rlike("^[0-9A-Za-z]+=*$"), F.lit(MIXED_BITS)).otherwise(F.lit(WIDE_BITS))
    # entropy of a window = log2(w) - sum(c log2 c) / w; the sum moves by f(c + 1) - f(c) and back
    chars = F.transform(F.split(s, ""), lambda c: F.ascii(c) - 43)  # + is 43, z is 122
    f = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(F.array_repeat(F.lit(0), 80).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("least"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        a = F.get(acc["n"], new)
        up = f(a + 1) - f(a)
        b = F.get(acc["n"], old) + F.when(old == new, 1).otherwise(0)
        down = F.when(old.isNull(), F.lit(0.0)).otherwise(f(b - 1) - f(b))
        n = F.transform(acc["n"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(old.isNotNull() & (k == old), 1).otherwise(0))
        total = acc["sum"] + up + down
        full = acc["i"] + 1 >= WINDOW
        least = F.when(~full, acc["least"]).when(acc["i"] + 1 == WINDOW, total).otherwise(F.least(acc["least"], total))
        return F.struct(n.alias("n"), total.alias("sum"), least.alias("least"), (acc["i"] + 1).alias("i"))

    # bound to a lambda variable, so that the characters are split once
    pairs = F.element_at(F.transform(F.array(chars), lambda a: F.transform(a, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.get(a, i - WINDOW)).alias("old")))), 1)
    least = F.aggregate(pairs, zero, step)["least"]
    return (F.lit(math.log2(WINDOW)) - least / WINDOW) >= bits


def _blanked(text: Column, spans: Column) -> Column:
    """The text with every span as blanks, so that positions stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], more).otherwise(acc["out"]).alias("out"))

    tail = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), zero, step, tail)).otherwise(text)


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds `out`: array<struct<start,order,end,kind>> by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign, access, hexes = (F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (ASSIGN, ACCESS, HEX))
    value = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= 6)
    always = lambda m: F.transform(m, lambda _: F.lit(True))
    base = F.concat(_located(t, ASSIGN, assign, value, "assign", 0), _located(t, ACCESS, access, always(access), "access", 1), _located(t, HEX, hexes, always(hexes), "hex", 2))
    allowed = lambda s: s.rlike(ALLOW[0]) | s.rlike(ALLOW[1]) | s.rlike(ALLOW[2]) | s.rlike(ALLOW[3])
    df = docs.withColumn(out, base)
    rest = out + "_rest"
    while rest in df.columns:
        rest += "_"
    df = df.withColumn(rest, _blanked(t, F.col(out)))
    wide = F.regexp_extract_all(F.col(rest), F.lit(CANDIDATE), F.lit(0))
    odd = F.transform(wide, lambda s: F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~allowed(s), _entropy_hit(s)).otherwise(False))
    return df.withColumn(out, F.array_sort(F.concat(F.col(out), _located(F.col(rest), CANDIDATE, wide, odd, "entropy", 3)))).drop(rest)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> (key, spans array<struct<start,order,end,kind>>)."""
    df = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return with_spans(df).select(F.col("id").alias(key), "spans")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of `text` replaced by `mark` (null texts stay
    null) and n_chars, where there is one, the new length."""
    name = "spans_"
    while name in docs.columns:
        name += "_"
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    tail = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    df = with_spans(docs, out=name).withColumn("text", F.when(F.size(name) > 0, F.aggregate(name, zero, step, tail)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.drop(name)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = text(F.filter("spans", lambda s: s["order"] < 3))
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
