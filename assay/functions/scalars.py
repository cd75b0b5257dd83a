"""Column functions over review text, paths, severities and dispositions.

Word boundaries are spelled as ASCII look-arounds, as Java's \\b also counts accented letters
as word characters. Every function maps null to null unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
# The shapes of a commit and of a CVE id.
SHA = f"(?i){_B}[0-9a-f]{{7,40}}{_E}"
CVE = rf"(?i){_B}CVE-[0-9]{{4}}-[0-9]{{4,7}}{_E}"
# The four shapes of a pull-request reference, each scanned on its own.
PR = [rf"#([0-9]+){_E}", rf"(?i){_B}PR[ -]?#?([0-9]+){_E}", rf"(?i){_B}pull/([0-9]+){_E}", rf"(?i){_B}pull request #?([0-9]+){_E}"]
SHINGLE = 8
# Prefixes of the metadata lines of a patch.
DIFF_HEADERS = ["index ", "diff --git ", "similarity index ", "dissimilarity index ", "old mode ", "new mode ", "deleted file mode ", "new file mode ", "rename from ", "rename to ", "copy from ", "copy to ", "GIT binary patch"]
# Ranks and weights of the severities; anything else counts 0.
SEVERITY = {"low": (1, 0.25), "medium": (2, 0.5), "high": (3, 0.75), "critical": (4, 1.0)}
# How an error reads as a vendor's rate limit, tried in this order.
RATE_LIMIT = ["rate[ _-]?limit", f"{_B}429{_E}", "too many requests", "usage limit", "quota (?:exceeded|exhausted)", "try again (?:in|after)", "capacity constraints", "overloaded"]
# Where an error names a wait, tried in this order; group 2, if any, is the unit.
RESET = [(r"(?i)try again in ([0-9]+)\s*(second|minute|hour)s?", True), (r"(?i)retry[- ]after:?\s*([0-9]+)", False), (r"(?i)resets? (?:at|in) ([0-9]+)\s*(second|minute|hour)s?", True), (r"(?i)try again at ([0-9]{1,2}):([0-9]{2})\s*(AM|PM|am|pm)?", True)]
CLOCK = RESET[-1][0]


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def shingles(toks: Column, width: int = SHINGLE) -> Column:
    """Every window of `width` tokens joined by a blank; none for fewer tokens."""
    # bound to a lambda variable, so that the tokens are made once and not once a window
    def windows(t: Column) -> Column:
        n = F.size(t)
        every = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_join(F.slice(t, i, width), " "))
        return F.when(n >= width, every).otherwise(F.expr("CAST(array() AS array<string>)"))

    return F.element_at(F.transform(F.array(toks), windows), 1)


def sha_tokens(text: Column) -> Column:
    """Runs of 7 to 40 hex digits as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(SHA), F.lit(0))


def pr_numbers(text: Column) -> Column:
    """P5: numbers of pull-request references as text, once for every shape that matches."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PR])


def pr_mentions(text: Column) -> Column:
    """P5: (mention, number) of the same references, the mention as it stands in the text; its only run of
    digits is the number."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PR])
    return F.transform(every, lambda m: F.struct(m.alias("mention"), F.regexp_extract(m, "[0-9]+", 0).alias("number")))


def cve_ids(text: Column) -> Column:
    """CVE ids as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(CVE), F.lit(0))


def strip_diff_headers(patch: Column) -> Column:
    """A patch without its metadata lines."""
    pattern = "^(" + "|".join(DIFF_HEADERS) + ")"
    return F.array_join(F.filter(F.split(patch, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def patch_shas(patch: Column) -> Column:
    """Commits that a patch's From and commit lines declare, lower case, in order, once each."""
    found = F.regexp_extract_all(patch, F.lit(r"(?im)^(?:From|commit)\s+([0-9a-f]{7,40})(?![0-9A-Za-z_])"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def severity_rank(severity: Column) -> Column:
    """1 to 4, 0 for null and unknown."""
    return F.coalesce(F.create_map(*[F.lit(x) for s, (r, _) in SEVERITY.items() for x in (s, r)])[severity], F.lit(0))


def severity_weight(severity: Column) -> Column:
    """0.25 to 1, 0 for null and unknown."""
    return F.coalesce(F.create_map(*[F.lit(x) for s, (_, w) in SEVERITY.items() for x in (s, w)])[severity], F.lit(0.0))


def at_or_above(severity: Column, least: str = "medium") -> Column:
    return severity_rank(severity) >= SEVERITY[least][0]


def final_status(b: Column, c: Column) -> Column:
    """The stage-3 disposition if there is one, else the stage-2 one, as a status; an unknown
    stage-3 disposition is `unassessed` and does not fall back."""
    d = F.coalesce(F.nullif(c, F.lit("")), b)
    known = {"CONFIRMED": "confirmed", "NARROWED": "narrowed", "REJECTED": "rejected", "INCONCLUSIVE": "inconclusive"}
    out = F.when(F.lit(False), F.lit(""))
    for k, v in known.items():
        out = out.when(d == k, F.lit(v))
    return out.otherwise(F.lit("unassessed"))


def survived(disposition: Column) -> Column:
    """Everything but REJECTED and INCONCLUSIVE survives, null included."""
    return ~F.coalesce(disposition, F.lit("")).isin("REJECTED", "INCONCLUSIVE")


def opaque_id(case: Column, arm: Column, finding: Column) -> Column:
    """An id that tells nothing of its parts: f and ten hex digits."""
    whole = F.concat_ws("\0", case.cast("string"), arm.cast("string"), finding.cast("string"))
    return F.concat(F.lit("f"), F.substring(F.sha2(whole.cast("binary"), 256), 1, 10))


def first_line(mechanism: Column) -> Column:
    """Through the first full stop if it is at position 1 to 119 (from 0), else the first 120
    characters; trimmed. Counts characters."""
    at = F.locate(".", mechanism)
    return F.trim(F.when(at.between(2, 120), F.substring(mechanism, F.lit(1), at)).otherwise(F.substring(mechanism, 1, 120)))


def clean_path(path: Column) -> Column:
    """Shortest equal slash path: no empty or `.` parts, `..` resolved; empty gives `.`."""
    rooted = F.startswith(path, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when((part == "..") & up, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    # element_at fails on an empty array, so a blank part stands at the bottom while folding
    bottom = F.array(F.lit(".."))
    parts = F.aggregate(F.split(path, "/"), bottom, lambda acc, p: F.when(F.size(acc) == 1, _on_empty(acc, p, rooted)).otherwise(step(acc, p)))
    joined = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def _on_empty(acc: Column, part: Column, rooted: Column) -> Column:
    return F.when(part.isin("", ".") | ((part == "..") & rooted), acc).otherwise(F.concat(acc, F.array(part)))


def arm_of(value: Column, prefixes: dict[str, str]) -> Column:
    """The arm of the longest prefix that fits a run id or protocol version, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for p in sorted(prefixes, key=lambda p: (-len(p), p)):
        out = out.when(F.startswith(value, F.lit(p)), F.lit(prefixes[p]))
    return out


def rate_limit_match(message: Column) -> Column:
    """The text by which a message reads as a rate limit, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(message, f"(?i){p}", 0), F.lit("")) for p in RATE_LIMIT])


def reset_hint(message: Column) -> Column:
    """The wait in seconds that a message names, by the first pattern with a number over 0. As
    in the blueprint, `try again at 2:30` reads as 2 seconds; stall_wait() reads the clock."""
    hints = []
    for p, unit in RESET:
        n = F.nullif(F.regexp_extract(message, p, 1), F.lit("")).try_cast("bigint")
        u = F.lower(F.regexp_extract(message, p, 2)) if unit else F.lit("")
        hints.append(F.when(n > 0, n * F.when(u == "minute", 60).when(u == "hour", 3600).otherwise(1)))
    return F.coalesce(*hints)


def stall_wait(message: Column, now: Column, fallback: Column) -> Column:
    """P20: seconds from `now` to the clock time a message names, and 30 more, if that is one minute
    to twelve hours ahead; else the fallback."""
    h, m, half = (F.regexp_extract(message, CLOCK, k) for k in (1, 2, 3))
    h, m, half = h.try_cast("int"), m.try_cast("int"), F.upper(half)
    h24 = F.when((half == "PM") & (h != 12), h + 12).when((half == "AM") & (h == 12), 0).otherwise(h)
    ahead = F.unix_timestamp(F.date_trunc("day", now)) + h24 * 3600 + m * 60 - F.unix_timestamp(now)
    good = (h <= 23) & (m <= 59) & ahead.between(60, 12 * 3600)
    return F.coalesce(F.when(good, ahead + 30), fallback)


def identifier_shapes(text: Column) -> Column:
    """array<struct<kind,matched>> of everything shaped like a commit, pull request or CVE."""
    named = lambda kind, found: F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("matched")))
    return F.concat(named("sha", sha_tokens(text)), *[named("pr", F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in PR], named("cve", cve_ids(text)))


def excerpt_around(text: Column, fragment: Column, reach: int = 40) -> Column:
    """The first match whatever its case with `reach` characters on both sides, trimmed; empty
    without a match."""
    at = F.instr(F.lower(text), F.lower(fragment))
    start = F.greatest(at - reach, F.lit(1))
    cut = F.substring(text, start, at + F.length(fragment) + reach - start)
    return F.when(at > 0, F.trim(cut)).when(text.isNotNull(), F.lit(""))


def strata(**dimensions: Column) -> Column:
    """array<struct<dim,bucket>> without the dimensions a case does not record."""
    every = F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("bucket")) for d, c in dimensions.items()])
    return F.filter(every, lambda x: F.coalesce(x["bucket"], F.lit("")) != "")


def rate(numerator: Column, denominator: Column) -> Column:
    """A share that is absent, not 0, where it cannot be computed."""
    return F.when(denominator > 0, numerator / denominator)


def percent(numerator: Column, denominator: Column) -> Column:
    """The agreement tables' percentage: 0 where the denominator is."""
    return F.when(denominator > 0, 100.0 * numerator / denominator).otherwise(F.lit(0.0))
