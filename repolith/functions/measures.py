"""Scalar measures: sizes, ramps, windows, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the size bands; the last band has none.
BAND_ENDS = (14, 24, 49, 99, 199, 399, 799, 1599)
LEAST_MEMBERS = 30
CHURN_DAYS, CHURN_SATURATION = 90, 8
RUNGS = (30, 60, 90, 180)
DAY = 86400


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def lin_map(x: Column, low: float, high: float) -> Column:
    return clamp((x - low) / (high - low))


def loc(start: Column, end: Column) -> Column:
    return F.greatest(end - start + 1, F.lit(0))


#: Texts in quotes, which keep what they hold; over lines only where three quotes open them.
TEXTS = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
#: A block comment within a line; and one over several, whose first line end stays, as it parts what stands before and behind.
BLOCK = r"/\*[^\n]*?\*/|/\*[^\n]*(\n)[\s\S]*?\*/"
#: A text that stands alone at the start of a line.
DOCSTRING = r"^[ \t]*(?:\"\"\"[^\n]*?\"\"\"|'''[^\n]*?''')|^[ \t]*(?:\"\"\"[^\n]*(\n)[\s\S]*?\"\"\"|'''[^\n]*(\n)[\s\S]*?''')"
#: What is matched from left to right, by how a language comments; groups are what stays of it.
COMMENTS = {
    "slashes": rf"(?m)({TEXTS})|//[^\n]*|{BLOCK}",
    "hashes": rf"(?m)({TEXTS})|#[^\n]*",
    "python": rf"(?m){DOCSTRING}|(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|{TEXTS})|#[^\n]*",
    "any": rf"(?m){DOCSTRING}|({TEXTS})|^[ \t]*#[^\n]*|//[^\n]*|{BLOCK}",
}
STAYS = {"slashes": "$1$2", "hashes": "$1", "python": "$1$2$3", "any": "$1$2$3$4"}


def ncloc(body: Column, comments: str = "any") -> Column:
    """Lines that hold more than white space and comments; what looks like a comment within a text or a comment is none."""
    bare = F.regexp_replace(body, COMMENTS[comments], STAYS[comments])
    return F.size(F.filter(F.split(bare, "\n"), lambda line: ~line.rlike(r"^\s*$")))


def days_since(ts: Column, now: Column) -> Column:
    """Fractional days, never negative."""
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0)) / F.lit(float(DAY))


def band(size: Column) -> Column:
    out = F.lit(len(BAND_ENDS))
    for k, end in reversed(list(enumerate(BAND_ENDS))):
        out = F.when(size <= end, k).otherwise(out)
    return F.when(size.isNotNull(), out).cast("int")


def tangle(cognitive: Column, median: Column) -> tuple[Column, Column]:
    """Complexity for its size, and raw, both 0..1; without a median both are raw."""
    raw = clamp(cognitive / 15.0)
    ratio = cognitive / F.greatest(median, F.lit(1))
    return F.when(median.isNull(), raw).otherwise(clamp((ratio - 1.0) / 3.0)), raw


def times_normal(cognitive: Column, median: Column) -> Column:
    return cognitive / F.greatest(median, F.lit(1))


def churn_rate(commits: Column, window_days: float) -> Column:
    return clamp(commits / F.lit(max(CHURN_SATURATION * window_days / CHURN_DAYS, 1.0)))


def window_ladder(span_days: int) -> list[int]:
    """The four churn windows of a repository that is so many days old."""
    top = RUNGS[-1]
    if span_days >= top:
        return list(RUNGS)
    return [max(1, span_days * r // top) for r in RUNGS[:-1]] + [max(1, span_days)]


def age_ramp(days: Column, span: Column) -> Column:
    """1 for today down to 0 at the repository's age, on a logarithmic scale."""
    return F.when(span < 1, F.lit(1.0)).otherwise(clamp(1.0 - F.log10(days + 1.0) / F.log10(span + 1.0)))


def share_ramp(share: Column) -> Column:
    return F.pow(F.least(F.lit(1.0), share / 0.25), F.lit(0.7))


def locality_gap(away: Column, incident: Column) -> Column:
    return F.when(incident > 0, away / incident)


def years(days: Column) -> Column:
    """One decimal below ten years, whole years above."""
    y = days / 365.0
    return F.when(y >= 10, F.format_string("%d", F.round(y).cast("long"))).otherwise(F.format_string("%.1f", y))


def thousands(x: Column) -> Column:
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


#: The lens bands (lower ends) and ages in days.
LENS_BANDS = {
    "callers": ((0, "none"), (1, "one"), (2, "few"), (6, "many")),
    "reach": ((0, "none"), (1, "one"), (2, "few"), (6, "many")),
    "clones": ((2, "pair"), (3, "few"), (6, "many")),
    "churn": ((0, "still"), (1, "some"), (3, "often"), (10, "constant")),
    "tangle": ((0.0, "plain"), (0.05, "mild"), (0.4, "knotty"), (0.75, "tangled")),
    "age": ((0, "day"), (1, "week"), (7, "month"), (30, "quarter"), (90, "older")),
}


def lens_band(lens: str, value: Column) -> Column:
    """The bucket that a lens paints; null is unknown, and so is a value under the lowest band."""
    out = F.lit("unknown")
    for low, name in LENS_BANDS[lens]:
        out = F.when(value >= low, F.lit(name)).otherwise(out)
    return F.when(value.isNull(), "unknown").otherwise(out)
