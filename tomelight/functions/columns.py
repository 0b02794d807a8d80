"""Column builders: strings, ranges, JSON and scores as built-in expressions."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, lower-cased and trimmed; 1 for two empty strings, 0 for one."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def ngrams(x: Column, n: int) -> Column:
    """The n-character substrings of x in order; empty for shorter strings."""
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda k: F.substring(x, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Jaccard similarity of the sets of n-grams of lower-cased strings; 1 if both are empty."""
    x, y = (F.array_distinct(ngrams(F.lower(v), n)) for v in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def bigram_bag(x: Column) -> Column:
    """The bigrams of x as an array of different longs: 21 bits for each sign, then which of its kind in x it is. Null for null.

    So a multiset is a set, and two of them are compared by array_intersect. Exact for texts of less than two million signs.
    """
    sign = lambda g, k: F.ascii(F.substring(g, k, F.lit(1))).cast("long")
    packed = F.array_sort(F.transform(ngrams(x, 2), lambda g: F.shiftleft(F.shiftleft(sign(g, F.lit(1)), 21) + sign(g, F.lit(2)), 21)))
    counted = F.transform(F.array(packed), lambda v: F.transform(v, lambda g, k: g + k.cast("long") + 1 - F.array_position(v, g)))  # v is read once
    return F.when(x.isNotNull(), F.get(counted, F.lit(0)))


def bag_dice(x: Column, y: Column) -> Column:
    """Dice coefficient of two arrays without repeats; 0 if one is empty."""
    return F.when((F.size(x) < 1) | (F.size(y) < 1), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of bigram multisets; 0 if a string has fewer than two characters, even for equal ones."""
    return bag_dice(bigram_bag(a), bigram_bag(b))


def half_up(x: Column) -> Column:
    """The nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def truncated(x: Column, limit: int, suffix: str = "...") -> Column:
    """x, or its start with the suffix inside the limit."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - len(suffix)), F.lit(suffix))).otherwise(x)


def slug(x: Column) -> Column:
    """Lower-case words joined by hyphens, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9\s-]", ""), r"\s+", "-"), r"-+", "-")


def comparable_url(x: Column) -> Column:
    """A URL without query, fragment and trailing slash, https, lower case; other strings trimmed and lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[?#].*$", ""), r"^http://", "https://")
    rootless = F.regexp_replace(bare, r"^(https://[^/]+/.+?)/+$", "$1")
    return F.when(F.lower(F.trim(x)).rlike(r"^https?://"), rootless).otherwise(F.lower(F.trim(x)))


def backoff_seconds(base: float, attempt: Column, cap: int = 6) -> Column:
    """base * 2^(attempt - 1), the exponent capped."""
    return F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(cap)))


def agreement_confidence(agreement: Column, witnesses: Column) -> Column:
    """Agreement weighted by the number of independent witnesses: 0.6 for one, 0.85 for two, 1 for more."""
    return agreement * F.when(witnesses <= 1, 0.6).when(witnesses == 2, 0.85).otherwise(1.0)


def java_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether Java, whose patterns rlike takes, can read a pattern."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def pattern_or_text(spark: SparkSession, x: Column, pattern: str) -> Column:
    """Whether a pattern is found in x in any case; one that Java cannot read is looked for as text."""
    if java_pattern(spark, pattern):
        return x.rlike(f"(?i){pattern}")
    return F.contains(F.lower(x), F.lit(pattern.lower()))


def first_block(spark: SparkSession, x: Column, titles: list[str], patterns: list[str]) -> Column:
    """For short lists. 'title' if x is one of the titles in any case, else the first pattern found in it in lower case; null if none is. Invalid patterns are skipped."""
    low = F.lower(x)
    return F.coalesce(F.when(low.isin(*(t.lower() for t in titles)), "title"), *(F.when(low.rlike(p), F.lit(p)) for p in patterns if java_pattern(spark, p)))


def term_ratio(x: Column, terms: list[str]) -> Column:
    """The share of the terms that x contains in any case."""
    return sum((F.contains(F.lower(x), F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) / len(terms)


def safe_url(x: Column) -> Column:
    """Whether a URL is http or https with a host; script, data and file schemes and // are not."""
    return F.lower(F.trim(x)).rlike(r"^https?://[^/]")


def first_best(scores: dict[str, Column], least: int, otherwise: str) -> Column:
    """The first name, in the order given, whose score is the greatest; `otherwise` if that is below `least`."""
    most = F.greatest(*scores.values())
    first = F.coalesce(*(F.when(s == most, F.lit(name)) for name, s in scores.items()))
    return F.when(most < least, otherwise).otherwise(first)
