"""Agreement of annotators, picks among texts, gates over numbered groups, and exports of labelled text."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tomelight.functions.batches import mapped
from tomelight.functions.columns import half_up
from tomelight.functions.titles import ascii_edges

# Texts that say nothing, and the words that English is told by.
PLACEHOLDERS = (r"(?i)^no\s+image\s+available?$", r"(?i)^cover[-\s]?not[-\s]?found", r"(?i)^tba$", r"(?i)^(unknown|n/a|none)$", r"(?i)^description\s+not\s+available$", r"(?i)^see\s+(also|wiki(pedia)?)", r"(?i)^this\s+(page|article)\s+is\s+a\s+stub")
ENGLISH = r"(?i)\b(the|a|an|and|of|to|in|is|for|on|with|by|that|this)\b"
SHORTEST, IDEAL, RICHEST = 80, 800, 1.5
LEVELS = {"excellent": 0.8, "good": 0.67, "fair": 0.4}
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("label", T.StringType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("label", pa.string())]))


def alpha(annotations: DataFrame) -> DataFrame:
    """annotations (unit, annotator, label) to one row: units, observed, expected, alpha, level.

    Pairs of labels of a unit are counted without listing them: a label that n annotators gave makes n (n - 1) / 2 equal
    pairs, and two labels make the product of their numbers, each way. Without a pair, alpha is 1.
    """
    counts = annotations.where("label is not null").groupBy("unit", "label").agg(F.count("*").alias("n"))
    total = Window.partitionBy("unit")
    counts = counts.withColumn("other", F.sum("n").over(total) - F.col("n"))
    cells = counts.groupBy("label").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum(F.col("n") * F.col("other")).alias("cross"))
    sums = cells.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(a) for a, c in (("all", F.col("same") + F.col("cross")), ("cross", F.col("cross")), ("squares", (F.col("same") + F.col("cross")) * (F.col("same") + F.col("cross"))))))
    units = annotations.agg(F.count_distinct("unit").alias("units"))
    observed, pairs = F.try_divide("cross", "all"), F.col("all") * F.col("all") - F.col("squares")
    expected = F.when(F.col("all") > 1, pairs / (F.col("all") * (F.col("all") - 1))).otherwise(pairs)
    value = F.when((F.col("all") > 0) & (expected > 0), 1 - observed / expected).otherwise(1.0)
    level = F.lit("poor")
    for name, least in reversed(LEVELS.items()):
        level = F.when(value >= least, name).otherwise(level)
    return units.crossJoin(sums).select("units", F.round(F.coalesce(observed, F.lit(0.0)), 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(value, 6).alias("alpha"), level.alias("level"))


def text_richness(x: Column) -> Column:
    """Up to 1.5 for a long text with English words."""
    letters = F.regexp_count(x, F.lit("[a-zA-Z]"))
    english = F.when(letters / F.length(x) < 0.4, 0.0).otherwise(F.least(F.lit(1.0), F.regexp_count(x, F.lit(ascii_edges(ENGLISH))) / 10))
    return F.least(F.lit(RICHEST), 0.6 + 0.6 * F.least(F.lit(1.0), F.length(x) / IDEAL) + 0.3 * english)


def pick_text(claims: DataFrame, weight: Column) -> DataFrame:
    """claims (entity, position, text) to entity, position, score, confidence: the text with the greatest weight times richness, then the first.

    Placeholders and texts of fewer than SHORTEST characters are no candidates."""
    x = F.trim("text")
    bad = F.lit(False)
    for p in PLACEHOLDERS:
        bad = bad | x.rlike(p)
    rows = claims.where(~bad & (F.length(x) >= SHORTEST)).select("entity", "position", F.round(weight * text_richness(x), 6).alias("score"))
    best = rows.groupBy("entity").agg(F.max_by(F.struct("position", "score"), F.struct("score", -F.col("position"))).alias("b"))
    return best.select("entity", "b.*", F.round(F.least(F.lit(1.0), F.col("b.score") / RICHEST), 6).alias("confidence"))


def drift_guard(votes: DataFrame, most: float) -> DataFrame:
    """votes (entity, value, anchor) with refused: the value is off the anchor's by more than `most` of it; without an anchor it stands."""
    return votes.withColumn("refused", F.coalesce(F.abs(F.col("value") - F.col("anchor")) / F.greatest(F.abs("anchor"), F.lit(1.0)) > most, F.lit(False)))


def partition_gate(members: DataFrame, fewest: int = 3, sizes: tuple[int, int] = (2, 30)) -> DataFrame:
    """members (entity, part, number) to entity, reason: why numbered parts are no partition; the first reason wins, null if they are one.

    few: fewer parts than `fewest`; twice: a number in two parts, or twice in one; order: a part's first whole number lies
    before that of the part before it; median: the lower median of the parts' sizes is out of bounds."""
    whole = F.min(F.when(F.col("number") == F.floor("number"), F.col("number")))
    parts = members.groupBy("entity", "part").agg(F.count("*").alias("size"), F.count_distinct("number").alias("own"), whole.alias("start"))
    numbers = members.groupBy("entity", "number").agg(F.count("*").alias("n")).groupBy("entity").agg(F.max("n").alias("times"))
    before = F.max("start").over(Window.partitionBy("entity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    every = parts.withColumn("back", F.coalesce(F.col("start") < before, F.lit(False))).groupBy("entity")
    every = every.agg(F.count("*").alias("parts"), F.max("back").alias("back"), F.sort_array(F.collect_list("size")).alias("sizes")).join(numbers, "entity")
    median = F.get("sizes", F.floor(F.size("sizes") / 2).cast("int"))
    reason = F.when(F.col("parts") < fewest, "few").when(F.col("times") > 1, "twice").when(F.col("back"), "order").when(~median.between(*sizes), "median")
    return every.select("entity", reason.alias("reason"))


def small_gaps(numbers: DataFrame, most: int = 5) -> DataFrame:
    """numbers (entity, number) to entity, filled: whole numbers missing between others, at most `most` before the next one."""
    rows = numbers.select("entity", F.floor("number").cast("int").alias("n")).distinct()
    after = F.lead("n").over(Window.partitionBy("entity").orderBy("n"))
    rows = rows.withColumn("after", after).where("after > n + 1")
    return rows.select("entity", F.explode(F.sequence(F.greatest(F.col("n") + 1, F.col("after") - most), F.col("after") - 1)).alias("filled"))


def rounded_median(values: Column) -> Column:
    """Of an array of numbers, the middle one, or the mean of the two with halves up; 0 for an empty array."""
    v, n = F.sort_array(values), F.size(values)
    at = lambda k: F.get(v, k.cast("int"))
    return F.when(n == 0, 0.0).when(n % 2 == 1, at(F.floor(n / 2)).cast("double")).otherwise(half_up((at(n / 2 - 1) + at(n / 2)) / 2).cast("double"))


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """A Markdown text with YAML front matter; null fields are left out, double quotes and backslashes in values escaped."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), quoted(c.cast("string")))) for k, c in fields.items()))
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), body)


@F.arrow_udf(SPANS)
def placed_spans(text: pa.Array, entities: pa.Array) -> pa.Array:
    """Spans by start: each entity (array of struct(text, label)) in turn at its first place that no earlier one touches.

    A place that touches a span is left for the first one at or after the span's end, as every place between touches it too;
    a term that comes again is looked for behind its last place. So a text is read about once for each of its distinct terms,
    however often they come. Ends are exclusive and count code points. Blank and missing entities, and those without a free
    place, are left out."""

    def place(x, row) -> list[dict]:
        spans, since = [], {}
        for e in () if x is None or row is None else row:
            term = e["text"] if e else None
            if not term:
                continue
            at = x.find(term, since.get(term, 0))
            while at >= 0:
                k = bisect_left(spans, (at, -1))
                touched = max([spans[j][1] for j in (k - 1, k) if 0 <= j < len(spans) and at < spans[j][1] and at + len(term) > spans[j][0]], default=None)
                if touched is None:
                    spans.insert(k, (at, at + len(term), term, e["label"]))
                    at += len(term)
                    break
                at = x.find(term, touched)
            since[term] = at if at >= 0 else len(x) + 1
        return [dict(zip(("start", "end", "term", "label"), s)) for s in spans]

    return mapped(place, _SPANS, text, entities)


def first_spans(text: Column, terms: Column) -> Column:
    """array<struct(start, end, term)>: for each term of an array in turn, its first place that no earlier span touches, by start."""
    spans = placed_spans(text, F.transform(terms, lambda x: F.struct(x.alias("text"), F.lit("").alias("label"))))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["term"].alias("term")))
