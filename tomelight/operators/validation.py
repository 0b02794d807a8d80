"""Repair of numbered ranges, merges of spans by priority, and picks by weighted votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Tolerance over an expected count, the widest gap between ranges and the same in medians, penalties.
MARGIN, GAP, GAP_MEDIANS, LEAST = 1.1, 15, 4, 0.1


def _lowered(c: Column, by: float) -> Column:
    return F.greatest(F.lit(LEAST), c - by)


def validated_ranges(ranges: DataFrame, expected: str, trusted: bool = False) -> DataFrame:
    """ranges (entity, number, first, last, confidence and the column `expected`) to those that are kept, repaired.

    In order of number, each against the last one kept. Dropped: ranges that begin beyond the expected count (with a
    margin of a tenth unless trusted), that hold more than three medians of numbers (of more than three ranges), or
    that begin after a gap of more than GAP or GAP_MEDIANS medians. A gap of one is closed, of more than three costs
    confidence; an overlap is cut off at the front, or drops the range. Range 1 that begins after 3 costs confidence.
    An entity's ranges meet in one row; an entity with one range is returned as it is.
    """
    row = F.struct(F.col("number").cast("long").alias("number"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("confidence").cast("double").alias("confidence"))
    rows = ranges.groupBy("entity").agg(F.sort_array(F.collect_list(row)).alias("xs"), F.max(expected).cast("double").alias("most"))
    counts = F.sort_array(F.transform("xs", lambda x: x["last"] - x["first"] + 1))
    rows = rows.select("entity", "xs", (F.col("most") * (1.0 if trusted else MARGIN)).alias("most"), F.get(counts, F.floor(F.size("xs") / 2).cast("int")).alias("median"))
    kind = "array<struct<number:bigint,first:bigint,last:bigint,confidence:double>>"
    same = lambda x, first, confidence: F.struct(x["number"].alias("number"), first.alias("first"), x["last"].alias("last"), confidence.alias("confidence"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)["last"]
        gap = x["first"] - last - 1
        far = (F.coalesce(x["first"] > F.col("most"), F.lit(False)) & (F.col("most") > 0)) | ((x["last"] - x["first"] + 1 > F.col("median") * 3) & (F.size("xs") > 3))
        lone = same(x, x["first"], F.when((x["number"] == 1) & (x["first"] > 3), _lowered(x["confidence"], 0.2)).otherwise(x["confidence"]))
        overlap = gap < -1
        first = F.when((gap == 1) | overlap, last + 1).otherwise(x["first"])
        lower = F.when(gap > 3, _lowered(x["confidence"], 0.2)).when(overlap, _lowered(x["confidence"], 0.15)).otherwise(x["confidence"])
        out = (gap > F.greatest(F.lit(GAP), F.col("median") * GAP_MEDIANS)) | (overlap & (last + 1 > x["last"]))
        after = F.when(out, kept).otherwise(F.array_append(kept, same(x, first, lower)))
        return F.when(far, kept).when(F.size(kept) == 0, F.array_append(kept, lone)).otherwise(after)

    kept = F.when(F.size("xs") <= 1, F.col("xs")).otherwise(F.aggregate("xs", F.array().cast(kind), step))
    return rows.select("entity", F.explode(kept).alias("r")).select("entity", "r.number", "r.first", "r.last", F.round("r.confidence", 6).alias("confidence"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """spans (doc, priority, start, end, kind; both ends inside) to those that hold: a span is dropped if a token of it is
    claimed by one of a lower priority number, or of the same that begins before it (then the shorter, then by kind).

    A document's spans meet in one row."""
    row = F.struct("priority", "start", "end", "kind")
    rows = spans.groupBy("doc").agg(F.sort_array(F.collect_list(row)).alias("xs"))
    empty = F.array().cast(rows.schema["xs"].dataType)
    take = lambda kept, x: F.when(F.exists(kept, lambda k: (x["start"] <= k["end"]) & (x["end"] >= k["start"])), kept).otherwise(F.array_append(kept, x))
    return rows.select("doc", F.explode(F.aggregate("xs", empty, take)).alias("s")).select("doc", "s.*")


def schedule_consensus(claims: DataFrame, least: float, fewest: int = 2) -> DataFrame:
    """claims (entity, pattern, weekday, due, confidence) to entity, pattern, confidence, weekday, due.

    The pattern with the greatest sum of confidences of `least` or more (then the first by name), if `fewest` claims have
    it; its confidence is their mean. The weekday has the greatest sum of all claims; due is the earliest."""
    strong = claims.where((F.col("confidence") >= least) & F.col("pattern").isNotNull()).groupBy("entity", "pattern").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("w"))
    first = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("w"), "pattern"))
    best = strong.withColumn("rn", first).where(F.col("rn") == 1).where(F.col("n") >= fewest)
    days = claims.groupBy("entity", "weekday").agg(F.round(F.sum("confidence"), 6).alias("w")).groupBy("entity").agg(F.max_by("weekday", F.struct("w", -F.col("weekday"))).alias("weekday"))
    dues = claims.groupBy("entity").agg(F.min("due").alias("due"))
    return best.select("entity", "pattern", F.round(F.col("w") / F.col("n"), 6).alias("confidence")).join(days, "entity").join(dues, "entity")


def votes_scale(votes: Column) -> Column:
    """Weight of a rating by its number of votes: 0.7 without any, else up to 1.5 on a log scale."""
    return F.when(F.coalesce(votes, F.lit(0)) <= 0, 0.7).otherwise(F.least(F.lit(1.5), 0.6 + 0.1 * F.log10(votes)))


def pick_rating(claims: DataFrame, weight: Column) -> DataFrame:
    """claims (entity, provider, rating, votes) to entity, provider, rating, confidence: the greatest weight times votes_scale, then the first provider."""
    rows = claims.where("rating is not null").withColumn("w", F.round(weight * votes_scale(F.col("votes")), 9))
    best = rows.groupBy("entity").agg(F.min(F.struct(-F.col("w"), "provider", "rating")).alias("b"), F.sum("w").alias("all"), F.max("w").alias("w"))
    return best.select("entity", F.col("b.provider").alias("provider"), F.col("b.rating").alias("rating"), F.round(F.col("w") / F.col("all"), 6).alias("confidence"))
