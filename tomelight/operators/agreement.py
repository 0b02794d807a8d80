"""Agreement of annotators on each type of entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tomelight.operators.curation import LEVELS


def agreement_level(alpha: Column) -> Column:
    """excellent, good, fair or poor."""
    level = F.lit("poor")
    for name, least in reversed(LEVELS.items()):
        level = F.when(alpha >= least, name).otherwise(level)
    return level


def alpha_by_type(annotations: DataFrame, first) -> DataFrame:
    """annotations (unit, annotator, label as BIO tag) to a row for each type: entity, n, observed, expected, alpha, level.

    For a type, every tag of another type counts as O. n is the number of tags of that type that the annotator `first` gave.
    Null labels are no answer; a type without a pair of answers has an alpha of 1. A unit counts once for each type only where
    someone used that type: the pairs of O and O of the other units are the pairs of all units less those of these.
    """
    label = F.col("label")
    own = F.coalesce(F.col("annotator") == first, F.lit(False)).cast("long")
    counts = annotations.where(label.isNotNull()).groupBy("unit", "label").agg(F.count("*").alias("n"), F.sum(own).alias("own"))
    return alpha_of_answers(counts.groupBy("unit").agg(F.collect_list(F.struct("label", "n", "own")).alias("answers")))


def alpha_of_answers(units: DataFrame) -> DataFrame:
    """As alpha_by_type, of a row for each unit: answers, an array of struct(label, n: how often it was given, own: how often by `first`).

    Units with the same answers are counted first, so that all else grows with the different answers only."""
    label = F.col("label")
    kind = F.when(label != "O", F.regexp_extract(label, "^[^-]*-([^-]+)", 1)).otherwise("")
    given = F.sort_array(F.filter("answers", lambda x: x["label"].isNotNull() & (x["n"] > 0)))
    patterns = units.groupBy("answers").agg(F.count("*").alias("times")).groupBy(given.alias("unit")).agg(F.sum("times").alias("times"))
    counts = patterns.select("unit", "times", F.explode("unit").alias("a")).groupBy("unit", "times", F.col("a.label").alias("label")).agg(F.sum("a.n").alias("n"), F.sum("a.own").alias("own")).withColumn("entity", kind)
    unit = Window.partitionBy("unit")
    counts = counts.withColumns({"all": F.sum("n").over(unit), "row": F.row_number().over(unit.orderBy("label"))})
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    every = counts.where("row = 1").agg(F.coalesce(F.sum(pairs("all") * F.col("times")), F.lit(0.0)).alias("every"))
    typed = counts.where("entity <> ''").withColumn("used", F.sum("n").over(Window.partitionBy("unit", "entity")))
    typed = typed.withColumns({"rest": F.col("all") - F.col("used"), "one": F.row_number().over(Window.partitionBy("unit", "entity").orderBy("label")) == 1})
    once = lambda x: F.sum(F.when(F.col("one"), x * F.col("times")).otherwise(0.0))
    cells = typed.groupBy("entity", "label").agg(
        F.sum(F.col("own") * F.col("times")).alias("own"), F.sum(pairs("n") * F.col("times")).alias("same"), F.sum(F.col("n") * (F.col("all") - F.col("n")) * F.col("times")).cast("double").alias("cross"),
        once(pairs("rest") - pairs("all")).alias("rest_same"), once(F.col("rest") * F.col("used")).alias("rest_cross"),
    )
    margin = F.col("same") + F.col("cross")
    sums = cells.groupBy("entity").agg(F.sum("own").alias("n"), F.sum(margin).alias("margin"), F.sum(margin * margin).alias("squares"), F.sum("cross").alias("cross"), F.sum("rest_same").alias("rs"), F.sum("rest_cross").alias("rc"))
    rest = F.col("every") + F.col("rs") + F.col("rc")
    sums = sums.crossJoin(F.broadcast(every)).select("entity", "n", (F.col("margin") + rest).alias("t"), (F.col("squares") + rest * rest).alias("s"), (F.col("cross") + F.col("rc")).alias("x"))
    observed = F.coalesce(F.try_divide("x", "t"), F.lit(0.0))
    other = F.col("t") * F.col("t") - F.col("s")
    expected = F.when(F.col("t") > 1, other / (F.col("t") * (F.col("t") - 1))).otherwise(other)
    alpha = F.when((F.col("t") > 0) & (expected > 0), 1 - observed / expected).otherwise(1.0)
    return sums.select("entity", "n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(alpha, 6).alias("alpha"), agreement_level(alpha).alias("level"))
